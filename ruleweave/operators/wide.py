"""Programs over one entity each, evaluated as columns: one row per entity, one truth column per predicate.

No operator here shuffles: a program is a chain of projections, whatever the number of cases. Bounds look at completions
of the unknowns, called worlds: an array of them is made in the row and the program runs over the array, head by head, so
the plan holds the program once, however many worlds or questions there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.truth import all_of, any_of, negate, noisy_or
from ruleweave.plans.rules import Rule, ordered_heads, polarities

MOST_MIXED = 14
THRESHOLD = 0.5
UNCOVERED = 0.2


def _name(signature: str) -> str:
    return signature.split("/")[0]


class Wide:
    """A non-recursive program of unary predicates, the columns that hold its observables, and those of their confidence."""

    def __init__(self, rules: list[Rule], observables: list[str], confidence: dict[str, str] | None = None):
        self.rules, self.observables, self.confidence = rules, observables, confidence or {}
        self.heads = [_name(s) for s in ordered_heads(rules)]
        if unknown := {x.atom.predicate for r in rules for x in r.body} - set(self.heads) - set(observables):
            raise ValueError(f"not declared: {', '.join(sorted(unknown))}")

    def columns(self) -> list[str]:
        """The columns that the program reads."""
        return [*self.observables, *dict.fromkeys(self.confidence.values())]

    def _body(self, rule: Rule, col) -> Column:
        return all_of(*(negate(col(x.atom.predicate)) if x.negated else col(x.atom.predicate) for x in rule.body))

    def _own(self, head: str) -> list[Rule]:
        return [r for r in self.rules if r.head.predicate == head]

    def _support(self, rule: Rule, fired: Column, p) -> Column:
        """Probability that a rule gives its head: strength times its positive premises' probabilities, if it fires."""
        out = F.lit(float(rule.strength))
        for x in rule.body:
            if not x.negated and (x.atom.predicate in self.heads or x.atom.predicate in self.confidence):
                out = out * p(x.atom.predicate)
        return F.when(fired == 2, out).otherwise(F.lit(0.0))

    def _confidence(self, observable: str) -> Column:
        return F.coalesce(F.col(self.confidence[observable]).cast("double"), F.lit(1.0))

    def truth(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Add a truth column for each head and fired_<rule id> for each rule; dependencies first."""
        col = lambda p: F.col(p if p in self.observables else prefix + p)
        for head in self.heads:
            own = self._own(head)
            df = df.withColumns({f"{prefix}fired_{r.rule_id}": self._body(r, col) for r in own})
            df = df.withColumn(prefix + head, any_of(*(F.col(f"{prefix}fired_{r.rule_id}") for r in own)))
        return df

    def probability(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        """truth() and a column p_<head> for each head: noisy-OR over the rules that fire; unknown premises support nothing."""
        df = self.truth(df)
        p = lambda x: F.col(prefix + x) if x in self.heads else self._confidence(x)
        for head in self.heads:
            df = df.withColumn(prefix + head, noisy_or(*(self._support(r, F.col(f"fired_{r.rule_id}"), p) for r in self._own(head))))
        return df

    # -- worlds ------------------------------------------------------------------------------------------

    def _mixed(self, goal: str) -> tuple[dict[str, set[int]], Column, list[Column]]:
        """Signs of the observables; how many of both signs are unknown in the row, and how many before each observable."""
        sign = {_name(s): v for s, v in polarities(self.rules, f"{goal}/1").items()}
        count, before = F.lit(0), []
        for o in self.observables:
            before.append(count)
            if len(sign.get(o, ())) == 2:
                count = count + F.when(F.col(o) == 1, 1).otherwise(0)
        return sign, count, before

    def _interval(self, goal: str, pinned: Column | None = None, value: Column | None = None) -> Column:
        """Struct lower, upper of P(goal) over the row's worlds; pinned: the number of an observable that has a value given.

        A world is numbered by bits: the lowest tells whether observables of one sign take the value that lowers or
        raises the goal, the others are the values of unknown observables of both signs, the first MOST_MIXED of them.
        """
        if goal not in self.heads:
            return F.struct(F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"))
        sign, _, _ = self._mixed(goal)

        def pins(world: Column) -> Column:
            out, before = [], F.lit(0)
            high = world % 2 * 2
            for k, o in enumerate(self.observables):
                own = sign.get(o, set())
                unknown = F.col(o) == 1
                if len(own) == 2:
                    bit = F.call_function("shiftright", world, before + 1) % 2 * 2
                    chosen = F.when(before < MOST_MIXED, bit).otherwise(0)
                    before = before + F.when(unknown if pinned is None else unknown & (pinned != k), 1).otherwise(0)
                else:
                    chosen = high if own == {1} else 2 - high if own == {-1} else F.lit(0)
                truth = F.when(unknown, chosen).otherwise(F.col(o))
                if pinned is not None:
                    truth = F.when(pinned == k, value).otherwise(truth)
                out.append(truth.cast("int").alias(f"t_{o}"))
            return F.struct(*out)

        bits = reduce(lambda a, b: a + b, [F.when((F.col(o) == 1) if pinned is None else (F.col(o) == 1) & (pinned != k), 1).otherwise(0) for k, o in enumerate(self.observables) if len(sign.get(o, ())) == 2], F.lit(0))
        most = F.call_function("shiftleft", F.lit(2), F.least(bits, F.lit(MOST_MIXED)).cast("int")) - 1
        worlds = F.transform(F.sequence(F.lit(0), most), pins)
        fields = [f"t_{o}" for o in self.observables]
        for head in self.heads:
            if head in sign:
                worlds = F.transform(worlds, self._step(head, tuple(fields)))
                fields += [f"t_{head}", f"p_{head}"]
        start = F.struct(F.lit(1.0).alias("lower"), F.lit(0.0).alias("upper"))
        return F.aggregate(worlds, start, lambda a, w: F.struct(F.least(a["lower"], w[f"p_{goal}"]).alias("lower"), F.greatest(a["upper"], w[f"p_{goal}"]).alias("upper")))

    def _step(self, head: str, fields: tuple[str, ...]):
        """A world with the truth and the probability of one more head."""
        own = self._own(head)

        def run(w: Column) -> Column:
            p = lambda x: w[f"p_{x}"] if x in self.heads else self._confidence(x)
            fired = [self._body(r, lambda x: w[f"t_{x}"]) for r in own]
            new = [any_of(*fired).alias(f"t_{head}"), noisy_or(*(self._support(r, f, p) for r, f in zip(own, fired, strict=True))).alias(f"p_{head}")]
            return F.struct(*(w[f].alias(f) for f in fields), *new)

        return run

    def bounds(self, df: DataFrame, goal: str, lower: str = "lower", upper: str = "upper", exact: str | None = None) -> DataFrame:
        """Add the least and greatest P(goal) over all completions of the unknowns.

        exact names a column that tells whether all completions were looked at: not where more than MOST_MIXED unknowns
        act on the goal both ways; those beyond stay false and the interval can be too narrow.
        """
        found = df.withColumn("__b", self._interval(goal)).withColumns({lower: F.col("__b.lower"), upper: F.col("__b.upper")}).drop("__b")
        return found.withColumn(exact, self._mixed(goal)[1] <= MOST_MIXED) if exact else found

    def questions(self, df: DataFrame, goal: str, key: str, limit: int = 5, epsilon: float = 1e-6) -> DataFrame:
        """key, question, decisive, gain, rank: which unknown is worth asking about, at most `limit` for each case."""
        df = df.select(key, *self.columns()).withColumn("__b", self._interval(goal))
        asked = F.array_compact(F.array(*(F.when(F.col(o) == 1, F.lit(k)) for k, o in enumerate(self.observables))))
        names = F.array(*map(F.lit, self.observables))

        def answered(k: Column) -> Column:
            return F.struct(F.get(names, k).alias("question"), self._interval(goal, k, F.lit(2)).alias("t"), self._interval(goal, k, F.lit(0)).alias("f"))

        def judged(q: Column) -> Column:
            crosses = lambda side: (q["t"][side] > THRESHOLD) != (q["f"][side] > THRESHOLD)
            width = lambda b: b["upper"] - b["lower"]
            gain = F.greatest(F.lit(0.0), width(F.col("__b")) - (width(q["t"]) + width(q["f"])) / 2)
            return F.struct((~(crosses("lower") | crosses("upper"))).alias("a"), (-F.round(gain, 9)).alias("b"), q["question"].alias("question"), (gain > epsilon).alias("worth"))

        ranked = F.array_sort(F.filter(F.transform(F.transform(asked, answered), judged), lambda q: ~q["a"] | q["worth"]))
        return df.select(key, F.posexplode(F.slice(ranked, 1, limit)).alias("rank", "q")).select(
            key, F.col("q.question").alias("question"), (~F.col("q.a")).alias("decisive"), (-F.col("q.b")).alias("gain"), (F.col("rank") + 1).alias("rank")
        )

    def counterfactuals(self, df: DataFrame, goal: str, key: str, limit: int | None = None) -> DataFrame:
        """key, fact: known facts whose single flip changes whether the goal holds; a limit keeps a case's first ones."""
        base = self.truth(df.select(key, *self.columns())).select(key, *self.observables, (F.col(goal) == 2).alias("__holds"))
        known = F.filter(F.array(*(F.when(F.col(o) != 1, F.lit(o)) for o in self.observables)), lambda x: x.isNotNull())
        each = base.select("*", F.explode(known).alias("fact"))
        flipped = each.withColumns({o: F.when(F.col("fact") == o, negate(F.col(o))).otherwise(F.col(o)) for o in self.observables})
        found = self.truth(flipped).where((F.col(goal) == 2) != F.col("__holds")).select(key, "fact")
        if limit is None:
            return found
        place = F.array_position(F.array(*map(F.lit, self.observables)), F.col("fact"))
        first = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(place.alias("at"), "fact"))), 1, limit).alias("x"))  # at most one for each observable
        return first.select(key, F.explode("x.fact").alias("fact"))

    def used_observables(self) -> list[str]:
        return [o for o in self.observables if any(x.atom.predicate == o for r in self.rules for x in r.body)]


def check(spark, wide: Wide, outcomes: list[str], most_inputs: int = 1 << 20, variants: int = 4) -> DataFrame:
    """For all assignments: rule_id, fired (on how many), dead, redundant (dropping it changes no outcome), contradictions.

    Inputs are the bits of a range of numbers, made and counted in place. A plan compares the program with `variants`
    programs of one rule less, so that a plan's size doesn't grow with the number of rules.
    """
    used = wide.used_observables()
    if 1 << len(used) > most_inputs:
        raise ValueError(f"2 ** {len(used)} inputs are more than {most_inputs}")
    zero = {o: F.lit(0) for o in wide.observables if o not in used}
    inputs = spark.range(1 << len(used)).select(*(((F.shiftright("id", i) % 2) * 2).cast("int").alias(o) for i, o in enumerate(used)))
    base = wide.truth(inputs.withColumns(zero) if zero else inputs)
    held = [o for o in outcomes if o in wide.heads or o in wide.observables]
    several = sum(((F.col(o) == 2).cast("int") for o in held), F.lit(0)) > 1
    fired = base.agg(F.count_if(several).alias("n"), *(F.count_if(F.col(f"fired_{r.rule_id}") == 2) for r in wide.rules)).first()
    same: dict[str, bool] = {}
    for start in range(0, len(wide.rules), variants):
        df, part = base, wide.rules[start : start + variants]
        for k, r in enumerate(part):
            rest, names = [x for x in wide.rules if x is not r], {}
            for o in wide.heads:  # as Wide.truth, but over columns of its own
                own = [x for x in rest if x.head.predicate == o]
                col = lambda p, names=names: names.get(p, F.col(p))
                df = df.withColumn(f"__v{k}_{o}", any_of(*(wide._body(x, col) for x in own)) if own else F.lit(0))
                names[o] = F.col(f"__v{k}_{o}")
        changed = [F.max(reduce(lambda a, b: a | b, ((F.col(o) == 2) != (F.col(f"__v{k}_{o}") == 2) for o in held if o in wide.heads), F.lit(False)).cast("int")) for k in range(len(part))]
        row = df.agg(*changed).first()
        same |= {r.rule_id: not row[k] for k, r in enumerate(part)}
    rows = [(r.rule_id, fired[i + 1], fired[i + 1] == 0, same[r.rule_id] and fired[i + 1] > 0, fired[0]) for i, r in enumerate(wide.rules)]
    return spark.createDataFrame(rows, "rule_id string, fired long, dead boolean, redundant boolean, contradictions long")


def check_cases(wide: Wide, found: DataFrame, cases: DataFrame, outcomes: list[str]) -> DataFrame:
    """The rows of `check` with the cases they concern: on how many a rule fires, may fire, and how many hold two outcomes.

    cases has the observables' truth columns. What the exhaustive check finds may lie where no case does, and a rule that could fire
    may never have; one pass over the cases tells.
    """
    truth = wide.truth(cases.select(*wide.columns()))
    held = [o for o in outcomes if o in wide.heads or o in wide.observables]
    several = F.count_if(sum(((F.col(o) == 2).cast("int") for o in held), F.lit(0)) > 1).alias("__both")
    counts = truth.agg(several, *(F.struct(F.count_if(F.col(f"fired_{r.rule_id}") == 2).alias("cases"), F.count_if(F.col(f"fired_{r.rule_id}") == 1).alias("open_cases")).alias(r.rule_id) for r in wide.rules))
    rows = F.inline(F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"`{r.rule_id}`.cases"), F.col(f"`{r.rule_id}`.open_cases"), F.col("__both").alias("contradictory_cases")) for r in wide.rules)))
    return found.join(counts.select(rows), "rule_id")
