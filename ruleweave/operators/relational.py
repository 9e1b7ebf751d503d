"""Programs over relations: rule bodies as joins within a case, recursion as delta iteration.

A relation is a DataFrame case_id, a0, a1, ..., t, where t is 0 (false), 1 (unknown) or 2 (true). Facts of two cases never
join. An atom that no row records is unknown if its predicate is askable and else false. As long as a literal's variables
aren't all bound it only ranges over recorded atoms, in the order in which the body is written; once they are bound, an
unrecorded askable atom counts as unknown.

With open_world, only true atoms match positive literals, unknown ones don't block, and an unrecorded atom in a negated
literal is unknown unless some rule concludes its predicate.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.functions.truth import noisy_or_of
from ruleweave.plans.rules import Atom, Literal, Rule, Var, strata
from ruleweave.sources.tables import case_parts, saved


#: Scans of the given relations that the plan of a derived one may hold; beyond it, one with several readers is written once.
MOST_SCANS = 16
#: Values in a list of those that share a term, and facts of a value beyond which its lists are met in several parts.
LIST, OFTEN = 512, 20_000
#: What tells instances of rules apart.
_INSTANCE = ["case_id", "head", "rule_id", "premises"]


class Program:
    """Rules with what is needed to read their bodies: askable predicates, all cases and the reading of unknowns.

    large_cases: a case may hold most of the facts, so that pairs over a shared term travel as lists.
    """

    def __init__(self, rules: list[Rule], askable: set[str] = frozenset(), open_world: bool = False, cases: DataFrame | None = None, large_cases: bool = False):
        self.rules, self.askable, self.open_world, self._cases, self.large_cases = rules, frozenset(askable), open_world, cases, large_cases
        self.heads = {r.head.signature for r in rules}
        self.scans: dict[str, int] = {}
        self.recorded: set[str] | None = None  # heads with recorded atoms, once evaluated
        self.readers = Counter(x.atom.signature for r in rules for x in r.body)

    def cases(self, relations: dict[str, DataFrame]) -> DataFrame:
        """case_id of all cases: those given, or those with a row in any relation."""
        if self._cases is not None:
            return self._cases.select("case_id").distinct()
        if not relations:
            raise ValueError("a program without relations needs its cases")
        return reduce(DataFrame.unionByName, (r.select("case_id") for r in relations.values())).distinct()

    def absent(self, signature: str) -> int:
        """Truth of an atom that isn't recorded."""
        if self.open_world:
            return 0 if signature in self.heads else 1
        return 1 if signature in self.askable else 0

    # -- one rule ----------------------------------------------------------------------------------------

    def bindings(self, rule: Rule, relations: dict[str, DataFrame], carried: set[str] = frozenset(), least: int = 1) -> tuple[DataFrame, dict[str, str]]:
        """Instances of at least that truth: case_id, a column for each variable, t, and t of premise i as __i; and the variables' columns.

        p of a positive premise i comes along as __pi where its signature is carried.
        """
        column: dict[str, str] = {}
        premises = [x for x in rule.body if not x.negated] + [x for x in rule.body if x.negated]
        df = None
        for i, x in enumerate(premises):
            names = sorted(x.atom.variables())
            bound = all(v in column for v in names)
            default = self.absent(x.atom.signature)
            outer = x.negated or (bound and default > 0 and not self.open_world)
            relation = relations.get(x.atom.signature)
            if df is None and (outer or bound):
                df = self.cases(relations)
            if relation is None:
                if not outer:  # nothing to range over
                    df = df if df is not None else self.cases(relations)
                    for v in names:
                        column.setdefault(v, f"v{len(column)}")
                    made = {c: F.lit(None).cast("string") for c in column.values() if c not in df.columns}
                    df = df.withColumns(made | {f"__{i}": F.lit(0)}).where(F.lit(False))
                    continue
                df = df.withColumn(f"__{i}", F.lit(default))
            else:
                if not outer:
                    relation = relation.where("t = 2" if self.open_world or least == 2 else "t > 0")
                elif default == 0:
                    relation = relation.where("t > 0")  # a false atom does what an unrecorded one does
                keys = ["case_id", *(column[v] for v in names if v in column)]
                for v in names:
                    column.setdefault(v, f"v{len(column)}")
                more = {f"__p{i}": "p"} if x.atom.signature in carried and not x.negated else {}
                leg = _leg(relation, x.atom, column, f"__{i}", more=more)
                df = leg if df is None else df.join(leg.hint("merge"), keys, "left" if outer else "inner")
                if outer:
                    df = df.withColumn(f"__{i}", F.coalesce(f"__{i}", F.lit(default)))
            if x.negated:
                df = df.withColumn(f"__{i}", 2 - F.col(f"__{i}"))
        t = reduce(F.least, (F.col(f"__{i}") for i in range(len(premises)))) if len(premises) > 1 else F.col("__0")
        return df.withColumn("t", t.cast("int")).where(F.col("t") >= least), column

    def _heads(self, rule: Rule, relations: dict[str, DataFrame]) -> DataFrame:
        found, column = self.bindings(rule, relations)
        return found.select("case_id", *(_value(t, column).alias(f"a{i}") for i, t in enumerate(rule.head.terms)), "t")

    def _paired(self, rule: Rule, relations: dict[str, DataFrame]) -> DataFrame | None:
        """The heads of h(A, B) <- p(A, P), q(B, P), each once; None for rules of another form.

        The values of B under a P come to each A as lists, which are laid out only there: as rows of their own the pairs would
        travel once for every P, and a set of all pairs would be held.
        """
        sides = [x.atom.variables() for x in rule.body]
        if len(sides) != 2 or any(x.negated or x.atom.signature not in relations for x in rule.body):
            return None
        head, shared = list(rule.head.terms), sorted(sides[0] & sides[1])
        only = [sides[0] - sides[1], sides[1] - sides[0]]
        if not shared or len(head) != 2 or not all(isinstance(x, Var) for x in head) or sorted(map(len, only)) != [1, 1] or {x.name for x in head} != only[0] | only[1]:
            return None
        keys = ["case_id", *(f"k{i}" for i in range(len(shared)))]
        legs = []  # dealt without the case, which groups and joins would leave out if it is a constant, and deal the rows again
        for x, v in zip(rule.body, "ab", strict=True):
            column = {name: f"k{shared.index(name)}" if name in shared else v for name in x.atom.variables()}
            leg = _leg(relations[x.atom.signature].where("t = 2" if self.open_world else "t > 0"), x.atom, column, f"t{v}")
            legs.append(leg.repartition(*keys[1:]).groupBy(*keys, v).agg(F.max(f"t{v}").alias(f"t{v}")))
        place = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("b")) - 1) / LIST)
        lists = legs[1].withColumn("place", place).groupBy(*keys, "place", "tb").agg(F.collect_list("b").alias("list"))
        joined = legs[0].join(lists.hint("merge"), keys).select("case_id", "a", F.least("ta", "tb").alias("t"), "list")
        often = legs[0].groupBy("case_id", "a").count().where(F.col("count") > OFTEN).select("case_id", "a", F.ceil(F.col("count") / OFTEN).cast("int").alias("parts"))  # one in OFTEN facts at most
        dealt = joined.join(F.broadcast(often), ["case_id", "a"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        mine = F.when(F.col("parts").isNull(), F.col("list")).otherwise(F.filter("list", lambda b: F.pmod(F.xxhash64(b), F.col("parts")) == F.col("part")))
        dealt = dealt.select("case_id", "a", "part", "t", mine.alias("list")).where(F.size("list") > 0).repartition("a", "part")
        found = dealt.groupBy("case_id", "a", "part").agg(*(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("t") == t, F.col("list"))))).alias(f"at{t}") for t in (1, 2)))
        for_t = lambda values, t: F.transform(values, lambda b: F.struct(b.alias("b"), F.lit(t).alias("t")))
        pairs = found.select("case_id", "a", F.explode(F.concat(for_t("at2", 2), for_t(F.array_except("at1", "at2"), 1))).alias("x"))
        names = ["a0", "a1"] if head[0].name in only[0] else ["a1", "a0"]
        return pairs.select("case_id", F.col("a").alias(names[0]), F.col("x.b").alias(names[1]), F.col("x.t").alias("t")).select("case_id", "a0", "a1", "t")

    def supports(self, relations: dict[str, DataFrame]) -> DataFrame:
        """case_id, head, rule_id, strength, t, premises of every instance over evaluated relations, each once.

        t is 2 for supports and 1 for blocked instances. premises are structs of atom, negated and t, positive ones first.
        """
        parts = self._supports_by_rule(relations)
        all_ = reduce(DataFrame.unionByName, parts)
        return all_ if len({r.rule_id for r in self.rules}) == len(parts) else all_.dropDuplicates(_INSTANCE)

    def saved_supports(self, relations: dict[str, DataFrame], least: int = 1) -> DataFrame:
        """supports of at least that truth, saved rule by rule."""
        found = saved(*self._supports_by_rule(relations, least))
        return found if len({r.rule_id for r in self.rules}) == len(self.rules) else found.dropDuplicates(_INSTANCE)

    def _supports_by_rule(self, relations: dict[str, DataFrame], least: int = 1) -> list[DataFrame]:
        parts = []
        for rule in self.rules:
            found, column = self.bindings(rule, relations, least=least)
            body = [x for x in rule.body if not x.negated] + [x for x in rule.body if x.negated]
            premises = [
                F.struct(_text(x.atom, column).alias("atom"), F.lit(x.negated).alias("negated"), F.col(f"__{i}").cast("int").alias("t")) for i, x in enumerate(body)
            ]
            parts.append(found.select("case_id", _text(rule.head, column).alias("head"), F.lit(rule.rule_id).alias("rule_id"), F.lit(float(rule.strength)).alias("strength"), "t", F.array(*premises).alias("premises")).dropDuplicates(_INSTANCE))
        return parts

    # -- all rules -----------------------------------------------------------------------------------------

    def evaluate(self, relations: dict[str, DataFrame], most_rounds: int = 200) -> dict[str, DataFrame]:
        """All relations with the derived ones added to what is recorded of them; a stratum without recursion is one pass."""
        relations = dict(relations)
        self.recorded = self.heads & relations.keys()
        for stratum in strata(self.rules):
            todo = list(stratum)
            while todo:
                waiting = {r.head.signature for r in todo}
                ready = [s for s in sorted(waiting) if not any(x.atom.signature in waiting for r in todo if r.head.signature == s for x in r.body)]
                if ready:
                    for s in ready:
                        given = [relations[s].select("case_id", *(c for c in relations[s].columns if c[0] == "a"), "t")] if s in relations else []
                        own = [r for r in todo if r.head.signature == s]
                        paired = self._paired(own[0], relations) if self.large_cases and len(own) == 1 and not given else None
                        merged = paired if paired is not None else _merged(given + [self._heads(r, relations) for r in own])
                        relations[s] = self._shared(s, merged, self.scans, lambda x: self.scans.get(x, 1))
                    todo = [r for r in todo if r.head.signature not in ready]
                else:
                    relations |= self._fixpoint(todo, relations, most_rounds)
                    todo = []
        return relations

    def _shared(self, signature: str, df: DataFrame, scans: dict[str, int], of) -> DataFrame:
        """A derived relation, written where its plan is large and several premises read it: else each would hold the plan again."""
        scans[signature] = sum(of(x.atom.signature) for r in self.rules if r.head.signature == signature for x in r.body)
        if scans[signature] <= MOST_SCANS or self.readers[signature] < 2:
            return df
        scans[signature] = 1
        return saved(df)

    def _fixpoint(self, rules: list[Rule], relations: dict[str, DataFrame], most_rounds: int) -> dict[str, DataFrame]:
        """Semi-naive iteration: each round joins the last round's new or raised atoms with all others."""
        own = {r.head.signature for r in rules}
        known: dict[str, DataFrame] = {}
        for s in own:
            starts = [self._heads(r, relations) for r in rules if r.head.signature == s and not any(x.atom.signature in own for x in r.body)]
            starts += [relations[s]] if s in relations else []
            if starts:
                known[s] = saved(_merged(starts))
        outer = {k: v for k, v in relations.items() if k not in own}
        delta = dict(known)
        for _ in range(most_rounds):
            found: dict[str, list[DataFrame]] = {}
            for r in rules:
                for i, x in enumerate(r.body):
                    if x.atom.signature in delta and not x.negated:
                        marked = Literal(Atom(f"{x.atom.predicate}__delta", x.atom.terms))
                        changed = Rule(r.head, (*r.body[:i], marked, *r.body[i + 1 :]), r.strength, r.rule_id)
                        seen = outer | known | {marked.atom.signature: delta[x.atom.signature]}
                        found.setdefault(r.head.signature, []).append(self._heads(changed, seen))
            fresh = {}
            for s, parts in found.items():
                merged = _merged(parts)
                if s in known:
                    keys = [c for c in merged.columns if c != "t"]
                    merged = merged.join(known[s].withColumnRenamed("t", "__old"), keys, "left").where("__old is null or t > __old").drop("__old")
                fresh[s] = saved(merged)
            delta = {s: d for s, d in fresh.items() if not d.isEmpty()}
            if not delta:  # a head without any start stays empty
                return known | {s: _merged([self._heads(r, outer | known) for r in rules if r.head.signature == s]) for s in own - known.keys()}
            known |= {s: saved(_merged([known[s], d])) if s in known else d for s, d in delta.items()}
        raise RuntimeError(f"no fixpoint within {most_rounds} rounds")

    def probabilities(self, relations: dict[str, DataFrame], most_rounds: int = 50, tolerance: float = 1e-9) -> dict[str, DataFrame]:
        """case_id, a0, ..., p of every true atom of evaluated relations.

        A recorded fact has its column p, or 1; a derived atom is the noisy-OR over its supports of strength times the
        premises' probabilities. Recursive predicates start from 0 and are raised until nothing moves: exact where no
        atom supports itself, and the least solution where one does.
        """
        out: dict[str, DataFrame] = {}
        scans: dict[str, int] = {}
        finished: set[str] = set()
        for s, r in relations.items():
            if s not in self.heads:
                p = F.coalesce(F.col("p").cast("double"), F.lit(1.0)) if "p" in r.columns else F.lit(1.0)
                out[s] = r.where("t = 2").select("case_id", *_args(r), p.alias("p"))
        for stratum in strata(self.rules):
            todo = list(stratum)
            while todo:
                waiting = {r.head.signature for r in todo}
                ready = [s for s in sorted(waiting) if not any(x.atom.signature in waiting for r in todo if r.head.signature == s for x in r.body)]
                group = [r for r in todo if r.head.signature in ready] if ready else todo
                for k in range(1 if ready else most_rounds):
                    made = {s: self._probability([r for r in group if r.head.signature == s], relations, out, finished) for s in {r.head.signature for r in group}}
                    if not ready:
                        made = {s: saved(d) for s, d in made.items()}
                        if k and not any(self._moved(out[s], d, tolerance) for s, d in made.items()):
                            break
                    else:
                        made = {s: self._shared(s, d, scans, lambda x: self.scans.get(x, 1) + scans.get(x, 1)) for s, d in made.items()}
                    out |= made
                finished |= {r.head.signature for r in group}
                todo = [r for r in todo if r not in group]
        return out

    @staticmethod
    def _moved(old: DataFrame, new: DataFrame, tolerance: float) -> bool:
        keys = [c for c in new.columns if c != "p"]
        both = new.join(old.withColumnRenamed("p", "__p"), keys, "left")
        return not both.where(F.abs(F.col("p") - F.coalesce("__p", F.lit(0.0))) > tolerance).isEmpty()

    def _probability(self, rules: list[Rule], relations: dict[str, DataFrame], known: dict[str, DataFrame], finished: set[str]) -> DataFrame:
        parts = []
        for rule in rules:
            # A finished head's table of probabilities has its true atoms, so it stands for the head itself, which would hold the plan again.
            used, denied = ({x.atom.signature for x in rule.body if x.negated == side} for side in (False, True))
            carried = (used & finished & known.keys() & self.heads) - denied - (self.heads if self.recorded is None else self.recorded)
            found, column = self.bindings(rule, relations | {s: known[s].withColumn("t", F.lit(2)) for s in carried}, carried)
            df, p = found.where("t = 2"), F.lit(float(rule.strength))
            for i, x in enumerate(y for y in rule.body if not y.negated):
                if x.atom.signature in carried:
                    p = p * F.coalesce(f"__p{i}", F.lit(0.0))
                    continue
                if x.atom.signature in relations and x.atom.signature not in self.heads and "p" not in relations[x.atom.signature].columns:
                    continue  # recorded and true, so its probability is 1
                if x.atom.signature in known:
                    names = sorted(x.atom.variables())
                    df = df.join(_leg(known[x.atom.signature], x.atom, column, f"__p{i}", "p").hint("merge"), ["case_id", *(column[v] for v in names)], "left")
                    p = p * F.coalesce(f"__p{i}", F.lit(0.0))
                else:
                    p = F.lit(0.0)
            parts.append(df.select("case_id", *(_value(t, column).alias(f"a{i}") for i, t in enumerate(rule.head.terms)), p.alias("p")))
        all_ = reduce(DataFrame.unionByName, parts)
        return all_.groupBy(*(c for c in all_.columns if c != "p")).agg(noisy_or_of(F.col("p")).alias("p"))


def _args(relation: DataFrame) -> list[str]:
    return [c for c in relation.columns if c[0] == "a" and c[1:].isdigit()]


def _leg(relation: DataFrame, atom: Atom, column: dict[str, str], name: str, value: str = "t", more: dict[str, str] | None = None) -> DataFrame:
    """A relation under the columns of an atom's variables: constants and repeated variables become filters; more: other columns by new name."""
    seen: dict[str, str] = {}
    for i, t in enumerate(atom.terms):
        if not isinstance(t, Var):
            relation = relation.where(F.col(f"a{i}") == F.lit(t))
        elif t.name in seen:
            relation = relation.where(F.col(f"a{i}") == F.col(seen[t.name]))
        else:
            seen[t.name] = f"a{i}"
    return relation.select("case_id", *(F.col(a).alias(column[v]) for v, a in seen.items()), F.col(value).alias(name), *(F.col(c).alias(x) for x, c in (more or {}).items()))


def _value(term: object, column: dict[str, str]) -> Column:
    return F.col(column[term.name]) if isinstance(term, Var) else F.lit(term)


def _text(atom: Atom, column: dict[str, str]) -> Column:
    """A ground atom as text."""
    if not atom.terms:
        return F.lit(atom.predicate)
    return F.concat(F.lit(atom.predicate + "("), F.concat_ws(", ", *(_value(t, column).cast("string") for t in atom.terms)), F.lit(")"))


def atom_text(signature: str, columns: list[str]) -> Column:
    """The text of a relation's rows as ground atoms."""
    return _text(Atom(signature.split("/")[0], tuple(map(Var, columns))), {c: c for c in columns})


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Each atom once; parts of several rules are merged one by one first, and come together by their cases."""
    keys = [c for c in parts[0].columns if c != "t"]
    best = lambda df: df.groupBy(*keys).agg(F.max("t").alias("t"))
    if len(parts) == 1:
        return best(parts[0])
    return best(reduce(DataFrame.unionByName, map(best, parts)).repartition(case_parts(parts[0].sparkSession), "case_id"))


def evaluate(rules: list[Rule], relations: dict[str, DataFrame], askable: set[str] = frozenset(), most_rounds: int = 200, open_world: bool = False) -> dict[str, DataFrame]:
    """All relations with the derived ones added."""
    return Program(rules, askable, open_world).evaluate(relations, most_rounds)


def truth_of(program: Program, relations: dict[str, DataFrame], atom: Atom) -> DataFrame:
    """case_id, t of a ground atom in each case."""
    column: dict[str, str] = {}
    cases = program.cases(relations)
    if atom.signature not in relations:
        return cases.withColumn("t", F.lit(program.absent(atom.signature)))
    found = _leg(relations[atom.signature], atom, column, "t")
    return cases.join(found, "case_id", "left").select("case_id", F.coalesce("t", F.lit(program.absent(atom.signature))).alias("t"))


def unknowns_blocking(supports: DataFrame, goals: DataFrame, most_rounds: int = 50) -> DataFrame:
    """case_id, goal, unknown: the unknown atoms below each goal (case_id, goal) that no rule instance concludes.

    Walks the instances from a goal to their premises, round by round, until nothing new is reached.
    """
    edges = saved(supports.select("case_id", "head", F.explode("premises").alias("x")).select("case_id", "head", F.col("x.atom").alias("atom"), (F.col("x.t") == 1).alias("unknown")).groupBy("case_id", "head", "atom").agg(F.max("unknown").alias("unknown")))
    start = goals.select("case_id", "goal", F.col("goal").alias("atom")).distinct()
    reached = saved(start.withColumn("unknown", F.lit(False)))
    delta = reached
    for _ in range(most_rounds):
        step = delta.select("case_id", "goal", F.col("atom").alias("head")).join(edges, ["case_id", "head"]).groupBy("case_id", "goal", "atom").agg(F.max("unknown").alias("unknown"))
        delta = saved(step.join(reached.select("case_id", "goal", "atom"), ["case_id", "goal", "atom"], "left_anti"))
        if delta.isEmpty():
            concluded = supports.select("case_id", F.col("head").alias("atom")).distinct()
            return reached.where("unknown").join(concluded, ["case_id", "atom"], "left_anti").select("case_id", "goal", F.col("atom").alias("unknown"))
        reached = saved(reached.unionByName(delta))
    raise RuntimeError(f"not walked within {most_rounds} rounds")
