"""Bounds, questions and counterfactuals of programs over relations, whatever the number of terms and with recursion.

A world fixes what a case leaves open. Worlds are numbered within a case, and the number becomes one more term of the
predicates that differ between worlds: a program over p(X) and q(X), where only p has open atoms, becomes one over
p(W, X) and q(X). One evaluation then covers all cases and all their worlds, by the same joins and the same recursion as
any other program, and what no open atom reaches is evaluated once a case and shared by its worlds.

Only open atoms that the goals rest on count: those met on the way down from the goals through rule instances that
aren't false. An instance that is false while atoms are unknown is false in every world, so no other can matter.

Unknown atoms that act on the goal one way only take the values that lower, then those that raise it; those that act both
ways are tried in all combinations, the first `MOST_MIXED` of a case, and the rest stay false, which `exact` tells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.operators.alike import MOST_FACTS, Alike, spelled, spelling
from ruleweave.operators.relational import Program, atom_text
from ruleweave.operators.wide import MOST_MIXED, THRESHOLD
from ruleweave.plans.rules import Atom, Literal, Rule, Var, polarities
from ruleweave.sources.tables import saved

_WORLD = Var("W__")
#: Worlds are numbered by their bits; the number of the atom that is turned over comes above them.
_TURNED = 1 << 32
#: Rounds of a walk whose atoms are kept apart before they are put into one table.
MOST_APART = 6


def cone(supports: DataFrame, starts: DataFrame, most_rounds: int = 200) -> DataFrame:
    """case_id, atom: the starts and all atoms below them in the rule instances, each once. supports are read in each round."""
    ways = supports.select("case_id", F.col("head").alias("atom"), F.col("premises.atom").alias("below")).hint("merge")
    reached = [saved(starts.select("case_id", "atom").distinct())]
    delta = reached[0]
    for _ in range(most_rounds):
        step = delta.join(ways, ["case_id", "atom"]).select("case_id", F.explode("below").alias("atom")).distinct()
        delta = saved(reduce(lambda df, r: df.join(r.hint("merge"), ["case_id", "atom"], "left_anti"), reached, step))
        if delta.isEmpty():
            return saved(*reached)
        reached = [*reached, delta] if len(reached) < MOST_APART else [saved(*reached, delta)]
    raise RuntimeError(f"not walked within {most_rounds} rounds")


class Worlds:
    """A program, its relations, and the ground goals of each case: case_id, a0, ... for one signature.

    Goals are asked together: an atom is open in a case if any of the case's goals rests on it.
    """

    def __init__(self, program: Program, relations: dict[str, DataFrame], goal: str, goals: DataFrame, most_mixed: int = MOST_MIXED):
        self.goal, self.most_mixed = goal, most_mixed
        self.sign = polarities(program.rules, goal)
        self.program = Program([r for r in program.rules if r.head.signature in self.sign], program.askable, program.open_world, program._cases)
        self.relations = {s: r for s, r in relations.items() if s in self.sign}
        self.args = [c for c in goals.columns if c[0] == "a" and c[1:].isdigit()]
        self.goals = saved(goals.select("case_id", *self.args).distinct())
        self.now = self.program.evaluate(self.relations)
        self.observed = [s for s in self.relations if s not in self.program.heads]

    def _below(self, least: int) -> DataFrame:
        """case_id, atom below the goals, through instances of at least that truth."""
        if not self.program.rules:
            return self.goals.select("case_id", atom_text(self.goal, self.args).alias("atom"))
        return cone(self.program.saved_supports(self.now, least), self.goals.select("case_id", atom_text(self.goal, self.args).alias("atom")))

    def _texts(self, signature: str, columns: list[str], where: str) -> DataFrame:
        """case_id, signature, atom, and those columns, of a relation's rows."""
        r = self.relations[signature]
        return r.where(where).select("case_id", F.lit(signature).alias("signature"), atom_text(signature, _args(r)).alias("atom"), *columns)

    def _evaluated(self, worlds: DataFrame, pins: DataFrame, truth: Column) -> tuple[dict[str, DataFrame], set[str], Program]:
        """The program over worlds (case_id, w); pins: case_id, signature, atom and what `truth` needs beside w."""
        open_ = {r.signature for r in pins.select("signature").distinct().collect()}  # at most the program's predicates
        differ = set(open_)
        while grown := {r.head.signature for r in self.program.rules if any(x.atom.signature in differ for x in r.body)} - differ:
            differ |= grown

        def moved(a: Atom) -> Atom:
            return Atom(f"{a.predicate}__w", (_WORLD, *a.terms)) if a.signature in differ else a

        rules = []
        for r in self.program.rules:
            body, first = [Literal(moved(x.atom), x.negated) for x in r.body], next((x for x in r.body if not x.negated), None)
            if r.head.signature in differ and not (first and first.atom.signature in differ and first.atom.variables()):
                body = [Literal(Atom("__world", (_WORLD,))), *body]  # else the first premise ranges over worlds
            rules.append(Rule(moved(r.head), tuple(body), r.strength, r.rule_id))
        name = lambda s: _moved(s) if s in differ else s
        relations = {s: r for s, r in self.relations.items() if s not in differ}
        relations["__world/1"] = worlds.select("case_id", F.col("w").alias("a0"), F.lit(2).alias("t"))
        of_case = worlds.select("case_id", "w")
        for s in differ & self.relations.keys():
            r, args = self.relations[s], _args(self.relations[s])
            more = ["p"] if "p" in r.columns else []
            columns = ["case_id", F.col("w").alias("a0"), *(F.col(a).alias(f"a{i + 1}") for i, a in enumerate(args)), "t", *more]
            if s in open_:
                pinned = pins.where(F.col("signature") == s).drop("signature")
                here = r.withColumn("atom", atom_text(s, args)).join(pinned.withColumn("__open", F.lit(True)), ["case_id", "atom"], "left").drop("atom")
                r = saved(here).join(of_case, "case_id")  # several premises read it, each with its worlds
                r = r.withColumn("t", F.when(F.col("__open"), truth).otherwise(F.when(F.col("t") == 1, 0).otherwise(F.col("t")) if self.closing else F.col("t")).cast("int"))
            else:
                r = r.join(of_case, "case_id")
            relations[_moved(s)] = r.select(*columns)
        program = Program(rules, {name(s) for s in self.program.askable}, self.program.open_world, self.program._cases)
        return relations, differ, program

    # -- completions -------------------------------------------------------------------------------------

    closing = True  # unknown atoms that no goal rests on are false, so that they are settled in every world

    def _open(self) -> DataFrame:
        """case_id, signature, atom, way, place: the unknown atoms, how they act, and their place in the case among those alike.

        way: 1 raises the goal, -1 lowers it, 0 is tried both ways, 2 would be but is beyond `most_mixed`.
        """
        parts = [self._texts(s, [], "t = 1") for s in self.observed if self.sign[s]]
        if not parts:
            return self.goals.where("false").select("case_id", F.lit("").alias("signature"), F.lit("").alias("atom"), F.lit(0).alias("way"), F.lit(0).alias("place"))
        found = reduce(DataFrame.unionByName, parts).distinct().join(self._below(1), ["case_id", "atom"], "left_semi")
        ways = F.create_map(*(F.lit(v) for s in self.observed for v in (s, 0 if len(self.sign[s]) == 2 else next(iter(self.sign[s])))))
        found = found.withColumn("way", ways[F.col("signature")])
        mixed = F.row_number().over(Window.partitionBy("case_id", F.col("way") == 0).orderBy("signature", "atom"))
        found = found.withColumn("place", mixed - 1)
        return found.withColumn("way", F.when((F.col("way") == 0) & (F.col("place") >= self.most_mixed), 2).otherwise(F.col("way")))

    @staticmethod
    def _value() -> Column:
        """Truth of an open atom (way, place, turn) in world w."""
        side, bits = F.col("w") % 2 * 2, F.call_function("shiftright", F.col("w") % _TURNED, F.col("place") + 1) % 2 * 2
        chosen = F.when(F.col("way") == 0, bits).when(F.col("way") == 1, side).when(F.col("way") == -1, 2 - side).otherwise(0)
        return F.when(F.col("turn") == F.floor(F.col("w") / _TURNED), 2 - chosen).otherwise(chosen)

    def _completions(self, turning: bool) -> tuple[DataFrame, DataFrame]:
        """open: the open atoms with turn, which numbers those that aren't tried both ways; worlds: case_id, w, n, exact."""
        turn = F.row_number().over(Window.partitionBy("case_id", F.col("way") == 0).orderBy("signature", "atom"))
        open_ = saved(self._open().withColumn("turn", F.when(F.col("way") == 0, F.lit(-1)).otherwise(turn)))
        counts = open_.groupBy("case_id").agg(F.count_if(F.col("way") == 0).cast("int").alias("mixed"), F.max(F.abs(F.col("way")) == 1).alias("sided"), F.max(F.col("way") == 2).alias("cut"), F.count_if(F.col("way") != 0).alias("turns"))
        cases = self.goals.select("case_id").distinct().join(counts, "case_id", "left").na.fill({"mixed": 0, "sided": False, "cut": False, "turns": 0})
        last = F.call_function("shiftleft", F.lit(2).cast("long"), F.col("mixed")) - 1
        step = F.when(F.col("sided"), F.lit(1).cast("long")).otherwise(F.lit(2).cast("long"))
        base = cases.withColumn("base", F.when(F.col("sided"), F.sequence(F.lit(0).cast("long"), last, step)).otherwise(F.sequence(F.lit(0).cast("long"), last - 1, step)))
        turned = F.sequence(F.lit(0).cast("long"), F.col("turns") if turning else F.lit(0).cast("long"))
        every = base.select("case_id", F.size("base").alias("n"), (~F.col("cut")).alias("exact"), "base", F.explode(turned).alias("turned"))
        every = every.select("case_id", "n", "exact", "turned", F.explode("base").alias("b"))
        return open_, every.select("case_id", "n", "exact", (F.col("b") + F.col("turned") * _TURNED).alias("w"))

    def _probability(self, turning: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """open, worlds, and case_id, a0, ..., w, p of the goals; w is null where the goal is the same in all worlds."""
        open_, worlds = self._completions(turning)
        worlds = saved(worlds)
        relations, differ, program = self._evaluated(worlds, open_.select("case_id", "signature", "atom", "way", "place", "turn"), self._value())
        found = program.probabilities(program.evaluate(relations))
        if self.goal in differ:
            p = found[_moved(self.goal)].select("case_id", F.col("a0").alias("w"), *(F.col(f"a{i + 1}").alias(f"a{i}") for i in range(len(self.args))), "p")
        elif self.goal in found:
            p = found[self.goal].select("case_id", F.lit(None).cast("long").alias("w"), *self.args, "p")
        else:
            p = self.goals.where("false").select("case_id", F.lit(None).cast("long").alias("w"), *self.args, F.lit(0.0).alias("p"))
        return open_, worlds, p.join(self.goals, ["case_id", *self.args], "left_semi")

    def _interval(self, p: DataFrame, worlds: DataFrame) -> DataFrame:
        """case_id, a0, ..., lower, upper, exact; a goal that isn't derived in a world has the probability 0 there."""
        keys = ["case_id", *self.args]
        base = p.where(F.coalesce(F.col("w"), F.lit(0)) < _TURNED).groupBy(*keys).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("held"), F.max(F.col("w").isNull()).alias("same"))
        known = worlds.groupBy("case_id").agg(F.first("n").alias("n"), F.first("exact").alias("exact"))
        joined = self.goals.join(known, "case_id").join(base, keys, "left")
        lower = F.when(F.col("same") | (F.col("held") == F.col("n")), F.col("low")).otherwise(F.lit(0.0))
        return joined.select(*keys, F.coalesce(lower, F.lit(0.0)).alias("lower"), F.coalesce("high", F.lit(0.0)).alias("upper"), "exact")

    def bounds(self) -> DataFrame:
        """case_id, a0, ..., lower, upper, exact: the least and greatest probability of each goal over all completions."""
        _, worlds, p = self._probability(turning=False)
        return self._interval(p, worlds)

    def bounds_and_questions(self, limit: int = 5) -> tuple[DataFrame, DataFrame]:
        """Both from one evaluation: the worlds of the questions hold those of the bounds."""
        open_, worlds, p = self._probability(turning=True)
        p = saved(p)
        return self._interval(p, worlds), self._questions(open_, worlds, p.where("w is not null"), limit)

    def questions(self, limit: int = 5, epsilon: float = 1e-6, threshold: float = THRESHOLD) -> DataFrame:
        """case_id, a0, ..., question, decisive, gain, rank, and the bounds of the goal if the answer is yes or no.

        Beside the worlds of the bounds, each open atom that isn't tried both ways is turned over in all of them.
        """
        open_, worlds, p = self._probability(turning=True)
        return self._questions(open_, worlds, saved(p.where("w is not null")), limit, epsilon, threshold)

    def _questions(self, open_: DataFrame, worlds: DataFrame, p: DataFrame, limit: int, epsilon: float = 1e-6, threshold: float = THRESHOLD) -> DataFrame:
        keys = ["case_id", *self.args]
        base = self._interval(p, worlds).select(*keys, (F.col("upper") - F.col("lower")).alias("width"))
        n = worlds.groupBy("case_id").agg(F.first("n").alias("n"))
        asked = open_.join(n, "case_id").select("case_id", F.col("atom").alias("question"), "way", "place", "turn", F.when(F.col("way") == 0, F.col("n") / 2).otherwise(F.col("n")).alias("worlds"))
        turned = F.floor(F.col("w") / _TURNED)
        seen = p.join(asked, "case_id").where((turned == 0) | (turned == F.col("turn"))).withColumn("v", self._value())
        sides = seen.groupBy(*keys, "question").agg(*(f(F.when(F.col("v") == v, F.col("p"))).alias(f"{name}_{v}") for v in (0, 2) for name, f in (("low", F.min), ("high", F.max), ("held", F.count))))
        each = self.goals.join(asked.select("case_id", "question", "worlds"), "case_id").join(sides, [*keys, "question"], "left").na.fill(0, ["held_0", "held_2"])
        for v, word in ((2, "true"), (0, "false")):
            each = each.withColumns({f"{word}_lower": F.when(F.col(f"held_{v}") < F.col("worlds"), 0.0).otherwise(F.col(f"low_{v}")), f"{word}_upper": F.coalesce(f"high_{v}", F.lit(0.0))})
        crosses = lambda side: (F.col(f"true_{side}") > threshold) != (F.col(f"false_{side}") > threshold)
        width = lambda word: F.col(f"{word}_upper") - F.col(f"{word}_lower")
        judged = each.join(base, keys).withColumn("decisive", crosses("lower") | crosses("upper")).withColumn("gain", F.greatest(F.lit(0.0), F.round(F.col("width") - (width("true") + width("false")) / 2, 9)))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(~F.col("decisive"), F.desc("gain"), "question"))  # a row for each open atom of a case
        ranked = judged.where(F.col("decisive") | (F.col("gain") > epsilon)).withColumn("rank", rank).where(F.col("rank") <= limit)
        return ranked.select(*keys, "question", "decisive", "gain", "rank", *(f"{word}_{side}" for word in ("true", "false") for side in ("lower", "upper")))

    # -- flips ---------------------------------------------------------------------------------------------

    def counterfactuals(self) -> DataFrame:
        """case_id, a0, ..., fact, was: the known facts whose single flip changes whether the goal holds.

        A world for each candidate: facts whose flip acts against a goal that holds, and those whose flip acts for one
        that doesn't. Where no premise denies a derived atom, a goal that holds can only fall by a fact it rests on.
        Unknown atoms stay unknown.
        """
        keys = ["case_id", *self.args]
        truth = self.now[self.goal].select(*keys, F.col("t").alias("now")) if self.goal in self.now else self.goals.where("false").select("*", F.lit(0).alias("now"))
        goals = saved(self.goals.join(truth, keys, "left").withColumn("holds", F.coalesce(F.col("now") == 2, F.lit(False))))
        known = [self._texts(s, [F.col("t").alias("was"), F.lit(1 in self.sign[s]).alias("up"), F.lit(-1 in self.sign[s]).alias("down")], "t <> 1") for s in self.observed]
        if not known:
            return goals.where("false").select(*keys, F.lit("").alias("fact"), F.lit(0).alias("was"))
        facts = reduce(DataFrame.unionByName, known).distinct()
        below = self._below(2).withColumn("held", F.lit(True))
        of_case = goals.groupBy("case_id").agg(F.max("holds").alias("some"), F.min("holds").alias("all"))
        raises, lowers = (F.when(F.col("was") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("up", "down"), ("down", "up")))
        deep = any(x.negated and x.atom.signature in self.program.heads for r in self.program.rules for x in r.body)
        rests = F.lit(True) if deep else F.coalesce("held", F.lit(False))
        chosen = facts.join(of_case, "case_id").join(below, ["case_id", "atom"], "left").where((F.col("some") & lowers & rests) | (~F.col("all") & raises))
        number = F.row_number().over(Window.partitionBy("case_id").orderBy("signature", "atom")).cast("long")
        pins = saved(chosen.select("case_id", "signature", "atom", "was", number.alias("turn")))
        worlds = saved(pins.select("case_id", F.col("turn").alias("w")))
        self.closing = False
        try:
            relations, differ, program = self._evaluated(worlds, pins, F.when(F.col("w") == F.col("turn"), 2 - F.col("was")).otherwise(F.col("was")))
        finally:
            self.closing = True
        if self.goal not in differ:
            return goals.where("false").select(*keys, F.lit("").alias("fact"), F.lit(0).alias("was"))
        found = program.evaluate(relations)[_moved(self.goal)].where("t = 2").select("case_id", F.col("a0").alias("turn"), *(F.col(f"a{i + 1}").alias(f"a{i}") for i in range(len(self.args))), F.lit(True).alias("then"))
        each = goals.join(pins, "case_id").join(found, ["case_id", "turn", *self.args], "left")
        return each.where(F.col("holds") != F.coalesce("then", F.lit(False))).select(*keys, F.col("atom").alias("fact"), "was")


def _moved(signature: str) -> str:
    name, n = signature.split("/")
    return f"{name}__w/{int(n) + 1}"


def _args(relation: DataFrame) -> list[str]:
    return [c for c in relation.columns if c[0] == "a" and c[1:].isdigit()]


def answers(program: Program, relations: dict[str, DataFrame], outcomes: list[str], goals: dict[str, DataFrame], limit: int = 5, uncovered: float = 0.2) -> DataFrame:
    """One row a case: case_id, outcomes, questions, assumptions, uncovered.

    outcomes: array of goal, lower, upper, exact of all goals of the case, by midpoint; questions: those of the first
    signature of `outcomes`; assumptions: what the numbers rest on; uncovered: no outcome reaches that probability.
    Cases that are alike but for names are judged once, and what they are told is put in the order of their own names.
    """
    alike = Alike(program.rules, relations, {s: goals[s] for s in outcomes}, program._cases, MOST_MIXED)
    relations = {s: saved(alike.one(r)) for s, r in relations.items()}
    program = Program(program.rules, program.askable, program.open_world, alike.one(program._cases) if program._cases is not None else None)
    names = saved(alike.names())
    found = [Worlds(program, relations, s, alike.one(goals[s])) for s in outcomes]
    first = found[0]
    bounds, questions = first.bounds_and_questions(max(limit, MOST_FACTS))  # in the order of the names of the one case
    named = lambda df, w: df.join(names, "case_id").withColumn("goal", spelling(w.goal, w.args, alike.sorts)).drop("names")
    intervals = reduce(DataFrame.unionByName, [named(b, w).select("case_id", F.struct((-(F.col("lower") + F.col("upper")) / 2).alias("order"), "goal", "lower", "upper", "exact").alias("x")) for w, b in zip(found, [bounds, *(w.bounds() for w in found[1:])], strict=True)])
    per_case = saved(intervals.groupBy("case_id").agg(F.collect_list("x").alias("x")))  # a case's goals
    atoms = [r.where("t = 1").join(names, "case_id").select("case_id", atom_text(s, _args(r)).alias("question"), spelling(s, _args(r), alike.sorts).alias("spelling")) for s, r in first.relations.items() if s in first.observed]
    if atoms:
        questions = questions.join(reduce(DataFrame.unionByName, atoms).dropDuplicates(["case_id", "question"]), ["case_id", "question"])
    else:
        questions = questions.withColumn("spelling", F.lit(None).cast("struct<predicate:string,terms:array<struct<text:string,at:bigint>>>"))
    of_goal = named(questions, first).groupBy("case_id", *first.args).agg(F.first("goal").alias("goal"), F.collect_list(F.struct("spelling", "decisive", "gain")).alias("each"))
    asked = of_goal.groupBy("case_id").agg(F.collect_list(F.struct("goal", "each")).alias("q"))
    settled = program.evaluate({s: r.withColumn("t", F.when(F.col("t") == 1, 0).otherwise(F.col("t"))) for s, r in relations.items()})
    several = program.supports(settled).where("t = 2").groupBy("case_id", "head").count().where("count > 1").groupBy("case_id").agg(F.count("*").alias("several"))
    heads = {r.head.signature for r in program.rules}
    open_ = [r.where("t = 1").select("case_id") for s, r in relations.items() if s not in heads]
    unknown = reduce(DataFrame.unionByName, open_).groupBy("case_id").agg(F.count("*").alias("unknown"))
    all_ = alike.all_of(saved(per_case.join(asked, "case_id", "left").join(several, "case_id", "left").join(unknown, "case_id", "left")))
    line = lambda count, text: F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.concat(F.col(count).cast("string"), F.lit(text)))
    assumed = F.array_compact(
        F.array(
            line("several", " conclusion(s) rest on several rules, taken as independent"),
            line("unknown", " fact(s) are unknown; bounds span all their values"),
            F.when(F.exists("x", lambda x: ~x["exact"]), F.lit("not all completions were tried")),
        )
    )
    ordered = F.array_sort(F.transform("x", lambda x: F.struct(x["order"].alias("order"), spelled(x["goal"]).alias("goal"), x["lower"].alias("lower"), x["upper"].alias("upper"), x["exact"].alias("exact"))))
    bare = F.transform(ordered, lambda x: F.struct(x["goal"].alias("goal"), x["lower"].alias("lower"), x["upper"].alias("upper"), x["exact"].alias("exact")))
    none = F.expr("array()").cast("array<struct<question:string,decisive:boolean,gain:double>>")
    by_worth = lambda g: F.slice(F.array_sort(F.transform(g["each"], lambda q: F.struct((~q["decisive"]).alias("tame"), (-q["gain"]).alias("order"), spelled(q["spelling"]).alias("question"), q["decisive"].alias("decisive"), q["gain"].alias("gain")))), 1, limit)
    ranked = F.array_sort(F.flatten(F.transform("q", lambda g: F.transform(by_worth(g), lambda q, i: F.struct(i.alias("rank"), spelled(g["goal"]).alias("goal"), q["question"].alias("question"), q["decisive"].alias("decisive"), q["gain"].alias("gain"))))))
    listed = F.coalesce(F.transform(ranked, lambda q: F.struct(q["question"].alias("question"), q["decisive"].alias("decisive"), q["gain"].alias("gain"))), none)
    return all_.select("case_id", bare.alias("outcomes"), listed.alias("questions"), assumed.alias("assumptions"), F.forall("x", lambda x: x["upper"] < uncovered).alias("uncovered"))
