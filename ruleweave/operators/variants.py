"""Many changes of a rule base tried at once on recorded cases, without evaluating the rule base once for each.

A variant leaves rules out of a base program and adds others. The base is evaluated once. Facts of two cases never join, so
a variant can only differ where one of its changed rules has an instance over the base's result; and it does not differ
if every atom that a dropped rule supports keeps as good a support, and every atom that an added rule concludes is as true
already. The support that remains only counts for atoms that cannot support themselves.

The cases that are left are evaluated again, all variants in one plan: the variant becomes one more term of the predicates that
depend on a changed rule, and a changed rule has a premise that holds in the pairs of case and variant that have it. What
depends on no changed rule is read as it is, once for all variants.

With counted, where only counts of cases are asked for, one of the cases that are alike but for names stands for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.alike import Alike
from ruleweave.operators.relational import Program, _args
from ruleweave.plans.rules import Atom, Literal, Rule, Var, canonical_key, strata
from ruleweave.sources.tables import saved

_VARIANT = Var("V__")

@dataclass(frozen=True)
class Variant:
    """The base without the rules of these ids and with these rules added."""

    name: str
    drop: frozenset[str] = field(default_factory=frozenset)
    add: tuple[Rule, ...] = ()


def without_each(rules: Sequence[Rule]) -> list[Variant]:
    """A variant for each rule that leaves it out."""
    return [Variant(r.rule_id, frozenset({r.rule_id})) for r in rules]


def with_each(proposed: Sequence[Rule]) -> list[Variant]:
    """A variant for each proposed rule that adds it."""
    return [Variant(r.rule_id, frozenset(), (r,)) for r in proposed]


class Trial:
    """The base's result over all cases, and what variants make of the cases in which they can differ.

    base: all relations under the base program. touched: variant, case_id of the pairs evaluated again. changed: for each
    signature that differs anywhere, variant, case_id, a0, ..., before, after of every atom whose truth differs. All rules,
    dropped and added ones together, must be stratified, and a predicate that any of them concludes counts as concluded. A null case_id joins nothing, so its rows take no part. Without cases or
    without variants the results are empty. counted: effects, replay and screen count all cases, but base, touched and changed hold
    only the cases that stand for those alike.
    """

    def __init__(self, program: Program, relations: dict[str, DataFrame], variants: Sequence[Variant], counted: bool = False):
        ids = [r.rule_id for r in program.rules]
        if len(set(ids)) < len(ids) or len({v.name for v in variants}) < len(variants):
            raise ValueError("rules and variants need names of their own")
        self.alike = Alike([*program.rules, *(r for v in variants for r in v.add)], relations, cases=program._cases) if counted and relations else None
        if self.alike:
            relations = {s: self.alike.one(df) for s, df in relations.items()}
            program = Program(program.rules, program.askable, program.open_world, self.alike.kinds)
        self.relations = relations = {s: saved(df) for s, df in relations.items()}  # read many times below
        self.variants = list(variants)
        self.added: dict[str, Rule] = {}
        for v in variants:
            for r in v.add:
                self.added.setdefault(f"{canonical_key(r)}:{r.strength}", r)
        gone = set().union(*(v.drop for v in variants))
        if unknown := sorted(gone - set(ids)):
            raise ValueError(f"no such rules: {', '.join(unknown)}")
        self.dropped = {r.rule_id: r for r in program.rules if r.rule_id in gone}
        self.together = [*program.rules, *self.added.values()]
        strata(self.together)
        self.cases = saved(program.cases(relations))
        self.program = Program(program.rules, program.askable, program.open_world, self.cases)
        self.program.heads |= {r.head.signature for r in self.added.values()}
        self.base = {s: saved(df) if s in program.heads else df for s, df in self.program.evaluate(relations).items()}
        spark = self.cases.sparkSession
        self._of_variant = spark.createDataFrame(
            [(v.name, rule_id, "") for v in variants for rule_id in sorted(v.drop)] + [(v.name, "", f"{canonical_key(r)}:{r.strength}") for v in variants for r in v.add], "variant string, dropped string, added string"
        ).distinct()
        self.touched = saved(self._touched())
        self._again = self._evaluated()
        self._changes: dict[str, DataFrame | None] = {}

    @property
    def changed(self) -> dict[str, DataFrame]:
        return {s: self._change(s) for s in sorted(self._again)}

    def _recursive(self) -> set[str]:
        """Signatures that depend on themselves."""
        needs: dict[str, set[str]] = {}
        for r in self.program.rules:
            needs.setdefault(r.head.signature, set()).update(x.atom.signature for x in r.body)
        return {s for s in needs if s in _closure({s}, needs, first=False)}

    def _instances(self, rules: dict[str, Rule], signature: str) -> DataFrame:
        """case_id, a0, ..., rule, t: the best instance of each rule for each atom of a signature, saved rule by rule."""
        parts = [self.program._heads(r, self.base).withColumn("rule", F.lit(k)) for k, r in rules.items() if r.head.signature == signature]
        return saved(*(df.groupBy("case_id", *_args(df), "rule").agg(F.max("t").alias("t")) for df in parts))

    def _touched(self) -> DataFrame:
        """variant, case_id of the pairs in which a variant may differ from the base."""
        parts = [self.cases.select(F.lit("").alias("variant"), "case_id").where(F.lit(False))]
        changes = self._of_variant
        recursive = self._recursive()
        for s in sorted({r.head.signature for r in self.dropped.values()}):
            lost = self._instances({k: r for k, r in self.dropped.items() if r.head.signature == s}, s)
            pairs = lost.join(changes.select("variant", F.col("dropped").alias("rule")), "rule")
            if s in recursive:
                parts.append(pairs.select("variant", "case_id").distinct())
                continue
            atom = ["case_id", *_args(lost)]
            wanted = pairs.groupBy("variant", *atom).agg(F.max("t").alias("lost"))
            # a support that stays is another rule's, by a rule that the variant doesn't drop, or a recorded fact
            every = self._instances({r.rule_id: r for r in self.program.rules}, s).join(lost.select(atom).distinct().hint("merge"), atom, "left_semi")
            gone = changes.where("dropped <> ''").select("variant", F.col("dropped").alias("rule"))
            stays = wanted.select("variant", *atom).join(every, atom).join(gone, ["variant", "rule"], "left_anti").select("variant", *atom, "t")
            if s in self.relations:
                stays = stays.unionByName(wanted.select("variant", *atom).join(self.relations[s].select(*atom, "t"), atom))
            best = stays.groupBy("variant", *atom).agg(F.max("t").alias("kept"))
            parts.append(wanted.join(best, ["variant", *atom], "left").where("kept is null or kept < lost").select("variant", "case_id").distinct())
        for s in sorted({r.head.signature for r in self.added.values()}):
            made = self._instances(self.added, s)
            atom = ["case_id", *_args(made)]
            if s in self.base:
                made = made.join(self.base[s].select(*atom, F.col("t").alias("now")), atom, "left").where("now is null or now < t")
            parts.append(made.join(changes.select("variant", F.col("added").alias("rule")), "rule").select("variant", "case_id").distinct())
        return reduce(DataFrame.unionByName, parts).distinct()

    def _laid_out(self, df: DataFrame) -> DataFrame:
        """Rows of the touched cases, once for each variant."""
        return df.join(self.touched.hint("merge"), "case_id")

    def _evaluated(self) -> dict[str, tuple[DataFrame, int]]:
        """For each signature that hangs on a changed rule its relation over the pairs, and the truth of what it doesn't record."""
        readers: dict[str, set[str]] = {}
        for r in self.together:
            for x in r.body:
                readers.setdefault(x.atom.signature, set()).add(r.head.signature)
        affected = _closure({r.head.signature for r in [*self.dropped.values(), *self.added.values()]}, readers)
        moved = lambda a: Atom(f"{a.predicate}__v", (_VARIANT, *a.terms)) if a.signature in affected else a
        rules, given, read = [], {}, set(affected)
        every = Atom("__touched", (_VARIANT,))
        given[every.signature] = self.touched.select("case_id", F.col("variant").alias("a0"), F.lit(2).alias("t"))
        for key, rule, has in [(r.rule_id, r, "base") for r in self.program.rules] + [(k, r, "added") for k, r in self.added.items()]:
            if rule.head.signature not in affected:
                continue
            read |= {x.atom.signature for x in rule.body}
            body = [Literal(moved(x.atom), x.negated) for x in rule.body]
            if has == "base" and key not in self.dropped:
                rules.append(Rule(moved(rule.head), (Literal(every), *body), rule.strength, rule.rule_id))
                continue
            guard = Atom(f"__has_{len(given)}", (_VARIANT,))
            on = self._of_variant.where(F.col("dropped" if has == "base" else "added") == key).select("variant").distinct()
            held = self.touched.join(on, "variant", "left_anti" if has == "base" else "left_semi")
            given[guard.signature] = held.select("case_id", F.col("variant").alias("a0"), F.lit(2).alias("t"))
            rules.append(Rule(moved(rule.head), (Literal(guard), *body), rule.strength, rule.rule_id))
        if not rules:
            return {}
        for s in sorted(read):
            if s not in affected and s in self.base:
                given[s] = self.base[s].select("case_id", *_args(self.base[s]), "t")
            elif s in affected and s in self.relations:
                r = self._laid_out(self.relations[s])
                given[_moved(s)] = r.select("case_id", F.col("variant").alias("a0"), *(F.col(a).alias(f"a{i + 1}") for i, a in enumerate(_args(self.relations[s]))), "t")
        name = lambda s: _moved(s) if s in affected else s
        again = Program(rules, {name(s) for s in self.program.askable}, self.program.open_world, self.cases)
        again.heads = {name(s) for s in self.program.heads}
        found = again.evaluate(given)
        return {s: (_back(found[_moved(s)]), again.absent(_moved(s))) for s in affected if _moved(s) in found}

    def _change(self, signature: str) -> DataFrame | None:
        """What of `changed` concerns one signature, worked out when it is first asked for; None where nothing can differ."""
        if signature in self._again and signature not in self._changes:
            found, default = self._again[signature]
            atom = ["variant", "case_id", *_args(found)]
            after = found.select(*atom, F.col("t").alias("after"))
            if signature in self.base:
                before = self._laid_out(self.base[signature].select(*atom[1:], F.col("t").alias("before")))
                both = after.join(before.hint("merge"), atom, "left").unionByName(before.join(after.hint("merge"), atom, "left_anti").withColumn("after", F.lit(None).cast("int")))
            else:
                both = after.withColumn("before", F.lit(None).cast("int"))
            both = both.withColumns({k: F.coalesce(k, F.lit(default)) for k in ("before", "after")}).where("before <> after")
            self._changes[signature] = saved(both.select(*atom, "before", "after"))
        return self._changes.get(signature)

    # -- what follows from it ------------------------------------------------------------------------------

    def _counted(self, df: DataFrame) -> DataFrame:
        """With a column of how many cases each row's case stands for."""
        return df.join(self.alike.kinds.select("case_id", "cases"), "case_id") if self.alike else df.withColumn("cases", F.lit(1).cast("long"))

    def _against(self, recorded: DataFrame, name: str) -> DataFrame:
        """case_id, against: of how many cases that each stands for the recorded conclusions hold, and none of them is the predicate."""
        found = recorded.where("conclusion is not null").groupBy("case_id").agg((~F.max(F.col("conclusion") == name)).alias("against")).where("against")
        if not self.alike:
            return found.select("case_id", F.lit(1).cast("long").alias("against"))
        of_key = self.alike.each.select("key", F.col("member").alias("case_id")).join(found, "case_id").groupBy("key").agg(F.count("*").alias("against"))
        return self.alike.kinds.select("key", "case_id").join(of_key, "key").select("case_id", "against")

    def effects(self, outcomes: Sequence[str]) -> DataFrame:
        """variant, touched, differs, wins, losses: cases evaluated again, those in which an atom of the outcomes differs, and those in which one comes to hold or holds no more.

        A variant that leaves out one rule and differs in no case is the proof that the recorded cases do without that rule.
        """
        names = self.touched.sparkSession.createDataFrame([(v.name,) for v in self.variants], "variant string")
        touched = self._counted(self.touched).groupBy("variant").agg(F.sum("cases").alias("touched"))
        parts = [self._change(s).select("variant", "case_id", (F.col("after") == 2).alias("won"), (F.col("before") == 2).alias("lost")) for s in outcomes if s in self._again]
        none = self.touched.select("variant", "case_id", F.lit(True).alias("won"), F.lit(True).alias("lost")).where(F.lit(False))
        by_case = reduce(DataFrame.unionByName, parts, none).groupBy("variant", "case_id").agg(F.max("won").alias("won"), F.max("lost").alias("lost"))
        of = lambda c: F.sum(F.when(F.col(c), F.col("cases")).otherwise(0))
        counts = self._counted(by_case).groupBy("variant").agg(F.sum("cases").alias("differs"), of("won").alias("wins"), of("lost").alias("losses"))
        return names.join(touched, "variant", "left").join(counts, "variant", "left").na.fill(0)

    def replay(self, goal: str, recorded: DataFrame | None = None) -> DataFrame:
        """variant, evidence, keeps, gains, losses, conflicts of each variant over the cases.

        A case is for the goal where some atom of it is true. keeps: it was and is; losses: it was and is no more; gains: it is now and
        was not; conflicts: the same where recorded (case_id, conclusion: a predicate) has conclusions of the case, none of them the goal's predicate.
        """
        true = self.base[goal].where("t = 2").select("case_id").distinct() if goal in self.base else self.cases.where(F.lit(False))
        names = self.touched.sparkSession.createDataFrame([(v.name,) for v in self.variants], "variant string")
        total = lambda df, name: self._counted(df).agg(F.coalesce(F.sum("cases"), F.lit(0)).alias(name))
        totals = total(self.cases, "evidence").join(total(true, "was"))  # one row each
        if goal in self._again:
            moved = self._change(goal).select("variant", "case_id").distinct()
            stay = moved.join(self.base[goal].where("t = 2"), "case_id") if goal in self.base else None
            delta = self._change(goal)
            atom = ["variant", "case_id", *_args(delta)]
            kept = [delta.where("after = 2").select("variant", "case_id")]
            if stay is not None:
                kept.append(stay.select(atom).join(delta.select(atom), atom, "left_anti").select("variant", "case_id"))
            now = reduce(DataFrame.unionByName, kept).distinct().withColumn("now", F.lit(True))
            by_case = moved.join(true.withColumn("was", F.lit(True)), "case_id", "left").join(now, ["variant", "case_id"], "left").na.fill(False)
            by_case = self._counted(by_case)
            other = F.lit(0)
            if recorded is not None:
                by_case = by_case.join(self._against(recorded, goal.split("/")[0]), "case_id", "left")
                other = F.coalesce("against", F.lit(0))
            of = lambda where, n: F.sum(F.when(where, n).otherwise(0))
            gained = F.col("now") & ~F.col("was")
            counts = by_case.groupBy("variant").agg(of(gained, F.col("cases") - other).alias("gains"), of(F.col("was") & ~F.col("now"), F.col("cases")).alias("losses"), of(gained, other).alias("conflicts"))
        else:
            counts = names.select("variant", *(F.lit(0).cast("long").alias(c) for c in ("gains", "losses", "conflicts")))
        found = names.join(counts, "variant", "left").na.fill(0).join(totals)
        return found.select("variant", "evidence", (F.col("was") - F.col("losses")).alias("keeps"), "gains", "losses", "conflicts")

    def screen(self, outcomes: Sequence[str]) -> DataFrame:
        """variant, differs, contradictions, verdict of variants that add rules, judged by the recorded cases.

        contradictions are cases that come to have true atoms of two outcomes and had not. Where an outcome's atoms have arguments
        it counts if any of them is true.
        """
        held = [self._outcome(s) for s in outcomes]
        both = reduce(DataFrame.unionByName, held).groupBy("variant", "case_id").agg(F.count_if("was").alias("was"), F.count_if("now").alias("now"))
        torn = self._counted(both.where("now > 1 and was <= 1")).groupBy("variant").agg(F.sum("cases").alias("contradictions"))
        found = self.effects(outcomes).join(torn, "variant", "left").na.fill(0)
        verdict = F.when(F.col("contradictions") > 0, "two outcomes in a case").when(F.col("touched") == 0, "changes nothing").when(F.col("differs") == 0, "changes no outcome").otherwise("admitted")
        return found.select("variant", "differs", "contradictions", verdict.alias("verdict"))

    def _outcome(self, signature: str) -> DataFrame:
        """variant, case_id, was, now: the touched pairs in which some atom of an outcome is or was true."""
        none = self.touched.select("variant", "case_id", F.lit(False).alias("was"), F.lit(False).alias("now")).where(F.lit(False))
        if signature not in self.base and signature not in self._again:
            return none
        parts = [none]
        if signature in self.base:
            atoms = self.touched.join(self.base[signature].where("t = 2"), "case_id")
            keys = ["variant", "case_id", *_args(atoms)]
            stays = atoms.select(keys)
            if signature in self._again:
                stays = stays.join(self._change(signature).select(keys), keys, "left_anti")
            parts.append(atoms.select("variant", "case_id", F.lit(True).alias("was"), F.lit(False).alias("now")))
            parts.append(stays.select("variant", "case_id", F.lit(False).alias("was"), F.lit(True).alias("now")))
        if signature in self._again:
            parts.append(self._change(signature).where("after = 2").select("variant", "case_id", F.lit(False).alias("was"), F.lit(True).alias("now")))
        return reduce(DataFrame.unionByName, parts).groupBy("variant", "case_id").agg(F.max("was").alias("was"), F.max("now").alias("now"))


def _moved(signature: str) -> str:
    name, n = signature.split("/")
    return f"{name}__v/{int(n) + 1}"


def _back(relation: DataFrame) -> DataFrame:
    """A relation with the variant as its first term, with a column for it."""
    return relation.select(F.col("a0").alias("variant"), "case_id", *(F.col(f"a{i + 1}").alias(f"a{i}") for i in range(len(_args(relation)) - 1)), "t")


def _closure(start: set[str], after: dict[str, set[str]], first: bool = True) -> set[str]:
    """What is reached from start along after, with start itself or only where it is reached again."""
    found = set(start) if first else set()
    todo = list(start)
    while todo:
        for s in after.get(todo.pop(), ()):
            if s not in found:
                found.add(s)
                todo.append(s)
    return found
