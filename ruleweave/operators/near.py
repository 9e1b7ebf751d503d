"""Near misses of programs over relations: rules that lack one or two premises for a head that isn't concluded.

For each way to leave premises out, the others are joined as they stand: true atoms for positive premises, atoms known to be
false for negated ones. What is left out may hold variables that nothing binds. In the head they range over the case's
constants, as the head must not hold already; elsewhere the case's least constant stands for all, as no constant
brings the rule closer: those that would are found with fewer premises left out.

After each join only the variables that are still needed are kept, each combination once, so premises that share
no variable with the rest cost a row a case.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.relational import _leg, _text, _value
from ruleweave.plans.rules import Rule
from ruleweave.sources.tables import saved


def _strings(relation: DataFrame) -> DataFrame:
    args = [c for c in relation.columns if c[0] == "a" and c[1:].isdigit()]
    return relation.select("case_id", *(F.col(a).cast("string").alias(a) for a in args), "t")


def constants(relations: dict[str, DataFrame]) -> DataFrame:
    """case_id, c: what the facts of each case name."""
    parts = [r.select("case_id", F.explode(F.array(*(c for c in r.columns if c[0] == "a"))).alias("c")) for r in relations.values() if "a0" in r.columns]
    return saved(*(p.distinct() for p in parts)).distinct()


def _candidates(rule: Rule, left_out: tuple[int, ...], now: dict[str, DataFrame], named: DataFrame, least: DataFrame) -> DataFrame | None:
    """case_id, rule_id, head, missing, satisfied: bindings under which all other premises hold and the head isn't concluded."""
    missing = [rule.body[i] for i in left_out]
    kept = sorted((x for i, x in enumerate(rule.body) if i not in left_out), key=lambda x: x.negated)
    wanted = rule.head.variables().union(*(x.atom.variables() for x in missing))
    column: dict[str, str] = {}
    df = None
    for k, x in enumerate(kept):
        if x.atom.signature not in now:
            return None
        shared = [column[v] for v in sorted(x.atom.variables()) if v in column]
        for v in sorted(x.atom.variables()):
            column.setdefault(v, f"v{len(column)}")
        leg = _leg(now[x.atom.signature].where("t = 0" if x.negated else "t = 2"), x.atom, column, "__t").drop("__t")
        df = leg if df is None else df.join(leg.hint("merge"), ["case_id", *shared])
        later = wanted.union(*(y.atom.variables() for y in kept[k + 1 :]))
        for v in [v for v in column if v not in later]:
            df = df.drop(column.pop(v))
        df = df.distinct()
    for v in sorted(wanted - column.keys()):
        column[v] = f"v{len(column)}_"
        source = named if v in rule.head.variables() else least
        df = df.join(source.select("case_id", F.col("c").alias(column[v])).hint("merge"), "case_id")
    if rule.head.signature in now:
        keys = [f"h{i}" for i in range(len(rule.head.terms))]
        held = now[rule.head.signature].where("t = 2").select("case_id", *(F.col(f"a{i}").alias(k) for i, k in enumerate(keys)))
        df = df.withColumns({k: _value(t, column).cast("string") for k, t in zip(keys, rule.head.terms, strict=True)}).join(held.hint("merge"), ["case_id", *keys], "left_anti")
    texts = [F.concat(F.lit("not " if x.negated else ""), _text(x.atom, column)) for x in missing]
    return df.select("case_id", F.lit(rule.rule_id).alias("rule_id"), _text(rule.head, column).alias("head"), F.array(*texts).alias("missing"), F.lit(len(kept)).alias("satisfied"))


def near_misses(rules: list[Rule], relations: dict[str, DataFrame], derived: dict[str, DataFrame] | None = None, most_missing: int = 2) -> DataFrame:
    """case_id, rule_id, head, missing, satisfied, distance, question, rank: each rule's nearest binding in each case.

    relations are the recorded facts, derived all relations after evaluation. Of equally near bindings the one with the least head,
    then the least list of missing premises counts. A rule that would need none of its premises isn't near. rank is by
    distance, then by the number of satisfied premises, then by head and rule.
    """
    now = {s: saved(_strings(r)) for s, r in {**relations, **(derived or {})}.items()}
    named = saved(constants({s: _strings(r) for s, r in relations.items()}))
    least = saved(named.groupBy("case_id").agg(F.min("c").alias("c")))
    found: DataFrame | None = None
    for distance in range(1, most_missing + 1):
        parts = [_candidates(r, m, now, named, least) for r in rules for m in combinations(range(len(r.body)), distance) if distance < len(r.body)]
        parts = [p for p in parts if p is not None]
        if not parts:
            continue
        if found is not None:
            near = saved(found.select("case_id", "rule_id")).hint("merge")
            parts = [p.join(near, ["case_id", "rule_id"], "left_anti") for p in parts]
        nearest = lambda df, x: df.groupBy("case_id", "rule_id").agg(F.min(x).alias("x"))
        best = nearest(saved(*(nearest(p, F.struct("head", "missing", "satisfied")) for p in parts)), "x")  # each way's nearest first
        level = saved(best.select("case_id", "rule_id", "x.head", "x.missing", "x.satisfied", F.lit(distance).alias("distance")))
        found = level if found is None else found.unionByName(level)
    if found is None:
        raise ValueError("no rule has two premises")
    first = F.col("missing")[0]
    asked = F.when(first.startswith("not "), F.concat(F.lit("is it established that "), F.substring(first, 5, 1 << 20), F.lit(" does not hold?"))).otherwise(F.concat(F.lit("does "), first, F.lit(" hold?")))
    order = F.array_sort(F.collect_list(F.struct("distance", (-F.col("satisfied")).alias("s"), "head", "rule_id", "missing")))  # a row a rule
    ranked = found.groupBy("case_id").agg(order.alias("x")).select("case_id", F.posexplode("x").alias("at", "x"))
    plain = ranked.select("case_id", "x.rule_id", "x.head", "x.missing", (-F.col("x.s")).alias("satisfied"), "x.distance", (F.col("at") + 1).alias("rank"))
    return plain.withColumn("question", F.when(F.col("distance") == 1, asked))
