"""What is done with evaluated cases: facts in long form, commitment, near misses, replay of rule changes, sampling.

All of it is projections and aggregations over the cases; the rules are metadata and become columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.functions.truth import first_match, noisy_or_of
from ruleweave.operators.wide import THRESHOLD, Wide
from ruleweave.sources.tables import saved


def facts_long(df: DataFrame, key: str, observables: list[str]) -> DataFrame:
    """key, fact, t: one row for each observable of each case."""
    return df.select(key, *observables).unpivot(key, observables, "fact", "t")


def commit(outcomes: list[str], threshold: float = THRESHOLD, otherwise: str = "human") -> Column:
    """The first outcome whose column lower_<outcome> is above the threshold, else a person decides."""
    return first_match([(F.col(f"lower_{o}") > threshold, o) for o in outcomes], otherwise)


def near_misses(wide: Wide, df: DataFrame, key: str, most_missing: int = 2) -> DataFrame:
    """key, rule_id, head, satisfied, missing, open, place: rules that would conclude something new, with a premise that holds and few that don't.

    Rules whose head holds already are left out. open lists the premises that don't hold. place ranks a case's rules: few
    missing first, then many satisfied, then by head and rule.
    """
    df = wide.truth(df.select(key, *wide.columns()))
    entries = []
    for r in wide.rules:
        held = [F.coalesce(F.col(x.atom.predicate) == (0 if x.negated else 2), F.lit(False)) for x in r.body]
        lacks = F.array_compact(F.array(*(F.when(~h, F.lit(f"not {x.atom.predicate}" if x.negated else x.atom.predicate)) for h, x in zip(held, r.body, strict=True))))
        missing = F.size(lacks)
        entry = F.struct(missing.alias("missing"), (missing - len(held)).alias("order"), F.lit(r.head.predicate).alias("head"), F.lit(r.rule_id).alias("rule_id"), (F.lit(len(held)) - missing).alias("satisfied"), lacks.alias("open"))
        entries.append(F.when((F.col(r.head.predicate) != 2) & (missing >= 1) & (missing <= most_missing) & (missing < len(held)), entry))
    ranked = F.array_sort(F.array_compact(F.array(*entries)))
    return df.select(key, F.posexplode(ranked).alias("at", "x")).select(key, "x.rule_id", "x.head", "x.satisfied", "x.missing", "x.open", (F.col("at") + 1).alias("place"))


def replay(before: Wide, after: Wide, df: DataFrame, goal: str, recorded: Column, evidence: Column | None = None) -> DataFrame:
    """One row: what the changed rules do over the cases.

    recorded: the conclusion that was recorded of a case, null where none was. keeps: the goal held and holds; gains: it
    holds now, and no other conclusion is recorded; conflicts: it holds now against a recorded one; losses: it holds no
    more. evidence: cases to test against (all, or where the given condition holds).
    """
    base = before.truth(df, "b_")
    both = after.truth(base, "a_").select(
        (F.col(f"b_{goal}") == 2).alias("was"), (F.col(f"a_{goal}") == 2).alias("now"), F.coalesce(recorded != goal, F.lit(False)).alias("against"), (F.lit(True) if evidence is None else evidence).alias("counts")
    )
    was, now, against = F.col("was"), F.col("now"), F.col("against")
    return both.where("counts").agg(
        F.count("*").alias("evidence"),
        F.count_if(was & now).alias("keeps"),
        F.count_if(~was & now & ~against).alias("gains"),
        F.count_if(was & ~now).alias("losses"),
        F.count_if(~was & now & against).alias("conflicts"),
    )


def caution(replayed: DataFrame, dropped: int, narrowest: int) -> DataFrame:
    """replayed with reach (share of the narrowest source's premises that are dropped) and a caution for the reviewer."""
    reach = dropped / narrowest if narrowest else 0.0
    text = (
        F.when(F.col("conflicts") > 0, F.concat(F.lit("contradicts "), F.col("conflicts").cast("string"), F.lit(" recorded decisions")))
        .when(F.lit(reach >= 0.5), F.lit(f"drops {dropped} of {narrowest} premises: a wider claim"))
        .when(F.col("evidence") < 10, F.concat(F.lit("only "), F.col("evidence").cast("string"), F.lit(" cases to test against")))
        .otherwise("no conflict")
    )
    return replayed.withColumn("reach", F.lit(reach)).withColumn("caution", text)


def blocking_rules(wide: Wide, df: DataFrame, key: str, unapproved: list[str]) -> DataFrame:
    """key, rule_id: rules in force without approval that fire on the case."""
    fired = F.array(*(F.when(F.col(f"fired_{i}") == 2, F.lit(i)) for i in unapproved))
    return wide.truth(df.select(key, *wide.observables)).select(key, F.explode(F.array_compact(fired)).alias("rule_id"))


def head_probability(supports: DataFrame, keys: list[str], support: Column, name: str = "probability") -> DataFrame:
    """Noisy-OR over the supports of each head."""
    return supports.groupBy(*keys).agg(noisy_or_of(support).alias(name))


def running_total(df: DataFrame, group: str, order: str, value: Column, name: str = "total") -> DataFrame:
    """df with the sum of value over a group's rows up to each row; rows of one group spread over many tasks.

    Rows are dealt by ranges of group and order; sums of the ranges before are added to the sums inside a range. Ties in
    order count in any order.
    """
    dealt = saved(df.withColumn("__v", value).repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = dealt.groupBy(group, "__part").agg(F.sum("__v").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    inside = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("__in", F.sum("__v").over(inside))
    joined = summed.join(ranges.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__before"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.select(*df.columns, (F.col("__in") + F.col("__before")).alias(name))


def systematic_sample(df: DataFrame, group: str, order: str, percent: int) -> DataFrame:
    """Every row, with `sampled` on `percent` of each group, spread evenly along the order."""
    n = F.col("__n")
    return running_total(df, group, order, F.lit(1).cast("long"), "__n").withColumn("sampled", F.floor(n * percent / 100) > F.floor((n - 1) * percent / 100)).drop("__n")


def fnv1a(text: Column) -> Column:
    """FNV-1a (32 bits) over the code points of a string, as a long."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(16777619).cast("long") % F.lit(1 << 32).cast("long"))


def screening(checks: dict[str, Column], conflict: Column, missing: Column) -> Column:
    """Reason: conflict before missing evidence before mismatch before match; null checks are unknown."""
    mismatch = ~F.coalesce(first_match([(~c, False) for c in checks.values()], True), F.lit(True))
    unknown = first_match([(c.isNull(), True) for c in checks.values()], False)
    return first_match([(conflict, "conflict"), (missing | unknown, "missing"), (mismatch, "mismatch")], "match")


def screening_status(reason: Column, auto_reject: bool = True) -> Column:
    """rejected only for a mismatch, and only if rejection without a person is on; else review."""
    return F.when((reason == "mismatch") & F.lit(auto_reject), "rejected").otherwise("review")


def clamped(value: Column, low: float, high: float, otherwise: float) -> Column:
    """An estimate inside its scale; `otherwise` where there is none."""
    return F.least(F.greatest(F.coalesce(value, F.lit(otherwise)), F.lit(low)), F.lit(high))
