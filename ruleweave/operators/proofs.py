"""Proofs of programs over relations: the instances a goal rests on, as a graph, as a tree of paths and as text.

The graph holds each instance once, however many proofs share it. The tree is spread out from the goals, a level of rules at a
time, with the path of atoms in each row: an atom that stands on its own path, or lies at the greatest depth, is named but not
taken apart again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.worlds import cone
from ruleweave.sources.tables import saved

MOST_DEPTH = 12


def instances(supports: DataFrame) -> DataFrame:
    """case_id, head, rule_id, strength, premises of the instances that hold."""
    return supports.where("t = 2").select("case_id", "head", "rule_id", "strength", "premises")


def proof_graph(supports: DataFrame, goals: DataFrame) -> DataFrame:
    """case_id, head, rule_id, premise, negated, derived: the premises of all instances below the goals (case_id, goal), each once.

    derived tells whether an instance concludes the premise. supports are read several times: give saved ones.
    """
    held = instances(supports)
    below = cone(held, goals.select("case_id", F.col("goal").alias("atom")))
    heads = held.select("case_id", F.col("head").alias("premise"), F.lit(True).alias("derived")).distinct()
    edges = held.join(below.withColumnRenamed("atom", "head"), ["case_id", "head"], "left_semi").select("case_id", "head", "rule_id", F.explode("premises").alias("x")).select("case_id", "head", "rule_id", F.col("x.atom").alias("premise"), F.col("x.negated").alias("negated")).distinct()
    return edges.join(heads, ["case_id", "premise"], "left").select("case_id", "head", "rule_id", "premise", "negated", F.coalesce("derived", F.lit(False)).alias("derived"))


def proof_tree(supports: DataFrame, goals: DataFrame, facts: DataFrame | dict[str, str] | None = None, most_depth: int = MOST_DEPTH) -> DataFrame:
    """case_id, goal, path, depth, kind, atom, rule_id, strength, source: the nodes of each goal's proof.

    path sorts the nodes as they are read: the number of each instance among those of its head, by rule and premises, then that of
    the premise. kind is derived, rule, fact, absent (a negated premise), shown (an atom on its own path, or too deep), or
    open for a goal that nothing concludes. facts, if given: case_id, atom, source of the recorded ones, or a predicate's source
    where all its facts have the same.
    """
    held = instances(supports)
    by_head = saved(held.groupBy("case_id", F.col("head").alias("atom")).agg(F.array_sort(F.collect_list(F.struct("rule_id", "premises", "strength"))).alias("ways")))
    sources = facts.select("case_id", "atom", "source").dropDuplicates(["case_id", "atom"]) if isinstance(facts, DataFrame) else None
    no_path = F.expr("array()").cast("array<int>")
    frontier = goals.select("case_id", "goal", F.col("goal").alias("atom"), no_path.alias("path"), F.expr("array()").cast("array<string>").alias("seen"), F.lit(False).alias("negated")).distinct()
    out = None
    depth = 0
    while True:
        known = saved(frontier.join(by_head, ["case_id", "atom"], "left"))
        again = F.array_contains("seen", F.col("atom")) | F.lit(depth >= most_depth)
        concluded = F.col("ways").isNotNull() & ~F.col("negated")
        kind = F.when(F.col("negated"), "absent").when(concluded & again, "shown").when(concluded, "derived").when(F.lit(depth == 0), "open").otherwise("fact")
        nodes = known.select("case_id", "goal", "path", F.lit(depth).alias("depth"), kind.alias("kind"), "atom", F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("double").alias("strength"))
        out = nodes if out is None else out.unionByName(nodes)
        opened = known.where(concluded & ~again).select("case_id", "goal", "atom", "path", F.array_append("seen", F.col("atom")).alias("seen"), F.posexplode("ways").alias("i", "way"))
        if depth >= most_depth or opened.isEmpty():
            break
        at = F.array_append("path", F.col("i"))
        out = out.unionByName(opened.select("case_id", "goal", at.alias("path"), F.lit(depth).alias("depth"), F.lit("rule").alias("kind"), "atom", F.col("way.rule_id").alias("rule_id"), F.col("way.strength").alias("strength")))
        frontier = opened.select("case_id", "goal", at.alias("path"), "seen", F.posexplode("way.premises").alias("j", "x")).select("case_id", "goal", F.col("x.atom").alias("atom"), F.array_append("path", F.col("j")).alias("path"), "seen", F.col("x.negated").alias("negated"))
        depth += 1
    if isinstance(facts, dict) and facts:
        of = F.create_map(*(F.lit(x) for pair in facts.items() for x in pair))[F.regexp_extract("atom", r"^[^(]*", 0)]
        return out.withColumn("source", F.when(F.col("kind") == "fact", of))
    if sources is None:
        return out.withColumn("source", F.lit(None).cast("string"))
    return out.join(sources, ["case_id", "atom"], "left").select(*out.columns, F.when(F.col("kind") == "fact", F.col("source")).alias("source"))


def tree_text(nodes: DataFrame, phrases: dict[str, str] | None = None, most_rules: int | None = None) -> DataFrame:
    """case_id, goal, proof: the nodes of each goal as indented lines. phrases: words for a predicate, in place of its name.

    most_rules: only the proofs in which no more rules are used, each as often as it is.
    """
    name = F.regexp_extract("atom", r"^[^(]*", 0)
    words = F.coalesce(F.create_map(*(F.lit(x) for p in phrases.items() for x in p))[name], name) if phrases else name
    shown = F.concat(words, F.regexp_extract("atom", r"\(.*$", 0))
    ending = F.when(F.col("kind") == "fact", F.concat(F.lit(" (fact"), F.coalesce(F.concat(F.lit(": "), F.col("source")), F.lit("")), F.lit(")"))).when(F.col("kind") == "shown", " (see above)").when(F.col("kind") == "open", " (not concluded)").otherwise("")
    line = F.when(F.col("kind") == "rule", F.concat(F.lit("by "), F.col("rule_id"), F.lit(", strength "), F.col("strength").cast("string"))).when(F.col("kind") == "absent", F.concat(F.lit("not "), shown, F.lit(" (does not hold)"))).otherwise(F.concat(shown, ending))
    indented = F.concat(F.expr("repeat('  ', size(path))"), line)
    lines = F.array_sort(F.collect_list(F.struct("path", indented.alias("line"))))  # a goal's proof
    found = nodes.groupBy("case_id", "goal").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("proof"), F.count_if(F.col("kind") == "rule").alias("n"))
    return (found if most_rules is None else found.where(F.col("n") <= most_rules)).drop("n")


def provenance(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """case_id, goal, kind, name, source, gap: each fact and rule of a proof once; gap: a rule that nobody has approved.

    rules: rule_id, status, origin, approved_by.
    """
    named = nodes.where("kind in ('fact', 'rule')").select("case_id", "goal", "kind", F.coalesce("rule_id", "atom").alias("name"), "rule_id", "source").dropDuplicates(["case_id", "goal", "kind", "name"])
    told = F.concat_ws(", ", "origin", "status", F.concat(F.lit("approved by "), F.coalesce(F.nullif("approved_by", F.lit("")), F.lit("nobody"))))
    known = rules.select("rule_id", told.alias("told"), ((F.col("status") != "approved") | F.coalesce(F.col("approved_by") == "", F.lit(True))).alias("lacks"))
    joined = named.join(known, "rule_id", "left")
    return joined.select("case_id", "goal", "kind", "name", F.when(F.col("kind") == "rule", F.coalesce("told", F.lit("not in the rule base"))).otherwise(F.col("source")).alias("source"), ((F.col("kind") == "rule") & F.coalesce("lacks", F.lit(True))).alias("gap"))
