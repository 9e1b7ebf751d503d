"""Why a goal holds: the steps of its proof, with sources, as rows of each case.

The steps follow the rules that fired, from the goal down. They are columns of the case first, so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.wide import Wide


def proof_steps(wide: Wide, df: DataFrame, key: str, goal: str, unapproved: tuple[str, ...] = ()) -> DataFrame:
    """key, kind, name, approved: the rules and premises that carry the goal, for cases where it holds.

    kind is rule, fact (known to be true), denied (an observable known to be false) or not_concluded (a derived
    predicate that no rule concludes). approved is null for all but rules; a false one is a gap in the case's authority.
    """
    if goal not in wide.heads:
        raise ValueError(f"no rule concludes {goal}")
    df = wide.truth(df.select(key, *wide.columns()))
    no = F.lit(False)
    needed: dict[str, Column] = {goal: F.col(goal) == 2}
    used: dict[str, Column] = {}
    for head in reversed(wide.heads):  # a head comes after all rules that look at it
        if head in needed:
            for r in (x for x in wide.rules if x.head.predicate == head):
                used[r.rule_id] = needed[head] & (F.col(f"fired_{r.rule_id}") == 2)
                for x in r.body:
                    if not x.negated and x.atom.predicate in wide.heads:
                        needed[x.atom.predicate] = needed.get(x.atom.predicate, no) | used[r.rule_id]
    df = df.withColumns({f"__used_{i}": c for i, c in used.items()})
    premises: dict[tuple[str, str], list[Column]] = {}
    for r in wide.rules:
        if r.rule_id in used:
            for x in r.body:
                p = x.atom.predicate
                if x.negated or p not in wide.heads:
                    kind = "fact" if not x.negated else "not_concluded" if p in wide.heads else "denied"
                    premises.setdefault((kind, p), []).append(F.col(f"__used_{r.rule_id}"))
    step = lambda kind, name, ok: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(ok).cast("boolean").alias("approved"))
    steps = [F.when(F.col(f"__used_{i}"), step("rule", i, i not in unapproved)) for i in used]
    steps += [F.when(reduce(or_, conditions), step(kind, name, None)) for (kind, name), conditions in premises.items()]
    return df.select(key, F.inline(F.array_compact(F.array(*steps))))


def proof_text(steps: DataFrame, key: str) -> DataFrame:
    """key, proof: the steps of each case as one line, rules first."""
    place = F.when(F.col("kind") == "rule", 0).otherwise(1)
    mark = F.when(F.col("approved") == F.lit(False), " (not approved)").otherwise("")
    line = F.struct(place.alias("place"), F.concat(F.col("kind"), F.lit(" "), F.col("name"), mark).alias("line"))
    listed = steps.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # as many lines as the program has rules and premises
    return listed.select(key, F.array_join(F.col("lines.line"), "; ").alias("proof"))


def uncertain(wide: Wide, df: DataFrame, key: str) -> DataFrame:
    """key, atoms: unknown observables, and derived predicates that are unknown, in the order of the program."""
    df = wide.truth(df.select(key, *wide.columns()))
    return df.select(key, F.array_compact(F.array(*(F.when(F.col(p) == 1, F.lit(p)) for p in [*wide.observables, *wide.heads]))).alias("atoms"))


def proof_tree(wide: Wide, df: DataFrame, key: str, goal: str, phrases: dict[str, str] | None = None, unapproved: tuple[str, ...] = ()) -> DataFrame:
    """key, proof: the nested proof of the goal as indented text, or why it isn't settled.

    A premise that must not hold is confirmed if it was observed to be false, and assumed if no rule concludes it. The
    tree of a head is a column, made once from those of its premises.
    """
    words = lambda p: (phrases or {}).get(p, p)
    df = wide.probability(df.select(key, *wide.columns()))
    deeper = lambda c: F.regexp_replace(c, r"(?m)^", "  ")

    def leaf(p: str, negated: bool) -> Column:
        if negated:
            settled = F.lit(f"not {words(p)} (assumed: no rule concludes it)" if p in wide.heads else f"not {words(p)} (confirmed)")
            return F.when(F.col(p) == 0, settled).otherwise(F.concat(F.lit(f"not {words(p)} "), F.when(F.col(p) == 1, "(unknown)").otherwise("(it holds)")))
        if p in wide.heads:
            return F.col(f"__tree_{p}")
        return F.when(F.col(p) == 2, F.lit(f"{words(p)} (fact)")).when(F.col(p) == 1, F.lit(f"{words(p)} (unknown)")).otherwise(F.lit(f"{words(p)} (absent)"))

    for head in wide.heads:
        rules = []
        for r in (x for x in wide.rules if x.head.predicate == head):
            mark = " (not approved)" if r.rule_id in unapproved else ""
            premises = F.concat_ws("\n", *(deeper(deeper(leaf(x.atom.predicate, x.negated))) for x in r.body))
            rules.append(F.when(F.col(f"fired_{r.rule_id}") == F.col(head), F.concat(F.lit(f"  by {r.rule_id}, strength {r.strength}{mark}\n"), premises)))
        shown = F.concat(F.lit(words(head)), F.when(F.col(head) == 2, F.concat(F.lit(", probability "), F.round(f"p_{head}", 4).cast("string"))).otherwise(F.lit(" (unknown)")))
        tree = F.when(F.col(head) > 0, F.concat_ws("\n", shown, *rules)).otherwise(F.lit(f"{words(head)} (absent)"))
        df = df.withColumn(f"__tree_{head}", tree)
    return df.select(key, F.col(f"__tree_{goal}").alias("proof"))


def provenance(steps: DataFrame, facts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """steps of a proof with where each comes from, and gap: whether a rule among them lacks approval.

    facts: key, fact, source; rules: rule_id, status, origin, approved_by, citation.
    """
    known = facts.select(key, F.col("fact").alias("name"), "source")
    origin = F.concat_ws(", ", "origin", F.when(F.col("approved_by") != "", F.concat(F.lit("approved by "), F.col("approved_by"))), F.when(F.col("citation") != "", F.col("citation")))
    ruled = rules.select(F.col("rule_id").alias("name"), F.col("status").alias("rule_status"), origin.alias("rule_source"))
    from_facts = steps.where(F.col("kind").isin("fact", "denied")).join(known, [key, "name"], "left").select(key, "kind", "name", "source", F.lit(False).alias("gap"))
    from_rules = steps.where(F.col("kind") == "rule").join(ruled, "name", "left").select(key, "kind", "name", F.col("rule_source").alias("source"), (F.coalesce("rule_status", F.lit("missing")) != "approved").alias("gap"))
    assumed = steps.where(F.col("kind") == "not_concluded").select(key, "kind", "name", F.lit("assumed").alias("source"), F.lit(False).alias("gap"))
    return from_facts.unionByName(from_rules).unionByName(assumed)


def answer_text(answers: DataFrame, key: str, goal: str) -> DataFrame:
    """key, text: an answer of governance.ask in one line."""
    percent = lambda c: F.concat(F.round(F.col(c) * 100, 1).cast("string"), F.lit("%"))
    between = F.concat(F.lit(f"{goal} between "), percent("lower"), F.lit(" and "), percent("upper"), F.when(F.col("exact"), "").otherwise(" (not all completions were tried)"))
    by = F.when(F.size("rules") > 0, F.concat(F.lit(" by "), F.array_join("rules", ", "))).otherwise("")
    text = F.when(F.size("blocked_on") > 0, F.concat(F.lit("waits for approval of "), F.array_join("blocked_on", ", "))).when(F.col("status") == "uncovered", F.concat(F.lit("not covered: "), between)).otherwise(F.concat(F.col("decision"), F.lit(": "), between, by))
    return answers.select(key, text.alias("text"))
