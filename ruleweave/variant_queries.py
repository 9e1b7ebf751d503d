"""Registered queries on what changes of the rule base would do to the recorded orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators.variants import Trial, Variant, with_each, without_each
from ruleweave.queries import _register, _t
from ruleweave.sources.rule_text import parse_program
from ruleweave.world_queries import _FACTS, order_facts, order_program

_PROPOSED = """
rule s1 settle(order) <- returned(L), line(L, S), trusted(S).
rule s2 escalate(order) <- risky(L), returned(L).
rule s3 calm(S) <- line(L, S), trusted(S).
rule s4 watch(S) <- trusted(S).
"""
_WIDER = """
rule c1 risky(L) <- line(L, S), returned(L).
rule c2 escalate(order) <- returned(L), line(L, S), trusted(S).
"""

#: For each order the truth of both outcomes under the base, and what the variants need.
_BASE = (
    "with "
    + _FACTS
    + """,
m as (select o, max(least(ret, 2 - tru)) as risky, max(least(tru, 2 - ret)) as calm, max(ret) as back, max(tru) as trusting, max(least(ret, tru)) as kind from facts group by 1),
e as (select *, greatest(risky, least(calm, back)) as escalate, calm as settle from m)"""
)


def _trial(spark, d, variants) -> Trial:
    return Trial(order_program(), order_facts(spark, d), variants, counted=True)


@_register(
    _BASE
    + """,
v as (
  select 'w1' as rule_id, escalate, settle, least(calm, back) as e1, settle as s1 from e union all select 'w2', escalate, settle, least(calm, back), settle from e
  union all select 'w3', escalate, settle, risky, 0 from e union all select 'w4', escalate, settle, risky, settle from e union all select 'w5', escalate, settle, escalate, 0 from e)
select rule_id, count(*) filter (e1 <> escalate or s1 <> settle) as differs, count(*) filter ((escalate = 2 and e1 < 2) or (settle = 2 and s1 < 2)) as losses,
  count(*) filter (e1 <> escalate or s1 <> settle) = 0 as redundant from v group by 1"""
)
def relational_redundancy(spark, d):
    """In how many orders an outcome hangs on each rule."""
    found = _trial(spark, d, without_each(order_program().rules)).effects(["escalate/1", "settle/1"])
    return found.select(F.col("variant").alias("rule_id"), "differs", "losses", (F.col("differs") == 0).alias("redundant"))


@_register(
    _BASE
    + """,
v as (select 'c1' as candidate, o, escalate, greatest(back, least(calm, back)) as now from e union all select 'c2', o, escalate, kind from e)
select candidate, count(*) as evidence, count(*) filter (escalate = 2 and now = 2) as keeps, count(*) filter (escalate < 2 and now = 2 and o_orderstatus <> 'F') as gains, count(*) filter (escalate = 2 and now < 2) as losses,
  count(*) filter (escalate < 2 and now = 2 and o_orderstatus = 'F') as conflicts from v join orders on o = o_orderkey group by 1"""
)
def relational_replay(spark, d):
    """What two wider rules in place of others make of the orders, against the conclusion that an order's status records."""
    wider = {r.rule_id: r for r in parse_program(_WIDER)[0]}
    variants = [Variant("c1", frozenset({"w1"}), (wider["c1"],)), Variant("c2", frozenset({"w1", "w4"}), (wider["c2"],))]
    status = F.col("o_orderstatus")
    recorded = _t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(status == "F", "settle").when(status == "P", "escalate").alias("conclusion"))
    return _trial(spark, d, variants).replay("escalate/1", recorded).withColumnRenamed("variant", "candidate")


@_register(
    _BASE
    + """,
v as (
  select 's1' as rule_id, escalate, settle, escalate as e1, greatest(settle, kind) as s1 from e union all select 's2', escalate, settle, escalate, settle from e
  union all select 's3', escalate, settle, greatest(risky, least(trusting, back)), trusting from e union all select 's4', escalate, settle, escalate, settle from e),
c as (select rule_id, count(*) filter (e1 <> escalate or s1 <> settle) as differs, count(*) filter (e1 = 2 and s1 = 2 and not (escalate = 2 and settle = 2)) as contradictions from v group by 1)
select *, case when contradictions > 0 then 'two outcomes in a case' when rule_id = 's2' then 'changes nothing' when differs = 0 then 'changes no outcome' else 'admitted' end as verdict from c"""
)
def relational_screen(spark, d):
    """Four proposed rules, each tried beside the base on all orders."""
    found = _trial(spark, d, with_each(parse_program(_PROPOSED)[0])).screen(["escalate/1", "settle/1"])
    return found.withColumnRenamed("variant", "rule_id")
