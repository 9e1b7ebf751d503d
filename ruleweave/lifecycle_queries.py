"""Registered queries on the life of rules: a store of rules beside the log of the orders that they decided."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators.governance import needs_rereview
from ruleweave.operators.lifecycle import RuleStore
from ruleweave.queries import _LOG, _register, governance_log, rule_stats
from ruleweave.sources.rule_text import parse_rule
from ruleweave.sources.tables import scratch

#: Strengths of r0 to r7; repeated in the SQL.
STRENGTHS = [0.9, 0.55, 0.8, 0.5, 0.9, 0.9, 0.75, 0.7]
_VALUES = ", ".join(f"('r{i}', {p})" for i, p in enumerate(STRENGTHS))


def _text(i: int) -> str:
    return f"rule r{i} [p={STRENGTHS[i]}] settled(X) <- sign{i}(X)."


def rule_store(spark) -> RuleStore:
    """Eight imported rules: r0 to r3 are approved, r4 and r5 wait for a person, r6 and r7 apply provisionally."""
    store = RuleStore(spark, scratch(spark, "rules"))
    store.import_text(" ".join(map(_text, range(8))))
    for i in range(4):
        store.approve(f"r{i}", "ann")
    rules = [parse_rule(f"settled(X) <- sign{i}(X).") for i in range(4, 8)]
    store.propose(rules[:2], critical=True)
    store.propose(rules[2:], critical=False)
    return store


@_register(f"with {_LOG} select rule_id, case when rule_id < 'r6' then 'pending_online' else 'provisional' end as status, count(*) as reuse from log where rule_id >= 'r4' group by 1")
def store_review_queue(spark, d):
    """Who waits for review, with the orders that each rule decided."""
    return rule_store(spark).review_queue(governance_log(spark, d)).select("rule_id", "status", "reuse")


@_register(f"with {_LOG}, s as (select rule_id, count(*) filter (verdict = 1) as s, count(*) filter (verdict = 0) as f from log group by 1), p as (select * from (values {_VALUES}) t(rule_id, strength)) select rule_id, round(strength::double, 6) as strength, s as successes, f as failures from s join p using (rule_id) where rule_id < 'r4' and s + f >= 8 and strength - (1 + s) / (2.0 + s + f) >= 0.2")
def store_rereview(spark, d):
    """Approved rules whose record has fallen far below their strength."""
    strengths = spark.createDataFrame([(r.rule.rule_id, float(r.rule.strength), r.status) for r in rule_store(spark).records()], "rule_id string, strength double, status string")
    rules = strengths.join(rule_stats(governance_log(spark, d)), "rule_id")
    return needs_rereview(rules).select("rule_id", "strength", "successes", "failures")


@_register(f"with {_LOG} select critical, count(*) as decisions, count(verdict) as judged from log where rule_id = 'r2' group by 1")
def store_rejection_impact(spark, d):
    """The decisions that a rejected rule had a part in."""
    found = rule_store(spark).reject_with_impact("r2", "ann", "outdated", governance_log(spark, d))
    return found.groupBy("critical").agg(F.count("*").alias("decisions"), F.count("verdict").alias("judged"))


@_register(f"with {_LOG} select query_id, rule_id from log where critical and rule_id >= 'r4'")
def store_violations(spark, d):
    """Critical orders that a rule decided which nobody has approved."""
    return rule_store(spark).invariant_violations(governance_log(spark, d)).select("query_id", "rule_id")
