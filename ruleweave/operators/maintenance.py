"""What a machine can settle about rules before and after a person sees them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ruleweave.operators.governance import APPROVED, Record, needs_rereview, wide_of
from ruleweave.operators.wide import check
from ruleweave.plans.rules import Rule

ADMITTED, DEAD, REDUNDANT = "admitted", "can never fire", "changes no outcome on any input"


def screen(spark: SparkSession, approved: list[Rule], proposed: list[Rule], observables: list[str], outcomes: Sequence[str], most_inputs: int = 1 << 20) -> list[tuple[str, str]]:
    """(rule id, verdict) for each proposed rule, tried beside the approved ones as if it were approved.

    A program with more inputs than can be run through is admitted, not turned away.
    """
    out = []
    for rule in proposed:
        wide = wide_of([*approved, rule], observables)
        if rule.rule_id not in {r.rule_id for r in wide.rules}:
            out.append((rule.rule_id, DEAD))
            continue
        if 1 << len(wide.used_observables()) > most_inputs:
            out.append((rule.rule_id, ADMITTED))
            continue
        rows = {r.rule_id: r for r in check(spark, wide, list(outcomes), most_inputs).collect()}
        own = rows[rule.rule_id]
        verdict = DEAD if own.dead else REDUNDANT if own.redundant else f"lets {own.contradictions} inputs have two outcomes" if own.contradictions else ADMITTED
        out.append((rule.rule_id, verdict))
    return out


def sweep(records: Sequence[Record], stats: DataFrame, observables: list[str], outcomes: Sequence[str], most_inputs: int = 1 << 20) -> tuple[list[str], list[tuple[str, str]]]:
    """Approved rules to review again (by stats: rule_id, status, strength, successes, failures), and rules to retire with the reason."""
    again = [r.rule_id for r in needs_rereview(stats).select("rule_id").orderBy("rule_id").collect()]
    approved = [r.rule for r in records if r.status == APPROVED]
    wide = wide_of(approved, observables)
    retire = [(r.rule_id, DEAD) for r in approved if r.rule_id not in {x.rule_id for x in wide.rules}]
    if wide.rules and 1 << len(wide.used_observables()) <= most_inputs:
        for r in check(stats.sparkSession, wide, list(outcomes), most_inputs).orderBy("rule_id").collect():
            if r.dead or r.redundant:
                retire.append((r.rule_id, DEAD if r.dead else REDUNDANT))
    return again, retire
