"""The life of rules as an append-only table of events: propose, approve, reject, retire, escalate.

A rule's status is that of its latest event. Rules are few and are read to the driver when they are compiled; the log of
decisions is not, and is only ever joined with them. A decision about one rule is never asked for twice: a proposal is
recognised by its canonical key.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.operators.governance import APPROVED, PENDING, PROPOSED, PROVISIONAL, REJECTED, RETIRED, Record
from ruleweave.plans.rules import NotStratified, Rule, canonical_key, strata
from ruleweave.plans.vocabulary import Vocabulary
from ruleweave.sources.rule_text import format_rule, parse_program, parse_rule

EVENTS = "seq long, event_id string, rule_id string, key string, status string, text string, actor string, note string, at timestamp"
_ALREADY = {APPROVED: "already_approved", REJECTED: "already_rejected", RETIRED: "already_rejected"}


class ForbiddenTransition(ValueError):
    """The rule's status does not allow the step."""


class RuleStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(EVENTS).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EVENTS)

    def history(self, rule_id: str) -> DataFrame:
        return self.events().where(F.col("rule_id") == rule_id).orderBy("seq")

    def rules(self) -> DataFrame:
        """rule_id, key, status, text of each rule, by its latest event."""
        last = self.events().groupBy("rule_id").agg(F.max_by(F.struct("key", "status", "text"), F.struct("seq", "event_id")).alias("x"))
        return last.select("rule_id", "x.*")

    def records(self) -> list[Record]:
        """The rules by id, read from their text; raises if a text no longer has the key under which it was settled."""
        out = []
        for r in self.rules().orderBy("rule_id").collect():
            rule = replace(parse_rule(r.text), rule_id=r.rule_id)
            if canonical_key(rule) != r.key:
                raise ValueError(f"{r.rule_id} is stored under {r.key}, but its text has the key {canonical_key(rule)}")
            meta = dict(rule.meta)
            out.append(Record(rule, r.status, str(meta.get("origin", "human")), str(meta.get("by", "")), str(meta.get("cites", ""))))
        strata([r.rule for r in out if r.status not in (REJECTED, RETIRED)])
        return out

    def active(self, critical: bool) -> list[Rule]:
        """Rules that may decide a case: on critical ones approved rules only."""
        wanted = [APPROVED] if critical else [APPROVED, PROVISIONAL]
        return [parse_rule(r.text) for r in self.rules().where(F.col("status").isin(wanted)).orderBy("rule_id").collect()]

    def _append(self, rows: list[tuple]) -> None:
        first = (self.events().agg(F.max("seq")).first()[0] or 0) + 1
        now = datetime.datetime.now(datetime.UTC)
        numbered = [(first + i, uuid.uuid4().hex, *r, now) for i, r in enumerate(rows)]  # of two writers' events with one number the id decides
        self.spark.createDataFrame(numbered, EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def propose(self, rules: list[Rule], critical: bool, actor: str = "", vocabulary: Vocabulary | None = None) -> list[str]:
        """Outcome of each proposal: new rules wait for a person if critical and apply provisionally if not.

        A new rule outside the vocabulary, or one that would make negation run in a circle, is rejected_invalid and isn't stored.
        """
        known = {r.key: r for r in self.rules().collect()}
        standing = [parse_rule(r.text) for r in known.values() if r.status not in (REJECTED, RETIRED)]
        rows, out = [], []
        for rule in rules:
            key = canonical_key(rule)
            old = known.get(key)
            if old is None:
                if invalid(rule, standing, vocabulary):
                    out.append("rejected_invalid")
                    continue
                standing.append(rule)
                status = PENDING if critical else PROVISIONAL
                rule_id = rule.rule_id or key
                rows.append((rule_id, key, status, format_rule(rule), actor, ""))
                known[key] = type("Row", (), {"rule_id": rule_id, "key": key, "status": status, "text": format_rule(rule)})
                out.append("queued_online" if critical else "applied_provisionally")
            elif old.status == PROPOSED:  # stored, but not put to anyone yet
                rows.append((old.rule_id, key, PENDING if critical else PROVISIONAL, old.text, actor, ""))
                out.append("queued_online" if critical else "applied_provisionally")
            elif old.status == PROVISIONAL and critical:
                rows.append((old.rule_id, key, PENDING, old.text, actor, "escalated"))
                out.append("queued_online")
            else:
                out.append(_ALREADY.get(old.status, "already_pending"))
        if rows:
            self._append(rows)
        return out

    def _move(self, rule_id: str, to: str, allowed: tuple[str, ...], actor: str, note: str) -> None:
        row = self.rules().where(F.col("rule_id") == rule_id).first()
        if row is None or row.status not in allowed:
            raise ForbiddenTransition(f"{rule_id} is {row.status if row else 'unknown'} and can't become {to}")
        self._append([(rule_id, row.key, to, row.text, actor, note)])

    def approve(self, rule_id: str, actor: str, note: str = "") -> None:
        self._move(rule_id, APPROVED, (PROPOSED, PROVISIONAL, PENDING), actor, note)

    def reject(self, rule_id: str, actor: str, note: str = "") -> None:
        self._move(rule_id, REJECTED, (PROPOSED, PROVISIONAL, PENDING, APPROVED), actor, note)

    def retire(self, rule_id: str, actor: str, note: str = "") -> None:
        self._move(rule_id, RETIRED, (APPROVED,), actor, note)

    def review_queue(self, log: DataFrame | None = None) -> DataFrame:
        """rule_id, status, reuse: those that wait online first, oldest first, then provisional ones by use."""
        since = self.events().groupBy("rule_id").agg(F.min("seq").alias("since"))
        waiting = self.rules().where(F.col("status").isin(PENDING, PROVISIONAL)).join(since, "rule_id")
        used = (log.groupBy("rule_id").agg(F.count("*").alias("reuse")) if log is not None else self.spark.createDataFrame([], "rule_id string, reuse long"))
        found = waiting.join(used, "rule_id", "left").select("rule_id", "status", F.coalesce("reuse", F.lit(0).cast("long")).alias("reuse"), "since")
        online = F.col("status") == PENDING
        return found.orderBy(online.desc(), F.when(online, F.col("since")), F.col("reuse").desc(), "rule_id").drop("since")

    def reject_with_impact(self, rule_id: str, actor: str, note: str, log: DataFrame) -> DataFrame:
        """Reject a rule; the logged decisions that it had a part in. A person and a reason must be named."""
        if not actor.strip() or not note.strip():
            raise ValueError("a rejection needs a person and a reason")
        self.reject(rule_id, actor, note)
        return log.where(F.col("rule_id") == rule_id)

    def invariant_violations(self, log: DataFrame) -> DataFrame:
        """Critical decisions of the log that used a rule which isn't approved; the log is never collected."""
        return log.where("critical").join(self.rules().where(F.col("status") == APPROVED).select("rule_id"), "rule_id", "left_anti")

    def export_text(self) -> str:
        """All rules as text that import_text reads; their status is part of it."""
        lines = []
        for r in self.rules().orderBy("rule_id").collect():
            rule = parse_rule(r.text)
            meta = dict(rule.meta) | {"p": rule.strength, "status": r.status}
            lines.append(format_rule(replace(rule, rule_id=r.rule_id, meta=tuple(sorted(meta.items())))))
        return "\n".join(lines)

    def import_text(self, text: str, actor: str = "import", vocabulary: Vocabulary | None = None) -> list[str]:
        """Ids of the rules that were added: those whose key isn't settled yet. Raises on a rule that is invalid."""
        known = {r.key: r for r in self.rules().collect()}
        standing = [parse_rule(r.text) for r in known.values() if r.status not in (REJECTED, RETIRED)]
        taken, rows, added = {r.rule_id for r in known.values()}, [], []
        for rule in parse_program(text)[0]:
            key = canonical_key(rule)
            if key in known:
                continue
            if found := invalid(rule, standing, vocabulary):
                raise ValueError(f"{rule}: {found}")
            known[key] = rule
            standing.append(rule)
            rule_id = rule.rule_id if rule.rule_id and rule.rule_id not in taken else key
            taken.add(rule_id)
            status = str(dict(rule.meta).get("status", PROPOSED))
            rows.append((rule_id, key, status, format_rule(replace(rule, rule_id=rule_id)), actor, "imported"))
            added.append(rule_id)
        if rows:
            self._append(rows)
        return added


def invalid(rule: Rule, standing: list[Rule], vocabulary: Vocabulary | None) -> str:
    """What stands against a rule beside the standing ones, or nothing."""
    found = vocabulary.problems(rule) if vocabulary else []
    try:
        strata([*standing, rule])
    except NotStratified as e:
        found.append(str(e))
    return "; ".join(found)


def route(status: Column, critical: Column, valid: Column | None = None) -> Column:
    """Outcome of proposals joined with the rule of their key: status is null where there is none."""
    wrong = F.lit(False) if valid is None else ~F.coalesce(valid, F.lit(False))
    known = F.when(status == APPROVED, "already_approved").when(status.isin(REJECTED, RETIRED), "already_rejected").when((status == PROVISIONAL) & critical, "queued_online").otherwise("already_pending")
    return F.when(status.isNotNull(), known).when(wrong, "rejected_invalid").when(critical, "queued_online").otherwise("applied_provisionally")
