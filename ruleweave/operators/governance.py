"""Asking the rule base about many cases at once, under its rules of approval, and the log of what was answered.

A critical case is only answered by approved rules; if a rule that isn't approved would fire on it, the case waits for a
person instead. Every answer is logged with the rules and the facts behind it, so that it can be replayed and audited.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.functions.truth import posterior
from ruleweave.operators.decisions import facts_long
from ruleweave.operators.wide import THRESHOLD, UNCOVERED, Wide
from ruleweave.plans.rules import Rule

PROPOSED, PROVISIONAL, PENDING, APPROVED, REJECTED, RETIRED = "proposed", "provisional", "pending_online", "approved", "rejected", "retired"
BLOCKED, ANSWERED, NOT_COVERED = "blocked_for_approval", "answered", "uncovered"


@dataclass(frozen=True)
class Record:
    """A rule under governance."""

    rule: Rule
    status: str = PROPOSED
    origin: str = "human"
    approved_by: str = ""
    citation: str = ""


def active(records: Sequence[Record], critical: bool) -> list[Rule]:
    """Rules that may decide: approved ones, and provisional ones if the case isn't critical."""
    return [r.rule for r in records if r.status == APPROVED or (r.status == PROVISIONAL and not critical)]


def wide_of(rules: list[Rule], observables: list[str], confidence: dict[str, str] | None = None) -> Wide:
    """A program of some of a domain's rules: a derived predicate that none of them concludes is false."""
    while True:
        heads = {r.head.predicate for r in rules} | set(observables)
        kept = []
        for r in rules:
            if all(x.atom.predicate in heads for x in r.body if not x.negated):
                kept.append(replace(r, body=tuple(x for x in r.body if x.atom.predicate in heads)))
        if kept == rules:
            return Wide(rules, observables, confidence)
        rules = kept


def _ids(rules: Sequence[Rule], fired) -> Column:
    return F.array_compact(F.array(*(F.when(fired(r.rule_id), F.lit(r.rule_id)) for r in sorted(rules, key=lambda r: r.rule_id)))) if rules else F.array().cast("array<string>")


def ask(cases: DataFrame, key: str, observables: list[str], records: Sequence[Record], goal: str, outcomes: Sequence[str], critical: Column, reason: Column | None = None) -> DataFrame:
    """An answer for each case.

    key, critical, reason, status, blocked_on, lower, upper and exact of the goal, decision (the first outcome whose lower
    bound is above the threshold, else human), rules and provisional (used by the reading in which unknowns are false).
    Projections only.
    """
    df = cases.select(key, *observables, critical.alias("critical"), (F.lit("") if reason is None else reason).alias("reason"))
    open_ = [r for r in records if r.status in (PROPOSED, PENDING, PROVISIONAL, APPROVED)]
    everything = wide_of([r.rule for r in open_], observables)
    unapproved = {r.rule.rule_id for r in open_ if r.status != APPROVED}
    df = everything.truth(df, "e_")
    waits = _ids([r for r in everything.rules if r.rule_id in unapproved], lambda i: F.col("critical") & (F.col(f"e_fired_{i}") == 2))
    df = df.withColumn("blocked_on", waits).select(key, *observables, "critical", "reason", "blocked_on")
    provisional = {r.rule.rule_id for r in records if r.status == PROVISIONAL}
    goals = list(dict.fromkeys([goal, *outcomes]))
    for mark, strict in (("s", True), ("l", False)):
        wide = wide_of(active(records, strict), observables)
        for g in goals:
            df = wide.bounds(df, g, f"{mark}_lower_{g}", f"{mark}_upper_{g}", f"{mark}_exact_{g}")
        closed = wide.truth(df.withColumns({f"__{o}": F.col(o) for o in observables}).withColumns({o: F.when(F.col(o) == 1, 0).otherwise(F.col(o)) for o in observables}), f"{mark}_")
        df = closed.withColumn(f"{mark}_rules", _ids(wide.rules, lambda i, mark=mark: F.col(f"{mark}_fired_{i}") == 2)).withColumns({o: F.col(f"__{o}") for o in observables})
    pick = lambda name: F.when(F.col("critical"), F.col(f"s_{name}")).otherwise(F.col(f"l_{name}"))
    blocked = F.size("blocked_on") > 0
    shown = lambda c: F.when(~blocked, c)
    uncovered = F.lit(True)
    for g in goals:
        uncovered = uncovered & (pick(f"upper_{g}") < UNCOVERED)
    decision = F.lit("human")
    for g in reversed(list(outcomes)):
        decision = F.when(pick(f"lower_{g}") > THRESHOLD, g).otherwise(decision)
    none = F.array().cast("array<string>")
    return df.select(
        key,
        "critical",
        "reason",
        F.when(blocked, BLOCKED).when(uncovered, NOT_COVERED).otherwise(ANSWERED).alias("status"),
        "blocked_on",
        shown(pick(f"lower_{goal}")).alias("lower"),
        shown(pick(f"upper_{goal}")).alias("upper"),
        shown(pick(f"exact_{goal}")).alias("exact"),
        F.when(blocked, "human").otherwise(decision).alias("decision"),
        F.when(blocked, none).otherwise(pick("rules")).alias("rules"),
        F.when(blocked, none).otherwise(F.filter(pick("rules"), lambda r: r.isin(*provisional) if provisional else F.lit(False))).alias("provisional"),
    )


def competing(bounds: DataFrame, key: str, outcomes: Sequence[str]) -> DataFrame:
    """key, place, outcome, middle: outcomes by the middle of their bounds (lower_<outcome>, upper_<outcome>)."""
    entries = F.array(*(F.struct((-(F.col(f"lower_{o}") + F.col(f"upper_{o}")) / 2).alias("m"), F.lit(o).alias("outcome")) for o in outcomes))
    return bounds.select(key, F.posexplode(F.array_sort(entries)).alias("at", "x")).select(key, (F.col("at") + 1).alias("place"), "x.outcome", (-F.col("x.m")).alias("middle"))


class DecisionLog:
    """Three tables that grow by whole runs: queries, the rules that each used, and the facts that each saw.

    A run is written to folders of its own attempt; a row in `committed`, written last, makes all three parts visible at
    once. What a run that was stopped left behind is never read, and a run that is repeated, or written by two writers at
    once, counts once: by the least of its attempts' names. So appends can be retried, also from foreachBatch.
    """

    _TABLES = ("queries", "query_rules", "query_facts")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> DataFrame:
        """attempt: one for each run."""
        return self.spark.read.schema("run string, attempt string").parquet(f"{self.path}/committed").groupBy("run").agg(F.min("attempt").alias("attempt")).select("attempt")

    def holds(self, run: str) -> bool:
        """Whether a run is in the log."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/committed")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return False
        return not self.spark.read.schema("run string, attempt string").parquet(f"{self.path}/committed").where(F.col("run") == run).isEmpty()

    def append(self, answers: DataFrame, cases: DataFrame, key: str, observables: list[str], goal: str, run: str, asked_by: str = "") -> bool:
        """Add a run's answers; False, and nothing written, if the log holds the run already."""
        if self.holds(run):
            return False
        attempt = uuid.uuid4().hex
        query = F.concat_ws("-", F.lit("q"), F.lit(run), F.col(key).cast("string"))
        asked = answers.select(query.alias("query_id"), F.lit(goal).alias("goal"), F.col(key).cast("string").alias("entity"), "critical", "reason", F.lit(asked_by).alias("asked_by"), F.lit(run).alias("run"), "lower", "upper", "status", "blocked_on", "decision")
        used = answers.select(query.alias("query_id"), F.explode("rules").alias("rule_id"), "provisional").select("query_id", "rule_id", F.array_contains("provisional", F.col("rule_id")).alias("provisional"))
        seen = facts_long(cases, key, observables).select(query.alias("query_id"), "fact", "t")
        for name, part in zip(self._TABLES, (asked, used, seen), strict=True):
            part.write.parquet(f"{self.path}/{name}/attempt={attempt}")
        self._commit(run, attempt)
        return True

    def _commit(self, run: str, attempt: str) -> None:
        self.spark.createDataFrame([(run, attempt)], "run string, attempt string").coalesce(1).write.mode("append").parquet(f"{self.path}/committed")

    def batches(self, answer, key: str, observables: list[str], goal: str, stream: str, asked_by: str = ""):
        """For foreachBatch: answers each batch of cases by answer(cases) and logs it as one run, once also after a restart."""

        def run(cases: DataFrame, batch_id: int) -> None:
            self.append(answer(cases), cases, key, observables, goal, f"{stream}-{batch_id}", asked_by)

        return run

    def table(self, name: str) -> DataFrame:
        """The rows of all committed runs."""
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").withColumn("attempt", F.col("attempt").cast("string")).join(self._committed(), "attempt", "left_semi").drop("attempt")

    def queries(self) -> DataFrame:
        """Queries with the sorted ids of the rules that they used, and of those that were provisional."""
        used = self.table("query_rules").groupBy("query_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"), F.array_sort(F.collect_set(F.when(F.col("provisional"), F.col("rule_id")))).alias("provisional"))
        return self.table("queries").join(used, "query_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("rules", "provisional")})

    def facts(self, query_ids: Sequence[str] | None = None) -> DataFrame:
        found = self.table("query_facts")
        return found if query_ids is None else found.where(F.col("query_id").isin(*query_ids))

    def replayed(self, observables: list[str]) -> DataFrame:
        """query_id and a truth column for each observable: the facts as they were when the query was asked."""
        columns = [F.max(F.when(F.col("fact") == o, F.col("t"))).alias(o) for o in observables]
        return self.table("query_facts").groupBy("query_id").agg(*columns)

    def tail(self, n: int) -> DataFrame:
        """The last n queries by run and id."""
        return self.table("queries").orderBy(F.col("run").desc(), F.col("query_id").desc()).limit(n)

    def row_counts(self) -> DataFrame:
        """table, rows."""
        parts = [self.table(t).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in ("queries", "query_rules", "query_facts")]
        return parts[0].union(parts[1]).union(parts[2])

    def record_outcomes(self, verdicts: DataFrame) -> DataFrame:
        """rule_id, successes, failures: verdicts (query_id, correct) counted for every rule that a query used."""
        return outcomes_by_rule(self.table("query_rules"), verdicts)


def outcomes_by_rule(used: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (query_id, correct) counted for each rule of used (query_id, rule_id), one of each query.

    Where verdicts have a column seq, the last of a query counts, so one can be taken back; else they must not differ.
    """
    last = F.max_by("correct", "seq") if "seq" in verdicts.columns else F.min("correct")
    settled = verdicts.groupBy("query_id").agg(last.alias("correct"))
    return used.join(settled, "query_id").groupBy("rule_id").agg(F.count_if("correct").alias("successes"), F.count_if(~F.col("correct")).alias("failures"))


# -- what the log says about the rules ------------------------------------------------------------------------


def needs_rereview(rules: DataFrame, least: int = 8, drop: float = 0.2) -> DataFrame:
    """Approved rules (rule_id, status, strength, successes, failures) whose record has fallen that far below their strength."""
    seen = F.col("successes") + F.col("failures")
    return rules.where((F.col("status") == APPROVED) & (seen >= least) & (F.col("strength") - posterior(F.col("successes"), F.col("failures")) >= drop))


def audited_badly(rules: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """Approved rules whose audits (successes, failures) were right in less than a share."""
    seen = F.col("successes") + F.col("failures")
    return rules.where((F.col("status") == APPROVED) & (seen >= least) & (F.col("successes") < share * seen))


def violations(queries: DataFrame, used: DataFrame, rules: DataFrame) -> DataFrame:
    """query_id, rule_id, status: answered critical queries that used a rule which is missing (null) or not approved."""
    critical = queries.where(F.col("critical") & (F.col("status") == ANSWERED)).select("query_id")
    return used.join(critical, "query_id", "left_semi").join(rules.select("rule_id", F.col("status").alias("rule_status")), "rule_id", "left").where(F.coalesce("rule_status", F.lit("")) != APPROVED).select("query_id", "rule_id", F.col("rule_status").alias("status"))


def impact(used: DataFrame, rule_id: str, provisional_only: bool = False) -> DataFrame:
    """Queries that a rule had a part in."""
    found = used.where(F.col("rule_id") == rule_id)
    return (found.where("provisional") if provisional_only else found).select("query_id").distinct()


def used_with(queries: DataFrame, rule_id: str) -> DataFrame:
    """Queries whose array of rules contains the rule."""
    return queries.where(F.array_contains("rules", rule_id))


def blocking(answers: DataFrame) -> DataFrame:
    """rule_id, waiting: how many cases wait for each rule's approval."""
    return answers.select(F.explode("blocked_on").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("waiting"))


def routed(records: Sequence[Record], waiting: DataFrame) -> DataFrame:
    """rule_id, before, after: provisional rules that block a critical case come to a person now."""
    spark = waiting.sparkSession
    table = spark.createDataFrame([(r.rule.rule_id, r.status) for r in records], "rule_id string, before string")
    joined = table.join(waiting, "rule_id", "left")
    return joined.select("rule_id", "before", F.when((F.col("before") == PROVISIONAL) & F.col("waiting").isNotNull(), PENDING).otherwise(F.col("before")).alias("after"))


# -- summaries ----------------------------------------------------------------------------------------------


def governance_summary(rules: DataFrame, queries: DataFrame, used: DataFrame) -> DataFrame:
    """One row of counts of rules by status and of queries by what became of them."""
    n = lambda s: F.count_if(F.col("status") == s)
    by_rule = rules.agg(F.count("*").alias("rules_total"), *(n(s).alias(f"rules_{s}") for s in (APPROVED, PROVISIONAL, PENDING, REJECTED)))
    provisional = used.where("provisional").select("query_id").distinct().withColumn("__p", F.lit(True))
    by_query = queries.join(provisional, "query_id", "left").agg(
        F.count("*").alias("queries_total"), F.count_if("critical").alias("queries_critical"), n(BLOCKED).alias("queries_blocked"), F.count_if("__p").alias("queries_provisional"), n(NOT_COVERED).alias("queries_uncovered")
    )
    broken = violations(queries, used, rules).agg(F.count("*").alias("invariant_violations"))
    return by_rule.join(by_query).join(broken)  # three single rows


def amortisation(rules: DataFrame, queries: DataFrame, used: DataFrame) -> DataFrame:
    """One row: reviews, decisions, rule applications of approved rules, and both per review (0 without a review)."""
    approved = rules.where(F.col("status") == APPROVED).select("rule_id")
    reuse = used.join(approved, "rule_id", "left_semi").agg(F.count("*").alias("applications"))
    row = approved.agg(F.count("*").alias("reviews")).join(queries.where(F.col("status") == ANSWERED).agg(F.count("*").alias("decisions"))).join(reuse)
    per = lambda c: F.when(F.col("reviews") > 0, F.col(c) / F.col("reviews")).otherwise(0.0)
    return row.withColumns({"decisions_per_review": per("decisions"), "applications_per_rule": per("applications")})


def most_reused(rules: DataFrame, used: DataFrame, most: int = 5) -> DataFrame:
    """rule_id, reuse of the approved rules that were used most."""
    return used.join(rules.where(F.col("status") == APPROVED).select("rule_id"), "rule_id").groupBy("rule_id").agg(F.count("*").alias("reuse")).orderBy(F.col("reuse").desc(), "rule_id").limit(most)


def rule_rows(rules: DataFrame, used: DataFrame) -> DataFrame:
    """rules with reuse and place: by status, then the most used first."""
    counted = rules.join(used.groupBy("rule_id").agg(F.count("*").alias("reuse")), "rule_id", "left").withColumn("reuse", F.coalesce("reuse", F.lit(0).cast("long")))
    return counted.withColumn("place", F.row_number().over(Window.orderBy("status", F.col("reuse").desc(), "rule_id")))  # rules are few


def outcome_counts(answers: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """One row: cases screened, committed, left to a person, blocked, and committed to each outcome."""
    blocked, committed = F.col("status") == BLOCKED, F.col("decision").isin(*outcomes)
    return answers.agg(
        F.count("*").alias("screened"), F.count_if(committed).alias("committed"), F.count_if(~committed & ~blocked).alias("human_queue"), F.count_if(blocked).alias("blocked"), *(F.count_if(F.col("decision") == o).alias(f"outcome_{o}") for o in outcomes)
    )


def cycle_report(decisions: DataFrame) -> DataFrame:
    """One row from decisions (status, took_effect, sampled, correct): what a pass over the cases came to."""
    blocked, uncovered = F.col("status") == BLOCKED, F.col("status") == NOT_COVERED
    decided = ~blocked & ~uncovered
    return decisions.agg(
        F.count_if(blocked).alias("blocked"),
        F.count_if(uncovered).alias("uncovered"),
        F.count_if(decided).alias("decided"),
        F.count_if(decided & F.col("took_effect")).alias("automatic"),
        F.count_if(decided & F.col("sampled")).alias("audited"),
        F.count_if(decided & F.col("correct").isNotNull()).alias("audit_verdicts"),
        F.count_if(decided & ~F.col("correct")).alias("audits_wrong"),
    )


def coverage(decisions: DataFrame) -> DataFrame:
    """One row from decisions (decided_by, status, sampled): how many the rules decided, and their share."""
    by_rules = F.count_if(F.col("decided_by") == "rules")
    return decisions.agg(F.count("*").alias("cases"), by_rules.alias("by_rules"), F.when(F.count("*") > 0, by_rules / F.count("*")).otherwise(0.0).alias("coverage"), F.count_if(F.col("status") == "waiting").alias("waiting"), F.count_if("sampled").alias("sampled"))


def campaign_stats(candidates: DataFrame, branch: str) -> DataFrame:
    """Counts by branch of candidates (status, decision, origin, audit_pending)."""
    status = lambda s: F.count_if(F.col("status") == s)
    return candidates.groupBy(branch).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("decision").isNotNull()).alias("screened"),
        F.count_if(F.col("decision") == "review").alias("flagged"),
        F.count_if((F.col("status") == "rejected") & (F.col("origin") == "agent")).alias("agent_rejected"),
        *(status(s).alias(s) for s in ("review", "held", "shortlisted", "hired", "rejected")),
        F.count_if("audit_pending").alias("audits_pending"),
    )


def export_record(rules: DataFrame, queries: DataFrame, path: str) -> None:
    """The rule base as CSV and the log as JSON lines, under path."""
    rules.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/rules.csv")
    queries.write.mode("overwrite").json(f"{path}/log.json")
