"""Registered queries on oversight, answers under approval, the log of answers, and packs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions.truth import beta_doubt
from ruleweave.operators import governance, oversight
from ruleweave.operators.explain import uncertain
from ruleweave.operators.lifecycle import route
from ruleweave.queries import _FEATURES, _LOG, _STATS, _WORLDS, OBSERVABLES, _register, _t, _with_truth, customer_pack, customers, governance_log, rule_stats
from ruleweave.sources.drafts import policy_rules
from ruleweave.sources.packs import load_pack

# -- oversight ------------------------------------------------------------------------------------------

_MODE = "case when (harm >= 9 and rights) or (harm >= 8 and reversibility <= 3) then 'human_only' when harm >= 6 or rights or confidence < 70 then 'human_approval' when harm <= 3 and reversibility >= 7 then 'ai_with_oversight' else 'ai_recommends' end"


@_register(f"with g as (select i % 10 + 1 as harm, i // 10 % 10 + 1 as reversibility, i // 100 % 2 = 1 as rights, i // 200 * 25 as confidence from range(1000) t(i)) select *, {_MODE} as mode from g")
def ladder_grid(spark, d):
    """All modes over a grid of estimates."""
    i = F.col("id")
    grid = spark.range(1000).select((i % 10 + 1).alias("harm"), (F.floor(i / 10) % 10 + 1).alias("reversibility"), (F.floor(i / 100) % 2 == 1).alias("rights"), (F.floor(i / 200) * 25).alias("confidence"))
    return grid.withColumn("mode", oversight.classify(*map(F.col, ("harm", "reversibility", "rights", "confidence"))))


_ESTIMATES = "e as (select l_orderkey, l_linenumber, ceil(l_quantity / 5)::int as harm, (l_linenumber + 3)::int as reversibility, l_returnflag = 'R' as rights, (100 - l_discount * 500)::int as confidence from lineitem)"


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of harm, reversibility, rights and confidence for each line."""
    harm, confidence = F.ceil(F.col("l_quantity") / 5).cast("int"), F.round(100 - F.col("l_discount") * 500).cast("int")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", harm.alias("harm"), (F.col("l_linenumber") + 3).cast("int").alias("reversibility"), (F.col("l_returnflag") == "R").alias("rights"), confidence.alias("confidence"))


@_register(f"""with {_ESTIMATES}, m as (select *, {_MODE} as mode, case when confidence >= 85 then 'ai_recommends' else 'human_approval' end as selected from e),
r as (select *, list_position(['ai_with_oversight', 'ai_recommends', 'human_approval', 'human_only'], mode) as a, list_position(['ai_with_oversight', 'ai_recommends', 'human_approval', 'human_only'], selected) as b from m)
select l_orderkey, l_linenumber, mode, b < a as downgrade from r""")
def ladder(spark, d):
    mode = oversight.classify(*map(F.col, ("harm", "reversibility", "rights", "confidence")))
    selected = F.when(F.col("confidence") >= 85, "ai_recommends").otherwise("human_approval")
    return _estimates(spark, d).select("l_orderkey", "l_linenumber", mode.alias("mode"), oversight.is_downgrade(selected, mode).alias("downgrade"))


def _kleene_ladder() -> str:
    """The ladder's rules in three-valued arithmetic; a width of a tenth or less isn't known."""
    t = lambda c: f"case when {c} is null then 1 when {c} then 2 else 0 end"
    return f"""with {_ESTIMATES}, w as (select *, case when confidence > 90 then null else (100 - confidence) / 100.0 end as width from e),
f as (select *, {t('harm >= 9')} as hx, {t('harm >= 8')} as hh, {t('harm >= 6')} as hm, {t('harm <= 3')} as hl, {t('reversibility <= 3')} as rh, {t('reversibility >= 7')} as re, {t('rights')} as ri, {t('width >= 0.3')} as un from w),
a as (select *, greatest(least(hx, ri), least(hh, rh)) as ho from f),
b as (select *, greatest(least(hm, 2 - ho), least(ri, 2 - ho), least(un, 2 - ho)) as ha from a),
c as (select *, least(hl, re, 2 - ho, 2 - ha) as ao from b), x as (select *, least(2 - ho, 2 - ha, 2 - ao) as ar from c)
select l_orderkey * 10 + l_linenumber as line, case when ho = 2 then 'human_only' when ha = 2 then 'human_approval' when ao = 2 then 'ai_with_oversight' when ar = 2 then 'ai_recommends' else 'human_approval' end as mode from x"""


@_register(_kleene_ladder())
def oversight_modes(spark, d):
    """Modes by the oversight rules; where the width of the bounds is unknown, it may block every mode but the first."""
    width = F.when(F.col("confidence") <= 90, (100 - F.col("confidence")) / 100.0)
    e = _estimates(spark, d).withColumn("interval_width", width).withColumnRenamed("rights", "rights_impacted").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return oversight.allocate(e, "line").select("line", "mode")


_DOUBT = "list_sum(list_transform(range(s + 1, s + f + 2), lambda j: exp(lgamma(s + f + 2) - lgamma(j + 1) - lgamma(s + f + 2 - j) + j * ln(x) + (s + f + 1 - j) * ln(1 - x))))"


@_register(_STATS + f", t as (select rule_id, successes as s, failures as f, 0.55::double as x from s) select rule_id, round({_DOUBT}, 6) as doubt from t")
def rule_doubt(spark, d):
    """P(a rule's accuracy is below the target), given its verdicts."""
    s = rule_stats(governance_log(spark, d))
    return s.select("rule_id", F.round(beta_doubt(F.col("successes"), F.col("failures"), 0.55), 6).alias("doubt"))


#: Rules r0 to r7: r0 to r2 are mined; r6 and r7 provisional. Every order uses the rule of its customer and that of its number.
_USED = f"{_LOG}, used as (select query_id, rule_id, rule_id >= 'r6' as provisional from log union select o_orderkey, 'r' || (o_orderkey % 8), o_orderkey % 8 >= 6 from orders)"


def _used(log: DataFrame) -> DataFrame:
    other = F.concat(F.lit("r"), (F.col("query_id") % 8).cast("string"))
    return log.select("query_id", "rule_id", (F.col("rule_id") >= "r6").alias("provisional")).union(log.select("query_id", other, other >= "r6")).distinct()


def _rules(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(8).select(F.concat(F.lit("r"), i.cast("string")).alias("rule_id"), F.when(i < 6, "approved").otherwise("provisional").alias("status"), F.when(i < 3, "mined").otherwise("document").alias("origin"))


@_register(
    f"with {_USED}, n as (select rule_id, (count(*) filter (verdict = 1) // 40)::int as s, (count(*) filter (verdict = 0) // 200)::int as f, case when rule_id < 'r3' then 0.85 else 0.8 end::double as x from log group by 1),"
    f" dt as (select rule_id, rule_id >= 'r6' as p, {_DOUBT} as doubt from n), w as (select query_id, bool_or(p) as p, max(doubt) as doubt from used join dt using (rule_id) group by 1)"
    " select query_id, round(case when o_orderstatus <> 'F' or w.doubt is null or w.p then 1.0 else least(greatest(0.02 + 0.98 * w.doubt, 0.02), 1.0) end, 6) as rate from orders join w on query_id = o_orderkey"
)
def audit_rate(spark, d):
    """Audit rates of decisions by the weakest rule; finished orders are automatic decisions."""
    log = governance_log(spark, d)
    stats = rule_stats(log).select("rule_id", F.floor(F.col("successes") / 40).alias("successes"), F.floor(F.col("failures") / 200).alias("failures"))
    mode = F.when(F.col("o_orderstatus") == "F", "ai_with_oversight").otherwise("human_approval")
    decisions = _t(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), mode.alias("mode"))
    return oversight.audit_rates(decisions, _used(log), _rules(spark).join(stats, "rule_id"), "query_id").select("query_id", F.round("rate", 6).alias("rate"))


_DRAW = "('0x' || substr(sha256('audit:' || l), 1, 16))::ubigint::double / 18446744073709551616.0"


@_register(f"""with {_ESTIMATES}, m as (select l_orderkey || '-' || l_linenumber as l, {_MODE} as mode, l_linenumber % 3 = 0 as covered from e),
b as (select *, not covered and mode in ('human_only', 'human_approval') as blocked, case mode when 'human_only' then 0.5 when 'human_approval' then 0.2 when 'ai_recommends' then 0.1 else 0.05 end::double as rate from m)
select l as line, mode, covered, blocked, rate, not blocked and {_DRAW} < rate as sampled from b""")
def decision_gate(spark, d):
    """Which lines wait for a person, and which of the others are drawn for audit."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    e = _estimates(spark, d).select(line.alias("line"), oversight.classify(*map(F.col, ("harm", "reversibility", "rights", "confidence"))).alias("mode"), (F.col("l_linenumber") % 3 == 0).alias("covered"))
    return oversight.gate(e, "line")


@_register(f"with {_ESTIMATES}, m as (select *, {_MODE} as mode from e) select l_orderkey, l_linenumber, case mode when 'human_only' then 0.5 when 'human_approval' then 0.2 when 'ai_recommends' then 0.1 else 0.05 end::double as rate from m")
def tier_audit_rate(spark, d):
    """The share of audits of each line's mode."""
    mode = oversight.classify(*map(F.col, ("harm", "reversibility", "rights", "confidence")))
    e = _estimates(spark, d).select("l_orderkey", "l_linenumber", mode.alias("mode"), F.lit(True).alias("covered"))
    return oversight.gate(e, "l_orderkey").select("l_orderkey", "l_linenumber", "rate")


# -- answers under approval --------------------------------------------------------------------------------

#: Status of the customer rules: r2 is provisional, r5 waits for approval.
_STATUS = {"r1": "approved", "r2": "provisional", "r3": "approved", "r4": "approved", "r5": "pending_online"}


def answers(spark: SparkSession, d: str) -> DataFrame:
    records = [governance.Record(r, _STATUS[r.rule_id]) for r in customer_pack().rules]
    cases = customers(spark, d)
    return governance.ask(cases, "c_custkey", OBSERVABLES, records, "decline", ["decline", "approve"], F.col("c_mktsegment") == "BUILDING")


_ASKED = (
    _WORLDS
    + """, s as (select c_custkey, min(case when least(f1, 2 - mitigated) = 2 then 0.704 else 0 end) as sl, max(case when least(f1, 2 - mitigated) = 2 then 0.704 else 0 end) as su from p2 group by 1),
closed as (select c_custkey, c_mktsegment, overdrawn // 2 * 2 as overdrawn, large_exposure // 2 * 2 as large_exposure, urgent_buyer // 2 * 2 as urgent_buyer, auto_segment // 2 * 2 as auto_segment,
  overdrawn as o, large_exposure as l, urgent_buyer as u, auto_segment as m from feats),
k as (select *, least(overdrawn, large_exposure) = 2 as k1, least(urgent_buyer, 2 - auto_segment) = 2 as k2, auto_segment = 2 as k3, c_mktsegment = 'BUILDING' as critical,
  least(u, 2 - m) = 2 as b2, least(m, 2 - greatest(least(o, l), least(u, 2 - m))) = 2 as b5 from closed),
asked as (select c_custkey, critical, critical and (b2 or b5) as blocked, list_filter([case when critical and b2 then 'r2' end, case when critical and b5 then 'r5' end], lambda x: x is not null) as waits,
  case when critical then sl else lower end as lo, case when critical then su else upper end as up, k1, k2 and not critical as k2, k3, (k1 or (k2 and not critical)) and not k3 as k4
  from k join b using (c_custkey) join s using (c_custkey)),
answered as (select *, case when blocked then 'blocked_for_approval' when up < 0.2 then 'uncovered' else 'answered' end as status, case when not blocked and lo > 0.5 then 'decline' else 'human' end as decision,
  list_filter([case when k1 then 'r1' end, case when k2 then 'r2' end, case when k3 then 'r3' end, case when k4 then 'r4' end], lambda x: x is not null and not blocked) as rules from asked)"""
)


@_register(_ASKED + """ select c_custkey, critical, status, array_to_string(waits, ',') as blocked_on, case when not blocked then round(lo, 6) end as lower, case when not blocked then round(up, 6) end as upper, decision,
 array_to_string(rules, ',') as rules, case when list_contains(rules, 'r2') then 'r2' else '' end as provisional from answered""")
def ask_status(spark, d):
    """Every customer's case under approval: critical ones wait where a rule that isn't approved would fire."""
    joined = {c: F.array_join(c, ",") for c in ("blocked_on", "rules", "provisional")}
    return answers(spark, d).drop("reason", "exact").withColumns(joined | {"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@_register(_ASKED + """ select count(*) as screened, count(*) filter (decision = 'decline') as committed, count(*) filter (decision <> 'decline' and not blocked) as human_queue, count(*) filter (blocked) as blocked,
 count(*) filter (decision = 'decline') as outcome_decline, 0 as outcome_approve from answered""")
def outcome_counts(spark, d):
    return governance.outcome_counts(answers(spark, d), ["decline", "approve"])


@_register(_ASKED + " select unnest(waits) as rule_id, count(*) as waiting from answered group by 1")
def waiting_for_approval(spark, d):
    return governance.blocking(answers(spark, d))


@_register(
    _WORLDS
    + """, a as (select c_custkey, (min(case when approve = 2 then 0.85 * 0.9 else 0 end) + max(case when approve = 2 then 0.85 * 0.9 else 0 end)) / 2 as m from p2 group by 1),
x as (select c_custkey, 'decline' as outcome, (lower + upper) / 2 as m from b union all select c_custkey, 'approve', m from a)
select c_custkey, outcome, round(m, 6) as middle, row_number() over (partition by c_custkey order by round(m, 9) desc, outcome)::int as place from x"""
)
def competing_outcomes(spark, d):
    """Outcomes of each customer by the middle of their bounds."""
    df, wide = customers(spark, d), customer_pack()
    for o in ("decline", "approve"):
        df = wide.bounds(df, o, f"lower_{o}", f"upper_{o}").withColumns({f"{side}_{o}": F.round(f"{side}_{o}", 9) for side in ("lower", "upper")})
    return governance.competing(df, "c_custkey", ["decline", "approve"]).withColumn("middle", F.round("middle", 6))


@_register(_with_truth() + """ select c_custkey, array_to_string(list_filter([case when overdrawn = 1 then 'overdrawn' end, case when large_exposure = 1 then 'large_exposure' end, case when urgent_buyer = 1 then 'urgent_buyer' end,
 case when auto_segment = 1 then 'auto_segment' end, case when elevated_risk = 1 then 'elevated_risk' end, case when mitigated = 1 then 'mitigated' end, case when approve = 1 then 'approve' end, case when decline = 1 then 'decline' end], lambda x: x is not null), ',') as atoms from p2""")
def uncertain_atoms(spark, d):
    return uncertain(customer_pack(), customers(spark, d), "c_custkey").select("c_custkey", F.array_join("atoms", ",").alias("atoms"))


# -- the log -----------------------------------------------------------------------------------------------

_QUERIES = f"{_USED}, q as (select o_orderkey as query_id, o_orderpriority = '1-URGENT' as critical, case o_orderstatus when 'F' then 'answered' when 'O' then 'uncovered' else 'blocked_for_approval' end as status from orders)"


def _queries(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", governance.ANSWERED).when(F.col("o_orderstatus") == "O", governance.NOT_COVERED).otherwise(governance.BLOCKED)
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderpriority") == "1-URGENT").alias("critical"), status.alias("status"))


@_register(f"with {_QUERIES} select query_id, rule_id, 'provisional' as status from used join q using (query_id) where critical and status = 'answered' and rule_id >= 'r6'")
def invariant(spark, d):
    """Answered critical queries that used a rule which isn't approved."""
    return governance.violations(_queries(spark, d), _used(governance_log(spark, d)), _rules(spark))


@_register(f"with {_USED} select distinct query_id from used where provisional and rule_id = 'r7'")
def impact(spark, d):
    return governance.impact(_used(governance_log(spark, d)), "r7", provisional_only=True)


@_register(f"with {_QUERIES} select (select count(*) from used where rule_id < 'r6') as applications, 6 as reviews, (select count(*) from q where status = 'answered') as decisions, round((select count(*) from used where rule_id < 'r6') / 6.0, 6) as applications_per_rule, round((select count(*) from q where status = 'answered') / 6.0, 6) as decisions_per_review")
def amortisation(spark, d):
    row = governance.amortisation(_rules(spark), _queries(spark, d), _used(governance_log(spark, d)))
    return row.withColumns({c: F.round(c, 6) for c in ("applications_per_rule", "decisions_per_review")})


@_register(f"""with {_QUERIES} select 8 as rules_total, 6 as rules_approved, 2 as rules_provisional, 0 as rules_pending_online, 0 as rules_rejected, count(*) as queries_total, count(*) filter (critical) as queries_critical,
 count(*) filter (status = 'blocked_for_approval') as queries_blocked, count(*) filter (query_id in (select query_id from used where provisional)) as queries_provisional, count(*) filter (status = 'uncovered') as queries_uncovered,
 (select count(*) from used join q using (query_id) where critical and status = 'answered' and rule_id >= 'r6') as invariant_violations from q""")
def governance_summary(spark, d):
    return governance.governance_summary(_rules(spark), _queries(spark, d), _used(governance_log(spark, d)))


@_register(f"with {_USED} select rule_id, count(*) as reuse from used where rule_id < 'r6' group by 1 order by reuse desc, rule_id limit 5")
def most_reused(spark, d):
    return governance.most_reused(_rules(spark), _used(governance_log(spark, d)))


@_register(f"with {_USED}, n as (select rule_id, count(*) as reuse, case when rule_id < 'r6' then 'approved' else 'provisional' end as status from used group by 1) select rule_id, status, reuse, row_number() over (order by status, reuse desc, rule_id)::int as place from n")
def rule_rows(spark, d):
    return governance.rule_rows(_rules(spark), _used(governance_log(spark, d))).select("rule_id", "status", "reuse", "place")


@_register(f"with {_USED} select used.rule_id, count(*) filter (verdict = 1) as successes, count(*) filter (verdict = 0) as failures from used join log using (query_id) where verdict is not null group by 1")
def verdicts_by_rule(spark, d):
    """A verdict counts for every rule that its query used."""
    log = governance_log(spark, d)
    return governance.outcomes_by_rule(_used(log), log.where("verdict is not null").select("query_id", (F.col("verdict") == 1).alias("correct")))


@_register(f"""with {_QUERIES}, x as (select q.*, query_id % 3 = 0 as auto, query_id % 5 = 0 as sampled, case when query_id % 5 = 0 then query_id % 2 = 0 end as correct from q)
select count(*) filter (status = 'blocked_for_approval') as blocked, count(*) filter (status = 'uncovered') as uncovered, count(*) filter (status = 'answered') as decided, count(*) filter (status = 'answered' and auto) as automatic,
 count(*) filter (status = 'answered' and sampled) as audited, count(*) filter (status = 'answered' and correct is not null) as audit_verdicts, count(*) filter (status = 'answered' and not correct) as audits_wrong from x""")
def cycle_report(spark, d):
    n = F.col("query_id")
    return governance.cycle_report(_queries(spark, d).select("status", (n % 3 == 0).alias("took_effect"), (n % 5 == 0).alias("sampled"), F.when(n % 5 == 0, n % 2 == 0).alias("correct")))


@_register("""select count(*) as cases, count(*) filter (o_orderstatus = 'F') as by_rules, round(avg((o_orderstatus = 'F')::int), 6) as coverage, count(*) filter (o_orderstatus = 'P') as waiting, count(*) filter (o_orderkey % 10 = 0) as sampled from orders""")
def rule_coverage(spark, d):
    status = F.col("o_orderstatus")
    cases = _t(spark, d, "orders").select(F.when(status == "F", "rules").otherwise("expert").alias("decided_by"), F.when(status == "P", "waiting").otherwise("settled").alias("status"), (F.col("o_orderkey") % 10 == 0).alias("sampled"))
    return governance.coverage(cases).withColumn("coverage", F.round("coverage", 6))


_CAMPAIGN = """c as (select o_orderpriority as branch, ['review', 'held', 'shortlisted', 'hired', 'rejected'][o_orderkey % 5 + 1] as status, case when o_orderstatus = 'F' then 'review' when o_orderstatus = 'O' then 'reject' end as decision,
 case when o_custkey % 2 = 0 then 'agent' else 'human' end as origin, o_custkey % 7 = 0 as audit_pending from orders)"""


@_register(f"""with {_CAMPAIGN} select branch, count(*) as total, count(decision) as screened, count(*) filter (decision = 'review') as flagged, count(*) filter (status = 'rejected' and origin = 'agent') as agent_rejected,
 count(*) filter (status = 'review') as review, count(*) filter (status = 'held') as held, count(*) filter (status = 'shortlisted') as shortlisted, count(*) filter (status = 'hired') as hired, count(*) filter (status = 'rejected') as rejected, count(*) filter (audit_pending) as audits_pending from c group by 1""")
def campaign_stats(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("review", "held", "shortlisted", "hired", "rejected"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    decision = F.when(F.col("o_orderstatus") == "F", "review").when(F.col("o_orderstatus") == "O", "reject")
    origin = F.when(F.col("o_custkey") % 2 == 0, "agent").otherwise("human")
    c = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("branch"), status.alias("status"), decision.alias("decision"), origin.alias("origin"), (F.col("o_custkey") % 7 == 0).alias("audit_pending"))
    return governance.campaign_stats(c, "branch")


@_register("""with p as (select c_custkey as id, 'r' || (c_custkey % 12) as rule_id, c_acctbal < 0 as critical, c_custkey % 12 <> 11 as valid from customer),
s as (select 'r' || i as rule_id, ['approved', 'rejected', 'pending_online', 'provisional'][i % 4 + 1] as status from range(8) t(i))
select id, case when status is null then case when not valid then 'rejected_invalid' when critical then 'queued_online' else 'applied_provisionally' end when status = 'approved' then 'already_approved'
 when status = 'rejected' then 'already_rejected' when status = 'provisional' and critical then 'queued_online' else 'already_pending' end as outcome from p left join s using (rule_id)""")
def propose_route(spark, d):
    """Proposals against a rule table of eight rules."""
    status = F.element_at(F.array(*map(F.lit, ["approved", "rejected", "pending_online", "provisional"])), (F.col("id") % 4 + 1).cast("int"))
    rules = spark.range(8).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), status.alias("status"))
    n = F.col("c_custkey") % 12
    p = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("r"), n.cast("string")).alias("rule_id"), (F.col("c_acctbal") < 0).alias("critical"), (n != 11).alias("valid"))
    return p.join(rules, "rule_id", "left").select("id", route(F.col("status"), F.col("critical"), F.col("valid")).alias("outcome"))


# -- packs and documents -------------------------------------------------------------------------------------


def _pack():
    return load_pack(os.path.join(os.path.dirname(os.path.abspath(__file__)), "packs"), "customers")


@_register("with " + _FEATURES + """, l as (select c_custkey::varchar as entity, unnest([{'f': 'overdrawn', 't': overdrawn, 's': 'c_acctbal'}, {'f': 'large_exposure', 't': large_exposure, 's': 'exposure'}, {'f': 'urgent_buyer', 't': urgent_buyer, 's': 'urgent'}, {'f': 'auto_segment', 't': auto_segment, 's': 'c_mktsegment'}]) as x from feats)
 select entity, x.f as fact, x.t as t, x.t = 1 as missing from l""")
def pack_facts(spark, d):
    """One row for each feature of each customer, by the pack's YAML."""
    found = _pack().facts_long(customers(spark, d))
    return found.select("entity", "fact", "t", F.col("source").endswith(" not supplied").alias("missing"))


@_register("with " + _FEATURES + """ select c_custkey, coalesce(exposure >= 800000, false) or c_mktsegment in ('BUILDING', 'MACHINERY') as critical, case when exposure >= 800000 then 'large: large exposure' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'builders: building trade' else 'default' end as reason,
 case c_mktsegment when 'BUILDING' then 'approve' when 'FURNITURE' then 'decline' else c_mktsegment end as label, 'decline' as goal from feats""")
def pack_context(spark, d):
    """Whether a customer's case is critical, by which rule, and its recorded outcome."""
    pack, df = _pack(), customers(spark, d)
    flag, reason = pack.criticality(df)
    return df.select("c_custkey", flag.alias("critical"), reason.alias("reason"), pack.label(df).alias("label"), pack.context(df)["goal"].alias("goal"))


@_register("""select n_nationkey as doc, 0 as place, 'Rules of ' || n_name as heading, 'decline(A) <- poor(A), not backed(A).' as rule, 0.7::double as strength, true as readable from nation
 union all select n_nationkey, 1, 'Rules of ' || n_name, 'approve(A) <- rich(A).', 0.9, true from nation union all select n_nationkey, 2, 'Open', 'odd(A) <- not rich(A).', 0.9, false from nation""")
def policy_scan(spark, d):
    """Annotated rules in one document for each nation; the last one can't be read."""
    text = F.concat(F.lit("# Rules of "), F.col("n_name"), F.lit("\ntext <!-- rule: decline(A) <- poor(A),\n not backed(A). | p=0.7 --> and <!-- rule: approve(A) <- rich(A) -->\n## Open\n<!-- rule: odd(A) <- not rich(A). -->"))
    found = policy_rules(_t(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), text.alias("text")), "doc")
    return found.select("doc", "place", "heading", F.regexp_replace("rule", r"\s+", " ").alias("rule"), "strength", F.col("problem").isNull().alias("readable"))
