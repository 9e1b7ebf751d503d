"""Registered queries on evaluated cases: commitment, near misses, replay, blocking rules, samples, rule probabilities."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ruleweave.operators.decisions import blocking_rules, caution, facts_long, fnv1a, head_probability, near_misses, replay, screening, screening_status, systematic_sample
from ruleweave.operators.explain import proof_steps
from ruleweave.operators.wide import Wide
from ruleweave.plans.generalise import candidates
from ruleweave.queries import _FEATURES, _WORLDS, OBSERVABLES, _register, _t, _with_truth, customer_pack, customers
from ruleweave.sources.rule_text import parse_program
from ruleweave.streaming.screening import screen


@_register("with " + _FEATURES + " " + " union all ".join(f"select c_custkey, '{o}' as fact, {o} as t from feats" for o in OBSERVABLES))
def facts_from_record(spark, d):
    return facts_long(customers(spark, d), "c_custkey", OBSERVABLES)


@_register(
    _WORLDS
    + """, a as (select c_custkey, min(case when approve = 2 then 0.85 * 0.9 else 0 end) as low from p2 group by 1)
 select c_custkey, case when b.lower > 0.5 then 'decline' when a.low > 0.5 then 'approve' else 'human' end as decision from b join a using (c_custkey)"""
)
def commit_rule(spark, d):
    return screen(customer_pack(), customers(spark, d), "c_custkey", ["decline", "approve"]).select("c_custkey", "decision")


_PREMISES = [("r1", "elevated_risk", "overdrawn = 2", "large_exposure = 2"), ("r2", "elevated_risk", "urgent_buyer = 2", "auto_segment = 0"), ("r3", "mitigated", "auto_segment = 2"), ("r4", "decline", "elevated_risk = 2", "mitigated = 0"), ("r5", "approve", "mitigated = 2", "elevated_risk = 0")]
_NEAR = " union all ".join(f"select c_custkey, '{i}' as rule_id, '{head}' as head, {' + '.join(f'({x})::int' for x in held)} as satisfied, {len(held)} as n from p2 where {head} <> 2" for i, head, *held in _PREMISES)


@_register(
    _with_truth()
    + f""", m as ({_NEAR}) select c_custkey, rule_id, head, satisfied::int as satisfied, (n - satisfied)::int as missing,
 row_number() over (partition by c_custkey order by n - satisfied, -satisfied, head, rule_id)::int as place from m where satisfied >= 1 and n - satisfied between 1 and 2"""
)
def near_miss(spark, d):
    return near_misses(customer_pack(), customers(spark, d), "c_custkey").drop("open")


_REPLAYED = """select count(*) as evidence, count(*) filter (was and now) as keeps, count(*) filter (not was and now and not against) as gains,
 count(*) filter (was and not now) as losses, count(*) filter (not was and now and against) as conflicts"""


@_register(_with_truth() + ", x as (select decline = 2 as was, least(f2, 2 - mitigated) = 2 as now, c_acctbal < -500 as against from p2) " + _REPLAYED + " from x")
def rule_replay(spark, d):
    """Decisions without r1 against those with all rules, where an approval is recorded for the deeply overdrawn."""
    pack = customer_pack()
    without = Wide([r for r in pack.rules if r.rule_id != "r1"], OBSERVABLES)
    return replay(pack, without, customers(spark, d), "decline", F.when(F.col("c_acctbal") < -500, "approve"))


@_register(_with_truth() + " select c_custkey, 'r2' as rule_id from p2 where f2 = 2 union all select c_custkey, 'r5' from p2 where approve = 2")
def rules_blocking(spark, d):
    return blocking_rules(customer_pack(), customers(spark, d), "c_custkey", ["r2", "r5"])


@_register("select l_orderkey, round(1 - product(1 - 0.3 * (1 - l_discount)), 6) as probability from lineitem where l_returnflag = 'R' group by 1")
def noisy_or_heads(spark, d):
    """trouble(O) <- returned(O, L) [p=0.3], each line with 1 - discount as its confidence."""
    lines = _t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return head_probability(lines, ["l_orderkey"], 0.3 * (1 - F.col("l_discount"))).withColumn("probability", F.round("probability", 6))


@_register("select c_custkey, floor(n * 15 / 100.0) > floor((n - 1) * 15 / 100.0) as sampled from (select c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as n from customer)")
def sampled_rejections(spark, d):
    return systematic_sample(_t(spark, d, "customer"), "c_nationkey", "c_custkey", 15).select("c_custkey", "sampled")


@_register("select c_custkey, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(c_name, ''), lambda x: ascii(x)::bigint)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) as bucket_hash from customer")
def fnv_hash(spark, d):
    return _t(spark, d, "customer").select("c_custkey", fnv1a(F.col("c_name")).alias("bucket_hash"))


@_register("""select l_orderkey, l_linenumber, case when l_shipdate < o_orderdate then 'conflict' when l_discount = 0 then 'missing' when l_quantity < 10 or l_tax > 0.06 then 'mismatch' else 'match' end as reason,
 case when not (l_shipdate < o_orderdate) and l_discount <> 0 and (l_quantity < 10 or l_tax > 0.06) then 'rejected' else 'review' end as status from lineitem join orders on l_orderkey = o_orderkey""")
def screening_assessment(spark, d):
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    checks = {"quantity": F.col("l_quantity") >= 10, "tax": F.col("l_tax") <= 0.06}
    return lines.select("l_orderkey", "l_linenumber", screening(checks, F.col("l_shipdate") < F.col("o_orderdate"), F.col("l_discount") == 0).alias("reason")).withColumn("status", screening_status(F.col("reason")))


_STEPS = [("rule", "r1", "true", "f1 = 2"), ("rule", "r2", "false", "f2 = 2"), ("rule", "r4", "true", "true"), ("fact", "overdrawn", "null", "f1 = 2"), ("fact", "large_exposure", "null", "f1 = 2"), ("fact", "urgent_buyer", "null", "f2 = 2"), ("denied", "auto_segment", "null", "f2 = 2"), ("not_concluded", "mitigated", "null", "true")]


@_register(_with_truth() + " " + " union all ".join(f"select c_custkey, '{kind}' as kind, '{name}' as name, {ok}::boolean as approved from p2 where decline = 2 and {when}" for kind, name, ok, when in _STEPS))
def proof(spark, d):
    """The rules and premises that decline each declined customer, where r2 lacks approval."""
    return proof_steps(customer_pack(), customers(spark, d), "c_custkey", "decline", ("r2",))


@_register(
    "with "
    + _FEATURES
    + """, x as (select least(overdrawn, large_exposure, urgent_buyer) = 2 or least(overdrawn, large_exposure, 2 - auto_segment) = 2 as was,
  least(overdrawn, large_exposure) = 2 as now, c_acctbal < -900 as against from feats), y as ("""
    + _REPLAYED
    + """ from x) select *, 1 / 3.0::double as reach, case when conflicts > 0 then 'contradicts ' || conflicts || ' recorded decisions' when evidence < 10 then 'only ' || evidence || ' cases to test against' else 'no conflict' end as caution from y"""
)
def generalise_replay(spark, d):
    """What changes if two rules are replaced by their shared premises."""
    rules, _ = parse_program("rule g1 refer(A) <- overdrawn(A), large_exposure(A), urgent_buyer(A). rule g2 refer(A) <- overdrawn(A), large_exposure(A), not auto_segment(A).")
    found = candidates(spark, rules)[0]
    general = dataclasses.replace(found.rule, rule_id="g")
    done = replay(Wide(rules, OBSERVABLES), Wide([general], OBSERVABLES), customers(spark, d), "refer", F.when(F.col("c_acctbal") < -900, "release"))
    return caution(done, found.dropped, found.narrowest)
