"""Registered queries of the rule engine over the star-schema tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.functions.truth import draw, feature, first_match, posterior
from ruleweave.operators.decisions import running_total
from ruleweave.operators.mining import candidates, examples, mine
from ruleweave.operators.relational import evaluate
from ruleweave.operators.wide import Wide, check, check_cases
from ruleweave.sources.rule_text import parse_program

#: Thresholds of the customer pack; repeated in the SQL.
LARGE = 400_000
CUSTOMER_RULES = """
rule r1 [p=0.8]  elevated_risk(A) <- overdrawn(A), large_exposure(A).
rule r2 [p=0.7]  elevated_risk(A) <- urgent_buyer(A), not auto_segment(A).
rule r3 [p=0.9]  mitigated(A) <- auto_segment(A).
rule r4 [p=0.88] decline(A) <- elevated_risk(A), not mitigated(A).
rule r5 [p=0.85] approve(A) <- mitigated(A), not elevated_risk(A).
"""
OBSERVABLES = ["overdrawn", "large_exposure", "urgent_buyer", "auto_segment"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customer_pack() -> Wide:
    return Wide(parse_program(CUSTOMER_RULES)[0], OBSERVABLES)


def customers(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with its observables; without pending orders its exposure, without orders its urgency is unknown."""
    orders = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("exposure"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    df = _t(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.select(
        "c_custkey",
        "c_mktsegment",
        "c_acctbal",
        "exposure",
        "urgent",
        feature(F.col("c_acctbal"), "lt", 0.0).alias("overdrawn"),
        feature(F.col("exposure"), "gte", float(LARGE)).alias("large_exposure"),
        feature(F.col("urgent"), "truthy").alias("urgent_buyer"),
        feature(F.col("c_mktsegment"), "eq", "AUTOMOBILE").alias("auto_segment"),
    )


_FEATURES = f"""
feats as (select c_custkey, c_mktsegment, c_acctbal, exposure, urgent,
  case when c_acctbal is null then 1 when c_acctbal < 0 then 2 else 0 end::int as overdrawn,
  case when exposure is null then 1 when exposure >= {LARGE} then 2 else 0 end::int as large_exposure,
  case when urgent is null then 1 when urgent then 2 else 0 end::int as urgent_buyer,
  case when c_mktsegment is null then 1 when c_mktsegment = 'AUTOMOBILE' then 2 else 0 end::int as auto_segment
 from customer left join (select o_custkey, sum(case when o_orderstatus = 'P' then o_totalprice end) as exposure, bool_or(o_orderpriority = '1-URGENT') as urgent from orders group by 1) on c_custkey = o_custkey)"""
_TRUTH = """
t1 as (select *, least(overdrawn, large_exposure) as f1, least(urgent_buyer, 2 - auto_segment) as f2 from {src}),
t2 as (select *, greatest(f1, f2) as elevated_risk, auto_segment as mitigated from t1),
t3 as (select *, least(elevated_risk, 2 - mitigated) as decline, least(mitigated, 2 - elevated_risk) as approve from t2),
p1 as (select *, 1 - (1 - case when f1 = 2 then 0.8 else 0 end) * (1 - case when f2 = 2 then 0.7 else 0 end) as p_risk from t3),
p2 as (select *, case when decline = 2 then 0.88 * p_risk else 0 end as p_decline from p1)"""


def _with_truth(src: str = "feats") -> str:
    return "with " + _FEATURES + "," + _TRUTH.format(src=src)


#: All completions of the unknowns: the brute-force reading of bounds.
_WORLDS = (
    "with "
    + _FEATURES
    + """,
bits as (select unnest([0, 2]) as b),
worlds as (select f.c_custkey, a.b as overdrawn, b.b as large_exposure, c.b as urgent_buyer, d.b as auto_segment
 from feats f, bits a, bits b, bits c, bits d
 where (f.overdrawn = 1 or a.b = f.overdrawn) and (f.large_exposure = 1 or b.b = f.large_exposure)
   and (f.urgent_buyer = 1 or c.b = f.urgent_buyer) and (f.auto_segment = 1 or d.b = f.auto_segment)),"""
    + _TRUTH.format(src="worlds")
    + ", b as (select c_custkey, min(p_decline) as lower, max(p_decline) as upper from p2 group by 1)"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_register("with " + _FEATURES + " select c_custkey, overdrawn, large_exposure, urgent_buyer, auto_segment from feats")
def feature_ops(spark, d):
    return customers(spark, d).select("c_custkey", *OBSERVABLES)


@_register("""select o_orderkey, (o_totalprice >= 300000 or o_orderpriority = '1-URGENT') as critical,
 case when o_totalprice >= 300000 then 'large: large order' when o_orderpriority = '1-URGENT' then 'urgent: urgent order' else 'default' end as reason from orders""")
def criticality(spark, d):
    large, urgent = F.col("o_totalprice") >= 300000, F.col("o_orderpriority") == "1-URGENT"
    return _t(spark, d, "orders").select("o_orderkey", first_match([(large, True), (urgent, True)], False).alias("critical"), first_match([(large, "large: large order"), (urgent, "urgent: urgent order")], "default").alias("reason"))


@_register(_with_truth() + " select c_custkey, elevated_risk::int as elevated_risk, mitigated::int as mitigated, decline::int as decline, approve::int as approve from p2")
def kleene_evaluation(spark, d):
    return customer_pack().truth(customers(spark, d)).select("c_custkey", "elevated_risk", "mitigated", "decline", "approve")


@_register(_with_truth() + " select c_custkey, round(p_risk, 6) as p_risk, round(p_decline, 6) as p_decline from p2")
def noisy_or_chain(spark, d):
    """An unknown premise supports nothing."""
    t = customer_pack().probability(customers(spark, d))
    return t.select("c_custkey", F.round("p_elevated_risk", 6).alias("p_risk"), F.round("p_decline", 6).alias("p_decline"))


@_register(_WORLDS + " select c_custkey, round(lower, 6) as lower, round(upper, 6) as upper from b")
def bounds(spark, d):
    df = customer_pack().bounds(customers(spark, d).select("c_custkey", *OBSERVABLES), "decline")
    return df.select("c_custkey", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@_register(_WORLDS + " select count(*) as cases, count(*) filter (upper < 0.2) as uncovered, count(*) filter (lower > 0.5) as committed, count(*) filter (lower <= 0.5 and upper > 0.5) as open_cases from b")
def uncovered_and_commit(spark, d):
    b = customer_pack().bounds(customers(spark, d).select("c_custkey", *OBSERVABLES), "decline")
    return b.agg(F.count("*").alias("cases"), F.count_if(F.col("upper") < 0.2).alias("uncovered"), F.count_if(F.col("lower") > 0.5).alias("committed"), F.count_if((F.col("lower") <= 0.5) & (F.col("upper") > 0.5)).alias("open_cases"))


def _voi_sql() -> str:
    parts = []
    for o in OBSERVABLES:
        w = lambda v, o=o: f"(select c_custkey, min(p_decline) as l, max(p_decline) as u from p2 where {o} = {v} group by 1)"
        parts.append(f"select b.c_custkey, '{o}' as question, ((t.l > 0.5) <> (f.l > 0.5) or (t.u > 0.5) <> (f.u > 0.5)) as decisive, round(greatest(0, b.upper - b.lower - (t.u - t.l + f.u - f.l) / 2), 6) as gain from b join {w(2)} t using (c_custkey) join {w(0)} f using (c_custkey) join feats using (c_custkey) where feats.{o} = 1")
    return _WORLDS + ", q as (" + " union all ".join(parts) + ") select c_custkey, question, decisive, gain, row_number() over (partition by c_custkey order by not decisive, gain desc, question)::int as rank from q where decisive or gain > 1e-6"


@_register(_voi_sql())
def voi_rank(spark, d):
    return customer_pack().questions(customers(spark, d), "decline", "c_custkey").withColumn("gain", F.round("gain", 6))


_FLIP = " union all ".join(f"select c_custkey, '{o}' as fact, " + ", ".join(f"2 - {x} as {x}" if x == o else x for x in OBSERVABLES) + f" from feats where {o} <> 1" for o in OBSERVABLES)


@_register("with " + _FEATURES + f""", flips as ({_FLIP}),
b as (select c_custkey, (greatest(least(overdrawn, large_exposure), least(urgent_buyer, 2 - auto_segment)) = 2 and auto_segment = 0) as was from feats),
n as (select c_custkey, fact, (greatest(least(overdrawn, large_exposure), least(urgent_buyer, 2 - auto_segment)) = 2 and auto_segment = 0) as now from flips)
select c_custkey, fact from n join b using (c_custkey) where was <> now""")
def counterfactual(spark, d):
    return customer_pack().counterfactuals(customers(spark, d), "decline", "c_custkey")


@_register(_with_truth() + " select c_mktsegment, count(*) filter (f1 = 2) as used_r1, count(*) filter (f1 = 1) as blocked_r1, count(*) filter (f2 = 2) as used_r2, count(*) filter (f2 = 1) as blocked_r2, count(*) filter (decline = 1) as decline_unknown from p2 group by 1")
def rules_used_and_blocked(spark, d):
    t = customer_pack().truth(customers(spark, d))
    n = lambda c, v, name: F.count_if(F.col(c) == v).alias(name)
    return t.groupBy("c_mktsegment").agg(n("fired_r1", 2, "used_r1"), n("fired_r1", 1, "blocked_r1"), n("fired_r2", 2, "used_r2"), n("fired_r2", 1, "blocked_r2"), n("decline", 1, "decline_unknown"))


@_register("""with bits as (select unnest([0, 2]) as b),
i as (select a.b as o, b.b as l, c.b as u, d.b as m from bits a, bits b, bits c, bits d),
e as (select *, least(o, l) as f1, least(u, 2 - m) as f2 from i),
x as (select *, greatest(f1, f2) as er, m as f3, least(greatest(f1, f2), 2 - m) as f4, least(m, 2 - greatest(f1, f2)) as f5 from e),
v as (select *, least(f2, 2 - m) as d1, least(m, 2 - f2) as a1, least(f1, 2 - m) as d2, least(m, 2 - f1) as a2, er as d3, 0 as a3 from x)
select r.id as rule_id, r.n as fired, r.n = 0 as dead, (r.n > 0 and r.c = 0) as redundant, r.k as contradictions from (
 select unnest([{'id':'r1','n':count(*) filter (f1=2),'c':count(*) filter (d1<>f4 or a1<>f5),'k':count(*) filter (f4=2 and f5=2)},
 {'id':'r2','n':count(*) filter (f2=2),'c':count(*) filter (d2<>f4 or a2<>f5),'k':count(*) filter (f4=2 and f5=2)},
 {'id':'r3','n':count(*) filter (f3=2),'c':count(*) filter (d3<>f4 or a3<>f5),'k':count(*) filter (f4=2 and f5=2)},
 {'id':'r4','n':count(*) filter (f4=2),'c':count(*) filter (f4<>0),'k':count(*) filter (f4=2 and f5=2)},
 {'id':'r5','n':count(*) filter (f5=2),'c':count(*) filter (f5<>0),'k':count(*) filter (f4=2 and f5=2)}]) as r from v)""")
def rule_base_check(spark, d):
    return check(spark, customer_pack(), ["decline", "approve"])


@_register(
    "select c.*, n.cases, n.open_cases, n.contradictory_cases from ("
    + SQL["rule_base_check"]
    + ") c join (select unnest(["
    + ", ".join(f"{{'rule_id': '{r}', 'cases': count(*) filter ({t} = 2), 'open_cases': count(*) filter ({t} = 1), 'contradictory_cases': count(*) filter (decline = 2 and approve = 2)}}" for r, t in zip("r1 r2 r3 r4 r5".split(), "f1 f2 mitigated decline approve".split(), strict=True))
    + "]) as n from ("
    + _with_truth()
    + " select * from p2)) on n.rule_id = c.rule_id"
)
def rule_base_check_cases(spark, d):
    """The exhaustive check with the customers that each finding concerns."""
    pack, outcomes = customer_pack(), ["decline", "approve"]
    return check_cases(pack, check(spark, pack, outcomes), customers(spark, d), outcomes)


@_register("""with s as (select distinct l_orderkey as c, l_suppkey as s from lineitem where l_returnflag = 'R')
select c_nationkey as nation, count(*) as pairs from s join orders on c = o_orderkey join customer on o_custkey = c_custkey join supplier on s = s_suppkey and s_nationkey = c_nationkey group by 1""")
def rule_join(spark, d):
    """local_return(C, N) <- returned(C, S), buyer(C, N), seller(S, N), with the order as C; one case."""
    case = F.lit(0).alias("case_id")
    t = F.lit(2).alias("t")
    lines = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(case, F.col("l_orderkey").alias("a0"), F.col("l_suppkey").alias("a1"), t).distinct()
    buyers = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(case, F.col("o_orderkey").alias("a0"), F.col("c_nationkey").alias("a1"), t)
    sellers = _t(spark, d, "supplier").select(case, F.col("s_suppkey").alias("a0"), F.col("s_nationkey").alias("a1"), t)
    rules, _ = parse_program("local_return(C, S, N) <- returned(C, S), buyer(C, N), seller(S, N).")
    found = evaluate(rules, {"returned/2": lines, "buyer/2": buyers, "seller/2": sellers})["local_return/3"]
    return found.groupBy(F.col("a2").alias("nation")).agg(F.count("*").alias("pairs"))


@_register("""select x.conv_id, x.turn, y.turn as reached from (select distinct conv_id, turn from conversations) x join (select distinct conv_id, turn from conversations) y on x.conv_id = y.conv_id and x.turn < y.turn""")
def closure(spark, d):
    """Recursive rules over the chain of turns of each conversation; the conversation is the case."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = _t(spark, d, "conversations").select("conv_id", "turn").distinct()
    edges = turns.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("a0"), F.lead("turn").over(w).alias("a1"), F.lit(2).alias("t")).where("a1 is not null")
    rules, _ = parse_program("reach(X, Y) <- next(X, Y). reach(X, Z) <- reach(X, Y), reach(Y, Z).")
    found = evaluate(rules, {"next/2": edges})["reach/2"]
    return found.select(F.col("case_id").alias("conv_id"), F.col("a0").alias("turn"), F.col("a1").alias("reached"))


@_register("""with l as (select d.doc_id, case when quality is null then 1 when quality = 1 then 2 else 0 end as good, case when toxic is null then 1 when toxic = 1 then 2 else 0 end as toxic from documents d left join labels l on d.doc_id = l.doc_id)
select doc_id, least(good, 2 - toxic)::int as suitable from l where least(good, 2 - toxic) > 0""")
def negation_three_valued(spark, d):
    """suitable(D) <- good(D), not toxic(D); a document without a label is unknown in both."""
    docs = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    rel = lambda c: docs.select(F.lit(0).alias("case_id"), F.col("doc_id").alias("a0"), feature(F.col(c), "eq", 1).alias("t"))
    rules, _ = parse_program("suitable(D) <- good(D), not toxic(D).")
    found = evaluate(rules, {"good/1": rel("quality"), "toxic/1": rel("toxic")}, {"good/1", "toxic/1"})["suitable/1"]
    return found.select(F.col("a0").alias("doc_id"), F.col("t").alias("suitable"))


@_register("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def negation_two_valued(spark, d):
    """idle(C) <- customer(C), not pending(C), where nothing is unknown."""
    case, t = F.lit(0).alias("case_id"), F.lit(2).alias("t")
    all_ = _t(spark, d, "customer").select(case, F.col("c_custkey").alias("a0"), t)
    pending = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(case, F.col("o_custkey").alias("a0"), t).distinct()
    rules, _ = parse_program("idle(C) <- customer(C), not pending(C).")
    return evaluate(rules, {"customer/1": all_, "pending/1": pending})["idle/1"].select(F.col("a0").alias("c_custkey"))


#: A governance log derived from the orders: each order is a query answered by rule r<custkey mod 8>.
_LOG = """log as (select o_orderkey as query_id, 'r' || (o_custkey % 8) as rule_id, o_orderpriority = '1-URGENT' as critical, o_custkey % 8 >= 6 as provisional,
 case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end as verdict from orders)"""


def governance_log(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.concat(F.lit("r"), (F.col("o_custkey") % 8).cast("string")).alias("rule_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("critical"),
        (F.col("o_custkey") % 8 >= 6).alias("provisional"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("verdict"),
    )


def rule_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("rule_id").agg(F.count("*").alias("reuse"), F.count_if(F.col("verdict") == 1).alias("successes"), F.count_if(F.col("verdict") == 0).alias("failures"))


_STATS = f"with {_LOG}, s as (select rule_id, count(*) as reuse, count(*) filter (verdict = 1) as successes, count(*) filter (verdict = 0) as failures from log group by 1)"


@_register(_STATS + " select rule_id, successes, failures, round((1 + successes) / (2.0 + successes + failures), 6) as posterior from s")
def outcome_feedback(spark, d):
    return rule_stats(governance_log(spark, d)).select("rule_id", "successes", "failures", F.round(posterior(F.col("successes"), F.col("failures")), 6).alias("posterior"))


@_register(_STATS + " select rule_id, reuse, row_number() over (order by reuse desc, rule_id)::int as place from s")
def review_queue(spark, d):
    return rule_stats(governance_log(spark, d)).select("rule_id", "reuse", F.row_number().over(Window.orderBy(F.col("reuse").desc(), "rule_id")).alias("place"))


@_register(_STATS + " select rule_id from s where successes + failures >= 8 and 0.8 - (1 + successes) / (2.0 + successes + failures) >= 0.2")
def rereview(spark, d):
    s = rule_stats(governance_log(spark, d))
    return s.where((F.col("successes") + F.col("failures") >= 8) & (0.8 - posterior(F.col("successes"), F.col("failures")) >= 0.2)).select("rule_id")


@_register("""select o_orderkey, (('0x' || substr(sha256('audit-v1:' || o_orderkey::varchar), 1, 16))::ubigint::double / 18446744073709551616.0) < 0.1 as sampled from orders""")
def audit_sample(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", (draw("audit-v1", F.col("o_orderkey")) < 0.1).alias("sampled"))


def _mine_ctes() -> str:
    """All bodies of up to three literals over observables that vary, in the order of mining."""
    lits = [(o, n) for o in sorted(OBSERVABLES) for n in (False, True)]
    name, cond = (lambda x: f"not {x[0]}" if x[1] else x[0]), (lambda x: f"{x[0]} = {0 if x[1] else 2}")
    bodies = [b for k in (1, 2, 3) for b in combinations(lits, k) if len({x[0] for x in b}) == k]
    varies = lambda o: f"(select count(*) filter ({o} = 2) between 1 and count(*) - 1 from feats)"
    each = " union all ".join(
        f"select {i} as n, {len(b)} as k, {[name(x) for x in b]} as lits, count(*) filter ({' and '.join(map(cond, b))}) as support, count(*) filter ({' and '.join(map(cond, b))} and c_acctbal > 5000) as hits from feats where {' and '.join(varies(o) for o, _ in b)}" for i, b in enumerate(bodies)
    )
    return "with " + _FEATURES + f", c as ({each}), base as (select avg((c_acctbal > 5000)::int) as b from feats), r as (select *, hits / support as p, row_number() over (order by hits / support desc, support desc, k, n)::int as place from c, base where support >= 20 and hits / support >= 0.5 and hits / support - b >= 0.02)"


def _mining_cases(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).withColumn("rich", F.col("c_acctbal") > 5000)


@_register(_mine_ctes() + " select array_to_string(lits, ', ') as body, support, hits, round(p, 6) as precision, place from r")
def mined_rules(spark, d):
    return mine(_mining_cases(spark, d), OBSERVABLES, "rich", precision=0.5, lift=0.02).withColumn("precision", F.round("precision", 6))


@_register(_mine_ctes() + " select array_to_string(lits, ', ') as body, support, hits, round(p, 6) as precision, row_number() over (order by place)::int as place from r where not exists (select 1 from r q where q.place < r.place and list_has_all(r.lits, q.lits))")
def mined_rules_unsubsumed(spark, d):
    return mine(_mining_cases(spark, d), OBSERVABLES, "rich", pruned=True, precision=0.5, lift=0.02).withColumn("precision", F.round("precision", 6))


def _literal_rows() -> str:
    return " union all ".join(f"select c_custkey, '{name}{o}' as lit, c_acctbal > 5000 as rich from feats where {o} = {t}" for o in OBSERVABLES for name, t in (("", 2), ("not ", 0)))


@_register(
    _mine_ctes()
    + f""", lit as ({_literal_rows()}),
b as (select array_to_string(lits, ', ') as body, unnest(lits) as lit, len(lits) as k from r where place <= 3),
h as (select body, c_custkey, bool_or(rich) as rich from b join lit using (lit) group by body, c_custkey, k having count(*) = k)
select body, c_custkey, coalesce(rich, false) as example from h qualify row_number() over (partition by body, coalesce(rich, false) order by c_custkey) <= 5"""
)
def mined_examples(spark, d):
    """Of the three best mined bodies the first five customers that speak for each, and the first five against it."""
    cases = _mining_cases(spark, d)
    return examples(cases, "c_custkey", "rich", candidates(cases, OBSERVABLES, "rich", precision=0.5, lift=0.02)[:3])


@_register(_with_truth() + " select c_mktsegment, round(avg((decline = 2)::int), 6) as decline_rate, count(*) as cases from p2 group by 1")
def subgroup_disparity(spark, d):
    t = customer_pack().truth(customers(spark, d))
    return t.groupBy("c_mktsegment").agg(F.round(F.avg((F.col("decline") == 2).cast("int")), 6).alias("decline_rate"), F.count("*").alias("cases"))


@_register(f"with {_LOG} select rule_id, query_id, sum(provisional::int) over (partition by rule_id order by query_id rows unbounded preceding)::bigint as reviews from log")
def running_cost(spark, d):
    log = governance_log(spark, d)
    return running_total(log, "rule_id", "query_id", F.col("provisional").cast("long"), "reviews").select("rule_id", "query_id", "reviews")


from ruleweave import decision_queries as _more  # noqa: E402, F401  registers its queries here
from ruleweave import governance_queries as _governance  # noqa: E402, F401
from ruleweave import relation_queries as _relations  # noqa: E402, F401
from ruleweave import lifecycle_queries as _lifecycle  # noqa: E402, F401
from ruleweave import world_queries as _worlds  # noqa: E402, F401
from ruleweave import proof_queries as _proofs  # noqa: E402, F401
from ruleweave import variant_queries as _variants  # noqa: E402, F401
from ruleweave import waiting_queries as _waiting  # noqa: E402, F401
