"""Registered queries on relational programs: unrecorded atoms, joins inside a case, readings of negation, probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.truth import feature_of
from ruleweave.operators.relational import Program, evaluate, unknowns_blocking
from ruleweave.queries import _register, _t
from ruleweave.sources.rule_text import parse_program

def _one_case():
    return F.lit(0).alias("case_id")


def _true():
    return F.lit(2).alias("t")


def _rules(text: str):
    return parse_program(text)[0]


@_register("""select d.doc_id, case when l.doc_id is null then 1 else 2 end as fit from documents d left join labels l on d.doc_id = l.doc_id where d.lang = 'en' and (l.doc_id is null or l.quality = 1)""")
def absent_askable(spark, d):
    """fit(D) <- english(D), checked(D): a document without a record of checked is unknown, as one can ask."""
    docs = _t(spark, d, "documents").where("lang = 'en'").select(_one_case(), F.col("doc_id").alias("a0"), _true())
    labels = _t(spark, d, "labels")
    checked = labels.select(_one_case(), F.col("doc_id").alias("a0"), feature_of(labels, "quality", "eq", 1).alias("t"))
    found = evaluate(_rules("fit(D) <- english(D), checked(D)."), {"english/1": docs, "checked/1": checked}, {"checked/1"})["fit/1"]
    return found.select(F.col("a0").alias("doc_id"), F.col("t").alias("fit"))


@_register("""with s as (select distinct l_suppkey as s, l_partkey as p from lineitem) select x.s as supplier, count(distinct y.s) as shares from s x join s y on x.p = y.p group by 1""")
def self_join(spark, d):
    """shares(A, B) <- supplies(A, P), supplies(B, P)."""
    supplies = _t(spark, d, "lineitem").select(_one_case(), F.col("l_suppkey").alias("a0"), F.col("l_partkey").alias("a1"), _true())
    found = Program(_rules("shares(A, B) <- supplies(A, P), supplies(B, P)."), large_cases=True).evaluate({"supplies/2": supplies})["shares/2"]
    return found.groupBy(F.col("a0").alias("supplier")).agg(F.count("*").alias("shares"))


@_register("""select distinct x.l_orderkey as order_id, x.l_linenumber as returned, y.l_linenumber as cheap from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey where x.l_returnflag = 'R' and y.l_discount >= 0.09""")
def product_in_case(spark, d):
    """both(X, Y) <- returned(X), cheap(Y): the literals share no variable, so all pairs of lines of one order."""
    lines = _t(spark, d, "lineitem")
    rel = lambda where: lines.where(where).select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("a0"), _true())
    found = evaluate(_rules("both(X, Y) <- returned(X), cheap(Y)."), {"returned/1": rel("l_returnflag = 'R'"), "cheap/1": rel("l_discount >= 0.09")})["both/2"]
    return found.select(F.col("case_id").alias("order_id"), F.col("a0").alias("returned"), F.col("a1").alias("cheap"))


@_register("""select n_nationkey as nation, 2 as calm from nation where n_nationkey not in (select c_nationkey from customer join orders on c_custkey = o_custkey where o_totalprice > 480000 and o_orderpriority = '1-URGENT' and o_orderstatus = 'P')""")
def ground_negation(spark, d):
    """calm(all) <- not pressed(order): one case for each nation."""
    cases = _t(spark, d, "nation").select(F.col("n_nationkey").alias("case_id"))
    big = _t(spark, d, "orders").where("o_totalprice > 480000 and o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pressed = big.select(F.col("c_nationkey").alias("case_id"), F.lit("order").alias("a0"), _true()).distinct()
    found = Program(_rules("calm(all) <- not pressed(order)."), cases=cases).evaluate({"pressed/1": pressed})["calm/1"]
    return found.select(F.col("case_id").alias("nation"), F.col("t").alias("calm"))


@_register("""select o_orderkey, 2 as price_truthy, 2 as priority_truthy, 1 as price_above_text, case when o_orderpriority like '%URGENT%' then 2 else 0 end as urgent,
 0 as price_is_text, 2 as status_not_number, case when o_orderstatus in ('F', 'P') then 2 else 0 end as settled, 1 as no_field from orders""")
def feature_types(spark, d):
    """Operators over fields whose type doesn't fit: no order is missing, and no equality is false."""
    o = _t(spark, d, "orders")
    f = lambda *a: feature_of(o, *a)
    return o.select(
        "o_orderkey",
        f("o_totalprice", "truthy").alias("price_truthy"),
        f("o_orderpriority", "truthy").alias("priority_truthy"),
        f("o_totalprice", "gt", "many").alias("price_above_text"),
        f("o_orderpriority", "contains", "URGENT").alias("urgent"),
        f("o_totalprice", "eq", "many").alias("price_is_text"),
        f("o_orderstatus", "ne", 1).alias("status_not_number"),
        f("o_orderstatus", "in", ["F", "P", 3]).alias("settled"),
        f("nothing", "eq", 1).alias("no_field"),
    )


@_register("""select d.doc_id, case when l.doc_id is null then 1 else 2 end as suitable from documents d left join labels l on d.doc_id = l.doc_id where d.lang = 'de' and coalesce(l.toxic, 0) <> 1""")
def open_world_negation(spark, d):
    """suitable(D) <- german(D), not toxic(D) where what isn't recorded is unknown."""
    docs = _t(spark, d, "documents").where("lang = 'de'").select(_one_case(), F.col("doc_id").alias("a0"), _true())
    labels = _t(spark, d, "labels")
    toxic = labels.select(_one_case(), F.col("doc_id").alias("a0"), feature_of(labels, "toxic", "eq", 1).alias("t"))
    found = evaluate(_rules("suitable(D) <- german(D), not toxic(D)."), {"german/1": docs, "toxic/1": toxic}, open_world=True)["suitable/1"]
    return found.select(F.col("a0").alias("doc_id"), F.col("t").alias("suitable"))


def _labelled(spark, d) -> tuple[Program, dict[str, DataFrame]]:
    """suitable and flagged documents; without a label good and toxic are unknown."""
    docs = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    rel = lambda c: docs.select(_one_case(), F.col("doc_id").alias("a0"), feature_of(docs, c, "eq", 1).alias("t"))
    program = Program(_rules("rule s1 suitable(D) <- good(D), not toxic(D). rule s2 flagged(D) <- toxic(D)."), {"good/1", "toxic/1"})
    return program, program.evaluate({"good/1": rel("quality"), "toxic/1": rel("toxic")})


@_register("""with l as (select d.doc_id, case when quality is null then 1 when quality = 1 then 2 else 0 end as g, case when toxic is null then 1 when toxic = 1 then 2 else 0 end as x from documents d left join labels l on d.doc_id = l.doc_id),
s as (select 's1' as rule_id, least(g, 2 - x) as t from l union all select 's2', x from l) select rule_id, count(*) filter (t = 2) as supports, count(*) filter (t = 1) as blocked from s group by 1""")
def supports_and_blocked(spark, d):
    program, found = _labelled(spark, d)
    return program.supports(found).groupBy("rule_id").agg(F.count_if(F.col("t") == 2).alias("supports"), F.count_if(F.col("t") == 1).alias("blocked"))


@_register("""select 'suitable(' || d.doc_id || ')' as goal, x || '(' || d.doc_id || ')' as unknown from documents d left join labels l on d.doc_id = l.doc_id, (select unnest(['good', 'toxic']) as x) where l.doc_id is null""")
def what_blocks(spark, d):
    """The unknowns below each goal that is neither true nor false."""
    program, found = _labelled(spark, d)
    supports = program.supports(found)
    goals = found["suitable/1"].where("t = 1").select("case_id", F.concat(F.lit("suitable("), F.col("a0").cast("string"), F.lit(")")).alias("goal"))
    return unknowns_blocking(supports, goals).select("goal", "unknown")


@_register("""with s as (select distinct l_orderkey as o, l_suppkey as s from lineitem), r as (select o, 1 - product(1 - 0.6 * (0.5 + (s % 50) / 100.0)) as p from s where s % 3 = 0 group by 1)
select o as order_id, round(p, 6) as late, round(0.9 * p, 6) as alarm from r join orders on o = o_orderkey where o_orderpriority <> '5-LOW' union all
select o, round(p, 6), null from r join orders on o = o_orderkey where o_orderpriority = '5-LOW'""")
def relational_probability(spark, d):
    """late(O) <- line(O, S), slow(S) with a confidence for each slow supplier; alarm(O) <- late(O), not minor(O)."""
    lines = _t(spark, d, "lineitem").select(_one_case(), F.col("l_orderkey").alias("a0"), F.col("l_suppkey").alias("a1"), _true()).distinct()
    slow = _t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(_one_case(), F.col("s_suppkey").alias("a0"), _true(), (0.5 + (F.col("s_suppkey") % 50) / 100.0).alias("p"))
    minor = _t(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(_one_case(), F.col("o_orderkey").alias("a0"), _true())
    program = Program(_rules("rule a [p=0.6] late(O) <- line(O, S), slow(S). rule b [p=0.9] alarm(O) <- late(O), not minor(O)."))
    p = program.probabilities(program.evaluate({"line/2": lines, "slow/1": slow, "minor/1": minor}))
    late, alarm = (p[f"{x}/1"].select(F.col("a0").alias("order_id"), F.round("p", 6).alias(x)) for x in ("late", "alarm"))
    return late.join(alarm, "order_id", "left")
