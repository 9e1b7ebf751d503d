"""Registered queries on what open facts mean for programs over relations: bounds, questions, counterfactuals, whole answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.relational import Program
from ruleweave.operators.worlds import Worlds, answers
from ruleweave.queries import _register, _t
from ruleweave.sources.rule_text import parse_program
from ruleweave.sources.tables import by_case, saved

ORDER_RULES = """
rule w1 [p=0.8] risky(L) <- line(L, S), returned(L), not trusted(S).
rule w2 [p=0.9] escalate(order) <- risky(L).
rule w3 [p=0.5] calm(S) <- line(L, S), trusted(S), not returned(L).
rule w4 [p=0.6] escalate(order) <- calm(S), returned(L).
rule w5 [p=0.7] settle(order) <- calm(S).
"""


def order_program() -> Program:
    return Program(parse_program(ORDER_RULES)[0])


def order_facts(spark, d) -> dict[str, DataFrame]:
    """A case for each order: its lines with their suppliers, which were returned, and which suppliers are trusted.

    Lines that are neither returned nor accepted are open, as are suppliers with debts.
    """
    lines = _t(spark, d, "lineitem")
    items = by_case(lines.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("l"), F.col("l_suppkey").alias("s"), "l_returnflag"), lines.count())
    flag = F.max(F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("t")
    balance = F.when(F.col("s_acctbal") > 4000, 2).when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("t")
    return {
        "line/2": items.select("case_id", F.col("l").alias("a0"), F.col("s").alias("a1"), F.lit(2).alias("t")).distinct(),
        "returned/1": items.groupBy("case_id", F.col("l").alias("a0")).agg(flag),
        "trusted/1": saved(items.select("case_id", "s").distinct().join(_t(spark, d, "supplier"), F.col("s") == F.col("s_suppkey")).select("case_id", F.col("s").alias("a0"), balance)),
    }


def order_goals(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("order").alias("a0")).distinct()


def goals_of(facts) -> DataFrame:
    """The same, from the facts, which lie by case."""
    return facts["line/2"].select("case_id", F.lit("order").alias("a0")).distinct()


def _order_worlds(spark, d) -> Worlds:
    return Worlds(order_program(), order_facts(spark, d), "escalate/1", order_goals(spark, d))


_FACTS = """
line as (select distinct l_orderkey as o, l_linenumber as l, l_suppkey as s from lineitem),
ret as (select l_orderkey as o, l_linenumber as l, max(case l_returnflag when 'R' then 2 when 'N' then 1 else 0 end) as t from lineitem group by 1, 2),
tru as (select distinct l.o, l.s, case when s_acctbal > 4000 then 2 when s_acctbal < 0 then 1 else 0 end as t from line l join supplier on s = s_suppkey),
facts as (select l.o, l.l, l.s, ret.t as ret, tru.t as tru from line l join ret on ret.o = l.o and ret.l = l.l join tru on tru.o = l.o and tru.s = l.s)"""

#: All completions of each order's open facts, with the probability of escalation in each.
_WORLDS = (
    "with "
    + _FACTS
    + """,
u as (select o, atom, key, row_number() over (partition by o order by atom, key) - 1 as i from (select o, 'returned' as atom, l as key from ret where t = 1 union all select o, 'trusted', s from tru where t = 1)),
k as (select x.o, count(u.o) as k from (select distinct o from line) x left join u on u.o = x.o group by 1),
w as (select o, unnest(range(1::bigint << k)) as w from k),
f as (
  select w.o, w.w, l, s, case when ret = 1 then 2 * ((w.w >> r.i) & 1) else ret end as ret, case when tru = 1 then 2 * ((w.w >> q.i) & 1) else tru end as tru
  from facts join w on w.o = facts.o left join u r on r.o = facts.o and r.atom = 'returned' and r.key = facts.l left join u q on q.o = facts.o and q.atom = 'trusted' and q.key = facts.s),
risky as (select o, w, l, 1 - product(case when ret = 2 and tru = 0 then 0.2 else 1.0 end) as p from f group by 1, 2, 3),
calm as (select o, w, s, 1 - product(case when ret = 0 and tru = 2 then 0.5 else 1.0 end) as p from f group by 1, 2, 3),
back as (select distinct o, w, l from f where ret = 2),
p as (
  select w.o, w.w, 1 - coalesce(a.x, 1) * coalesce(b.x, 1) as p from w
  left join (select o, w, product(1 - 0.9 * p) as x from risky group by 1, 2) a on a.o = w.o and a.w = w.w
  left join (select calm.o, calm.w, product(1 - 0.6 * p) as x from calm join back on back.o = calm.o and back.w = calm.w group by 1, 2) b on b.o = w.o and b.w = w.w),
b as (select o, min(p) as lower, max(p) as upper from p group by 1)"""
)


@_register(_WORLDS + " select o as order_id, round(lower, 6) as lower, round(upper, 6) as upper, true as exact from b")
def relational_bounds(spark, d):
    """Bounds on escalating each order over all its open facts; returned and trusted act on it both ways."""
    found = _order_worlds(spark, d).bounds()
    return found.select(F.col("case_id").alias("order_id"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "exact")


@_register(
    _WORLDS
    + """,
each as (
  select p.o, u.atom || '(' || u.key || ')' as question, min(p) filter (v = 1) as t0, max(p) filter (v = 1) as t1, min(p) filter (v = 0) as f0, max(p) filter (v = 0) as f1
  from (select p.*, u.i as at, (p.w >> u.i) & 1 as v from p join u on u.o = p.o) p join u on u.o = p.o and u.i = p.at group by 1, 2),
judged as (
  select each.*, ((t0 > 0.5) <> (f0 > 0.5)) or ((t1 > 0.5) <> (f1 > 0.5)) as decisive, greatest(0, round(upper - lower - (t1 - t0 + f1 - f0) / 2, 9)) as gain from each join b on b.o = each.o),
r as (select *, row_number() over (partition by o order by not decisive, gain desc, question) as rank from judged where decisive or gain > 0.000001)
select o as order_id, question, decisive, round(gain, 6) as gain, rank::int as rank from r where rank <= 3"""
)
def relational_questions(spark, d):
    """The three open facts of each order that are most worth asking about."""
    found = _order_worlds(spark, d).questions(limit=3)
    return found.select(F.col("case_id").alias("order_id"), "question", "decisive", F.round("gain", 6).alias("gain"), "rank")


@_register(
    "with "
    + _FACTS
    + """,
known as (select o, 'line' as kind, l, s, 2 as was from line union all select o, 'returned', l, null, t from ret where t <> 1 union all select o, 'trusted', null, s, t from tru where t <> 1),
v as (
  select k.o, k.kind, k.l, k.s, k.was, f.ret as ret0, f.tru as tru0, case when kind = 'line' and k.l = f.l and k.s = f.s then 0 else 2 end as line,
    case when kind = 'returned' and k.l = f.l then 2 - ret else ret end as ret, case when kind = 'trusted' and k.s = f.s then 2 - tru else tru end as tru
  from known k join facts f on f.o = k.o),
h as (
  select o, kind, l, s, was, bool_or(ret0 = 2 and tru0 = 0) or (bool_or(ret0 = 0 and tru0 = 2) and bool_or(ret0 = 2)) as holds,
    bool_or(line = 2 and ret = 2 and tru = 0) or (bool_or(line = 2 and ret = 0 and tru = 2) and bool_or(ret = 2)) as later
  from v group by all)
select o as order_id, case kind when 'line' then 'line(' || l || ', ' || s || ')' when 'returned' then 'returned(' || l || ')' else 'trusted(' || s || ')' end as fact, was from h where holds <> later"""
)
def relational_counterfactuals(spark, d):
    """Known facts of an order whose flip alone would change whether it is escalated."""
    found = _order_worlds(spark, d).counterfactuals()
    return found.select(F.col("case_id").alias("order_id"), "fact", "was")


@_register(
    _WORLDS
    + """,
settle as (select w.o, w.w, 1 - coalesce(x, 1) as p from w left join (select o, w, product(1 - 0.7 * p) as x from calm group by 1, 2) c on c.o = w.o and c.w = w.w),
sb as (select o, min(p) as lower, max(p) as upper from settle group by 1)
select b.o as order_id, round(b.lower, 6) as escalate_lower, round(b.upper, 6) as escalate_upper, round(sb.lower, 6) as settle_lower, round(sb.upper, 6) as settle_upper, k.k as unknown, b.upper < 0.2 and sb.upper < 0.2 as uncovered
from b join sb on sb.o = b.o join k on k.o = b.o"""
)
def relational_answers(spark, d):
    """One row an order: the bounds of both outcomes, how many facts are open, and whether no outcome is in reach."""
    facts = order_facts(spark, d)
    goals = saved(goals_of(facts))
    found = answers(order_program(), facts, ["escalate/1", "settle/1"], {"escalate/1": goals, "settle/1": goals})
    of = lambda goal, side: F.round(F.get(F.filter("outcomes", lambda x: x["goal"] == f"{goal}(order)"), F.lit(0))[side], 6).alias(f"{goal}_{side}")
    open_ = F.coalesce(F.regexp_extract(F.get(F.filter("assumptions", lambda x: x.contains("unknown")), F.lit(0)), r"^\d+", 0).cast("long"), F.lit(0)).alias("unknown")
    return found.select(F.col("case_id").alias("order_id"), *(of(g, s) for g in ("escalate", "settle") for s in ("lower", "upper")), open_, "uncovered")
