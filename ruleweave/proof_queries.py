"""Registered queries on why programs over relations conclude what they do, and what they nearly conclude."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators.near import near_misses
from ruleweave.operators.proofs import proof_graph, proof_tree, provenance, tree_text
from ruleweave.operators.relational import Program, atom_text
from ruleweave.plans.rules import polarities
from ruleweave.queries import _register
from ruleweave.sources.rule_text import parse_program
from ruleweave.sources.tables import saved
from ruleweave.world_queries import _FACTS, goals_of, order_facts, order_program

_NEAR = "rule n1 dispute(L) <- line(L, S), returned(L), not trusted(S). rule n2 praise(S) <- trusted(S), line(L, S)."


@_register(
    "with "
    + _FACTS
    + """,
c as (select distinct o, c from (select o, l::varchar as c from line union all select o, s::varchar from line)),
b as (
  select x.o, x.c as x, y.c as y, line.o is not null as has_line, coalesce(rx.t, 1) = 2 as has_returned, coalesce(ty.t, 1) = 0 as distrusted, coalesce(ty.t, 1) = 2 as has_trusted
  from c x join c y on y.o = x.o left join line on line.o = x.o and line.l::varchar = x.c and line.s::varchar = y.c
  left join ret rx on rx.o = x.o and rx.l::varchar = x.c left join tru ty on ty.o = x.o and ty.s::varchar = y.c),
n as (
  select o, 'n1' as rule_id, 'dispute(' || x || ')' as head, 3 as size, has_line::int + has_returned::int + distrusted::int as satisfied,
    list_filter([case when not has_line then 'line(' || x || ', ' || y || ')' end, case when not has_returned then 'returned(' || x || ')' end, case when not distrusted then 'not trusted(' || y || ')' end], lambda z: z is not null) as missing from b
  union all
  select o, 'n2', 'praise(' || y || ')', 2, has_trusted::int + has_line::int, list_filter([case when not has_trusted then 'trusted(' || y || ')' end, case when not has_line then 'line(' || x || ', ' || y || ')' end], lambda z: z is not null) from b),
m as (select n.*, size - satisfied as distance from n where satisfied between 1 and size - 1 and size - satisfied <= 2 and not exists (select 1 from n h where h.o = n.o and h.head = n.head and h.satisfied = h.size)),
best as (select * from m qualify row_number() over (partition by o, rule_id order by distance, head, missing) = 1)
select o as order_id, rule_id, head, array_to_string(missing, '; ') as missing, satisfied::int as satisfied, distance::int as distance, (row_number() over (partition by o order by distance, satisfied desc, head, rule_id))::int as rank from best"""
)
def relational_near_miss(spark, d):
    """Of both rules the binding in each order that is nearest to firing, and what it lacks."""
    rules = parse_program(_NEAR)[0]
    facts = order_facts(spark, d)
    derived = Program(rules, open_world=True).evaluate(facts)
    found = near_misses(rules, facts, {s: derived[s] for s in ("dispute/1", "praise/1")})
    return found.select(F.col("case_id").alias("order_id"), "rule_id", "head", F.array_join("missing", "; ").alias("missing"), "satisfied", "distance", "rank")


def _supports(spark, d):
    rules, facts = order_program().rules, order_facts(spark, d)
    program = Program([r for r in rules if r.head.signature in polarities(rules, "escalate/1")])
    goals = goals_of(facts).select("case_id", atom_text("escalate/1", ["a0"]).alias("goal"))
    return program.saved_supports(program.evaluate(facts), 2), goals, facts


_INSTANCES = (
    "with "
    + _FACTS
    + """,
w1 as (select o, l, s from facts where ret = 2 and tru = 0),
w3 as (select o, l, s from facts where ret = 0 and tru = 2),
back as (select o, l from ret where t = 2),
risky as (select distinct o, l from w1),
calm as (select distinct o, s from w3)"""
)


@_register(
    _INSTANCES
    + """,
w as (select o from calm intersect select o from back),
e as (
  select o, 'escalate(order)' as head, 'w2' as rule_id, 'risky(' || l || ')' as premise, false as negated, true as derived from risky
  union select o, 'risky(' || l || ')', 'w1', unnest(['line(' || l || ', ' || s || ')', 'returned(' || l || ')', 'trusted(' || s || ')']), unnest([false, false, true]), false from w1
  union select o, 'escalate(order)', 'w4', 'calm(' || s || ')', false, true from calm where o in (from w)
  union select o, 'escalate(order)', 'w4', 'returned(' || l || ')', false, false from back where o in (from w)
  union select o, 'calm(' || s || ')', 'w3', unnest(['line(' || l || ', ' || s || ')', 'trusted(' || s || ')', 'returned(' || l || ')']), unnest([false, false, true]), false from w3 where o in (from w))
select o as order_id, head, rule_id, premise, negated, derived from e"""
)
def relational_proof_graph(spark, d):
    """What the escalation of each order rests on, each step once."""
    supports, goals, _ = _supports(spark, d)
    return proof_graph(supports, goals).withColumnRenamed("case_id", "order_id")


@_register(
    _INSTANCES
    + """,
n as (
  select x.o, coalesce(a.n, 0) as n1, coalesce(b.n, 0) as nr, coalesce(c.n, 0) as n3, coalesce(e.n, 0) as nc, coalesce(f.n, 0) as nb from (select distinct o from line) x
  left join (select o, count(*) as n from w1 group by 1) a on a.o = x.o left join (select o, count(*) as n from risky group by 1) b on b.o = x.o
  left join (select o, count(*) as n from w3 group by 1) c on c.o = x.o left join (select o, count(*) as n from calm group by 1) e on e.o = x.o left join (select o, count(*) as n from back group by 1) f on f.o = x.o)
select o as order_id, nr + nc * nb + n1 + n3 * nb as rules, case when nr + nc * nb > 0 then 1 + nr + nc * nb else 0 end as derived, 2 * n1 + nc * nb + 2 * n3 * nb as facts, n1 + n3 * nb as absent, nr + nc * nb = 0 as open from n"""
)
def relational_proof_tree(spark, d):
    """The size of each order's proof, with what is shared by several of its branches counted in each."""
    supports, goals, _ = _supports(spark, d)
    nodes = proof_tree(supports, goals)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return nodes.groupBy(F.col("case_id").alias("order_id")).agg(n("rule").alias("rules"), n("derived").alias("derived"), n("fact").alias("facts"), n("absent").alias("absent"), (n("open") > 0).alias("open"))


@_register(
    _INSTANCES
    + """,
one as (select o, any_value(l) as l, any_value(s) as s from w1 group by 1 having count(*) = 1)
select o as order_id, 'escalate(order)' || chr(10) || '  by w2, strength 0.9' || chr(10) || '    risky(' || l || ')' || chr(10) || '      by w1, strength 0.8' || chr(10) || '        line(' || l || ', ' || s || ') (fact: line item)' || chr(10)
  || '        returned(' || l || ') (fact: return flag)' || chr(10) || '        not distrust of(' || s || ') (does not hold)' as proof
from one where o not in (select o from calm)"""
)
def relational_proof_text(spark, d):
    """The proof as text of the orders that a single rule instance escalates."""
    supports, goals, _ = _supports(spark, d)
    once = supports.select("case_id", F.col("head").alias("goal")).join(goals.hint("merge"), ["case_id", "goal"]).groupBy("case_id", "goal").count().where("count = 1")
    once = saved(once.select("case_id", "goal"))  # by several instances, a goal's proof has more than two rules
    below = saved(supports.join(once.select("case_id").hint("merge"), "case_id", "left_semi"))
    nodes = proof_tree(below, once, {"line": "line item", "returned": "return flag", "trusted": "balance"})
    text = tree_text(nodes, {"trusted": "distrust of"}, most_rules=2)
    return text.where("proof like '%by w1%'").select(F.col("case_id").alias("order_id"), "proof")


@_register(
    _INSTANCES
    + """,
r as (select o, 'w1' as name from w1 union select o, 'w2' from risky union select c.o, unnest(['w3', 'w4']) from calm c join back b on b.o = c.o)
select name, case name when 'w1' then 'mined, approved, approved by ann' when 'w2' then 'human, approved, approved by nobody' when 'w3' then 'document, provisional, approved by nobody' else 'not in the rule base' end as source, name <> 'w1' as gap, count(distinct o) as orders from r group by 1"""
)
def relational_provenance(spark, d):
    """The rules that escalations rest on, where each comes from, and in how many orders nobody answers for it."""
    supports, goals, _ = _supports(spark, d)
    rules = spark.createDataFrame([("w1", "approved", "mined", "ann"), ("w2", "approved", "human", ""), ("w3", "provisional", "document", None)], "rule_id string, status string, origin string, approved_by string")
    found = provenance(proof_tree(supports, goals), rules).where("kind = 'rule'")
    return found.groupBy("name", "source", "gap").agg(F.count("*").alias("orders"))
