"""Supports that hold, sources by predicate, and proofs of few rules against the same from all instances and recorded facts."""

import random

from pyspark.sql import functions as F
from test_relational import relation
from test_worlds import BASE, random_case, random_rules

from ruleweave.operators.proofs import proof_tree, tree_text
from ruleweave.operators.relational import Program, atom_text
from ruleweave.proof_queries import _supports
from ruleweave.sources.rule_text import parse_program


def test_supports_that_hold_are_those_of_truth_two(spark):
    for seed in (21, 22):
        rnd = random.Random(seed)
        rules, facts = random_rules(rnd), {c: random_case(rnd) for c in range(4)}
        relations = {f"{p}/{n}": relation(spark, [(c, *args, t) for c in facts for (q, args), t in facts[c].items() if q == p], n) for p, n in BASE}
        for program in (Program(rules, {"p/1"}), Program(rules, open_world=True)):
            known = program.evaluate(relations)
            rows = lambda df: sorted((r.case_id, r.head, r.rule_id, str(r.premises)) for r in df.collect())
            assert rows(program.saved_supports(known, 2)) == rows(program.supports(known).where("t = 2"))


def test_sources_by_predicate_and_few_rules(spark):
    program = Program(parse_program("rule a [p=0.5] d(X) <- p(X), not q(X). rule b [p=0.9] g(all) <- d(X).")[0])
    given = {"p/1": relation(spark, [(1, "x", 2), (2, "x", 2), (2, "y", 2), (3, "z", 0)]), "q/1": relation(spark, [(1, "y", 2), (2, "z", 0)])}
    supports = program.saved_supports(program.evaluate(given), 2)
    goals = spark.createDataFrame([(c, "g(all)") for c in (1, 2, 3)], "case_id int, goal string")
    facts = given["p/1"].select("case_id", atom_text("p/1", ["a0"]).alias("atom"), F.lit("record").alias("source"))
    by_fact, by_predicate = (proof_tree(supports, goals, x) for x in (facts, {"p": "record"}))
    assert sorted(map(str, by_fact.collect())) == sorted(map(str, by_predicate.collect()))
    found = {r.case_id: r.proof for r in tree_text(by_predicate, most_rules=2).collect()}
    assert found.keys() == {1, 3} and "p(x) (fact: record)" in found[1] and found[3] == "g(all) (not concluded)"
    assert tree_text(by_predicate).count() == 3


def test_supports_of_a_goal_leave_other_rules_out(spark, small):
    supports, goals, _ = _supports(spark, small)
    assert {r.rule_id for r in supports.select("rule_id").distinct().collect()} == {"w1", "w2", "w3", "w4"}
    assert goals._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
