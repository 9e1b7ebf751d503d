"""Tables by case: joins, groups and walks within a case move no rows."""

from pyspark.sql import functions as F

from ruleweave.operators.relational import Program
from ruleweave.proof_queries import _supports
from ruleweave.sources.rule_text import parse_program
from ruleweave.sources.tables import saved


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def facts(spark, t):
    return saved(spark.range(400).select((F.col("id") % 40).alias("case_id"), (F.col("id") % 7).alias("a0"), F.lit(t).alias("t")).distinct())


def test_rules_of_placed_facts_move_no_rows(spark):
    program = Program(parse_program("rule a [p=0.5] d(X) <- p(X), q(X). rule b [p=0.9] g(X) <- d(X), p(X).")[0])
    found = program.evaluate({"p/1": facts(spark, 2), "q/1": facts(spark, 2)})
    assert exchanges(found["g/1"]) == 0 and exchanges(program.probabilities(found)["g/1"]) == 0
    assert found["g/1"].count() == facts(spark, 2).count()


def test_saved_appends(spark):
    found = saved(facts(spark, 2), facts(spark, 0), facts(spark, 1))
    assert sorted(r["count"] for r in found.groupBy("t").count().collect()) == [facts(spark, 2).count()] * 3
    assert exchanges(found.groupBy("case_id", "a0").count()) == 0


def test_supports_of_orders_move_no_rows(spark, small):
    supports, _, lines = _supports(spark, small)
    assert exchanges(supports.groupBy("case_id", "head").count()) == 0 and exchanges(lines["returned/1"]) == 0


def test_cases_of_several_tables_count_once(spark):
    parts = {f"{p}/1": facts(spark, 2) for p in "pqr"}
    assert saved(Program([], cases=None).cases(parts)).count() == 40


def test_probabilities_read_each_relation_once_a_rule(spark):
    program = Program(parse_program("rule a [p=0.5] d(X) <- p(X), q(X). rule b [p=0.9] g(X) <- d(X), p(X).")[0])
    given = {"p/1": facts(spark, 2), "q/1": facts(spark, 2)}
    p = program.probabilities(program.evaluate(given))
    assert p["g/1"]._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 3
    assert {round(r.p, 9) for r in p["g/1"].collect()} == {0.45}


def test_recorded_heads_keep_their_probability(spark):
    program = Program(parse_program("rule a [p=0.5] d(X) <- p(X). rule b [p=0.9] g(X) <- d(X). rule c [p=0.4] h(X) <- d(X), not g(X).")[0])
    one = lambda a: spark.createDataFrame([(0, a, 2)], "case_id int, a0 int, t int")
    p = program.probabilities(program.evaluate({"p/1": one(1), "d/1": one(2)}))
    assert sorted((r.a0, round(r.p, 9)) for r in p["g/1"].collect()) == [(1, 0.45), (2, 0.0)]
