import pytest
from pyspark.sql import functions as F

from ruleweave.operators.lifecycle import ForbiddenTransition, RuleStore
from ruleweave.queries import OBSERVABLES, customer_pack, customers, governance_log
from ruleweave.sources.drafts import policy_rules
from ruleweave.sources.rule_text import parse_rule
from ruleweave.streaming.screening import start_screening


def test_lifecycle(spark, tmp_path):
    store = RuleStore(spark, f"file://{tmp_path}/rules")
    one, two = parse_rule("rule r1 [p=0.8] h(X) <- a(X), b(X)."), parse_rule("rule r2 g(X) <- h(X), not c(X).")
    assert store.propose([one, two], critical=False) == ["applied_provisionally"] * 2
    assert store.propose([parse_rule("h(Y) <- b(Y), a(Y).")], critical=False) == ["already_pending"]
    assert store.propose([two], critical=True) == ["queued_online"] and store.active(True) == []
    assert [r.rule_id for r in store.review_queue().collect()] == ["r2", "r1"]
    store.approve("r1", "ann")
    store.reject("r2", "ann", "too wide")
    assert store.propose([one, two], critical=True) == ["already_approved", "already_rejected"]
    assert [str(r) for r in store.active(True)] == [str(one)] and store.active(True)[0].strength == 0.8
    with pytest.raises(ForbiddenTransition):
        store.approve("r2", "ann")
    assert [e.status for e in store.history("r2").collect()] == ["provisional", "pending_online", "rejected"]


def test_invariant(spark, small, tmp_path):
    store = RuleStore(spark, f"file://{tmp_path}/rules")
    store.propose([parse_rule("rule r1 h(X) <- a(X).")], critical=False)
    store.approve("r1", "ann")
    log = governance_log(spark, small)
    assert store.invariant_violations(log).count() == log.where("critical and rule_id <> 'r1'").count()


def test_policy_rules(spark):
    text = "# Lending\ntext\n<!-- rule: decline(A) <- poor(A), not backed(A). | p=0.7 -->\n## Other\n<!-- rule: approve(A) <- rich(A). -->"
    got = policy_rules(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string"), "doc_id").orderBy("heading").collect()
    assert [(r.heading, r.rule, r.strength) for r in got] == [("Lending", "decline(A) <- poor(A), not backed(A).", 0.7), ("Other", "approve(A) <- rich(A).", 0.9)]


def test_stream(spark, small, tmp_path):
    customers(spark, small).select("c_custkey", *OBSERVABLES).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("c_custkey long, " + ", ".join(f"{o} int" for o in OBSERVABLES)).parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        start_screening(customer_pack(), stream, "c_custkey", ["decline", "approve"], f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.count() == spark.read.parquet(f"{small}/customer.parquet").count() and out.where(F.col("lower_decline") > F.col("upper_decline")).isEmpty()
