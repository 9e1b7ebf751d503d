import pytest
from compare import connect, mismatch

from ruleweave.operators.explain import proof_steps, proof_text
from ruleweave.plans.generalise import by_use, candidates
from ruleweave.queries import QUERIES, SQL, customer_pack
from ruleweave.sources.rule_text import parse_rule


@pytest.mark.parametrize("name", ["proof", "generalise_replay"])
def test_against_sql(spark, small, name):
    assert mismatch(QUERIES[name](spark, small), connect(small), SQL[name]) == ""


def test_proof(spark):
    cases = spark.createDataFrame([(1, 2, 2, 0, 0), (2, 2, 2, 2, 0), (3, 2, 1, 0, 0), (4, 0, 0, 2, 2)], "id long, overdrawn int, large_exposure int, urgent_buyer int, auto_segment int")
    got = proof_text(proof_steps(customer_pack(), cases, "id", "decline", ("r2",)), "id").orderBy("id").collect()
    one = "rule r1; rule r4; fact large_exposure; fact overdrawn; not_concluded mitigated"
    two = "rule r1; rule r2 (not approved); rule r4; denied auto_segment; fact large_exposure; fact overdrawn; fact urgent_buyer; not_concluded mitigated"
    assert [(r.id, r.proof) for r in got] == [(1, one), (2, two)]  # unknown premises prove nothing
    assert proof_steps(customer_pack(), cases.limit(0), "id", "decline").isEmpty()
    with pytest.raises(ValueError):
        proof_steps(customer_pack(), cases, "id", "overdrawn")


def test_generalise(spark):
    a, b = parse_rule("h(X) <- p(X), q(X), r(X)."), parse_rule("h(X) <- p(X), q(X), not s(X).")
    c, d = parse_rule("likes(X, tea) <- buys(X, tea)."), parse_rule("likes(X, milk) <- buys(X, milk).")
    found = candidates(spark, [a, b, c, d])
    assert [(str(x.rule), x.how, x.dropped, x.narrowest) for x in found] == [("h(X) <- p(X), q(X).", "dropped-literals", 1, 3), ("likes(X, G0) <- buys(X, G0).", "variabilised", 0, 1)]
    assert not candidates(spark, [a, parse_rule("h(X) <- p(X)."), c])
    assert not candidates(spark, [parse_rule("h(X) <- p(X), not q(X)."), parse_rule("h(X) <- r(X), not q(X).")])  # unsafe
    e, f = parse_rule("g(X) <- e(X, 1), e(1, 2)."), parse_rule("g(X) <- e(X, 3), e(3, 2).")
    assert [str(x.rule) for x in candidates(spark, [e, f])] == ["g(X) <- e(G0, 2), e(X, G0)."]
    rank = lambda x, y: [c for c, _ in by_use([(found[0], x), (found[1], y)])]
    row = type("Row", (), {"conflicts": 0, "gains": 1})
    worse = type("Row", (), {"conflicts": 1, "gains": 9})
    assert rank(row, row) == [found[1], found[0]] and rank(row, worse) == [found[0], found[1]]
