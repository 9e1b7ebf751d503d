from fractions import Fraction
from itertools import product
from math import comb

import compare
import pytest
from pyspark.sql import functions as F

from ruleweave import queries as q
from ruleweave.functions.truth import beta_doubt
from ruleweave.operators.relational import evaluate
from ruleweave.operators.wide import Wide
from ruleweave.plans.rules import NotStratified, UnsafeRule, canonical_key, strata
from ruleweave.sources.rule_text import RuleSyntaxError, format_rule, parse_program, parse_rule


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(name, spark, small, con):
    df = q.QUERIES[name](spark, small)
    if name in q.SQL:
        assert not compare.mismatch(df, con, q.SQL[name])
    else:
        assert df.count() > 0


def test_text_round_trip():
    rule = parse_rule('rule r1 [p=0.8] high(A) <- over(A, 2024-01-02), not thin(A, "x \\"y").')
    assert rule.strength == 0.8
    assert canonical_key(parse_rule(format_rule(rule))) == canonical_key(rule)
    assert canonical_key(parse_rule("h(X) <- a(X), b(X, Y).")) == canonical_key(parse_rule("h(P) <- b(P, Q), a(P)."))
    rules, facts = parse_program("a(x). fact b(1.5) = unknown [source=\"form\"]. c(X) :- a(X). # end")
    assert len(rules) == 1 and [f["truth"] for f in facts] == ["true", "unknown"]


def test_errors():
    with pytest.raises(RuleSyntaxError, match="line 2, column 6"):
        parse_program("a(x).\nb(x) ?")
    with pytest.raises(UnsafeRule):
        parse_rule("h(X) <- not a(X).")
    with pytest.raises(NotStratified):
        strata(parse_program("p(X) <- d(X), not q(X). q(X) <- d(X), not p(X).")[0])


def test_bounds_with_both_polarities(spark):
    rules, _ = parse_program("rule a [p=0.9] m(X) <- u(X), v(X). rule b [p=0.6] g(X) <- v(X), not m(X). rule c [p=0.5] g(X) <- u(X), w(X).")
    wide = Wide(rules, ["u", "v", "w"])
    df = spark.createDataFrame(list(product((0, 1, 2), repeat=3)), "u int, v int, w int")

    def p(u, v, w):
        m = u == 2 and v == 2
        return 1 - (1 - 0.6 * (v == 2 and not m)) * (1 - 0.5 * (u == 2 and w == 2))

    for r in wide.bounds(df, "g", exact="exact").collect():
        assert r.exact
        worlds = [p(*x) for x in product(*((0, 2) if t == 1 else (t,) for t in (r.u, r.v, r.w)))]
        assert r.lower == pytest.approx(min(worlds)) and r.upper == pytest.approx(max(worlds))


def test_cyclic_closure(spark):
    edges = spark.createDataFrame([(1, "a", "b", 2), (1, "b", "a", 2), (1, "b", "c", 1), (2, "c", "d", 2)], "case_id int, a0 string, a1 string, t int")
    rules, _ = parse_program("r(X, Y) <- e(X, Y). r(X, Z) <- r(X, Y), e(Y, Z).")
    found = {(x.case_id, x.a0, x.a1): x.t for x in evaluate(rules, {"e/2": edges})["r/2"].collect()}
    assert found == {(1, "a", "b"): 2, (1, "b", "a"): 2, (1, "b", "c"): 1, (1, "a", "a"): 2, (1, "b", "b"): 2, (1, "a", "c"): 1, (2, "c", "d"): 2}


def test_beta_doubt(spark):
    cases = [(0, 0), (5, 1), (40, 9), (400, 90)]
    df = spark.createDataFrame(cases, "s int, f int").select("s", "f", beta_doubt(F.col("s"), F.col("f"), 0.75).alias("p"))
    x = Fraction(3, 4)
    for r in df.collect():
        n = r.s + r.f + 1
        assert r.p == pytest.approx(float(sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(r.s + 1, n + 1))), abs=1e-9)
