"""Relational programs against a plain-Python reading of the semantics, on random programs and the special cases."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from ruleweave.functions.truth import feature_of
from ruleweave.operators.relational import Program, evaluate, truth_of, unknowns_blocking
from ruleweave.plans.rules import Atom, Var, strata
from ruleweave.sources.rule_text import parse_atom, parse_program


def relation(spark, rows, arity=1):
    return spark.createDataFrame(rows, "case_id int, " + "".join(f"a{i} string, " for i in range(arity)) + "t int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain(rules, facts, askable, constants):
    """Truth of all atoms of one case by enumerating every binding; facts: {(predicate, args): truth}."""
    known = dict(facts)
    heads = {r.head.signature for r in rules}

    def truth(atom, bound):
        args = tuple(bound.get(t.name) if isinstance(t, Var) else t for t in atom.terms)
        return known.get((atom.predicate, args), 1 if atom.signature in askable and atom.signature not in heads else 0)

    for stratum in strata(rules):
        while True:
            fresh = {}
            for r in stratum:
                names = sorted({v for x in r.body for v in x.atom.variables()})
                for values in product(constants, repeat=len(names)):
                    bound = dict(zip(names, values, strict=True))
                    seen, t = set(), 2
                    for x in [y for y in r.body if not y.negated]:
                        args = tuple(bound.get(v.name) if isinstance(v, Var) else v for v in x.atom.terms)
                        if not x.atom.variables() <= seen and (x.atom.predicate, args) not in known:
                            t = 0  # ranges over recorded atoms only
                        t = min(t, truth(x.atom, bound))
                        seen |= x.atom.variables()
                    for x in [y for y in r.body if y.negated]:
                        t = min(t, 2 - truth(x.atom, bound))
                    if t:
                        args = tuple(bound.get(v.name) if isinstance(v, Var) else v for v in r.head.terms)
                        fresh[r.head.predicate, args] = max(t, fresh.get((r.head.predicate, args), 0))
            moved = {k: v for k, v in fresh.items() if v > known.get(k, 0)}
            if not moved:
                break
            known |= moved
    return known


@pytest.mark.parametrize("seed", range(6))
def test_random_programs(spark, seed):
    rnd = random.Random(seed)
    constants = ["a", "b", "c"]
    atom = lambda p, n: f"{p}({', '.join(rnd.choice(['X', 'Y', 'Z', 'a']) for _ in range(n))})"
    base, derived = [("p", 1), ("q", 1), ("e", 2)], [("d", 1), ("f", 2), ("g", 1)]
    text = []
    while len(text) < 5:
        k = rnd.randrange(3)
        body = [atom(*rnd.choice(base + derived[: k + 1])) for _ in range(rnd.randint(1, 3))] + ["not " + atom(*rnd.choice(base + derived[:k])) for _ in range(rnd.randint(0, 1))]
        line = f"{atom(*derived[k])} <- {', '.join(body)}."
        try:
            parse_program(line)
            strata(parse_program(" ".join([*text, line]))[0])
            text.append(line)
        except ValueError:
            pass
    rules = parse_program(" ".join(text))[0]
    askable = {"p/1", "e/2"}
    facts = {c: {(p, args): rnd.randrange(3) for p, n in base for args in product(constants, repeat=n) if rnd.random() < 0.5} for c in (1, 2)}
    relations = {f"{p}/{n}": relation(spark, [(c, *args, t) for c in facts for (q, args), t in facts[c].items() if q == p], n) for p, n in base}
    found = evaluate(rules, relations, askable)
    for p, n in derived:
        if f"{p}/{n}" in {r.head.signature for r in rules}:
            want = sorted((c, *args, t) for c in facts for (q, args), t in plain(rules, facts[c], askable, constants).items() if q == p and t)
            assert rows(found[f"{p}/{n}"].where("t > 0")) == want, text


def test_absent_and_ground(spark):
    p, q = relation(spark, [(1, "a", 2), (1, "b", 2), (2, "a", 1)]), relation(spark, [(1, "a", 2), (1, "b", 0)])
    rules = parse_program("h(X) <- p(X), q(X). g(a) <- not q(a). k(X) <- p(X), q(b). m(X) <- p(X), not none(X). z(c) <- q(a), p(a).")[0]
    found = evaluate(rules, {"p/1": p, "q/1": q}, {"q/1"})
    assert rows(found["h/1"]) == [(1, "a", 2), (2, "a", 1)]  # case 2 has no record of q(a): unknown
    assert rows(found["g/1"]) == [(2, "a", 1)]
    assert rows(found["k/1"]) == [(2, "a", 1)]
    assert rows(found["m/1"]) == rows(p)
    assert rows(found["z/1"]) == [(1, "c", 2), (2, "c", 1)]
    assert rows(truth_of(Program(rules, {"q/1"}), {"p/1": p, "q/1": q}, parse_atom("q(b)"))) == [(1, 0), (2, 1)]
    assert rows(evaluate(parse_program("h(X) <- p(X).")[0], {"p/1": p, "h/1": relation(spark, [(3, "z", 2)])})["h/1"]) == [*rows(p), (3, "z", 2)]
    assert evaluate(parse_program("h(X) <- nothing(X).")[0], {"p/1": p})["h/1"].isEmpty()


def test_open_world(spark):
    p, q = relation(spark, [(1, "a", 2), (1, "b", 1), (1, "c", 2), (1, "d", 2)]), relation(spark, [(1, "a", 0), (1, "d", 2)])
    rules = parse_program("h(X) <- p(X), not q(X). k(X) <- p(X), not h(X).")[0]
    found = evaluate(rules, {"p/1": p, "q/1": q}, open_world=True)
    assert rows(found["h/1"]) == [(1, "a", 2), (1, "c", 1)]  # unknown b doesn't match, unrecorded q(c) is unknown
    assert rows(found["k/1"]) == [(1, "c", 1), (1, "d", 2)]


def test_recursion_through_two_heads_and_clashing_names(spark):
    e = relation(spark, [(1, "a", "b", 2), (1, "b", "c", 2), (1, "c", "a", 1)], 2)
    rules = parse_program("odd(T, Case_id) <- e(T, Case_id). even(T, V0) <- odd(T, M), e(M, V0). odd(T, V0) <- even(T, M), e(M, V0).")[0]
    found = evaluate(rules, {"e/2": e})
    assert {(r.a0, r.a1): r.t for r in found["even/2"].collect()}["a", "c"] == 2 and found["odd/2"].count() == found["even/2"].count() == 9


def test_supports_probability_and_unknowns(spark):
    rules = parse_program("rule r1 [p=0.5] h(X) <- e(X, Y), p(Y). rule r2 [p=0.4] h(X) <- p(X). rule r3 [p=0.9] g(X) <- h(X), not q(X).")[0]
    e = relation(spark, [(1, "a", "b", 2), (1, "a", "c", 2), (1, "d", "a", 2)], 2)
    p = spark.createDataFrame([(1, "b", 2, 0.8), (1, "c", 2, 1.0), (1, "a", 1, 1.0)], "case_id int, a0 string, t int, p double")
    program = Program(rules, {"q/1", "p/1"})
    found = program.evaluate({"e/2": e, "p/1": p, "q/1": relation(spark, [(1, "a", 0)])})
    made = program.probabilities(found)
    assert {r.a0: round(r.p, 9) for r in made["h/1"].collect()} == {"a": round(1 - (1 - 0.4) * (1 - 0.5), 9), "b": 0.32, "c": 0.4}
    assert {r.a0: round(r.p, 9) for r in made["g/1"].collect()} == {"a": 0.63}
    s = program.supports(found)
    assert s.where("head = 'h(a)' and t = 2").count() == 2 and s.where("t = 1 and rule_id = 'r1'").first().head == "h(d)"
    goals = spark.createDataFrame([(1, "g(d)"), (1, "g(a)")], "case_id int, goal string")
    assert sorted((r.goal, r.unknown) for r in unknowns_blocking(s, goals).collect()) == [("g(a)", "p(a)"), ("g(d)", "p(a)"), ("g(d)", "q(d)")]


def test_probability_of_recursion(spark):
    e = relation(spark, [(1, "a", "b", 2), (1, "b", "c", 2), (1, "a", "c", 2)], 2)
    rules = parse_program("rule x [p=0.5] r(X, Y) <- e(X, Y). rule y [p=0.5] r(X, Z) <- r(X, Y), e(Y, Z).")[0]
    program = Program(rules)
    made = program.probabilities(program.evaluate({"e/2": e}))
    assert {(r.a0, r.a1): r.p for r in made["r/2"].collect()} == {("a", "b"): 0.5, ("b", "c"): 0.5, ("a", "c"): 1 - 0.5 * 0.75}


def test_feature_types(spark):
    df = spark.createDataFrame([(1, "x", True, 1.5, ["a"]), (0, "", False, float("nan"), []), (None, None, None, None, None)], "i int, s string, b boolean, d double, l array<string>")
    t = lambda *a, **k: [r.t for r in df.select(feature_of(df, *a, **k).alias("t")).collect()]
    assert t("s", "truthy") == t("i", "truthy") == t("b", "truthy") == t("l", "truthy") == [2, 0, 1]
    assert t("i", "gt", "x") == [1, 1, 1] and t("s", "lt", 3, missing=0) == [0, 0, 0] and t("i", "contains", "x", missing=2) == [2, 2, 2]
    assert t("i", "eq", "1") == [0, 0, 1] and t("i", "ne", "1") == [2, 2, 1] and t("b", "eq", 1) == [2, 0, 1] and t("s", "in", [1, "x"]) == [2, 0, 1]
    assert t("d", "gte", 1) == [2, 0, 1] and t("d", "ne", 1) == [2, 2, 1] and t("l", "contains", "a") == [2, 0, 1] and t("l", "contains", 1) == [0, 0, 1]
    assert t("none", "eq", 1) == [1, 1, 1] and t("i", "not_in", [1]) == [0, 2, 1] and t("s", "contains", "x") == [2, 0, 1]
    with pytest.raises(ValueError):
        feature_of(df, "none", "like", 1)


def test_atom_text(spark):
    assert parse_atom("p(X, a).") == Atom("p", (Var("X"), "a"))
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_pairs_of_large_cases_travel_as_lists(spark, monkeypatch):
    from ruleweave.operators import relational

    monkeypatch.setattr(relational, "LIST", 4)
    monkeypatch.setattr(relational, "OFTEN", 9)
    made = lambda salt: spark.range(900).selectExpr("cast(id % 2 as int) as case_id", f"abs(hash(id, {salt})) % 23 as a0", f"abs(hash(id, {salt + 1})) % 40 as a1", f"abs(hash(id, {salt + 2})) % 3 as t")
    given = {"p/2": made(1), "q/2": made(5)}
    for text in ("h(A, B) <- p(A, P), q(B, P).", "h(B, A) <- p(A, P), q(B, P).", "h(A, B) <- p(A, P), p(B, P)."):
        for open_world in (False, True):
            plain, lists = (relational.Program(parse_program(text)[0], open_world=open_world, large_cases=x).evaluate(given)["h/2"] for x in (False, True))
            assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, lists.collect()))
            assert "collect_list" in lists._jdf.queryExecution().optimizedPlan().toString()
