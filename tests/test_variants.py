"""Variants of a rule base against evaluating each of them from scratch in every case."""

import random

import pytest
from pyspark.sql import functions as F
from test_relational import plain, relation
from test_worlds import BASE, CONSTANTS, random_case, random_rules

from ruleweave.operators.relational import Program
from ruleweave.operators.variants import Trial, Variant, with_each, without_each
from ruleweave.plans.rules import strata
from ruleweave.sources.rule_text import parse_program

RECURSIVE = "rule r1 d(X) <- p(X), not q(X). rule r2 f(X, Y) <- e(X, Y). rule r3 f(X, Z) <- f(X, Y), e(Y, Z). rule r4 g(X) <- f(X, X), not d(X). rule r5 d(X) <- e(X, a). rule r6 f(X, Y) <- f(Y, X)."
ADDED = "rule n1 f(X, Y) <- d(X), q(Y), e(X, Y). rule n2 h(X) <- g(X), not p(X). rule n3 d(X) <- q(X), e(X, X). rule n4 d(X) <- p(X), not q(X)."


def tables(spark, facts):
    return {f"{p}/{n}": relation(spark, [(c, *args, t) for c in facts for (q, args), t in facts[c].items() if q == p], n) for p, n in BASE}


def by_definition(rules, variant):
    return [r for r in rules if r.rule_id not in variant.drop] + list(variant.add)


def check(spark, rules, variants, facts, askable):
    trial = Trial(Program(rules, askable), tables(spark, facts), variants)
    got = {}
    for s, df in trial.changed.items():
        for r in df.collect():
            *atom, before, after = tuple(r)
            got[atom[0], atom[1], s.split("/")[0], tuple(atom[2:])] = (before, after)
    want = {}
    for c, known in facts.items():
        base = plain(rules, known, askable, CONSTANTS)
        for v in variants:
            now = plain(by_definition(rules, v), known, askable, CONSTANTS)
            for k in base.keys() | now.keys():
                if k[0] not in {p for p, _ in BASE} and base.get(k, 0) != now.get(k, 0):
                    want[v.name, c, *k] = (base.get(k, 0), now.get(k, 0))
    assert got == want
    pairs = {tuple(r) for r in trial.touched.collect()}
    assert {k[:2] for k in want} <= pairs
    return trial, want, pairs


@pytest.mark.parametrize("seed", range(2))
def test_random_variants(spark, seed):
    rnd = random.Random(seed)
    rules = random_rules(rnd)
    facts = {c: random_case(rnd) for c in range(6)}
    added = []
    for r in random_rules(random.Random(seed + 50)):
        try:
            strata([*rules, *added, r])
            added.append(r)
        except ValueError:
            pass
    variants = without_each(rules) + [Variant(f"m{i}", frozenset(rnd.sample([r.rule_id for r in rules], rnd.randrange(3))), tuple(rnd.sample(added, min(len(added), rnd.randint(1, 2))))) for i in range(4)]
    check(spark, rules, variants, facts, {"p/1"} if seed else set())


def test_recursion_and_support_that_stays(spark):
    rnd = random.Random(7)
    rules, added = parse_program(RECURSIVE)[0], parse_program(ADDED)[0]
    facts = {c: random_case(rnd) for c in range(8)}
    variants = without_each(rules) + with_each(added) + [Variant("swap", frozenset({"r1"}), (added[3],)), Variant("none"), Variant("all", frozenset(r.rule_id for r in rules), ())]
    trial, want, pairs = check(spark, rules, variants, facts, set())
    assert not {p for p in pairs if p[0] in ("none", "n4")}  # an equal rule adds nothing
    assert {k[0] for k in want} >= {"r2", "r3", "r5", "all"} and not {k for k in want if k[0] == "swap"}

    true = lambda vs, c, p: any(t == 2 and k[0] == p for k, t in plain(by_definition(rules, vs), facts[c], set(), CONSTANTS).items())
    recorded = spark.createDataFrame([(0, "g"), (1, "other"), (2, None), (3, "other"), (3, "g"), (4, "other")], "case_id int, conclusion string")
    said = {0: {"g"}, 1: {"other"}, 3: {"other", "g"}, 4: {"other"}}
    for r in trial.replay("g/1", recorded).collect():
        v = next(v for v in variants if v.name == r.variant)
        was, now = {c for c in facts if true(Variant(""), c, "g")}, {c for c in facts if true(v, c, "g")}
        against = {c for c, names in said.items() if "g" not in names}
        assert tuple(r)[1:] == (len(facts), len(was & now), len(now - was - against), len(was - now), len((now - was) & against))
    effects = {r.variant: r for r in trial.effects(["g/1", "d/1"]).collect()}
    assert effects.keys() == {v.name for v in variants}
    for v in variants:
        assert effects[v.name].differs == len({k[1] for k in want if k[0] == v.name and k[2] in ("g", "d")})
    for r in trial.screen(["g/1", "d/1"]).collect():
        v = next(v for v in variants if v.name == r.variant)
        torn = [c for c in facts if true(v, c, "g") and true(v, c, "d") and not (true(Variant(""), c, "g") and true(Variant(""), c, "d"))]
        assert r.contradictions == len(torn)


def test_nothing_and_mistakes(spark):
    rules = parse_program(RECURSIVE)[0]
    facts = {f"{p}/{n}": relation(spark, [], n) for p, n in BASE}
    trial = Trial(Program(rules), facts, without_each(rules))
    assert trial.touched.isEmpty() and all(df.isEmpty() for df in trial.changed.values())
    assert {tuple(r)[1:] for r in trial.effects(["g/1"]).collect()} == {(0, 0, 0, 0)}
    none = Trial(Program(rules), facts, [])
    assert none.changed == {} and none.effects(["g/1"]).isEmpty() and none.replay("g/1").isEmpty()
    with pytest.raises(ValueError, match="no such rules: zz"):
        Trial(Program(rules), facts, [Variant("v", frozenset({"zz"}))])
    with pytest.raises(ValueError, match="names of their own"):
        Trial(Program(rules), facts, [Variant("v"), Variant("v")])


def test_open_world(spark):
    rnd = random.Random(11)
    rules, added = parse_program(RECURSIVE)[0], parse_program(ADDED)[0]
    facts = tables(spark, {c: random_case(rnd) for c in range(6)})
    variants = [*without_each(rules[:2]), *with_each(added[1:3])]
    trial = Trial(Program(rules, open_world=True), facts, variants)

    def whole(of):
        program = Program(of, open_world=True, cases=trial.cases)
        program.heads |= {r.head.signature for r in [*rules, *added]}
        return {(r[0], s, *tuple(r)[1:-1]): r.t for s, df in program.evaluate(facts).items() if s not in facts for r in df.collect()}

    base, default = whole(rules), 0  # every predicate that differs is concluded
    for v in variants:
        now = whole(by_definition(rules, v))
        want = {k: (base.get(k, default), now.get(k, default)) for k in base.keys() | now.keys() if base.get(k, default) != now.get(k, default)}
        got = {(r.case_id, s, *tuple(r)[2:-2]): (r.before, r.after) for s, df in trial.changed.items() for r in df.where(F.col("variant") == v.name).collect()}
        assert got == want
