"""Bounds, questions and counterfactuals of relational programs against an enumeration of all worlds."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F
from test_relational import plain, relation

from ruleweave.operators.relational import Program, evaluate
from ruleweave.operators.worlds import Worlds, answers
from ruleweave.plans.rules import Var, strata
from ruleweave.sources.rule_text import parse_program

CONSTANTS = ["a", "b"]
BASE = [("p", 1), ("q", 1), ("e", 2)]
DERIVED = [("d", 1), ("f", 2), ("g", 1)]


def random_rules(rnd):
    atom = lambda p, n: f"{p}({', '.join(rnd.choice(['X', 'Y', 'a']) for _ in range(n))})"
    text = []
    while len(text) < 6:
        k = rnd.randrange(3) if len(text) > 2 else len(text)
        body = [atom(*rnd.choice(BASE + DERIVED[:k])) for _ in range(rnd.randint(1, 2))] + ["not " + atom(*rnd.choice(BASE + DERIVED[:k])) for _ in range(rnd.randint(0, 2))]
        line = f"rule r{len(text)} [p={rnd.randint(40, 95) / 100}] {atom(*DERIVED[k])} <- {', '.join(body)}."
        try:
            strata(parse_program(" ".join([*text, line]))[0])
            text.append(line)
        except ValueError:
            pass
    return parse_program(" ".join(text))[0]


def probability(rules, facts, askable, constants, goal, confidence=None):
    """P of a ground goal (predicate, args) where no predicate is recursive."""
    known = plain(rules, facts, askable, constants)
    heads = {r.head.signature for r in rules}

    def p(predicate, args, signature):
        if signature not in heads:
            return (confidence or {}).get((predicate, args), 1.0) if known.get((predicate, args)) == 2 else 0.0
        rest = 1.0
        for r in rules:
            if r.head.signature != signature:
                continue
            names = sorted({v for x in r.body for v in x.atom.variables()})
            for values in product(constants, repeat=len(names)):
                bound = dict(zip(names, values, strict=True))
                ground = lambda a, bound=bound: (a.predicate, tuple(bound[t.name] if isinstance(t, Var) else t for t in a.terms))
                default = lambda a: 1 if a.signature in askable and a.signature not in heads else 0
                truth = [2 - known.get(ground(x.atom), default(x.atom)) if x.negated else known.get(ground(x.atom), 0) for x in r.body]
                if ground(r.head) == (predicate, args) and min(truth) == 2:
                    body = 1.0
                    for x in r.body:
                        if not x.negated:
                            body *= p(*ground(x.atom), x.atom.signature)
                    rest *= 1 - r.strength * body
        return 1 - rest

    return p(goal[0], goal[1], f"{goal[0]}/{len(goal[1])}")


def text(key):
    return f"{key[0]}({', '.join(key[1])})"


def completions(facts, pinned=()):
    unknown = [k for k, t in facts.items() if t == 1 and k not in dict(pinned)]
    for values in product((0, 2), repeat=len(unknown)):
        yield {**facts, **dict(pinned), **dict(zip(unknown, values, strict=True))}


def random_case(rnd):
    facts = {(p, args): rnd.choice([0, 2, 2]) for p, n in BASE for args in product(CONSTANTS, repeat=n) if rnd.random() < 0.85}
    for k in rnd.sample(sorted(facts), min(len(facts), rnd.randint(0, 5))):
        facts[k] = 1
    return facts


def setting(spark, seed, cases=3):
    rnd = random.Random(seed)
    rules = random_rules(rnd)
    facts = {c: random_case(rnd) for c in range(cases)}
    relations = {f"{p}/{n}": relation(spark, [(c, *args, t) for c in facts for (q, args), t in facts[c].items() if q == p], n) for p, n in BASE}
    goals = spark.createDataFrame([(c, a) for c in facts for a in CONSTANTS], "case_id int, a0 string")
    askable = {"p/1"} if seed % 2 else set()
    return rules, facts, relations, goals, askable


@pytest.mark.parametrize("seed", range(2))
def test_bounds_and_questions(spark, seed):
    rules, facts, relations, goals, askable = setting(spark, seed)
    worlds = Worlds(Program(rules, askable), relations, "g/1", goals)
    span = lambda c, a, pinned=(): [f(probability(rules, w, askable, CONSTANTS, ("g", (a,))) for w in completions(facts[c], pinned)) for f in (min, max)]
    found = {(r.case_id, r.a0): r for r in worlds.bounds().collect()}
    assert found.keys() == {(c, a) for c in facts for a in CONSTANTS}
    for (c, a), r in found.items():
        assert [r.lower, r.upper] == pytest.approx(span(c, a), abs=1e-9) and r.exact
    asked = {}
    for r in worlds.questions(limit=2).collect():
        asked.setdefault((r.case_id, r.a0), []).append((r["rank"], r.question, r.decisive, r.gain, r.true_lower, r.true_upper, r.false_lower, r.false_upper))
    for c, a in found:
        want, (low, high) = [], span(c, a)
        for k in (k for k, t in facts[c].items() if t == 1):
            yes, no = span(c, a, [(k, 2)]), span(c, a, [(k, 0)])
            decisive = any((y > 0.5) != (n > 0.5) for y, n in zip(yes, no, strict=True))
            gain = max(0.0, round(high - low - (yes[1] - yes[0] + no[1] - no[0]) / 2, 9))
            if decisive or gain > 1e-6:
                want.append((not decisive, -gain, text(k), yes, no))
        want = sorted(want)[:2]
        got = sorted(asked.get((c, a), []))
        assert [(g[0], g[1], g[2]) for g in got] == [(i + 1, w[2], not w[0]) for i, w in enumerate(want)]
        for g, w in zip(got, want, strict=True):
            assert list(g[3:]) == pytest.approx([-w[1], *w[3], *w[4]], abs=1e-6)


@pytest.mark.parametrize("seed", range(10, 11))
def test_counterfactuals(spark, seed):
    rules, facts, relations, goals, askable = setting(spark, seed)
    found = {tuple(r) for r in Worlds(Program(rules, askable), relations, "g/1", goals).counterfactuals().collect()}
    want = set()
    for c in facts:
        holds = lambda f, a: plain(rules, f, askable, CONSTANTS).get(("g", (a,)), 0) == 2
        for k, t in facts[c].items():
            for a in CONSTANTS:
                if t != 1 and holds(facts[c], a) != holds({**facts[c], k: 2 - t}, a):
                    want.add((c, a, text(k), t))
    assert found == want


def test_recursion_in_worlds(spark):
    """reach over edges, of which some are unknown: certain where all worlds have a way, possible where one has."""
    rules = parse_program("rule a [p=1.0] reach(X, Y) <- edge(X, Y). rule b [p=1.0] reach(X, Z) <- reach(X, Y), edge(Y, Z).")[0]
    edges = [(1, "a", "b", 2), (1, "b", "c", 1), (1, "c", "d", 2), (1, "a", "c", 1), (2, "a", "d", 1), (2, "d", "a", 2)]
    relations = {"edge/2": spark.createDataFrame(edges, "case_id int, a0 string, a1 string, t int")}
    goals = spark.createDataFrame([(1, "a", "d"), (1, "a", "b"), (1, "d", "a"), (2, "a", "a"), (2, "d", "d")], "case_id int, a0 string, a1 string")
    found = {tuple(r)[:5] for r in Worlds(Program(rules), relations, "reach/2", goals).bounds().collect()}
    assert found == {(1, "a", "d", 0.0, 1.0), (1, "a", "b", 1.0, 1.0), (1, "d", "a", 0.0, 0.0), (2, "a", "a", 0.0, 1.0), (2, "d", "d", 0.0, 1.0)}


def test_confidence_and_cut(spark):
    """Confidence of an unknown fact counts where it is true; beyond most_mixed the interval is marked."""
    rules = parse_program("rule a [p=0.5] m(X) <- p(X). rule b [p=1.0] g(all) <- p(X), not m(Y), q(Y).")[0]
    p = spark.createDataFrame([(1, "a", 1, 0.4), (1, "b", 1, 1.0), (2, "a", 2, 0.25)], "case_id int, a0 string, t int, p double")
    q = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (2, "z", 2)], "case_id int, a0 string, t int")
    goals = spark.createDataFrame([(1, "all"), (2, "all")], "case_id int, a0 string")
    run = lambda most: {r.case_id: (round(r.lower, 9), round(r.upper, 9), r.exact) for r in Worlds(Program(rules), {"p/1": p, "q/1": q}, "g/1", goals, most).bounds().collect()}
    assert run(14) == {1: (0.0, 1.0, True), 2: (0.25, 0.25, True)}
    assert run(1) == {1: (0.0, 0.4, False), 2: (0.25, 0.25, True)}


def test_without_unknowns_rules_or_facts(spark):
    rules = parse_program("rule a [p=0.5] g(X) <- p(X).")[0]
    goals = spark.createDataFrame([(1, "a"), (1, "b")], "case_id int, a0 string")
    p = spark.createDataFrame([(1, "a", 2)], "case_id int, a0 string, t int")
    worlds = Worlds(Program(rules), {"p/1": p}, "g/1", goals)
    assert sorted(tuple(r) for r in worlds.bounds().collect()) == [(1, "a", 0.5, 0.5, True), (1, "b", 0.0, 0.0, True)]
    assert worlds.questions().collect() == []
    assert [tuple(r) for r in worlds.counterfactuals().collect()] == [(1, "a", "p(a)", 2)]
    assert [r.upper for r in Worlds(Program(rules), {"p/1": p}, "h/1", goals).bounds().collect()] == [0.0, 0.0]


def test_answers(spark):
    rules = parse_program("rule a [p=0.9] yes(X) <- p(X). rule b [p=0.8] yes(X) <- q(X). rule c [p=0.7] no(X) <- p(X), not q(X).")[0]
    relations = {"p/1": relation(spark, [(1, "x", 2), (2, "x", 0), (3, "x", 2)]), "q/1": relation(spark, [(1, "x", 1), (2, "x", 0), (3, "x", 2)])}
    goals = {f"{g}/1": spark.createDataFrame([(c, "x") for c in (1, 2, 3)], "case_id int, a0 string") for g in ("yes", "no")}
    found = {r.case_id: r for r in answers(Program(rules), relations, ["yes/1", "no/1"], goals).collect()}
    rounded = lambda r: [(o.goal, round(o.lower, 6), round(o.upper, 6)) for o in r.outcomes]
    assert rounded(found[1]) == [("yes(x)", 0.9, 0.98), ("no(x)", 0.0, 0.7)] and not found[1].uncovered
    assert rounded(found[2]) == [("no(x)", 0.0, 0.0), ("yes(x)", 0.0, 0.0)] and found[2].uncovered and found[2].assumptions == []
    assert [(q.question, q.decisive, round(q.gain, 6)) for q in found[1].questions] == [("q(x)", False, 0.08)] and found[2].questions == []
    assert found[1].assumptions == ["1 fact(s) are unknown; bounds span all their values"]
    assert found[3].assumptions == ["1 conclusion(s) rest on several rules, taken as independent"]


def test_deep_chains_stay_small(spark):
    """Two rules a head, each reading the head before: the plan must not double with each level."""
    text = " ".join(f"rule a{i} [p=0.9] h{i}(X) <- h{i - 1}(X), p(X). rule b{i} [p=0.5] h{i}(X) <- h{i - 1}(X), not q(X)." for i in range(1, 13))
    rules = parse_program(text + " rule s [p=1.0] h0(X) <- p(X).")[0]
    relations = {"p/1": spark.range(50).select(F.lit(1).alias("case_id"), F.col("id").alias("a0"), F.lit(2).alias("t")), "q/1": spark.range(0, 50, 2).select(F.lit(1).alias("case_id"), F.col("id").alias("a0"), F.lit(2).alias("t"))}
    found = evaluate(rules, relations)["h12/1"]
    assert found.count() == 50 and found._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 40
