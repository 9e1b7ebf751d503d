"""Near misses and proofs of relational programs against plain enumerations."""

import random
from itertools import product

import pytest
from test_relational import relation
from test_worlds import BASE, CONSTANTS, random_case, random_rules, text

from ruleweave.operators.near import near_misses
from ruleweave.operators.proofs import proof_graph, proof_tree, provenance, tree_text
from ruleweave.operators.relational import Program
from ruleweave.plans.rules import Var
from ruleweave.sources.rule_text import parse_program


def near_by_definition(rules, recorded, known, most):
    """Best (distance, head, missing, satisfied) of each rule in one case, over all bindings of the case's constants."""
    names = sorted({a for _, args in recorded for a in args})
    best = {}
    for r in rules:
        variables = sorted({v for x in r.body for v in x.atom.variables()})
        for values in product(names, repeat=len(variables)):
            bound = dict(zip(variables, values, strict=True))
            ground = lambda a, bound=bound: (a.predicate, tuple(bound[t.name] if isinstance(t, Var) else t for t in a.terms))
            if known.get(ground(r.head)) == 2:
                continue
            missing = [x for x in r.body if known.get(ground(x.atom), 1) != (0 if x.negated else 2)]
            if 0 < len(missing) <= most and len(missing) < len(r.body):
                found = (len(missing), text(ground(r.head)), [("not " if x.negated else "") + text(ground(x.atom)) for x in missing], len(r.body) - len(missing))
                best[r.rule_id] = min(best.get(r.rule_id, found), found)
    return best


@pytest.mark.parametrize("seed", range(2))
def test_near_misses(spark, seed):
    rnd = random.Random(seed)
    rules = random_rules(rnd)
    facts = {c: random_case(rnd) for c in range(3)}
    relations = {f"{p}/{n}": relation(spark, [(c, *args, t) for c in facts for (q, args), t in facts[c].items() if q == p], n) for p, n in BASE}
    derived = {s: d for s, d in Program(rules, open_world=True).evaluate(relations).items() if s not in relations}
    known = {c: dict(facts[c]) for c in facts}
    for s, d in derived.items():
        for r in d.collect():
            known[r.case_id][s.split("/")[0], tuple(r)[1:-1]] = r.t
    got = {}
    for r in near_misses(rules, relations, derived).orderBy("case_id", "rank").collect():
        got.setdefault(r.case_id, []).append((r.rule_id, (r.distance, r["head"], r.missing, r.satisfied)))
        assert (r.question is not None) == (r.distance == 1)
    for c in facts:
        want = near_by_definition(rules, facts[c], known[c], 2)
        assert dict(got.get(c, [])) == want
        assert [i for i, _ in got.get(c, [])] == sorted(want, key=lambda i: (want[i][0], -want[i][3], want[i][1], i))


CYCLE = parse_program("rule a [p=0.9] reach(X, Y) <- edge(X, Y). rule b [p=0.8] reach(X, Z) <- reach(X, Y), edge(Y, Z). rule c [p=0.7] lone(X) <- node(X), not reach(X, X).")[0]


def cyclic(spark):
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "b")]
    relations = {"edge/2": spark.createDataFrame([(*e, 2) for e in edges], "case_id int, a0 string, a1 string, t int"), "node/1": spark.createDataFrame([(2, "a", 2)], "case_id int, a0 string, t int")}
    program = Program(CYCLE)
    return program.supports(program.evaluate(relations)).cache()


def nodes_by_definition(supports, case, goal, most):
    ways = {}
    for s in supports:
        if s.case_id == case and s.t == 2:
            ways.setdefault(s["head"], []).append((s.rule_id, [(x.atom, x.negated, x.t) for x in s.premises]))
    out = []

    def walk(atom, path, seen, depth, negated):
        own = sorted(ways.get(atom, [])) if not negated else []
        kind = "absent" if negated else ("shown" if atom in seen or depth >= most else "derived") if own else "open" if not depth else "fact"
        out.append((tuple(path), kind, atom))
        if kind == "derived":
            for i, (rule, premises) in enumerate(own):
                out.append(((*path, i), "rule", rule))
                for j, (p, n, _) in enumerate(premises):
                    walk(p, (*path, i, j), seen | {atom}, depth + 1, n)

    walk(goal, (), frozenset(), 0, False)
    return sorted(out)


@pytest.mark.parametrize("most", [12, 2])
def test_proof_tree_on_a_cycle(spark, most):
    supports = cyclic(spark)
    goals = spark.createDataFrame([(1, "reach(a, a)"), (1, "reach(a, z)"), (2, "lone(a)")], "case_id int, goal string")
    nodes = proof_tree(supports, goals, most_depth=most).collect()
    rows = supports.collect()
    for case, goal in [(1, "reach(a, a)"), (1, "reach(a, z)"), (2, "lone(a)")]:
        got = sorted((tuple(n.path), n.kind, n.rule_id or n.atom) for n in nodes if (n.case_id, n.goal) == (case, goal))
        assert got == nodes_by_definition(rows, case, goal, most)


def test_proof_graph_and_text(spark):
    supports = cyclic(spark)
    goals = spark.createDataFrame([(1, "reach(a, b)"), (2, "lone(a)")], "case_id int, goal string")
    edges = {tuple(r) for r in proof_graph(supports, goals).collect()}
    assert (2, "lone(a)", "c", "reach(a, a)", True, False) in edges and (1, "reach(a, c)", "b", "reach(a, b)", False, True) in edges
    assert len(edges) == len({(r.case_id, r["head"], r.rule_id, x.atom) for r in supports.collect() if r.t == 2 and (r.case_id == 2 or r["head"].startswith("reach(a")) for x in r.premises if (r.case_id, r["head"]) != (2, "reach(a, b)")})
    facts = spark.createDataFrame([(2, "node(a)", "register")], "case_id int, atom string, source string")
    nodes = proof_tree(supports, goals, facts)
    proof = {r.case_id: r.proof for r in tree_text(nodes, {"lone": "alone"}).collect()}
    assert proof[2] == "alone(a)\n  by c, strength 0.7\n    node(a) (fact: register)\n    not reach(a, a) (does not hold)"
    assert "reach(a, b) (see above)" in proof[1]
    rules = spark.createDataFrame([("c", "approved", "human", "ann"), ("a", "provisional", "mined", "")], "rule_id string, status string, origin string, approved_by string")
    found = {(r.case_id, r.name): (r.source, r.gap) for r in provenance(nodes, rules).collect()}
    assert found[2, "c"] == ("human, approved, approved by ann", False) and found[2, "node(a)"] == ("register", False)
    assert found[1, "a"] == ("mined, provisional, approved by nobody", True) and found[1, "b"] == ("not in the rule base", True)
