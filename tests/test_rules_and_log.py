"""Canonical keys under symmetry, the life of imported rules, verdicts that are taken back, and runs that are cut off or repeated."""

import random
import time
from itertools import permutations

import pytest

from ruleweave.operators import governance
from ruleweave.operators.lifecycle import ForbiddenTransition, RuleStore
from ruleweave.plans.rules import Atom, Literal, Rule, UnsafeRule, Var, canonical_form


def renamed(rule, rnd):
    names = sorted({v for x in rule.body for v in x.atom.variables()} | rule.head.variables())
    to = dict(zip(names, rnd.sample([f"Z{i}" for i in range(60)], len(names)), strict=True))
    f = lambda a: Atom(a.predicate, tuple(Var(to[t.name]) if isinstance(t, Var) else t for t in a.terms))
    body = [Literal(f(x.atom), x.negated) for x in rule.body]
    rnd.shuffle(body)
    return Rule(f(rule.head), tuple(body))


def edges(pairs):
    return Rule(Atom("h", (Var("X"),)), (Literal(Atom("p", (Var("X"),))), *(Literal(Atom("e", (Var(a), Var(b)))) for a, b in pairs)))


@pytest.mark.parametrize("pairs", [[(f"A{i}", f"B{i}") for i in range(12)], [("C", f"B{i}") for i in range(12)], [(f"B{i}", f"B{(i + 1) % 12}") for i in range(12)], [(f"B{i}", f"B{i // 6 * 6 + (i + 1) % 6}") for i in range(12)]])
def test_symmetric_bodies_have_one_form_soon(pairs):
    rule, rnd = edges(pairs), random.Random(2)
    began = time.perf_counter()
    form = canonical_form(rule)
    assert time.perf_counter() - began < 1
    assert all(canonical_form(renamed(rule, rnd)) == form for _ in range(5))


def test_forms_are_equal_only_for_equal_rules():
    rnd = random.Random(3)
    assert canonical_form(edges([(f"B{i}", f"B{(i + 1) % 6}") for i in range(6)])) != canonical_form(edges([(f"B{i}", f"B{i // 3 * 3 + (i + 1) % 3}") for i in range(6)]))

    def least(r):
        names = sorted({v for x in r.body for v in x.atom.variables()} | r.head.variables())
        made = []
        for p in permutations(range(len(names))):
            to = dict(zip(names, p, strict=True))
            f = lambda a, to=to: str(Atom(a.predicate, tuple(Var(f"Q{to[t.name]}") if isinstance(t, Var) else t for t in a.terms)))
            made.append((f(r.head), sorted(("not " if x.negated else "") + f(x.atom) for x in r.body)))
        return str(min(made))

    forms: dict[str, set[str]] = {}
    for _ in range(800):
        try:
            body = tuple(Literal(Atom(rnd.choice("pe"), tuple(rnd.choice([Var("X"), Var("Y"), Var("Z"), Var("W"), "a"]) for _ in range(2))), rnd.random() < 0.2) for _ in range(rnd.randint(1, 5)))
            r = Rule(Atom("h", tuple(Var(rnd.choice("XY")) for _ in range(rnd.randint(0, 2)))), body)
        except UnsafeRule:
            continue
        assert canonical_form(renamed(r, rnd)) == canonical_form(r)
        forms.setdefault(canonical_form(r), set()).add(least(r))
    assert len(forms) > 100 and all(len(x) == 1 for x in forms.values()) and len(set().union(*forms.values())) == len(forms)


def test_imported_rules_can_be_approved(spark, tmp_path):
    store = RuleStore(spark, f"file://{tmp_path}/rules")
    store.import_text("rule a [p=0.9] bad(X) <- late(X). rule b [p=0.9] good(X) <- early(X). rule c [p=0.5] odd(X) <- late(X), early(X).")
    assert {r.status for r in store.rules().collect()} == {"proposed"}
    store.approve("a", "ann")
    store.reject("b", "ann", "no")
    from ruleweave.sources.rule_text import parse_rule

    assert store.propose([parse_rule("odd(Y) <- early(Y), late(Y).")], critical=True) == ["queued_online"]
    assert {r.rule_id: r.status for r in store.rules().collect()} == {"a": "approved", "b": "rejected", "c": "pending_online"}
    with pytest.raises(ForbiddenTransition):
        store.approve("b", "ann")


def test_a_verdict_can_be_taken_back(spark):
    used = spark.createDataFrame([("q1", "r"), ("q2", "r")], "query_id string, rule_id string")
    verdicts = spark.createDataFrame([("q1", True, 1), ("q1", False, 2), ("q2", True, 3)], "query_id string, correct boolean, seq int")
    assert [tuple(r) for r in governance.outcomes_by_rule(used, verdicts).collect()] == [("r", 1, 1)]


def _answers(spark, ids):
    schema = "id int, critical boolean, reason string, lower double, upper double, status string, blocked_on array<string>, decision string, rules array<string>, provisional array<string>"
    return spark.createDataFrame([(i, False, "", 0.1, 0.9, "answered", [], "yes", ["r1"], []) for i in ids], schema), spark.createDataFrame([(i, 2) for i in ids], "id int, o int")


def test_runs_count_once_or_not_at_all(spark, tmp_path, monkeypatch):
    log = governance.DecisionLog(spark, f"file://{tmp_path}/log")
    add = lambda run, ids, to=log: to.append(*_answers(spark, ids), "id", ["o"], "g", run)
    assert add("one", [1, 2]) and not add("one", [1, 2])
    cut = governance.DecisionLog(spark, f"file://{tmp_path}/log")

    def stop(*a):
        raise RuntimeError("stopped")

    monkeypatch.setattr(cut, "_commit", stop)
    with pytest.raises(RuntimeError):
        add("two", [3], cut)
    assert sorted(r.entity for r in log.table("queries").collect()) == ["1", "2"] and not log.holds("two")
    assert add("two", [3])
    assert sorted(r.entity for r in log.table("queries").collect()) == ["1", "2", "3"]
    monkeypatch.setattr(log, "holds", lambda run: False)  # a second writer that began before the first had ended
    assert add("two", [3])
    for name in ("queries", "query_rules", "query_facts"):
        assert log.table(name).count() == 3
    assert {tuple(r) for r in log.replayed(["o"]).collect()} == {("q-one-1", 2), ("q-one-2", 2), ("q-two-3", 2)}


def test_batches_of_a_stream_are_logged_once(spark, tmp_path):
    log = governance.DecisionLog(spark, f"file://{tmp_path}/log")
    folder = f"{tmp_path}/in"
    spark.createDataFrame([(i, 2) for i in range(5)], "id int, o int").repartition(2).write.parquet(folder)
    write = log.batches(lambda cases: _answers(spark, [r.id for r in cases.collect()])[0], "id", ["o"], "g", "s")
    for restart in range(2):
        stream = spark.readStream.schema("id int, o int").parquet(folder)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint{restart}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.entity for r in log.table("queries").collect()) == list("01234")  # the second start had lost its checkpoint
