"""One case in place of those alike but for names, against judging each case by itself."""

import random

from pyspark.sql import functions as F
from test_relational import relation
from test_worlds import BASE, random_rules

from ruleweave.operators import alike
from ruleweave.operators.alike import Alike
from ruleweave.operators.relational import Program
from ruleweave.operators.variants import Trial, with_each, without_each
from ruleweave.operators.worlds import Worlds, answers
from ruleweave.sources.rule_text import parse_program

RULES = "rule a [p=0.9] yes(X) <- p(X), e(X, Y), not q(Y). rule b [p=0.8] yes(X) <- q(X), e(Y, X). rule c [p=0.7] no(X) <- p(X), not q(X). rule d [p=0.6] yes(all) <- e(X, a)."


def renamed_cases(rnd, kinds, copies):
    """Random cases over a, b, c, and each of them again under other names of b and c; a is named by the rules."""
    facts = {}
    for k in range(kinds):
        one = {(p, args): rnd.choice([0, 1, 2, 2]) for p, n in BASE for args in ([(x,) for x in "abc"] if n == 1 else [(x, y) for x in "abc" for y in "abc"]) if rnd.random() < 0.5}
        for i in range(copies):
            names = {"a": "a", **dict(zip("bc", rnd.sample("bcdefghxyz", 2), strict=True))}
            facts[k + kinds * i] = {(p, tuple(names[x] for x in args)): t for (p, args), t in one.items()}
    return facts


def tables(spark, facts):
    return {f"{p}/{n}": relation(spark, [(c, *args, t) for c in facts for (q, args), t in facts[c].items() if q == p], n) for p, n in BASE}


def test_equal_keys_only_where_a_renaming_exists(spark):
    facts = renamed_cases(random.Random(3), 12, 4)
    rules = parse_program(RULES)[0]
    found = Alike(rules, tables(spark, facts))
    keys = {r.member: (r.key, [x.split(":")[1] for x in r.names]) for r in found.each.collect()}
    assert keys.keys() == facts.keys() and sum(r.cases for r in found.kinds.collect()) == len(facts)
    for c, (key, names) in keys.items():
        for other, (key2, names2) in keys.items():
            if key == key2:
                to = {"a": "a", **dict(zip(names, names2, strict=True))}
                assert {(p, tuple(to[x] for x in args)): t for (p, args), t in facts[c].items()} == facts[other]
    assert found.kinds.count() <= 20  # constants that stay alike may be numbered in two ways


def test_sorts_large_cases_and_mixed_types(spark, monkeypatch):
    rules = parse_program("rule a g(L) <- line(L, S), t(S).")[0]
    rows = [(1, 1, 7, 2), (2, 5, 3, 2), (3, 4, 4, 2), *((4, i, i, 2) for i in range(200)), *((5, i, i, 2) for i in range(200))]
    line = spark.createDataFrame(rows, "case_id int, a0 int, a1 int, t int")
    trusted = spark.createDataFrame([(1, 7, 2), (2, 3, 2), (3, 4, 2), (4, 1, 2), (5, 1, 2), (None, 1, 2)], "case_id int, a0 bigint, t int")
    kinds = lambda rel, rules=rules: sorted((r.case_id, r.cases) for r in Alike(rules, rel).kinds.collect())
    assert kinds({"line/2": line, "t/1": trusted}) == [(1, 3), (4, 1), (5, 1)]  # a line's number is no supplier's
    assert kinds({"line/2": line, "t/1": trusted.withColumn("a0", F.col("a0").cast("string"))}) == [(c, 1) for c in range(1, 6)]
    assert kinds({"line/2": line, "t/1": trusted}, parse_program("rule a g(L) <- line(L, 3).")[0]) == [(1, 2), (2, 1), (4, 1), (5, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a case goes on in the next batch
    try:
        assert kinds({"line/2": line, "t/1": trusted}) == [(1, 3), (4, 1), (5, 1)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_answers_in_each_cases_own_names(spark):
    facts = renamed_cases(random.Random(5), 3, 3)
    program, relations = Program(parse_program(RULES)[0]), tables(spark, facts)
    constants = {c: sorted({x for _, args in f for x in args}) for c, f in facts.items()}
    goals = {f"{g}/1": spark.createDataFrame([(c, x) for c in facts for x in [*constants[c], "all"]], "case_id int, a0 string") for g in ("yes", "no")}
    found = {r.case_id: r for r in answers(program, relations, ["yes/1", "no/1"], goals, limit=2).collect()}
    assert found.keys() == facts.keys()
    worlds = {g: Worlds(program, relations, g, goals[g]) for g in goals}
    for g, w in worlds.items():
        for r in w.bounds().collect():
            (got,) = [o for o in found[r.case_id].outcomes if o.goal == f"{g[:-2]}({r.a0})"]
            assert (round(got.lower, 9), round(got.upper, 9), got.exact) == (round(r.lower, 9), round(r.upper, 9), r.exact)
    asked = {}
    for r in worlds["yes/1"].questions(limit=2).collect():
        asked.setdefault(r.case_id, []).append((r["rank"], r.a0, r.question, r.decisive, round(r.gain, 6)))
    for c, r in found.items():
        assert [(q.question, q.decisive, round(q.gain, 6)) for q in r.questions] == [x[2:] for x in sorted(asked.get(c, []))]
        order = [(-round((o.lower + o.upper) / 2, 9), o.goal) for o in r.outcomes]
        assert order == sorted(order)


def test_counted_trials(spark):
    rnd = random.Random(9)
    facts = renamed_cases(rnd, 6, 4)
    rules = random_rules(rnd)
    variants = [*without_each(rules), *with_each(parse_program("rule n1 f(X, Y) <- q(X), e(X, Y). rule n2 g(X) <- p(X), not q(X).")[0])]
    each, counted = (Trial(Program(rules), tables(spark, facts), variants, counted=c) for c in (False, True))
    assert counted.cases.count() < each.cases.count() == len(facts)
    recorded = spark.createDataFrame([(c, rnd.choice(["g", "d", None])) for c in facts], "case_id int, conclusion string")
    rows = lambda t: [sorted(map(tuple, df.collect())) for df in (t.effects(["g/1", "d/1"]), t.screen(["g/1", "d/1"]), t.replay("g/1", recorded))]
    assert rows(each) == rows(counted)


def test_many_kinds_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(alike, "MOST_SENT", 0)
    facts = renamed_cases(random.Random(4), 4, 2)
    found = Alike(parse_program(RULES)[0], tables(spark, facts))
    rows = found.all_of(found.kinds.select("case_id", F.col("case_id").alias("one"))).collect()
    assert {r.case_id for r in rows} == facts.keys() and len(rows) == len(facts)
