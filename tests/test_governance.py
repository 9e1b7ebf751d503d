"""Vocabulary, packs, cases, drafts, answers under approval and their log, oversight, mining, maintenance."""

import json

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import governance, maintenance, mining, oversight
from ruleweave.operators.decisions import clamped, running_total, screening_status
from ruleweave.operators.explain import answer_text, proof_steps, proof_tree, provenance
from ruleweave.operators.lifecycle import RuleStore
from ruleweave.operators.wide import Wide
from ruleweave.plans.rules import canonical_key
from ruleweave.plans.vocabulary import Predicate, Vocabulary, inferred
from ruleweave.queries import OBSERVABLES, customer_pack, customers
from ruleweave.sources import cases as sources
from ruleweave.sources.drafts import judged_drafts, policy_rules
from ruleweave.sources.packs import PackError, available_packs, load_pack
from ruleweave.sources.tables import upsert
from ruleweave.sources.rule_text import parse_atom, parse_program, parse_rule


def test_vocabulary(spark, tmp_path):
    v = Vocabulary([Predicate("p", phrase="{0} is p"), Predicate("q", 2, askable=False), Predicate("h", kind="derived")])
    assert v.askable() == {"p/1"} and v.problems(parse_rule("h(X) <- p(X), q(X, a).")) == []
    assert len(v.problems(parse_rule("p(X) <- r(X).")))== 2 and v.fact_problem(parse_atom("h(a)")) and v.fact_problem(parse_atom("p(a)")) is None
    assert v.phrase(parse_atom("p(ann)")) == "ann is p" and v.phrase(parse_atom("q(a, b)")) == "q(a, b)"
    v.save(spark, f"file://{tmp_path}/v")
    assert Vocabulary.load(spark, f"file://{tmp_path}/v").predicates == v.predicates
    good, bad = v.split([parse_rule("h(X) <- p(X)."), parse_rule("h(X) <- z(X).")])
    assert len(good) == 1 and bad[0][1] == ["z/1 is not declared"]
    with pytest.raises(ValueError):
        Vocabulary([Predicate("p"), Predicate("p")])
    with pytest.raises(ValueError):
        Predicate("p", 1, arg_types=("string", "int"))
    assert [p.name for p in inferred([parse_rule("h(X) <- p(X), not q(X).")]).observables()] == ["p", "q"]


PACK = """
decision: {goal_predicate: hire, outcomes: [hire, wait], label_field: result, label_map: {1: hire}}
context_fields: [senior, other]
criticality: {rules: [{rule_id: top, description: senior post, field: senior, value: true}], default_critical: false}
predicates: [{name: able}, {name: seen, askable: false}, {name: hire, kind: derived}, {name: wait, kind: derived}]
features: [{predicate: able, from: score, op: gte, value: 5}]
seed_rules: [{text: "hire(X) <- able(X), not seen(X).", strength: 0.9}]
"""


def test_pack(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "pack.yaml").write_text(PACK)
    assert available_packs(str(tmp_path)) == ["jobs"] and available_packs(str(tmp_path / "none")) == []
    pack = load_pack(str(tmp_path), "jobs")
    df = spark.createDataFrame([("a", 7, True, "1"), ("b", None, False, "2"), ("c", 1, None, None)], "id string, score int, senior boolean, result string")
    assert [tuple(r) for r in pack.facts(df).collect()] == [("a", 2, 0), ("b", 1, 0), ("c", 0, 0)]
    assert [r.source for r in pack.facts_long(df).collect()] == ["score = 7", "score not supplied", "score = 1"]
    flag, reason = pack.criticality(df)
    got = df.select(flag.alias("f"), reason.alias("r"), pack.label(df).alias("l"), pack.context(df).alias("c")).collect()
    assert [(r.f, r.r, r.l) for r in got] == [(True, "top: senior post", "hire"), (False, "default", "2"), (False, "default", None)]
    assert got[0].c.asDict() == {"senior": True, "other": None, "goal": "hire"}
    assert [r.hire for r in pack.wide().truth(pack.facts(df)).collect()] == [2, 1, 0]
    assert str(pack.goal_for("a")) == "hire(a)" and len(pack.competing("a")) == 2
    (tmp_path / "jobs" / "pack.yaml").write_text(PACK.replace("name: able", "name: hale").replace("outcomes: [hire", "outcomes: [fly").replace("hire(X) <- able(X)", "hire(X <- able(X)"))
    with pytest.raises(PackError) as e:
        load_pack(str(tmp_path), "jobs")
    assert all(x in str(e.value) for x in ("feature able", "outcome fly", "can't be read"))
    spoilt = "domain_id: posts" + PACK.replace("from: score, ", "").replace("field: senior, ", "").replace("strength: 0.9", "strength: high").replace("{name: able}", "{name: able, arity: many}, 7").replace("default_critical: false", "default_critical: false, x: 1")
    (tmp_path / "jobs" / "pack.yaml").write_text(spoilt)
    with pytest.raises(PackError) as e:
        load_pack(str(tmp_path), "jobs")
    assert all(x in str(e.value) for x in ("domain_id is posts", "lacks from", "lacks field", "strength can't be 'high'", "arity can't be 'many'", "predicates holds 7"))


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "x": 1}, {"id": None, "x": 2}, {"x": 3}]))
    assert [r.x for r in sources.json_cases(spark, f"file://{tmp_path}/c.json").collect()] == [1]
    line = "A11 24 A34 A43 5000 A65 A75 4 A92 A102 4 A121 25 A143 A152 2 A173 1 A192 A201 2"
    (tmp_path / "g").write_text(line + "\n" + line.replace("A11", "A13").replace(" 2\n", " 1"))
    raw = sources.credit_file(spark, f"file://{tmp_path}/g")
    one = sources.credit_cases(raw, F.lit("x")).first()
    assert one.overdrawn and one.adverse_history and one.thin_savings and one.guarantor and one.young_applicant and one.long_term and one.large_amount
    assert not one.other_plans and one.sex == "female" and one.outcome == "decline" and one.multiple_credits
    many = spark.range(400).select(F.concat(F.lit("c"), "id").alias("id"), F.lit(True).alias("guarantor"), F.lit(True).alias("thin_savings"), F.lit(False).alias("substantial_savings"))
    gaps = {"other_debtors": ["guarantor"], "savings_status": ["thin_savings", "substantial_savings"]}
    blank = sources.with_gaps(many, "id", gaps, 0.25, 7)
    n = blank.agg(F.count_if(F.col("guarantor").isNull()), F.count_if(F.col("thin_savings").isNull()), F.count_if(F.col("thin_savings").isNull() != F.col("substantial_savings").isNull())).first()
    assert 60 < n[0] < 140 and 60 < n[1] < 140 and n[2] == 0 and sources.with_gaps(many, "id", gaps, 0.0).exceptAll(many).isEmpty()


def hidden_rules(spark):
    priors = {"low_income": 0.5, "renter": 0.5, "savings": 0.4, "bicycle": 0.35}
    return sources.generated(spark, 2000, priors, [(("low_income", "renter"), ("savings",))], ("eligible", "refused"), noise=0.02, gaps=["savings"], missing=0.1, seed=3)


def test_mining_finds_hidden_rules(spark):
    made = hidden_rules(spark)
    assert made.exceptAll(hidden_rules(spark).repartition(7)).isEmpty()
    names = ["low_income", "renter", "savings", "bicycle"]
    cases = made.select("id", (F.col("outcome") == "eligible").alias("label"), *(F.when(F.col(c).isNull(), 1).when(F.col(c), 2).otherwise(0).alias(c) for c in names))
    ranked = mining.candidates(cases, names, "label")
    chosen = mining.proposals(ranked, "eligible")
    assert [str(r) for _, r in chosen][:1] == ["eligible(X) <- low_income(X), renter(X), not savings(X)."] and not any("bicycle" in str(r) for _, r in chosen)
    assert chosen[0][1].strength > 0.95 and mining.proposals(ranked, "eligible", {canonical_key(chosen[0][1])}) == chosen[1:]
    shown = mining.examples(cases, "id", "label", [chosen[0][0]]).collect()
    assert sum(r.example for r in shown) == 5
    constant = cases.withColumn("always", F.lit(2))
    assert [str(c) for c in mining.candidates(constant, [*names, "always"], "label")] == [str(c) for c in ranked]
    assert mining.candidates(cases.limit(0), names, "label") == [] and mining.examples(cases, "id", "label", []).isEmpty()


def records(status):
    return [governance.Record(r, status.get(r.rule_id, "approved")) for r in customer_pack().rules]


def test_ask_log_and_replay(spark, small, tmp_path):
    cases = customers(spark, small)
    asked = governance.ask(cases, "c_custkey", OBSERVABLES, records({"r2": "provisional", "r5": "rejected"}), "decline", ["decline", "approve"], F.col("c_acctbal") < 0)
    log = governance.DecisionLog(spark, f"file://{tmp_path}/log")
    log.append(asked, cases, "c_custkey", OBSERVABLES, "decline", "run1", "ann")
    q = log.queries()
    assert q.count() == cases.count() and q.where("critical and size(provisional) > 0").isEmpty()
    assert not q.where("status = 'blocked_for_approval' and blocked_on = array('r2') and critical").isEmpty()
    again = governance.ask(log.replayed(OBSERVABLES).join(q.select("query_id", "critical"), "query_id"), "query_id", OBSERVABLES, records({"r2": "provisional", "r5": "rejected"}), "decline", ["decline", "approve"], F.col("critical"))
    both = again.join(q.select("query_id", F.col("status").alias("s"), F.col("lower").alias("l"), F.col("rules").alias("r")), "query_id")
    assert both.where("status <> s or not (lower <=> l) or not (array_sort(rules) <=> r)").isEmpty() and both.count() == q.count()
    rules = spark.createDataFrame([(r.rule.rule_id, r.status) for r in records({"r2": "provisional"})], "rule_id string, status string")
    assert governance.violations(log.table("queries"), log.table("query_rules"), rules).isEmpty()
    assert governance.violations(log.table("queries"), log.table("query_rules"), rules.where("rule_id <> 'r4'")).count() == q.where("critical and status = 'answered' and array_contains(rules, 'r4')").count()
    some = q.where("array_contains(rules, 'r4')").first().query_id
    verdict = spark.createDataFrame([(some, True), (some, True)], "query_id string, correct boolean")
    assert {r.rule_id: r.successes for r in log.record_outcomes(verdict).collect()}["r4"] == 1
    assert log.tail(3).count() == 3 and {r.table: r.rows for r in log.row_counts().collect()}["query_facts"] == 4 * q.count()
    assert governance.used_with(q, "r4").count() == governance.impact(log.table("query_rules"), "r4").count()
    assert {(r.rule_id, r.after) for r in governance.routed(records({"r2": "provisional"}), governance.blocking(asked)).collect()} >= {("r2", "pending_online"), ("r1", "approved")}
    texts = {r.text.split(" ")[0] for r in answer_text(asked, "c_custkey", "decline").collect()}
    assert "waits" in texts
    governance.export_record(rules, q, f"file://{tmp_path}/x")
    assert spark.read.csv(f"file://{tmp_path}/x/rules.csv", header=True).count() == 5 and spark.read.json(f"file://{tmp_path}/x/log.json").count() == q.count()


def test_store_checks_and_text(spark, tmp_path):
    v = Vocabulary([Predicate("a"), Predicate("b"), Predicate("h", kind="derived"), Predicate("g", kind="derived")])
    store = RuleStore(spark, f"file://{tmp_path}/s")
    given = [parse_rule(x) for x in ("rule r1 [p=0.6, cites=\"2.1\"] h(X) <- a(X).", "rule r2 h(X) <- zzz(X).", "rule r3 g(X) <- b(X), not h(X).", "rule r4 h(X) <- a(X), not g(X).")]
    assert store.propose(given, False, "ann", v) == ["applied_provisionally", "rejected_invalid", "applied_provisionally", "rejected_invalid"]
    store.approve("r1", "bob")
    assert [(r.rule.rule_id, r.status, r.rule.strength, r.citation) for r in store.records()] == [("r1", "approved", 0.6, "2.1"), ("r3", "provisional", 0.8, "")]
    other = RuleStore(spark, f"file://{tmp_path}/t")
    assert other.import_text(store.export_text()) == ["r1", "r3"] and other.import_text(store.export_text()) == []
    assert [(r.status, str(r.rule), r.rule.strength) for r in other.records()] == [(r.status, str(r.rule), r.rule.strength) for r in store.records()]
    with pytest.raises(ValueError):
        other.import_text("h(X) <- zzz(X).", vocabulary=v)
    with pytest.raises(ValueError):
        store.reject_with_impact("r1", "", "", spark.range(0).selectExpr("'' as rule_id"))


def test_drafts(spark):
    text = "# A\n<!-- rule: h(X) <- p(X) --> <!-- rule: h(X) <-\n q(X). | p=0.5 -->\n## B\n<!-- rule: h(X) <- not p(X). -->"
    found = policy_rules(spark.createDataFrame([(1, text), (2, "<!-- rule: g(X) <- p(X). -->"), (3, None)], "d int, text string"), "d").orderBy("d", "place").collect()
    assert [(r.heading, r.strength, r.problem is None) for r in found] == [("A", 0.9, True), ("A", 0.5, True), ("B", 0.9, False), ("preamble", 0.9, True)]
    assert found[0].rule_key == canonical_key(parse_rule("h(Y) <- p(Y)."))
    known = spark.createDataFrame([(canonical_key(parse_rule("h(X) <- q(X).")),)], "rule_key string")
    drafts = spark.createDataFrame([("h(X) <- p(X)", 3.0, "Clause 4.1 (inverse)", "see clause 4.1."), ("h(Y) <- q(Y).", 0.0, None, "x"), ("h(", None, "implied", "x")], "rule string, strength double, citation string, source string")
    got = {r.rule: r for r in judged_drafts(drafts, known).collect()}
    assert got["h(X) <- p(X)."].strength == 1.0 and got["h(X) <- p(X)."].verified and got["h(X) <- p(X)."].problem is None
    assert got["h(Y) <- q(Y)."].problem == "already in the rule base" and got["h(."].problem and not got["h(."].verified and got["h(."].strength == 0.7


def test_ladder_is_that_of_plain_code(spark):
    def plain(h, r, rights, c):
        if (h >= 9 and rights) or (h >= 8 and r <= 3):
            return "human_only"
        return "human_approval" if h >= 6 or rights or c < 70 else "ai_with_oversight" if h <= 3 and r >= 7 else "ai_recommends"

    grid = spark.range(1, 11).crossJoin(spark.range(1, 11).toDF("r")).crossJoin(spark.createDataFrame([(b, c) for b in (True, False) for c in (0, 69, 70, 71, 100)], "rights boolean, c int"))
    for x in grid.select("*", oversight.classify(F.col("id"), F.col("r"), F.col("rights"), F.col("c")).alias("m")).collect():
        assert x.m == plain(x.id, x.r, x.rights, x.c)
    width = grid.where("c in (0, 100)").select(F.concat_ws("-", "id", "r", "rights", "c").alias("k"), F.col("id").alias("harm"), F.col("r").alias("reversibility"), F.col("rights").alias("rights_impacted"), ((100 - F.col("c")) / 100).alias("interval_width"))
    for x in oversight.allocate(width, "k").collect():
        h, r, rights, c = x.k.split("-")
        assert x.mode == plain(int(h), int(r), rights == "true", int(c)) and x.rules
    modes = spark.createDataFrame([("ai_recommends", "human_only"), ("human_only", "ai_recommends")], "e string, s string")
    assert [r.w is not None for r in modes.select(oversight.downgrade_warning(F.col("e"), F.col("s")).alias("w")).collect()] == [True, False]
    unknown = spark.createDataFrame([("x", None, None, None, None)], "k string, harm int, reversibility int, rights_impacted boolean, interval_width double")
    assert oversight.allocate(unknown, "k").first().mode == "human_approval"


def test_audit_rates(spark):
    d = spark.createDataFrame([(1, "ai_with_oversight"), (2, "ai_with_oversight"), (3, "human_only"), (4, "ai_with_oversight"), (5, "ai_with_oversight")], "k int, mode string")
    used = spark.createDataFrame([(1, "a"), (1, "b"), (2, "p"), (3, "a"), (5, "a")], "k int, rule_id string")
    rules = spark.createDataFrame([("a", "approved", "human", 1000, 0), ("b", "approved", "mined", 3, 3), ("p", "provisional", "human", 900, 0)], "rule_id string, status string, origin string, successes int, failures int")
    got = {r.k: r for r in oversight.audit_rates(d, used, rules, "k").collect()}
    assert got[1].weakest == "b" and 0.9 < got[1].rate < 1 and got[2].rate == got[3].rate == got[4].rate == 1.0 and got[5].rate == pytest.approx(0.02)


def test_maintenance(spark):
    rules = parse_program("rule r1 yes(X) <- a(X), b(X). rule r2 no(X) <- c(X), not yes(X).")[0]
    tried = parse_program("rule n1 yes(X) <- a(X), b(X), c(X). rule n2 yes(X) <- d(X), not d(X). rule n3 no(X) <- a(X). rule n4 yes(X) <- d(X), not c(X). rule n5 no(X) <- none(X).")[0]
    got = dict(maintenance.screen(spark, rules, tried, ["a", "b", "c", "d"], ["yes", "no"]))
    assert got["n1"] == maintenance.REDUNDANT and got["n2"] == got["n5"] == maintenance.DEAD and "two outcomes" in got["n3"] and got["n4"] == maintenance.ADMITTED
    assert dict(maintenance.screen(spark, rules, tried[:1], ["a", "b", "c"], ["yes", "no"], most_inputs=4))["n1"] == maintenance.ADMITTED
    recs = [governance.Record(r, "approved") for r in [*rules, tried[0]]]
    stats = spark.createDataFrame([("r1", "approved", 0.8, 2, 8), ("r2", "approved", 0.8, 9, 1)], "rule_id string, status string, strength double, successes int, failures int")
    assert maintenance.sweep(recs, stats, ["a", "b", "c"], ["yes", "no"]) == (["r1"], [("n1", maintenance.REDUNDANT)])
    assert [r.rule_id for r in governance.audited_badly(stats).collect()] == ["r1"]


def test_proof_tree_and_provenance(spark):
    cases = spark.createDataFrame([(1, 2, 2, 0, 0), (2, 2, 1, 0, 0), (3, 0, 0, 0, 0)], "id long, overdrawn int, large_exposure int, urgent_buyer int, auto_segment int")
    got = {r.id: r.proof for r in proof_tree(customer_pack(), cases, "id", "decline", {"overdrawn": "in the red"}, ("r1",)).collect()}
    want = "decline, probability 0.704\n  by r4, strength 0.88\n    elevated_risk, probability 0.8\n      by r1, strength 0.8 (not approved)\n        in the red (fact)\n        large_exposure (fact)\n    not mitigated (assumed: no rule concludes it)"
    assert got[1] == want and "large_exposure (unknown)" in got[2] and got[3] == "decline (absent)"
    steps = proof_steps(customer_pack(), cases, "id", "decline")
    facts = spark.createDataFrame([(1, "overdrawn", "balance = -5")], "id long, fact string, source string")
    rules = spark.createDataFrame([("r1", "provisional", "mined", "", ""), ("r4", "approved", "human", "ann", "2.1")], "rule_id string, status string, origin string, approved_by string, citation string")
    found = {r.name: r for r in provenance(steps, facts, rules, "id").collect()}
    assert found["r1"].gap and not found["r4"].gap and found["r4"].source == "human, approved by ann, 2.1" and found["overdrawn"].source == "balance = -5" and found["mitigated"].source == "assumed"


def test_small_helpers(spark):
    df = spark.createDataFrame([(g, i, 1) for g in ("a", "b", None) for i in range(50)] + [("a", 99, None)], "g string, i int, v int").repartition(5)
    got = {(r.g, r.i): r.total for r in running_total(df, "g", "i", F.col("v")).collect()}
    assert len(got) == 151 and all(got[g, i] == i + 1 for g in ("a", "b", None) for i in range(50)) and got["a", 99] == 50
    one = spark.createDataFrame([(12.0,), (None,)], "x double").select(clamped(F.col("x"), 0, 10, 5).alias("c"))
    assert [r.c for r in one.collect()] == [10.0, 5.0]
    s = spark.createDataFrame([("mismatch",), ("match",)], "r string").select(screening_status(F.col("r")).alias("a"), screening_status(F.col("r"), False).alias("b"))
    assert [tuple(r) for r in s.collect()] == [("rejected", "review"), ("review", "review")]


def test_upsert(spark):
    stored = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "key string, text string, n int")
    changes = spark.createDataFrame([("b", "new", 9), ("c", "z", 3)], "key string, text string, n int")
    assert sorted(map(tuple, upsert(stored, changes, "key", keep=("text",)).collect())) == [("a", "x", 1), ("b", "y", 9), ("c", "z", 3)]


def test_many_mixed_unknowns(spark):
    n = 16
    text = " ".join(f"rule a{i} [p=0.9] m{i}(X) <- o{i}(X). rule b{i} [p=0.6] g(X) <- o{i}(X), not m{(i + 1) % n}(X)." for i in range(n))
    wide = Wide(parse_program(text)[0], [f"o{i}" for i in range(n)])
    df = spark.range(3).select(*(F.when(F.col("id") * 7 > i, 0).otherwise(1).alias(f"o{i}") for i in range(n)))
    assert [r.exact for r in wide.bounds(df, "g", exact="exact").collect()] == [False, True, True]
