"""How much a person has to do with a decision: modes, audit rates, samples and the gate before a decision takes effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.truth import beta_doubt, draw, feature_of, first_match
from ruleweave.operators.wide import Wide
from ruleweave.sources.rule_text import parse_program

HUMAN_ONLY, HUMAN_APPROVAL, AI_RECOMMENDS, AI_WITH_OVERSIGHT = "human_only", "human_approval", "ai_recommends", "ai_with_oversight"

#: How restrictive a mode is, which mode counts if several hold, and the share of audits by mode.
RESTRICTIVENESS = {AI_WITH_OVERSIGHT: 0, AI_RECOMMENDS: 1, HUMAN_APPROVAL: 2, HUMAN_ONLY: 3}
PRECEDENCE = [HUMAN_ONLY, HUMAN_APPROVAL, AI_WITH_OVERSIGHT, AI_RECOMMENDS]
AUDIT_SHARE = {HUMAN_ONLY: 0.50, HUMAN_APPROVAL: 0.20, AI_RECOMMENDS: 0.10, AI_WITH_OVERSIGHT: 0.05}
#: The accuracy a rule must have by its origin, the least audit rate, and the inputs that are supposed.
TARGETS = {"mined": 0.85, "document": 0.80, "human": 0.80}
DEFAULT_TARGET, AUDIT_FLOOR, SALT = 0.80, 0.02, "audit-v1"
DEFAULTS = {"harm": 5, "reversibility": 5, "rights": False, "confidence": 50}
#: What the rules of the modes look at.
FEATURES = [
    ("harm_extreme", "harm", "gte", 9),
    ("harm_high", "harm", "gte", 8),
    ("harm_material", "harm", "gte", 6),
    ("harm_low", "harm", "lte", 3),
    ("hard_to_reverse", "reversibility", "lte", 3),
    ("easily_reversible", "reversibility", "gte", 7),
    ("rights_impacted", "rights_impacted", "truthy", None),
    ("uncertain", "interval_width", "gte", 0.30),
]
#: The rules of the modes.
LADDER = """
rule ov1 [p=0.99] human_only(D) <- harm_extreme(D), rights_impacted(D).
rule ov2 [p=0.99] human_only(D) <- harm_high(D), hard_to_reverse(D).
rule ov3 [p=0.97] human_approval(D) <- harm_material(D), not human_only(D).
rule ov4 [p=0.97] human_approval(D) <- rights_impacted(D), not human_only(D).
rule ov5 [p=0.95] human_approval(D) <- uncertain(D), not human_only(D).
rule ov6 [p=0.95] ai_with_oversight(D) <- harm_low(D), easily_reversible(D), not human_only(D), not human_approval(D).
rule ov7 [p=0.9] ai_recommends(D) <- decision(D), not human_only(D), not human_approval(D), not ai_with_oversight(D).
"""


def classify(harm: Column, reversibility: Column, rights: Column, confidence: Column) -> Column:
    """The mode by four estimates; the first that matches counts."""
    steps = [
        (((harm >= 9) & rights) | ((harm >= 8) & (reversibility <= 3)), HUMAN_ONLY),
        ((harm >= 6) | rights | (confidence < 70), HUMAN_APPROVAL),
        ((harm <= 3) & (reversibility >= 7), AI_WITH_OVERSIGHT),
    ]
    return first_match(steps, AI_RECOMMENDS)


def _rank(mode: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RESTRICTIVENESS.items() for x in kv)), mode)


def is_downgrade(effective: Column, suggested: Column) -> Column:
    """Whether the mode in effect gives away more than the one suggested."""
    return _rank(effective) < _rank(suggested)


def downgrade_warning(effective: Column, suggested: Column) -> Column:
    """A notice where it does, else null."""
    text = F.concat(F.lit("suggested "), suggested, F.lit(", selected "), effective, F.lit(": less human control, on the selecting person's account"))
    return F.when(is_downgrade(effective, suggested), text)


def ladder() -> Wide:
    return Wide(parse_program(LADDER)[0], ["decision", *(f[0] for f in FEATURES)])


def allocate(df: DataFrame, key: str, mode: str = "mode") -> DataFrame:
    """key, mode, rules: modes by rules over harm, reversibility, rights_impacted, interval_width; null fields are unknown.

    The first mode of PRECEDENCE that holds counts. If none holds, as some field is unknown, a person must approve.
    """
    facts = df.select(key, F.lit(2).alias("decision"), *(feature_of(df, field, op, value).alias(name) for name, field, op, value in FEATURES))
    wide = ladder()
    found = wide.truth(facts)
    chosen = first_match([(F.col(m) == 2, m) for m in PRECEDENCE], HUMAN_APPROVAL)
    fired = F.array_compact(F.array(*(F.when(F.col(f"fired_{r.rule_id}") == 2, F.lit(r.rule_id)) for r in wide.rules)))
    return found.select(key, chosen.alias(mode), fired.alias("rules"))


def audit_rates(decisions: DataFrame, used: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key, mode, rate, weakest: the audit rate of each decision (key, mode), by the weakest rule that it used.

    used: key, rule_id; rules: rule_id, status, origin, successes, failures. A decision that a person sees anyway, that no
    rule gives, or that a provisional rule touches is always audited.
    """
    target = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv)), F.col("origin")), F.lit(DEFAULT_TARGET))
    doubts = rules.select("rule_id", (F.col("status") == "provisional").alias("provisional"), beta_doubt(F.col("successes"), F.col("failures"), target).alias("doubt"))
    worst = used.select(key, "rule_id").join(doubts, "rule_id").groupBy(key).agg(F.max("provisional").alias("provisional"), F.max(F.struct("doubt", "rule_id")).alias("w"))
    rate = first_match([(F.col("mode") != AI_WITH_OVERSIGHT, 1.0), (F.col("w").isNull(), 1.0), (F.col("provisional"), 1.0)], None)
    by_doubt = F.least(F.greatest(F.lit(AUDIT_FLOOR) + (1 - AUDIT_FLOOR) * F.col("w.doubt"), F.lit(AUDIT_FLOOR)), F.lit(1.0))
    return decisions.join(worst, key, "left").select(key, "mode", F.coalesce(rate.cast("double"), by_doubt).alias("rate"), F.col("w.rule_id").alias("weakest"))


def sampled(key: Column, rate: Column, salt: str = SALT) -> Column:
    """Whether a decision is drawn for audit: the same answer for everyone who computes it."""
    return (rate >= 1.0) | ((rate > 0.0) & (draw(salt, key) < rate))


def gate(df: DataFrame, key: str, mode: str = "mode", covered: str = "covered") -> DataFrame:
    """df with blocked, rate and sampled: only a decision that no approved rule covers, in a mode of human control, waits."""
    share = F.element_at(F.create_map(*(F.lit(x) for kv in AUDIT_SHARE.items() for x in kv)), F.col(mode))
    blocked = ~F.coalesce(F.col(covered), F.lit(False)) & F.coalesce(F.col(mode), F.lit(HUMAN_APPROVAL)).isin(HUMAN_ONLY, HUMAN_APPROVAL)
    out = df.withColumns({"blocked": blocked, "rate": F.coalesce(share, F.lit(0.1))})
    return out.withColumn("sampled", ~F.col("blocked") & sampled(F.col(key), F.col("rate"), "audit"))


def took_effect(status: Column, mode: Column, drawn: Column) -> Column:
    """Whether an answer takes effect without a person: answered, automatic and not drawn for audit."""
    return (status == "answered") & (mode == AI_WITH_OVERSIGHT) & ~drawn
