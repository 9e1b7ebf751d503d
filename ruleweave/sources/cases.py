"""Tables of cases: JSON records, the public German credit file, gaps in records, and generated cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions.truth import draw

#: Columns of the credit file, in order, and those that hold numbers.
CREDIT_COLUMNS = (
    "checking_status duration_months credit_history purpose credit_amount savings_status employment_since installment_rate personal_status_sex "
    "other_debtors residence_since property age_years other_installment_plans housing existing_credits job dependants telephone foreign_worker target"
).split()
CREDIT_NUMBERS = frozenset("duration_months credit_amount installment_rate residence_since age_years existing_credits dependants target".split())
#: Observables of a credit case that hold if a field has one of these codes, or is in a range.
CREDIT_CODES = {
    "overdrawn": ("checking_status", "A11"),
    "no_checking_account": ("checking_status", "A14"),
    "healthy_balance": ("checking_status", "A13"),
    "adverse_history": ("credit_history", "A33 A34"),
    "clean_history": ("credit_history", "A30 A31"),
    "thin_savings": ("savings_status", "A61 A65"),
    "substantial_savings": ("savings_status", "A63 A64"),
    "employed_long": ("employment_since", "A74 A75"),
    "unemployed": ("employment_since", "A71"),
    "guarantor": ("other_debtors", "A102 A103"),
    "owns_property": ("property", "A121"),
    "no_property": ("property", "A124"),
    "other_plans": ("other_installment_plans", "A141 A142"),
    "foreign_worker": ("foreign_worker", "A201"),
}
CREDIT_RANGES = {
    "large_amount": ("credit_amount", 5000, None),
    "long_term": ("duration_months", 24, None),
    "high_instalment_burden": ("installment_rate", 4, None),
    "multiple_credits": ("existing_credits", 2, None),
    "young_applicant": ("age_years", None, 26),
}
#: Fields that may be missing, and what is unknown then.
CREDIT_GAPS = {"other_debtors": ["guarantor"], "savings_status": ["thin_savings", "substantial_savings"], "employment_since": ["employed_long", "unemployed"], "property": ["owns_property", "no_property"]}


def json_cases(spark: SparkSession, path: str, entity: str = "id") -> DataFrame:
    """Records of a JSON list (or of one record a line), one row for each value of the entity field."""
    found = spark.read.json(path, multiLine=True)
    if entity not in found.columns:
        raise ValueError(f"the records have no field {entity}")
    return found.where(F.col(entity).isNotNull())


def credit_file(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows under their column names, with `line`, the number of the row."""
    schema = ", ".join(f"{c} {'int' if c in CREDIT_NUMBERS else 'string'}" for c in CREDIT_COLUMNS)
    return spark.read.csv(path, schema=schema, sep=" ")


def credit_cases(raw: DataFrame, entity: Column) -> DataFrame:
    """Observables, attributes for analysis and the outcome of each row; sex is kept as an attribute, never as an observable."""
    codes = [F.col(c).isin(*values.split()).alias(name) for name, (c, values) in CREDIT_CODES.items()]
    ranges = [(F.col(c) >= low if low is not None else F.col(c) < high).alias(name) for name, (c, low, high) in CREDIT_RANGES.items()]
    sex = F.when(F.col("personal_status_sex").isin("A92", "A95"), "female").otherwise("male").alias("sex")
    outcome = F.when(F.col("target") == 2, "decline").otherwise("approve").alias("outcome")
    return raw.select(entity.alias("id"), *codes, *ranges, sex, "credit_amount", "duration_months", "age_years", outcome)


def with_gaps(cases: DataFrame, key: str, gaps: dict[str, list[str]], rate: float, seed: int = 0) -> DataFrame:
    """cases with the columns of each gap blank together in a share of rows, drawn reproducibly by key."""
    blank = {c: draw(f"gap-{seed}-{name}", F.col(key)) < rate for name, columns in gaps.items() for c in columns}
    return cases.select(*(F.when(~blank[c], F.col(c)).alias(c) if c in blank else F.col(c) for c in cases.columns))


def generated(
    spark: SparkSession,
    n: int,
    priors: dict[str, float],
    rules: Sequence[tuple[Sequence[str], Sequence[str]]],
    label: tuple[str, str],
    noise: float = 0.0,
    gaps: Sequence[str] = (),
    missing: float = 0.0,
    seed: int = 0,
    prefix: str = "case_",
) -> DataFrame:
    """n cases with attributes drawn by their priors, a label by hidden rules, and gaps made after the label.

    rules: attributes that must hold and that must not; a case gets label[0] if one rule holds, else label[1]; a share of
    `noise` labels is flipped. All draws come from the case's number and the seed, so any partitioning gives one table.
    """
    number = F.col("id")
    ids = spark.range(n).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), len(str(max(n - 1, 1))), "0")).alias("id"))
    flags = ids.select("id", *((draw(f"{seed}-{a}", number) < p).alias(a) for a, p in priors.items()))
    fired = F.lit(False)
    for required, forbidden in rules:
        one = F.lit(True)
        for a in required:
            one = one & F.col(a)
        for a in forbidden:
            one = one & ~F.col(a)
        fired = fired | one
    flipped = draw(f"{seed}-noise", number) < noise
    labelled = flags.withColumn("label_flipped", flipped).withColumn("outcome", F.when(fired != flipped, label[0]).otherwise(label[1]))
    return with_gaps(labelled, "id", {a: [a] for a in gaps}, missing, seed)
