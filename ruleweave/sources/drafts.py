"""Rules that others have drafted: annotations in policy documents, and a table of drafts from a language model.

Reading a rule is the one step done in Python, over the few distinct texts of rules; finding and joining is Spark's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.plans.rules import canonical_key
from ruleweave.sources.rule_text import parse_rule

#: The form of an annotation, and what its parts are.
NOTE = r"<!--\s*rule:\s*((?:[^|\-]|-(?!->))*?)\s*(?:\|\s*p\s*=\s*([0-9.]+)\s*)?-->"
HEADING = r"(?m)^#{1,6}[ \t]*([^\n]*?)[ \t]*$"
DEFAULT_STRENGTH, DRAFT_STRENGTH = 0.9, 0.7


def read_rules(df: DataFrame, column: str = "rule") -> DataFrame:
    """df with r, a struct of key and problem: the canonical key of a rule's text, or why it can't be read; each distinct text is read once."""

    @F.pandas_udf("key string, problem string")
    def read(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[str | None, str | None]:
            try:
                return canonical_key(parse_rule(t or "")), None
            except ValueError as e:
                return None, str(e).splitlines()[0]

        return pd.DataFrame([one(t) for t in texts], columns=["key", "problem"])

    texts = df.select(F.col(column).alias("__rule")).distinct()
    known = texts.withColumn("r", read(F.col("__rule")))
    return df.join(known, F.col(column).eqNullSafe(F.col("__rule")), "left").drop("__rule")


def policy_rules(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, place, heading, rule, strength, rule_key, problem of all annotations <!-- rule: head <- body. | p=0.9 -->.

    A document may hold several on one line, and one over several lines. heading is the last one before the annotation,
    else preamble. problem tells why a rule can't be read; such a note is kept, so that its author learns of it.
    """
    text = F.col(column).cast("string")
    marked = documents.where(text.contains("<!--")).select(F.col(key), text.alias("__text"))
    gaps = F.split("__text", NOTE, -1)
    notes = F.regexp_extract_all("__text", F.lit(NOTE), F.lit(1))
    strengths = F.regexp_extract_all("__text", F.lit(NOTE), F.lit(2))
    zipped = F.transform(notes, lambda n, i: F.struct(i.alias("place"), n.alias("rule"), F.get(strengths, i).alias("p"), F.array_join(F.slice(gaps, F.lit(1), i + 1), "\n\n").alias("before")))
    each = marked.select(key, F.inline(zipped))
    headings = F.regexp_extract_all("before", F.lit(HEADING), F.lit(1))
    rule = F.regexp_replace("rule", r"([^.])$", "$1.")
    found = each.select(key, "place", F.coalesce(F.try_element_at(headings, F.lit(-1)), F.lit("preamble")).alias("heading"), rule.alias("rule"), F.coalesce(F.expr("try_cast(nullif(p, '') as double)"), F.lit(DEFAULT_STRENGTH)).alias("strength"))
    return read_rules(found).select(key, "place", "heading", "rule", "strength", F.col("r.key").alias("rule_key"), F.col("r.problem").alias("problem"))


def judged_drafts(drafts: DataFrame, known: DataFrame, source: str = "source") -> DataFrame:
    """drafts (rule, strength, citation and the source's text) with rule_key, strength, verified and problem.

    A draft is set aside if it can't be read or a known rule (rule_key) has its key. Strengths come into [0.01, 1]. A
    citation is verified if what stands before its first bracket occurs in the source.
    """
    rule = F.regexp_replace(F.trim("rule"), r"([^.])$", "$1.")
    anchor = F.lower(F.trim(F.regexp_replace(F.substring_index("citation", "(", 1), r"^[\s.,;:]+|[\s.,;:]+$", "")))
    cited = F.col("citation").isNotNull() & (F.trim("citation") != "")
    verified = ~cited | F.col(source).isNull() | ((anchor != "") & F.contains(F.lower(F.col(source)), anchor))
    strength = F.round(F.least(F.greatest(F.coalesce(F.col("strength").cast("double"), F.lit(DRAFT_STRENGTH)), F.lit(0.01)), F.lit(1.0)), 3)
    read = read_rules(drafts.withColumn("rule", rule)).withColumns({"rule_key": F.col("r.key"), "strength": strength, "verified": F.coalesce(verified, F.lit(False))})
    old = known.select("rule_key", F.lit(True).alias("__old")).distinct()
    joined = read.join(old, "rule_key", "left")
    problem = F.coalesce(F.col("r.problem"), F.when(F.col("__old"), "already in the rule base"))
    return joined.withColumn("problem", problem).drop("r", "__old")
