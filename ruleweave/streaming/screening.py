"""Screening a stream of cases: truth columns and bounds on each micro-batch, appended to a log of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.decisions import commit
from ruleweave.operators.wide import Wide


def screen(wide: Wide, cases: DataFrame, key: str, outcomes: list[str]) -> DataFrame:
    """key, lower and upper of each outcome, and decision. Projections only, so a stream of cases needs no state."""
    df = cases.select(key, *wide.observables)
    for o in outcomes:
        df = wide.bounds(df, o, f"lower_{o}", f"upper_{o}")
    return df.select(key, *(c for o in outcomes for c in (f"lower_{o}", f"upper_{o}")), commit(outcomes).alias("decision"))


def start_screening(wide: Wide, stream: DataFrame, key: str, outcomes: list[str], log_path: str, checkpoint: str):
    """Write the decisions of a stream of cases as Parquet; each case is decided once, also after a restart."""
    return screen(wide, stream, key, outcomes).writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def decision_rates(decisions: DataFrame, at: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions for each window of event time, with a watermark for late cases."""
    return decisions.withWatermark(at, late).groupBy(F.window(at, window), "decision").count()
