"""Decisions that wait for a person: a stream of cases and verdicts with each case's place kept as state.

A message is case_id, seq, kind, flag, sampled, actor. Its kinds: `asked` (flag: the decision is blocked; sampled: it is drawn for
audit), `settle` (flag: approved or rejected) and `audit` (flag: right or wrong). A blocked case waits until a person
settles it, once; any other takes effect at once, and if it is drawn it stays in the audit queue until someone has ruled
on it, once. Verdicts that come before their case are kept until it comes. Verdicts that no longer apply are logged as refused, so none is
lost. A second `asked` of a case is refused too, as are messages of other kinds. Messages with a null case_id belong to no case
and are left out; a null flag counts as false.

In a batch the messages of a case count by seq, then kind, actor and flag, whatever order they arrive in; batches count in turn.
Each batch joins its messages with the state that the batch before it wrote, by windows over a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.sources.tables import delete

MESSAGES = "case_id string, seq long, kind string, flag boolean, sampled boolean, actor string"
#: Kept between batches: the place of each case (mark 0, place, sampled), and the messages that came before it (mark 1).
STATE = f"{MESSAGES}, mark int, place string"

#: Where a case can be, and what is said of a verdict that doesn't apply.
WAITING, SETTLED, APPROVED, REJECTED, AUDITED_OK, AUDITED_WRONG, REFUSED = "waiting", "settled", "approved", "rejected", "audited_ok", "audited_wrong", "refused"


def next_status(status: str | None, sampled: bool, kind: str, flag: bool) -> str:
    """Where a message takes a case that is at status (None: not asked yet), or refused."""
    if kind == "asked" and status is None:
        return WAITING if flag else SETTLED
    if kind == "settle" and status == WAITING:
        return APPROVED if flag else REJECTED
    if kind == "audit" and status == SETTLED and sampled:
        return AUDITED_OK if flag else AUDITED_WRONG
    return REFUSED


def judged(messages: DataFrame, state: DataFrame) -> DataFrame:
    """What a batch makes of its cases and of those kept: the columns of STATE, and open, found, now, drawn.

    open: the case has been asked; found: what a message did; now, drawn: the case's place after the batch.
    """
    rows = messages.where("case_id is not null").withColumns({"mark": F.lit(2), "place": F.lit(None).cast("string")}).unionByName(state)
    case = Window.partitionBy("case_id")
    in_order = [F.col(c).asc_nulls_first() for c in ("seq", "kind", "actor", "flag", "sampled")]
    of_case = lambda where, x: F.max(F.when(where, x)).over(case)
    yes = lambda c: F.coalesce(c, F.lit(False))
    blocked, verdict = yes(F.col("flag")), F.col("mark") > 0
    df = rows.withColumns({"asks": yes((F.col("mark") == 2) & (F.col("kind") == "asked")), "was": of_case(~verdict, F.col("place"))})
    number = F.row_number().over(Window.partitionBy("case_id", "asks").orderBy(*in_order))
    df = df.withColumn("first", F.col("asks") & F.col("was").isNull() & (number == 1))  # the case comes before what was kept for it
    df = df.withColumn("start", F.coalesce("was", of_case(F.col("first"), F.when(blocked, WAITING).otherwise(SETTLED))))
    df = df.withColumns({"open": F.col("start").isNotNull(), "drawn": yes(of_case(~verdict | F.col("first"), yes(F.col("sampled")) & ~(F.col("first") & blocked)))})
    wanted = F.when(F.col("start") == WAITING, "settle").when((F.col("start") == SETTLED) & F.col("drawn"), "audit")
    df = df.withColumn("fits", yes(verdict & (F.col("kind") == wanted)))
    number = F.row_number().over(Window.partitionBy("case_id", "fits").orderBy("mark", *in_order))
    ruled = F.when(F.col("kind") == "settle", F.when(blocked, APPROVED).otherwise(REJECTED)).otherwise(F.when(blocked, AUDITED_OK).otherwise(AUDITED_WRONG))
    df = df.withColumn("found", F.when(F.col("first"), F.col("start")).when(F.col("fits") & (number == 1), ruled).otherwise(REFUSED))
    return df.withColumn("now", F.coalesce(of_case(F.col("fits") & (F.col("found") != REFUSED), F.col("found")), "start"))


def _batch(log_path: str, states: str):
    """A batch's steps and the state after it, in folders by its number: a batch that is repeated writes the same again."""

    def run(messages: DataFrame, number: int) -> None:
        spark = messages.sparkSession
        before = spark.read.schema(STATE).parquet(f"{states}/{number - 1}") if number else spark.createDataFrame([], STATE)
        found = judged(messages, before).persist()
        done = found.where("open and mark > 0").select("case_id", "seq", "kind", F.col("found").alias("status"), F.col("drawn").alias("sampled"), "actor")
        done.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        place = found.where("open").groupBy("case_id").agg(F.first("now").alias("place"), F.first("drawn").alias("sampled"))
        place = place.select("case_id", none("seq", "long"), none("kind", "string"), none("flag", "boolean"), "sampled", none("actor", "string"), F.lit(0).alias("mark"), "place")
        early = found.where("not open").withColumn("mark", F.lit(1)).select(place.columns)
        place.unionByName(early).write.mode("overwrite").parquet(f"{states}/{number}")
        found.unpersist()
        if number > 1:  # a repeated batch reads the state before it only
            delete(spark, f"{states}/{number - 2}")

    return run


def start_waiting(messages: DataFrame, log_path: str, checkpoint: str):
    """Add what the messages do to a log in Parquet, each message once, also after a restart; ends when all that is there is read."""
    typed = messages.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in MESSAGES.split(", ")))
    return typed.writeStream.foreachBatch(_batch(log_path, f"{checkpoint}-cases")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def places(log: DataFrame) -> DataFrame:
    """case_id, status, sampled, by: where each case is, and who ruled on it."""
    rank = F.when(F.col("status").isin(WAITING, SETTLED), 0).otherwise(1)  # a case is asked, then ruled on at most once
    last = log.where(F.col("status") != REFUSED).groupBy("case_id").agg(F.max_by(F.struct("status", "sampled", F.when(rank == 1, F.col("actor")).alias("by")), rank).alias("x"))
    return last.select("case_id", "x.status", "x.sampled", "x.by")


def waiting(log: DataFrame) -> DataFrame:
    """Cases that cannot proceed without a person."""
    return places(log).where(F.col("status") == WAITING).select("case_id")


def audit_queue(log: DataFrame) -> DataFrame:
    """Decisions that took effect and were drawn for audit, on which nobody has ruled yet."""
    return places(log).where((F.col("status") == SETTLED) & F.col("sampled")).select("case_id")


def audited(log: DataFrame) -> DataFrame:
    """query_id, correct: the auditors' verdicts, as outcomes of the rules behind the decisions count them."""
    return places(log).where(F.col("status").isin(AUDITED_OK, AUDITED_WRONG)).select(F.col("case_id").alias("query_id"), (F.col("status") == AUDITED_OK).alias("correct"))
