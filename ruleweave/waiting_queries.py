"""Registered query on decisions that wait for a person: orders as cases, their lines as verdicts, in a stream of two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions.truth import draw
from ruleweave.queries import _register, _t
from ruleweave.sources.tables import scratch
from ruleweave.streaming.waiting import MESSAGES, places, start_waiting


@_register(
    """with asked as (select o_orderkey as case_id, o_orderpriority = '1-URGENT' as blocked, o_orderpriority <> '1-URGENT' and (('0x' || substr(sha256('audit-v1:' || o_orderkey::varchar), 1, 16))::ubigint::double / 18446744073709551616.0) < 0.5 as sampled from orders),
v as (select l_orderkey as case_id, case l_returnflag when 'N' then 'audit' else 'settle' end as kind, case l_returnflag when 'N' then l_discount < 0.05 else l_returnflag = 'A' end as flag, 's' || l_suppkey as actor, l_linenumber as seq from lineitem),
f as (select a.case_id, v.kind, v.flag, v.actor from asked a join v on v.case_id = a.case_id and ((a.blocked and kind = 'settle') or (a.sampled and kind = 'audit')) qualify row_number() over (partition by a.case_id order by seq, kind, actor, flag) = 1)
select a.case_id, case when blocked then case when flag then 'approved' when not flag then 'rejected' else 'waiting' end when flag then 'audited_ok' when not flag then 'audited_wrong' else 'settled' end as status, sampled, actor as by
from asked a left join f on f.case_id = a.case_id"""
)
def waiting_cases(spark, d):
    """Urgent orders wait, others are drawn for audit; lines settle or audit. The second run resumes from the first one's state; open orders come after some of their verdicts."""
    orders, urgent = _t(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT"
    asked = orders.select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.lit(0).cast("long").alias("seq"), F.lit("asked").alias("kind"), urgent.alias("flag"), (draw("audit-v1", F.col("o_orderkey")) < 0.5).alias("sampled"), F.lit("desk").alias("actor"), (F.col("o_orderstatus") == "O").alias("later")
    )
    audits = F.col("l_returnflag") == "N"
    verdicts = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.col("l_linenumber").cast("long").alias("seq"),
        F.when(audits, "audit").otherwise("settle").alias("kind"),
        F.when(audits, F.col("l_discount") < 0.05).otherwise(F.col("l_returnflag") == "A").alias("flag"),
        F.lit(False).alias("sampled"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("actor"),
        (F.col("l_linenumber") > 2).alias("later"),
    )
    messages = asked.unionByName(verdicts)
    source, log, checkpoint = (scratch(spark, k) for k in ("messages", "log", "checkpoint"))
    for later in (False, True):
        messages.where(F.col("later") == later).drop("later").write.mode("append").parquet(source)
        start_waiting(spark.readStream.schema(MESSAGES).parquet(source), log, checkpoint).awaitTermination()
    return places(spark.read.parquet(log)).withColumn("case_id", F.col("case_id").cast("long"))
