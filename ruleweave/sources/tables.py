"""Tables in the shared folder, and tables kept as event logs."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one, but only if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ruleweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


#: Session setting: the number of parts in which cases are kept.
_PARTS = "ruleweave.case.parts"
#: Joins may use parts that agree on some of the keys. A union of such tables doesn't pass for placed: Spark 4.1 lost track of
#: the parts below one, and counted a case three times.
_PLACED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.unionOutputPartitioning": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
#: Rows of a table by case that a part should hold.
ROWS_A_PART = 100_000


def case_parts(spark: SparkSession) -> int:
    return int(spark.conf.get(_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def by_case(df: DataFrame, rows: int) -> DataFrame:
    """The largest table by case of a program, saved; tables that are saved after it are kept in as many parts as its rows ask for."""
    spark = df.sparkSession
    spark.conf.set(_PARTS, str(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_PART))))
    return saved(df)


def saved(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, which every executor sees; it is deleted when the driver ends.

    Rows with a case_id are kept in parts by it, so joins and groups within a case move no rows. More frames with the same columns
    are appended one after the other, each from the parts in which it is.
    """
    spark = df.sparkSession
    path = scratch(spark, "ruleweave")
    if "case_id" not in df.columns:
        reduce(DataFrame.unionByName, more, df).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    for key, value in _PLACED.items():
        spark.conf.set(key, value)
    n, name = case_parts(spark), path.rsplit("/", 1)[1].replace("-", "_")
    for x in (df, *more):
        x.select(df.columns).repartition(n, "case_id").write.bucketBy(n, "case_id").option("path", path).mode("append").format("parquet").saveAsTable(name)
    return spark.table(name)


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        spark.sql(f"drop table if exists `{path.rsplit('/', 1)[1].replace('-', '_')}`")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def upsert(stored: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """stored with changes merged in by key; columns in keep stay as first stored."""
    old = stored.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in keep))
    merged = changes.join(old, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in stored.columns))
    return stored.join(changes.select(key), key, "left_anti").select(stored.columns).unionByName(merged)
