"""Helpers shared by the operators: reading tables, shared-folder tables, and checked collection."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores after it until no taken one equals it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for use in an expression, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def sampled(df: DataFrame, column: str, share: float) -> DataFrame:
    """The rows whose hash of a column is below a share of all 64-bit hashes: fine enough for a table of any size."""
    return df if share >= 1 else df.where(F.xxhash64(column) < F.lit(int(share * 2.0**64) - 2**63))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    atexit.register(_delete, spark, path)
    return path


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as a Parquet table into the shared folder and read it back.

    Every executor sees the table, so the loss of one costs nothing. It is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "ruleweave")
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Text bytes handled at a time inside a task, so that memory doesn't grow with the length of the texts of a batch.
SLICE_BYTES = 4 << 20


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cut Arrow batches into runs of rows with about `most` bytes in `column`; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(df: DataFrame, make, fields: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Append columns computed in Arrow batches from one text column, which is dropped; the others pass as they are.

    make() is called once a task and returns f(list of texts) -> {name: list or array}, for the names in `fields`. Where the
    table has a column of such a name already, the new one's name gets underscores until it is free.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    keys = [c for c in df.columns if c != column]
    added = StructType.fromDDL(fields)
    kinds = to_arrow_schema(added)
    names = list(keys)
    for field in added.fields:
        names.append(free_name(names, field.name))

    def run(batches):
        f = make()
        for part in slices(batches, "__text", most):
            got = f(part.column("__text").to_pylist())
            made = [got[x.name] if isinstance(got[x.name], pa.Array) else pa.array(got[x.name], type=x.type) for x in kinds]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[f"c{i}" for i in range(len(names))])

    plain = df.select(*(F.col(quoted(k)).alias(f"c{i}") for i, k in enumerate(keys)), F.col(quoted(column)).alias("__text"))
    schema = StructType([*plain.schema.fields[:-1], *(StructField(f"c{len(keys) + i}", x.dataType) for i, x in enumerate(added.fields))])
    return plain.mapInArrow(run, schema).toDF(*names)  # names inside are plain, as any may hold dots
