"""Cutting lineage: tables written to the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import scratch_path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    A lost executor then costs a re-read, not a recomputation; column pruning and filters
    reach the written files.  ``batch_rows`` holds for the Arrow batches of this write alone."""
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    try:
        if batch_rows:
            conf.set(_BATCH, str(batch_rows))
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_columns_free(df: DataFrame, *names: str) -> str:
    """A prefix for helper columns that clashes with none of the input's columns."""
    prefix = "__"
    while any(c.lower().startswith(prefix + n) for c in df.columns for n in names):
        prefix += "_"
    return prefix


#: Bits of the filter of ``perhaps_in``: 524,288 words of 64 at most, so 8 MB.
FILTER_BITS = 1 << 25


def perhaps_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the same column of ``keys``: all that are, and a
    share of the others that grows with the number of keys.  A join then shuffles few rows that find
    no partner.  The keys' bits are OR-ed into words, which are few enough to broadcast at any size."""
    p = with_columns_free(df, "slot", "word", "bits")
    slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    words = keys.select(slot.alias(p + "slot")).groupBy(F.expr(f"{p}slot div 64").alias(p + "word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({p}slot % 64 as int)))").alias(p + "bits"))
    return df.withColumn(p + "slot", slot).withColumn(p + "word", F.expr(f"{p}slot div 64")).join(
        F.broadcast(words), p + "word").where(
        f"shiftrightunsigned({p}bits, cast({p}slot % 64 as int)) & 1 = 1").select(df.columns)
