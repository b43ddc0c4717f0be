"""Text scans: CSV with header (S1), whitespace-delimited lines with a quoted
last field (S2), the experiment config table (S3), result read-back (S4).

All are lazy DataFrame scans; nothing is read on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import MANIFEST, ROWS
from ..functions.scalar import constraint_direction, constraint_feature, file_stem, fold_from_label, split_list

# The config defaults.
DEFAULT_MONOTONIC = ""
DEFAULT_OBJECTIVE = "count:poisson"
DEFAULT_LR = 0.1
# The whitespace file's column names and types (Auto MPG).
AUTO_MPG_COLUMNS = [("mpg", "double"), ("cylinders", "int"), ("displacement", "double"),
                    ("horsepower", "string"), ("weight", "double"), ("acceleration", "double"),
                    ("model_year", "int"), ("origin", "int"), ("car_name", "string")]


def read_csv(spark: SparkSession, path: str, schema: str | None = None,
             null_value: str | None = None) -> DataFrame:
    """CSV with a header.  Pass ``schema`` at scale (inference costs a
    pass); ``null_value='NA'`` reads that text as NULL (trap T1)."""
    r = spark.read.option("header", True).option("ignoreTrailingWhiteSpace", False) \
        .option("ignoreLeadingWhiteSpace", False)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return r.csv(path)


def read_whitespace(spark: SparkSession, path: str,
                    columns: Sequence[tuple[str, str]] = AUTO_MPG_COLUMNS) -> DataFrame:
    """Whitespace-separated fields; a double-quoted field may hold blanks.
    Every line splits into tokens with one regex; tokens are typed by name
    (``try_cast``, so '?' becomes NULL for numbers).  Fields that a short line lacks are NULL."""
    toks = F.regexp_extract_all(F.col("value"), F.lit(r'("[^"]*"|\S+)'), 1)
    lines = spark.read.text(path).where(F.trim("value") != "").select(toks.alias("t"))
    out = []
    for i, (name, typ) in enumerate(columns):
        raw = F.regexp_replace(F.try_element_at("t", F.lit(i + 1)), r'^"|"$', "")
        out.append((raw if typ == "string" else raw.try_cast(typ)).alias(name))
    return lines.select(*out)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """S3 (+ F12, F13, F14): config rows with defaults; ``monotonic`` parsed to a
    map (last duplicate wins; a bad direction raises)."""
    df = read_csv(spark, path, "dataset string, target string, monotonic string, "
                               "objective string, lr string")
    df = (df.withColumn("monotonic", F.coalesce("monotonic", F.lit(DEFAULT_MONOTONIC)))
            .withColumn("objective", F.coalesce("objective", F.lit(DEFAULT_OBJECTIVE)))
            .withColumn("lr", F.coalesce(F.col("lr").try_cast("double"), F.lit(DEFAULT_LR)))
            .withColumn("name", file_stem("dataset")))
    items = F.transform(split_list("monotonic"),
                        lambda s: F.struct(constraint_feature(s).alias("k"),
                                           constraint_direction(s).alias("v")))
    # map_from_entries keeps the last value of a duplicate key only under LAST_WIN
    entries = F.aggregate(items, F.create_map().cast("map<string,int>"),
                          lambda acc, e: F.map_concat(
                              F.map_filter(acc, lambda k, v: k != e["k"]),
                              F.create_map(e["k"], e["v"])))
    return df.withColumn("monotonic", entries)


def read_results(spark: SparkSession, path: str, datasets: Sequence[str] | None = None, run: str | None = None) -> DataFrame:
    """The committed rows of ``datasets`` (default: all), of one run or else of each dataset's latest
    run.  Datasets that have none give no rows; partitions of other runs are not read."""
    committed = spark.read.parquet(f"{path}/{MANIFEST}")
    if datasets is not None:
        committed = committed.where(F.col("dataset").isin(list(datasets)))
    if run is not None:
        committed = committed.where(F.col("run") == run)
    latest = committed.groupBy("dataset").agg(F.max_by("version", F.struct("run", "version")).alias("version"))
    versions = [r["version"] for r in latest.select("version").distinct().collect()]     # a version per dataset and run
    schema = ", ".join(f"{c} string" for c in ("dataset", "run", "version"))
    rows = spark.read.parquet(f"{path}/{ROWS}")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("dataset", "version")}).drop("run").where(
        F.col("version").isin(versions))
    told = spark.createDataFrame(latest.collect(), "dataset string, version string") if versions else \
        spark.createDataFrame([], schema).select("dataset", "version")
    return rows.join(F.broadcast(told), ["dataset", "version"], "left_semi").drop("version")


def read_diagnostics(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table that ``write_diagnostics`` wrote."""
    return spark.read.parquet(f"{path}/{name}")


def read_processed(spark: SparkSession, path: str, n_folds: int = 6) -> DataFrame:
    """A table written by ``write_processed``, with ``fold`` as a number.  The
    label 'test' is the last fold; a label that is neither it nor a number gives
    NULL, which training refuses."""
    df = spark.read.option("basePath", path).parquet(path)
    label = F.col("fold").cast("string")
    return df.withColumn("fold", F.when(label == "test", F.lit(n_folds)).otherwise(fold_from_label(label)))
