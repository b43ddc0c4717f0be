"""Sinks (K1-K4).  Parquet keeps hostile column names intact (trap T2)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col

#: Folders of a results table: the rows of all runs, and what was committed.
ROWS, MANIFEST = "rows", "manifest"


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: the prepared table, partitioned by fold, overwritten."""
    w = df.write.mode("overwrite").partitionBy("fold")
    if fmt == "csv":
        w.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.parquet(path)


def new_run() -> str:
    """A run id; later runs sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_results(results: DataFrame, path: str, run: str | None = None) -> str:
    """K2 / K4: result rows by dataset and run, then a manifest row per dataset written.  Readers see
    a dataset's rows only from then on, so a run that fails half-way leaves nothing to be read; a rerun doesn't touch
    what is there.  A dataset written twice in a run has its last rows.  Returns the run's id."""
    run = run or new_run()
    version = new_run()
    rows = results.withColumn("run", F.lit(run)).withColumn("version", F.lit(version))
    rows.write.mode("append").partitionBy("dataset", "run", "version").parquet(f"{path}/{ROWS}")
    spark = results.sparkSession
    (spark.read.parquet(f"{path}/{ROWS}").where((F.col("run") == run) & (F.col("version") == version))
     .select(F.col("dataset").cast("string"), F.col("run").cast("string"), F.col("version").cast("string")).distinct()
     .coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}"))
    return run


def format_2dp(df: DataFrame, cols: list[str]) -> DataFrame:
    """K3: doubles as text with two decimals."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.format_string("%.2f", col(c)))
    return out


def write_importances(df: DataFrame, path: str) -> None:
    """K3: importance table with two decimals, as CSV."""
    num = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    format_2dp(df, num).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_diagnostics(diagnostics: dict[str, DataFrame | None], path: str) -> None:
    """Each diagnostic table of a study in a folder of its own (importances as numbers; K3 has them as text)."""
    for name, df in diagnostics.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
