"""Cleaning operators over DataFrames.

Scale notes: value counts are a map-side-combined ``groupBy``; the joins back
to the row table go through ``join_small`` (broadcast only when its bytes are measured to
be few), so a hot value never lands in a single task through a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalar import col
from .folds import sums_before
from .joins import join_small


def feature_columns(df: DataFrame, target: str, fold: str = "fold",
                    exclude: Iterable[str] = ()) -> list[str]:
    """Every column except target, fold (and any key columns given)."""
    skip = {target, fold, *exclude}
    return [c for c in df.columns if c not in skip]


def categorical_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The string-typed columns among ``cols``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(types[c], StringType)]


def value_counts(df: DataFrame, c: str, out: str = "n") -> DataFrame:
    """A1: rows per value (NULL is a value too)."""
    return df.groupBy(col(c).alias(c)).agg(F.count(F.lit(1)).alias(out))


def rare_values(df: DataFrame, c: str, threshold: int) -> DataFrame:
    """A2: values seen fewer than ``threshold`` times (NULL excluded, as pandas)."""
    return value_counts(df.where(col(c).isNotNull()), c).where(F.col("n") < threshold)


def replace_rare(df: DataFrame, c: str, threshold: int, other: str = "other") -> DataFrame:
    """J1 + P8: values seen fewer than ``threshold`` times become ``other``."""
    rare = rare_values(df, c, threshold).select(col(c).alias("_rare"), F.lit(True).alias("_is_rare"))
    j = join_small(df, rare, df[f"`{c}`"] == rare["_rare"], "left")
    return (j.withColumn(c, F.when(F.col("_is_rare"), F.lit(other)).otherwise(col(c)))
             .drop("_rare", "_is_rare"))


def distinct_count(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """A3: distinct non-NULL values per column (one row)."""
    f = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(*[f(col(c)).alias(c) for c in cols])


def dictionary(df: DataFrame, c: str) -> DataFrame:
    """F11 dictionary: distinct non-NULL values in sorted order -> 0-based code, which is the number of values
    before (``folds.sums_before``), so no task holds all values."""
    values = df.select(col(c).alias("value")).where(F.col("value").isNotNull()).distinct()
    return sums_before(values.withColumn("_one", F.lit(1)), "value", "_one", "code").select(
        "value", F.col("code").cast("int").alias("code"))


def dictionary_encode(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """replace each string column by its dictionary code (NULL stays NULL).

    The dictionary covers all rows given (test rows too, as the reference).
    """
    out = df
    for c in cols:
        d = dictionary(df, c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        out = join_small(out, d, out[f"`{c}`"] == d["_v"], "left")
        out = out.withColumn(c + suffix, F.col("_code")).drop("_v", "_code")
    return out


def mask_as_first(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Replace each listed column by its value on the first row.

    "First" is the smallest ``key``.  Absent columns are skipped, the type is
    kept.  One single-row aggregate; no join.
    """
    present = [c for c in features if c in df.columns]
    if not present:
        return df
    row = df.agg(*[F.min_by(col(c), col(key)).alias(f"v{i}") for i, c in enumerate(present)]).first()
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for i, c in enumerate(present):
        out = out.withColumn(c, F.lit(row[f"v{i}"]).cast(types[c]))
    return out
