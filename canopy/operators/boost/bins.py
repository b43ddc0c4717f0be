"""Feature binning (M3).

Numeric features get up to ``max_bins`` quantile bins from exact interpolated percentiles over all
rows.  A value's bin is the number of cut points <= value, so ``bin <= b`` is the same test
as ``value < cut[b]``.  String features get a dictionary code (sorted distinct values, test rows
included); a long dictionary is a table that the rows are joined with.  Missing values get bin -1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType

from ...functions.scalar import col
from ...session import scratch_path
from ..clean import dictionary
from ..folds import percentiles_of_columns
from ..joins import join_small

#: Up to so many categories a dictionary is kept with the feature's specification; a longer one is a table.
INLINE_CATEGORIES = 10_000


@dataclass
class FeatureSpec:
    names: list[str]
    is_cat: list[bool]
    edges: list[np.ndarray | None] = field(default_factory=list)
    categories: list[list[str] | None] = field(default_factory=list)
    #: Features whose dictionary is a table (value, code): its path and length.
    tables: dict[int, tuple[str, int]] = field(default_factory=dict)

    def n_bins(self, i: int) -> int:
        if i in self.tables:
            return self.tables[i][1]
        return len(self.categories[i]) if self.is_cat[i] else len(self.edges[i]) + 1

    @property
    def max_bins(self) -> int:
        return max([self.n_bins(i) for i in range(len(self.names))] or [1])

    def bin_values(self, i: int, values) -> np.ndarray:
        """Bins of raw values (or, with a dictionary table, of codes) for feature i; missing and unknown give -1."""
        if i in self.tables:
            codes = pd.to_numeric(pd.Series(values)).to_numpy(dtype=np.float64, na_value=np.nan)
            return np.where(np.isnan(codes), -1, codes).astype(np.int32)
        if self.is_cat[i]:
            codes = pd.Categorical(pd.Series(values, dtype="object"),
                                   categories=self.categories[i]).codes
            return codes.astype(np.int32)
        x = pd.to_numeric(pd.Series(values), errors="coerce").to_numpy(dtype=np.float64,
                                                                          na_value=np.nan)
        b = np.searchsorted(self.edges[i], x, side="right").astype(np.int32)
        b[np.isnan(x)] = -1
        return b

    def threshold(self, i: int, split_bin: int) -> float | None:
        if self.is_cat[i]:
            return None
        e = self.edges[i]
        return float(e[split_bin]) if split_bin < len(e) else float("inf")


def with_missing(df: DataFrame, features: list[str]) -> DataFrame:
    """Features in the forms that are binned: NaN is missing, booleans are
    numbers, and what is neither number nor boolean is text."""
    out = {}
    for f in df.schema.fields:
        if f.name not in features:
            continue
        if isinstance(f.dataType, BooleanType):
            out[f.name] = col(f.name).cast("int")
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            out[f.name] = F.nanvl(col(f.name), F.lit(None))
        elif not isinstance(f.dataType, NumericType):
            out[f.name] = col(f.name).cast("string")
    return df.withColumns(out) if out else df


def coded(df: DataFrame, spec: FeatureSpec, names: list[str] | None = None) -> DataFrame:
    """``df`` with the features (in columns ``names``) in the forms that ``bin_values`` takes."""
    names = names or spec.names
    out = with_missing(df, names)
    for i, (path, _) in spec.tables.items():
        told = df.sparkSession.read.parquet(path).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = join_small(out, told, out[f"`{names[i]}`"] == told["_value"], "left").withColumn(
            names[i], F.col("_code")).drop("_value", "_code")
    return out


def feature_spec(df: DataFrame, features: list[str], max_bins: int = 256) -> FeatureSpec:
    """Cut points for numeric features and dictionaries for string ones.

    Exact interpolated percentiles of all numeric features in one go (``percentiles_of_columns``).  The result is the
    same for any partitioning.  Dictionaries of all text
    features come from one distinct job; those of more than ``INLINE_CATEGORIES`` values are written as tables.
    """
    df = with_missing(df, features)
    types = {f.name: f.dataType for f in df.schema.fields}
    is_cat = [not isinstance(types[c], NumericType) for c in features]
    probs = [i / max_bins for i in range(1, max_bins)]
    edges: list[np.ndarray | None] = [None if cat else np.zeros(0) for cat in is_cat]
    cats: list[list[str] | None] = [[] if cat else None for cat in is_cat]
    tables: dict[int, tuple[str, int]] = {}

    if not all(is_cat):
        numeric = [i for i, cat in enumerate(is_cat) if not cat]
        for i, (_, found) in zip(numeric, percentiles_of_columns(df, [col(features[i]) for i in numeric], probs)):
            edges[i] = np.array(sorted(set(found.values())), dtype=np.float64)
    if any(is_cat):
        pairs = [F.struct(F.lit(i).alias("f"), col(c).cast("string").alias("x")) for i, c in enumerate(features) if is_cat[i]]
        texts = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.f", "p.x").where(F.col("x").isNotNull()).distinct()
        sizes = {r["f"]: r["n"] for r in texts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
        long = sorted(i for i, n in sizes.items() if n > INLINE_CATEGORIES)
        for i in long:
            path = scratch_path(df.sparkSession, "categories")
            dictionary(df, features[i]).write.parquet(path)
            tables[i] = (path, sizes[i])
        for r in texts.where(~F.col("f").isin(long)).collect() if len(long) < len(sizes) else ():
            cats[r["f"]].append(r["x"])
    return FeatureSpec(list(features), is_cat, edges, [None if c is None else sorted(c) for c in cats], tables)
