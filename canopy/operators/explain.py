"""Diagnostics as tables: target histogram (A13), grids (F16), gain importance
(A12, A14, M25), partial dependence and ICE curves (M23, M24), and the
monotonicity check on ICE curves.

Charts are not drawn; each function returns the table behind the chart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, linspace_value
from .boost import objectives
from .boost.bins import coded
from .boost.score import bin_frame, predict_frame


def min_max(df: DataFrame, c: str) -> tuple[float | None, float | None]:
    """A10: min and max of the non-NULL values (one tiny aggregate)."""
    r = df.agg(F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")).first()
    return r["lo"], r["hi"]


def target_histogram(df: DataFrame, c: str, n_bins: int = 50) -> DataFrame:
    """Equal-width histogram, bins 1..n_bins, the maximum in the last bin."""
    lo, hi = min_max(df, c)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    width = (hi - lo) if hi > lo else 1.0
    b = F.least(F.floor((col(c) - F.lit(lo)) / F.lit(width) * n_bins) + 1, F.lit(n_bins))
    return (df.where(col(c).isNotNull()).groupBy(b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def linspace_grid(spark: SparkSession, df: DataFrame, c: str, n: int = 50) -> DataFrame:
    """F16: n evenly spaced values from min to max of the non-NULL values."""
    lo, hi = min_max(df, c)
    if lo is None:
        return spark.createDataFrame([], "grid_ix int, grid_value double")
    return spark.range(n).select(F.col("id").cast("int").alias("grid_ix"),
                                 linspace_value(F.lit(float(lo)), F.lit(float(hi)), F.col("id"), n)
                                 .alias("grid_value"))


# ---------------------------------------------------------------- importance
def gain_importance(model_table: DataFrame, features: list[str], model: str | None = None) -> DataFrame:
    """A14 + A12 + M25: mean split gain per feature, as a share of the total
    x 100 (all-zero totals left as they are; unused features 0).

    One row per (model, feature), by model and descending share (O2)."""
    mt = model_table if model is None else model_table.where(F.col("model") == model)
    gains = (mt.where(~F.col("is_leaf")).groupBy("model", "feature")
               .agg(F.avg("gain").alias("gain")))
    # every (model, feature) pair, features listed per model row (no join)
    grid = mt.select("model").distinct().select(
        "model", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    full = grid.join(gains, ["model", "feature"], "left").fillna(0.0, subset=["gain"])
    total = F.sum("gain").over(Window.partitionBy("model"))
    return full.select("model", "feature", "gain",
                       F.when(total > 0, F.col("gain") / total * 100).otherwise(F.col("gain")).alias("pct")
                       ).orderBy("model", F.desc("pct"), "feature")


# ---------------------------------------------------------------- PDP / ICE
def partial_dependence(df: DataFrame, spec, trees: list, base_margin: float, objective: str,
                       feature: str, grid: list[float]) -> DataFrame:
    """Mean prediction over all rows of ``df`` with ``feature`` set to each grid value.

    Without a link the rows are met once, whatever the grid: a row is counted at every leaf that it reaches when splits
    on the feature let it through to both sides; a grid value's mean is then the sum of the values of the leaves whose
    splits on the feature it meets, weighed by those counts.  With a log link the trees of a row don't add up, so
    its margin is taken once for the trees without the feature and once per distinct bin of the grid for the others.
    Tasks emit counts per leaf, or sums per bin; rows are binned once."""
    spark = df.sparkSession
    bins = [int(b) for b in spec.bin_values(spec.names.index(feature), list(grid))] if len(grid) else []
    values = spark.createDataFrame([(i, float(v), b) for i, (v, b) in enumerate(zip(grid, bins))],
                                   "grid_ix int, grid_value double, bin int")
    at = _link_sums if objectives.get(objective).log_link else _leaf_sums
    return at(df, spec, trees, base_margin, objective, spec.names.index(feature), sorted(set(bins))).join(
        F.broadcast(values), "bin").select("grid_ix", "grid_value", "pdp")        # a row per grid value


def _binned(df: DataFrame, spec) -> tuple[DataFrame, list[str]]:
    names = spec.names
    return (coded(df, spec).select(*[col(c).alias(f"f{i}") for i, c in enumerate(names)]),
            [f"f{i}" for i in range(len(names))])


def _leaf_sums(df: DataFrame, spec, trees: list, base_margin: float, objective: str, fi: int, bins: list[int]) -> DataFrame:
    """(bin, pdp) from the rows that can reach each leaf."""
    spark = df.sparkSession
    src, cols = _binned(df, spec)
    slim = [t.routing() for t in trees]

    def fn(it):
        counts = [np.zeros(len(t.feature), np.int64) for t in slim]
        n = 0
        for pdf in it:
            b = bin_frame(pdf, spec, cols)
            n += len(b)
            for t, c in zip(slim, counts):
                t.reach(b, fi, c)
        rows = [(k, int(leaf), int(c[leaf])) for k, c in enumerate(counts) for leaf in np.flatnonzero(c)]
        yield pd.DataFrame([(-1, 0, n), *rows], columns=["tree_id", "node_id", "n"]).astype(
            {"tree_id": np.int32, "node_id": np.int32})

    counts = src.mapInPandas(fn, "tree_id int, node_id int, n long").groupBy("tree_id", "node_id").agg(F.sum("n").alias("n"))
    # A row per leaf and bin of the grid that meets the leaf's splits on the feature: bounded by the model.
    leaves = [(k, leaf, b, float(t.value[leaf])) for k, t in enumerate(trees) for leaf, met in t.leaves_by_bin(fi, bins) for b in met]
    leaves += [(-1, 0, b, float(base_margin)) for b in bins]
    told = spark.createDataFrame(leaves, "tree_id int, node_id int, bin int, value double")
    total = Window.partitionBy("bin")
    summed = counts.join(told.hint("merge"), ["tree_id", "node_id"]).withColumn(
        "rows", F.max(F.when(F.col("tree_id") < 0, F.col("n"))).over(total))
    return summed.groupBy("bin", "rows").agg(F.sum(F.col("value") * F.col("n")).alias("s")).where("rows > 0").select(
        "bin", (F.col("s") / F.col("rows")).alias("pdp"))


def _link_sums(df: DataFrame, spec, trees: list, base_margin: float, objective: str, fi: int, bins: list[int]) -> DataFrame:
    """(bin, pdp): the other trees' margins once, the feature's own trees once per bin."""
    src, cols = _binned(df, spec)
    slim = [t.routing() for t in trees]
    own = [t for t in slim if (t.feature == fi).any()]
    rest = [t for t in slim if not (t.feature == fi).any()]
    predict = objectives.get(objective).predict

    def fn(it):
        sums, n = np.zeros(len(bins)), 0
        for pdf in it:
            if not len(pdf):
                continue
            b = bin_frame(pdf, spec, cols)
            fixed = np.full(len(b), base_margin)
            for t in rest:
                fixed += t.predict(b)
            n += len(b)
            for k, v in enumerate(bins):
                b[:, fi] = v
                m = fixed.copy()
                for t in own:
                    m += t.predict(b)
                sums[k] += predict(m).sum()
        if n:
            yield pd.DataFrame({"bin": np.array(bins, np.int32), "s": sums, "n": np.full(len(bins), n, np.int64)})

    return src.mapInPandas(fn, "bin int, s double, n long").groupBy("bin").agg((F.sum("s") / F.sum("n")).alias("pdp"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows chosen by md5(seed:key) order (all rows if fewer); exact and
    repeatable.  A top-n, which Spark runs as a per-task top-n then a merge."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", col(key)).limit(n).drop("_h")


def ice_curves(df: DataFrame, key: str, spec, trees: list, base_margin: float, objective: str,
               feature: str, grid: list[float], n_lines: int = 50, seed: int = 42) -> DataFrame:
    """M24 (ICE part): predictions of ``n_lines`` sampled rows at every grid value."""
    names = spec.names
    fi = names.index(feature)
    trees = [t.routing() for t in trees]
    rows = sample_rows(df, key, n_lines, seed)
    src = coded(rows.withColumn("_row", col(key).cast("string")), spec).select(
                      F.col("_row").alias("row_key"), *[col(c).alias(f"f{i}") for i, c in enumerate(names)])
    cols = [f"f{i}" for i in range(len(names))]
    g = list(grid)

    def fn(it):
        for pdf in it:
            if not len(pdf):
                continue
            out = []
            for k, v in enumerate(g):
                pdf[cols[fi]] = v
                p = predict_frame(pdf, spec, cols, trees, base_margin, objective)
                out.append(pd.DataFrame({"row_key": pdf["row_key"], "grid_ix": np.int32(k),
                                         "grid_value": float(v), "pred": p}))
            yield pd.concat(out, ignore_index=True)

    return src.mapInPandas(fn, "row_key string, grid_ix int, grid_value double, pred double")


def monotonicity_violations(ice: DataFrame, direction: int, tol: float = 1e-9) -> DataFrame:
    """Steps along each ICE curve that move against ``direction`` (5.3 check)."""
    w = Window.partitionBy("row_key").orderBy("grid_ix")
    d = F.col("pred") - F.lag("pred").over(w)
    return (ice.withColumn("step", d).where(F.col("step").isNotNull())
               .where(F.lit(float(direction)) * F.col("step") < -tol))
