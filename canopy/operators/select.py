"""Selection and reporting over result tables.

Result tables are small (one row per trained configuration); every operator
here is ordinary DataFrame SQL with window functions partitioned by
(dataset, approach).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import signed_pct

RESULT_SCHEMA = ("dataset string, approach string, max_depth int, cv_mape double, "
                 "test_mape double, n_trees int, num_trees_phase1 int, phase1_pct double, "
                 "chosen boolean, run_ix int")

# Fixed value: the approaches in report order.
APPROACHES = ["baseline", "monotonic", "progressive"]


def choose_best(results: DataFrame) -> DataFrame:
    """Per (dataset, approach) flag the lowest CV error; first run wins ties."""
    w = Window.partitionBy("dataset", "approach").orderBy(F.col("cv_mape").asc_nulls_last(),
                                                          F.col("run_ix"))
    return results.withColumn("chosen", F.row_number().over(w) == 1)


def best_of(results: DataFrame, approach: str) -> DataFrame:
    """The arg-min row of one approach per dataset."""
    r = results.where(F.col("approach") == approach)
    w = Window.partitionBy("dataset").orderBy(F.col("cv_mape").asc_nulls_last(), F.col("run_ix"))
    return r.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def chosen(results: DataFrame) -> DataFrame:
    """P9."""
    return results.where(F.col("chosen"))


def of_approach(results: DataFrame, approach: str) -> DataFrame:
    """P10."""
    return results.where(F.col("approach") == approach)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def in_report_order(results: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Rows by the datasets' place in the config, then by approach (report order)."""
    def place(c, names):
        return F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col(c))
    return results.orderBy(place("dataset", datasets), place("approach", APPROACHES), "run_ix")


def deltas(results: DataFrame, reference: str = "baseline") -> DataFrame:
    """Chosen test error of each approach against the reference approach,
    absolute and in percent, with '%+.1f%%' text."""
    ch = chosen(results)
    ref = ch.where(F.col("approach") == reference).select("dataset", F.col("test_mape").alias("_ref"))
    out = (ch.join(ref, "dataset").where(F.col("approach") != reference)
             .select("dataset", "approach", "test_mape",
                     (F.col("test_mape") - F.col("_ref")).alias("delta"),
                     (F.lit(100.0) * (F.col("test_mape") - F.col("_ref")) / F.col("_ref")).alias("delta_pct")))
    return out.withColumn("delta_text", signed_pct("delta_pct"))


def pivot_importance(long: DataFrame, approaches: Sequence[str] = APPROACHES) -> DataFrame:
    """J7 + O3: (approach, feature, pct) -> one row per feature, a column per
    approach, ordered by the first approach's share (descending)."""
    wide = long.groupBy("feature").pivot("approach", list(approaches)).agg(F.first("pct"))
    first = approaches[0]
    return wide.fillna(0.0, subset=list(approaches)).orderBy(F.col(first).desc(), "feature")
