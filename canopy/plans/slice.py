"""Minimum slice: per-fold error of a training-fold median predictor.

scan -> fixture -> quantile strata -> balanced folds -> per-model median over
its training folds -> MAPE per validation fold and the unweighted mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import ape
from ..operators.folds import assign_folds, percentiles_of_subsets
from ..session import scratch_path
from ..sources.tables import charge_rows

N_FOLDS = 6  # fold 6 is the hold-out test fold


def train_fold_models(df: DataFrame, n_folds: int = N_FOLDS, fold_col: str = "fold") -> DataFrame:
    """Each row once per CV model it trains (all folds but its own and test).

    A bounded fan-out of n_folds - 2 through ``explode``; no join.
    """
    ks = F.array(*[F.lit(k) for k in range(1, n_folds)])
    return df.where(F.col(fold_col) != n_folds).withColumn(
        "k", F.explode(F.filter(ks, lambda k: k != F.col(fold_col))))


def median_predictor_cv(df: DataFrame, y: str = "charge", n_folds: int = N_FOLDS) -> DataFrame:
    """A7 + A8: per-fold MAPE of the median of the other training folds."""
    train = {str(k): (F.col("fold") != n_folds) & (F.col("fold") != k) for k in range(1, n_folds)}
    med = percentiles_of_subsets(df.select("fold", y), y, [0.5], train).select(
        F.col("subset").cast("int").alias("k"), F.col("value").alias("median_pred"))
    val = df.where(F.col("fold") != n_folds).select(F.col("fold").alias("k"), y)
    per_fold = (val.join(F.broadcast(med), "k")
                   .groupBy("k").agg(F.count(F.lit(1)).alias("n_val"),
                                     F.first("median_pred").alias("median_pred"),
                                     F.avg(ape(F.col(y), F.col("median_pred"))).alias("mape")))
    return (per_fold.withColumn("cv_mape", F.avg("mape").over(Window.partitionBy()))
                    .select(F.col("k").cast("int").alias("fold"), "n_val",
                            F.round("median_pred", 6).alias("median_pred"),
                            F.round("mape", 9).alias("mape"),
                            F.round("cv_mape", 9).alias("cv_mape")))


def min_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_folds(charge_rows(spark, sf_dir), "row_key", N_FOLDS, 42, stratify_col="charge", keep=["charge"])
    # Written once: the medians and the errors would each shuffle the whole table for its folds.
    path = scratch_path(spark, "folded")
    rows.write.parquet(path)
    return median_predictor_cv(spark.read.parquet(path))
