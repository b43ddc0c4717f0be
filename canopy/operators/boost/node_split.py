"""Split search over a level's cells (M7-M10, M14, M15), in the JVM.

Windows over (model, node, feature) give the totals, the missing bin and the sums up to each cell, in bin order
or, for categories, by G / (H + lambda).  Every prefix is a candidate, with the missing bin sent right or
left; child weights are clamped to the node's bounds, and the monotone direction is enforced.
The greatest loss change wins, ties go to the lower feature, the earlier position, missing right.
Sums are integers until a candidate is weighed, so the result is the same for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .histogram import METRICS, TOTALS

K_RT_EPS = 1e-6  # a split must reduce the loss by more than this

_BEST = ["feature", "bin", "pos", "dl", "loss_chg", "GL", "HL", "CL", "GR", "HR", "CR", "wl", "wr"]


def _gain(g: Column, h: Column, w: Column, lam: float) -> Column:
    return -(2.0 * g * w + (h + lam) * w * w)


def _weight(g: str, h: str, lam: float) -> Column:
    """A node's weight within its bounds; 0 before them where nothing is to divide by (no rows and no lambda)."""
    return F.greatest(F.least(F.coalesce(F.try_divide(-F.col(g), F.col(h) + lam), F.lit(0.0)), "upper"), "lower")


def _filled() -> Column:
    return (F.col("bin") >= 0) & (F.col("C") > 0)


def _scaled(cells: DataFrame, bits: list[tuple[int, int]]) -> DataFrame:
    """With each model's unit of G and H."""
    units = [F.element_at(F.array(*[F.lit(2.0 ** -b[k]) for b in bits]), F.col("model") + 1) for k in (0, 1)]
    return cells.withColumns({"unit_g": units[0], "unit_h": units[1]})


def placed(cells: DataFrame, bits: list[tuple[int, int]], categorical: list[int], reg_lambda: float) -> DataFrame:
    """Cells of a level with totals, missing sums, place in the candidates' order and sums up to there."""
    own = _scaled(cells.where(F.col("feature") >= TOTALS), bits)
    ratio = F.try_divide(F.col("G") * F.col("unit_g"), F.col("H") * F.col("unit_h") + reg_lambda)
    order = F.when(F.col("bin") < 0, float("-inf")).when(F.col("feature").isin(categorical), ratio).otherwise(F.col("bin"))
    group = Window.partitionBy("model", "node", "feature")
    run = group.orderBy(order, "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = F.col("bin") < 0
    return own.select(
        "*", F.sum(F.when(_filled(), 1).otherwise(0)).over(run).cast("int").alias("pos"),
        *[F.sum(c).over(group).alias(f"{c}t") for c in "GHC"],
        *[F.sum(F.when(missing, F.col(c)).otherwise(0)).over(group).alias(f"{c}m") for c in "GHC"],
        *[F.sum(F.when(missing, 0).otherwise(F.col(c))).over(run).alias(f"{c}0") for c in "GHC"],
        *[F.max(c).over(group).alias(f"{c}_") for c in ("dir", "lower", "upper")]).drop("dir", "lower", "upper").withColumnsRenamed(
            {"dir_": "dir", "lower_": "lower", "upper_": "upper"})


def candidates(spots: DataFrame, reg_lambda: float, min_child_weight: float) -> DataFrame:
    """Every prefix split, ``ok`` if it may be taken."""
    lam = float(reg_lambda)
    both = spots.withColumn("dl", F.explode(F.array(F.lit(False), F.lit(True)))).where(
        (F.col("feature") < 0) & ~F.col("dl") | (F.col("feature") >= 0) & _filled() & (~F.col("dl") | (F.col("Cm") > 0)))
    left = {f"{c}l": F.col(f"{c}0") + F.when(F.col("dl"), F.col(f"{c}m")).otherwise(0) for c in "GHC"}
    units = {"G": F.col("unit_g"), "H": F.col("unit_h")}
    both = both.withColumns(left).select(
        "model", "node", "feature", "bin", "pos", "dl", "dir", "lower", "upper", "Gt", "Ht", "Ct",
        *[(F.col(f"{c}l") * units[c]).alias(f"{c}L") for c in "GH"], F.col("Cl").alias("CL"),
        *[((F.col(f"{c}t") - F.col(f"{c}l")) * units[c]).alias(f"{c}R") for c in "GH"], (F.col("Ct") - F.col("Cl")).alias("CR"),
        (F.col("Gt") * units["G"]).alias("Gn"), (F.col("Ht") * units["H"]).alias("Hn"))
    weighed = both.withColumns({"wl": _weight("GL", "HL", lam), "wr": _weight("GR", "HR", lam), "wp": _weight("Gn", "Hn", lam)})
    loss = (_gain(F.col("GL"), F.col("HL"), F.col("wl"), lam) + _gain(F.col("GR"), F.col("HR"), F.col("wr"), lam)
            - _gain(F.col("Gn"), F.col("Hn"), F.col("wp"), lam))
    ok = ((F.col("feature") >= 0) & (F.col("HL") >= min_child_weight) & (F.col("HR") >= min_child_weight) & (F.col("CL") > 0)
          & (F.col("CR") > 0) & (F.col("loss_chg") > K_RT_EPS) & (F.col("dir") * (F.col("wr") - F.col("wl")) >= 0))
    return weighed.withColumn("loss_chg", loss).withColumn("ok", ok)


def best_splits(cells: DataFrame, bits: list[tuple[int, int]], categorical: list[int], reg_lambda: float,
                min_child_weight: float, by: tuple[str, ...] = ("model", "node")) -> DataFrame:
    """Per group: the totals Gn, Hn, Ct and the best split's columns (null: none)."""
    found = candidates(placed(cells, bits, categorical, reg_lambda), reg_lambda, min_child_weight)
    rank = F.when(F.col("ok"), F.struct("loss_chg", -F.col("feature"), -F.col("pos"), ~F.col("dl")))
    inner = [c for c in _BEST if c not in by]
    return found.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("Gn", "Hn", "Ct")],
                                  F.max_by(F.struct(*inner), rank).alias("_best")).select(*by, "Gn", "Hn", "Ct", "_best.*")


def left_categories(cells: DataFrame, bits: list[tuple[int, int]], categorical: list[int], reg_lambda: float,
                    chosen: list[tuple[int, int, int, int]]) -> DataFrame:
    """(model, node, left): the category codes up to the chosen place of (model, node, feature, pos) rows."""
    want = cells.sparkSession.createDataFrame(chosen, "model int, node int, feature int, last int")
    some = cells.join(F.broadcast(want), ["model", "node", "feature"])  # a row per open node
    spots = placed(some, bits, categorical, reg_lambda)
    return spots.where(_filled() & (F.col("pos") <= F.col("last"))).groupBy("model", "node").agg(
        F.collect_list("bin").alias("left"))


def metric_rows(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("feature") == METRICS).select("model", "node", "bin", "lower", "upper", "G", "H", "C")
