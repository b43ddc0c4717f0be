"""Model table (one row per tree node) and scoring.

Scoring is an Arrow-batched ``mapInPandas``: the fields of the fitted trees that
route rows go to the executors once, as a broadcast variable (their size is
bounded by trees x nodes, never by data); each batch is binned with the training cut points and routed through every tree.
``case_when_sql`` renders a small model as SQL text, a second scoring path
used to check the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.scalar import col
from . import objectives
from .bins import FeatureSpec, coded

MODEL_TABLE_SCHEMA = (
    "model string, tree_id int, node_id int, depth int, feature_id int, feature string, "
    "is_cat boolean, split_bin int, threshold double, left_cats array<string>, "
    "default_left boolean, is_leaf boolean, gain double, cover double, n_rows long, "
    "weight double, value double, lower double, upper double")


def model_rows(name: str, trees: list, spec: FeatureSpec) -> list[tuple]:
    rows = []
    for t_id, t in enumerate(trees):
        for n in np.nonzero(t.used)[0]:
            f = int(t.feature[n])
            leaf = f < 0
            depth = int(np.floor(np.log2(n + 1)))
            if leaf:
                rows.append((name, t_id, int(n), depth, None, None, None, None, None, None, None,
                             True, None, float(t.cover[n]), int(t.count[n]), float(t.weight[n]),
                             float(t.value[n]), float(t.lower[n]), float(t.upper[n])))
                continue
            cat = bool(t.is_cat[n])
            thr = None if cat else spec.threshold(f, int(t.split_bin[n]))
            # A dictionary table's values are not fetched: the codes stand in the tree.
            cats = [spec.categories[f][c] for c in t.cat_left.get(int(n), [])] if cat and f not in spec.tables else None
            rows.append((name, t_id, int(n), depth, f, spec.names[f], cat,
                         None if cat else int(t.split_bin[n]), thr, cats, bool(t.default_left[n]),
                         False, float(t.gain[n]), float(t.cover[n]), int(t.count[n]),
                         float(t.weight[n]), None, float(t.lower[n]), float(t.upper[n])))
    return rows


def model_table(spark: SparkSession, models: dict, spec: FeatureSpec) -> DataFrame:
    """models: name -> list of trees.  A small DataFrame (size of the models)."""
    rows = [r for name, trees in models.items() for r in model_rows(name, trees, spec)]
    return spark.createDataFrame(rows, MODEL_TABLE_SCHEMA)


def bin_frame(pdf: pd.DataFrame, spec: FeatureSpec, cols: list[str]) -> np.ndarray:
    n = len(pdf)
    if not spec.names:
        return np.zeros((n, 0), np.int32)
    return np.column_stack([spec.bin_values(i, pdf[c].to_numpy()) for i, c in enumerate(cols)])


def predict_frame(pdf: pd.DataFrame, spec: FeatureSpec, cols: list[str], trees: list,
                  base_margin: float, objective: str) -> np.ndarray:
    bins = bin_frame(pdf, spec, cols)
    m = np.full(len(pdf), base_margin)
    for t in trees:
        m += t.predict(bins)
    return objectives.get(objective).predict(m)


def predict(df: DataFrame, spec: FeatureSpec, trees: list, base_margin: float, objective: str,
            keep: list[str], out: str = "prediction", features: list[str] | None = None) -> DataFrame:
    """Score ``df`` (raw feature columns named as in training, or ``features``)."""
    feats = features or spec.names
    held = df.withColumns({f"_keep{i}": col(c) for i, c in enumerate(keep)}) if keep else df
    src = coded(held, spec, feats).select(*[col(f"_keep{i}").alias(f"k{i}") for i in range(len(keep))],
                                           *[col(c).alias(f"f{i}") for i, c in enumerate(feats)])
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
                       + [f"`{out}` double"])
    fcols = [f"f{i}" for i in range(len(feats))]
    told = df.sparkSession.sparkContext.broadcast([t.routing() for t in trees])

    def fn(it):
        for pdf in it:
            p = predict_frame(pdf, spec, fcols, told.value, base_margin, objective)
            res = pd.DataFrame({c: pdf[f"k{i}"] for i, c in enumerate(keep)})
            res[out] = p
            yield res

    return src.mapInPandas(fn, schema)


def _sql_lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v))


def case_when_sql(trees: list, spec: FeatureSpec, base_margin: float, objective: str,
                  quote=lambda c: f"`{c}`") -> str:
    """A SQL expression computing the same prediction from raw columns."""
    def node_sql(t, n):
        f = int(t.feature[n])
        if f < 0:
            return repr(float(t.value[n]))
        c = quote(spec.names[f])
        if f in spec.tables:
            raise ValueError(f"the dictionary of {spec.names[f]!r} is a table: too long for SQL text")
        if t.is_cat[n]:
            cats = [spec.categories[f][k] for k in t.cat_left.get(int(n), [])]
            test = f"{c} in ({', '.join(_sql_lit(x) for x in cats)})" if cats else "false"
        else:
            test = f"{c} < {_sql_lit(spec.threshold(f, int(t.split_bin[n])))}"
        miss = "true" if t.default_left[n] else "false"
        left, right = node_sql(t, 2 * n + 1), node_sql(t, 2 * n + 2)
        return f"(case when {c} is null then (case when {miss} then {left} else {right} end) " \
               f"when {test} then {left} else {right} end)"
    margin = " + ".join([repr(float(base_margin))] + [node_sql(t, 0) for t in trees])
    if not objectives.get(objective).log_link:
        return f"({margin})"
    return f"exp(least(greatest({margin}, {-objectives.MARGIN_CLIP!r}), {objectives.MARGIN_CLIP!r}))"
