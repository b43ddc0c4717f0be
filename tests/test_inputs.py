"""Awkward inputs of training and scans: missing labels, NaN, booleans, short lines; exact percentiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators.boost.bins import feature_spec, with_missing
from canopy.operators.boost.fit import BoostParams
from canopy.operators.folds import percentiles, percentiles_by
from canopy.plans.study import fit_final


def frame(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(str(i), i % 6 + 1, float(10 + 5 * (i % 2)), bool(i % 2), float(rng.normal()) if i % 7 else float("nan")) for i in range(n)]
    return spark.createDataFrame(rows, "k string, fold int, y double, flag boolean, x double")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_percentiles_equal_numpy_for_any_partitioning(spark, parts):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500).round(1), np.full(300, 0.5)])
    rows = [(float(v), "a" if i % 3 else "b") for i, v in enumerate(x)] + [(None, "a"), (float("nan"), "b")]
    df = spark.createDataFrame(rows, "x double, g string").repartition(parts)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert percentiles(df, "x", probs) == pytest.approx(np.percentile(x, [100 * p for p in probs]).tolist(), abs=1e-12)
    got = {(r.g, r.p): r.value for r in percentiles_by(df, "x", [0.5], ["g"]).collect()}
    for g in "ab":
        assert got[g, 0.5] == pytest.approx(np.median([v for i, v in enumerate(x) if (i % 3 > 0) == (g == "a")]))
    assert percentiles(df.limit(0), "x", probs) == []


def test_bad_labels_and_folds_are_errors(spark):
    df = frame(spark)
    p = BoostParams(max_trees=2)
    first = F.col("k") == "0"
    for change, params in ((df.withColumn("y", F.when(~first, F.col("y"))), p),
                           (df.withColumn("y", F.when(first, float("nan")).otherwise(F.col("y"))), p),
                           (df.withColumn("fold", F.when(~first, F.col("fold"))), p),
                           (df.withColumn("y", F.when(first, -1.0).otherwise(F.col("y"))), BoostParams(objective="count:poisson")),
                           (df.withColumn("y", F.when(first, 0.0).otherwise(F.col("y"))), BoostParams(objective="reg:gamma"))):
        with pytest.raises(ValueError):
            fit_final(change, "k", "y", ["x"], 1, 1, params)


def test_booleans_split_and_nan_is_missing(spark):
    df = frame(spark)
    spec = feature_spec(df, ["flag", "x"], 4)
    assert not any(spec.is_cat) and not np.isnan(np.concatenate(spec.edges)).any()
    assert with_missing(df, ["x"]).where("x is null").count() == 9
    fitted = fit_final(df, "k", "y", ["flag", "x"], 1, 1, BoostParams(subsample=1.0, colsample_bytree=1.0, learning_rate=1.0, max_bins=4))
    assert fitted.models[0].trees[0].feature[0] == 0


def test_continued_model_keeps_its_start(spark):
    df = frame(spark)
    p = BoostParams(subsample=1.0, colsample_bytree=1.0, max_bins=4)
    first = fit_final(df, "k", "y", ["flag"], 1, 1, p)
    base = first.models[0].base_margin
    other = df.withColumn("y", F.col("y") * 10)
    more = fit_final(other, "k", "y", ["flag"], 1, 2, p, init_trees=first.models[0].trees, init_base=base, spec=first.features)
    assert more.models[0].base_margin == base


def test_short_lines_and_leading_tabs(spark, tmp_path):
    from canopy.functions.scalar import first_token_lower
    from canopy.sources.text import read_whitespace

    (tmp_path / "a.txt").write_text('1 2 "b c"\n3\n')
    rows = read_whitespace(spark, str(tmp_path / "a.txt"), [("a", "int"), ("b", "int"), ("c", "string")]).collect()
    assert [tuple(r) for r in rows] == [(1, 2, "b c"), (3, None, None)]
    one = spark.createDataFrame([("\tFord pinto",)], "c string").select(first_token_lower("c")).first()[0]
    assert one == "ford"
