"""Percentiles by brackets and the dealing of folds: exact, and little is moved for them."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import folds
from canopy.operators.boost.histogram import PassPlan, _Rows
from canopy.operators.boost.state import Block
from canopy.operators.folds import assign_folds, percentiles, percentiles_of_columns


@pytest.fixture
def ranks(monkeypatch):
    """The scratch tables of values that are written while a test runs."""
    made, real = [], folds.scratch_path

    def told(spark, name):
        made.append((name, real(spark, name)))
        return made[-1][1]

    monkeypatch.setattr(folds, "scratch_path", told)
    return made


def test_few_values_are_moved_for_a_median(spark, ranks):
    n = 200_000
    df = spark.range(n, numPartitions=5).select((F.xxhash64("id") / 3).alias("x"))
    values = np.sort([r.x for r in df.collect()])
    assert percentiles(df, "x", [0.5]) == [float((values[n // 2 - 1] + values[n // 2]) / 2)]
    written = sum(spark.read.parquet(path).count() for name, path in ranks if name == "ranks")
    assert written < n / 20


@pytest.mark.parametrize("parts", [1, 7])
def test_percentiles_of_several_columns_are_numpys(spark, parts):
    rng = np.random.default_rng(5)
    n = 30_000
    columns = [rng.lognormal(0, 3, n), rng.integers(0, 5, n) / 7, np.where(rng.random(n) < 0.97, 2.0, rng.random(n)),
               np.where(rng.random(n) < 0.3, np.nan, -rng.random(n)), np.full(n, np.nan)]
    rows = [[None if i % 2 and np.isnan(v) else float(v) for i, v in enumerate(r, 1)] for r in zip(*columns)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(parts)
    probs = [0.0, 1.0, *(i / 64 for i in range(1, 64))]
    got = percentiles_of_columns(df, [F.col(c) for c in "abcde"], probs)
    for (total, found), values in zip(got, columns):
        values = values[~np.isnan(values)]
        assert total == len(values)
        assert [found[p] for p in probs if len(values)] == (np.quantile(values, probs).tolist() if len(values) else [])


def test_a_rank_outside_its_bracket_is_found(spark, monkeypatch):
    monkeypatch.setattr(folds, "SKETCH", 20)
    monkeypatch.setattr(folds, "BRACKET", 1e-9)
    df = spark.range(5000, numPartitions=3).select((F.col("id") * 0.25).alias("x"))
    probs = [0.1, 0.37, 0.5, 0.93]
    assert percentiles(df, "x", probs) == np.quantile(np.arange(5000) * 0.25, probs).tolist()


def test_folds_move_the_rows_once_with_one_number_beside_the_hash(spark):
    keys = [f"k{i}" for i in range(2000)]
    y = [float(i % 40) if i % 9 else None for i in range(2000)]
    df = spark.createDataFrame([*zip(keys, y), (None, 3.0), (None, 3.0)], "key string, y double")
    out = assign_folds(df, "key", 6, 42, stratify_col="y")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    moved = {line.split("RepartitionByExpression ")[1] for line in plan.splitlines() if "RepartitionByExpression [_g" in line}
    assert moved and "_b#" not in plan
    got = {r.key: r.fold for r in out.collect()}
    # Keys that are missing count in their stratum, which they stand first in, but get no fold.
    s = {r.key: r.s for r in df.where("key is not null").select("key", folds.stratum_column(df, "y", 6).alias("s")).collect()}
    nulls = df.where("key is null").select(folds.stratum_column(df, "y", 6).alias("s")).first()["s"]
    order = sorted([(nulls, "", "")] * 2 + [(s[k], hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k in keys])
    assert got == {k: i % 6 + 1 for i, (_, _, k) in enumerate(order) if k}


def test_a_blocks_cells_are_found_once_for_all_holdouts():
    rng = np.random.default_rng(0)
    fold = rng.integers(1, 7, 500).astype(np.int32)
    bins = np.stack([rng.integers(-1, 3, 500), rng.integers(-1, 5, 500)], axis=1).astype(np.int16)
    block = Block(0, np.zeros(500, np.int64), fold, np.ones(500), bins, None)
    plan = PassPlan(objective="reg:squarederror", width=6, widths=[4, 6], test_fold=6, subsample=1.0, seed=1, tree_index=0, bases=[0.0])
    whole = {}
    for holdout in (1, 2, 6):
        cells = _Rows(block, holdout, plan, whole).cell((0, 1))
        used = (fold != holdout) & (fold != 6)
        assert (cells == (bins[used, 0] + 1) * 6 + bins[used, 1] + 1).all()
    assert list(whole) == [(0, 1)]
