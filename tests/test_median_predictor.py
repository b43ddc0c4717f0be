"""The median predictor's cross-validation (A7, A8) moves the table once, and of it only what it uses."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import folds
from canopy.operators.folds import assign_folds, percentiles_of_subsets
from canopy.plans import slice as median_slice
from canopy.sources import tables

N = 20_000


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lineitem"))
    spark.range(N, numPartitions=4).selectExpr(
        "id as l_orderkey", "cast(id % 7 as int) as l_linenumber", "id % 500 as l_partkey", "id % 20 as l_suppkey",
        "cast(id % 50 as double) as l_quantity", "900.0D + id * 7919 % 100003 as l_extendedprice", "id % 11 / 100.0D as l_discount",
        "id % 9 / 100.0D as l_tax", "'A' as l_returnflag", "'O' as l_linestatus").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_the_table_is_shuffled_once_and_few_values_for_the_medians(spark, sf_dir, monkeypatch):
    made, dealt, real, deal = [], [], folds.scratch_path, assign_folds

    def told(spark, name):
        made.append((name, real(spark, name)))
        return made[-1][1]

    def kept(*args, **more):
        dealt.append(deal(*args, **more))
        return dealt[-1]

    monkeypatch.setattr(folds, "scratch_path", told)
    monkeypatch.setattr(median_slice, "assign_folds", kept)
    out = median_slice.min_slice(spark, sf_dir)
    assert sum(spark.read.parquet(path).count() for name, path in made if name == "ranks") < N / 10
    # What is dealt: the label, and by what rows are placed.  The errors read what was dealt, and don't deal anew.
    moved = re.findall(r"hash\(([^()]*), 42\)", dealt[0]._jdf.queryExecution().optimizedPlan().toString())
    assert moved and {tuple(re.sub(r"#\d+L?", "", c) for c in m.split(", ")) for m in moved} == {("charge", "_g", "_h")}
    assert "_g" not in out._jdf.queryExecution().optimizedPlan().toString()

    rows = deal(tables.charge_rows(spark, sf_dir), "row_key", 6, 42, stratify_col="charge").select("fold", "charge").toPandas()
    fold, y = rows["fold"].to_numpy(), rows["charge"].to_numpy()
    want = {}
    for k in range(1, 6):
        m = np.median(y[(fold != k) & (fold != 6)])
        own = y[fold == k]
        want[k] = (len(own), round(m, 6), pytest.approx(np.mean(np.abs(own - m) / np.maximum(np.abs(own), 1e-15)), abs=1e-8))
    assert {r["fold"]: (r["n_val"], r["median_pred"], r["mape"]) for r in out.collect()} == want


@pytest.mark.parametrize("keep", [["y"], ["key", "y"]])
def test_kept_columns_have_the_same_folds(spark, keep):
    rows = [(f"k{i}", float(i % 40) if i % 9 else None, i) for i in range(2000)] + [(None, 3.0, 0)]
    df = spark.createDataFrame(rows, "key string, y double, z int")
    for own in ({"stratify_col": "y"}, {}, {"stratum": F.col("y") > 7}):
        whole = assign_folds(df, "key", 6, 42, **own).select(*keep, "fold")
        part = assign_folds(df, "key", 6, 42, keep=keep, **own)
        assert part.columns == [*keep, "fold"]
        assert sorted(map(repr, part.collect())) == sorted(map(repr, whole.collect()))


@pytest.mark.parametrize("parts", [1, 5])
def test_percentiles_of_subsets_are_numpys(spark, parts):
    rng = np.random.default_rng(3)
    x, g = rng.lognormal(0, 3, 5000), rng.integers(0, 4, 5000)
    rows = [(float(v) if i % 7 else None if i % 2 else float("nan"), int(s) if i % 11 else None) for i, (v, s) in enumerate(zip(x, g))]
    df = spark.createDataFrame(rows, "x double, g int").repartition(parts)
    probs = [0.5, 0.0, 0.25, 1.0]
    subsets = {str(k): F.col("g") != k for k in range(4)} | {"none": F.col("g") > 9, "all": F.lit(True)}
    got = {(r["subset"], r["p"]): r["value"] for r in percentiles_of_subsets(df, "x", probs, subsets).collect()}
    want = {}
    for name in subsets:
        own = [v for v, s in rows if v is not None and v == v and (name == "all" or s is not None and name != "none" and s != int(name))]
        want |= {(name, p): float(np.quantile(own, p)) for p in probs if own}
    assert got == want
