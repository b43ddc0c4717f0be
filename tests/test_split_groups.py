"""The split search over cells, exact sums, the state tables, and preparing all datasets."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopy.operators.boost import exact, histogram
from canopy.operators.boost.bins import feature_spec
from canopy.operators.boost.fit import BoostParams, ModelSpec, Trainer
from canopy.operators.boost.histogram import CELLS, level_cells, sampled
from canopy.operators.boost.node_split import best_splits, left_categories
from canopy.operators.boost.state import State
from canopy.operators.folds import assign_folds
from canopy.plans.datasets import prepare_all
from canopy.sources import tables
from conftest import SF_SMALL

FEATS = ["price", "discount", "tax", "quantity", "returnflag", "linestatus"]
BITS = (3, 0)


def _cells(rng, tasks):
    """Cells of two nodes over three features, of which the last is categorical, as many tasks give them."""
    rows = []
    for node in (1, 2):
        for _ in range(tasks):
            bins = rng.integers(-1, 5, (40, 3))
            g = rng.integers(-8, 9, 40)
            rows.append((0, node, -1, 0, 0, int(g.sum()), 40, 40))
            for f in range(3):
                for b in np.unique(bins[:, f]):
                    at = bins[:, f] == b
                    rows.append((0, node, f, int(b), [0, 1, 0][f], int(g[at].sum()), int(at.sum()), int(at.sum())))
    pdf = pd.DataFrame(rows, columns=["model", "node", "feature", "bin", "dir", "G", "H", "C"])
    pdf.insert(5, "lower", np.where(pdf["node"] == 1, -np.inf, -0.01))
    pdf.insert(6, "upper", np.where(pdf["node"] == 1, np.inf, 0.01))
    return pdf


def _brute(part, lam=1.0, mcw=1.0):
    """The best split by trying every prefix, missing right and left."""
    lo, hi = part["lower"].iat[0], part["upper"].iat[0]

    def weight(g, h):
        return max(min(-g / (h + lam), hi), lo)

    def gain(g, h):
        w = weight(g, h)
        return -(2 * g * w + (h + lam) * w * w)

    best = None
    for f, of in part[part["feature"] >= 0].groupby("feature"):
        sums = of.groupby("bin")[["G", "H", "C"]].sum()
        sums["G"] = sums["G"] / 2 ** BITS[0]
        t = sums.sum()
        miss = sums.loc[-1] if -1 in sums.index else sums.iloc[0] * 0
        real = sums[sums.index >= 0]
        if f == 2:
            real = real.iloc[np.lexsort((real.index, real["G"] / (real["H"] + lam)))]
        for dl in (False, True) if miss["C"] else (False,):
            left = miss * dl
            for pos, (b, row) in enumerate(real.iterrows(), 1):
                left = left + row
                right = t - left
                loss = gain(left["G"], left["H"]) + gain(right["G"], right["H"]) - gain(t["G"], t["H"])
                wl, wr = weight(left["G"], left["H"]), weight(right["G"], right["H"])
                if min(left["H"], right["H"]) < mcw or min(left["C"], right["C"]) <= 0 or loss <= 1e-6 or \
                        of["dir"].iat[0] * (wr - wl) < 0:
                    continue
                key = (loss, -f, -pos, not dl)
                if best is None or key > best[0]:
                    best = key, {"feature": f, "bin": b, "pos": pos, "dl": dl, "loss_chg": loss, "wl": wl, "wr": wr,
                                 "left": sorted(real.index[:pos])}
    return best[1]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_splits_of_many_tasks_equal_trying_every_prefix(spark, seed):
    pdf = _cells(np.random.default_rng(seed), tasks=30)
    cells = level_cells(spark.createDataFrame(pdf, CELLS).repartition(17)).persist()
    got = {r["node"]: r for r in best_splits(cells, [BITS], [2], 1.0, 1.0).collect()}
    assert set(got) == {1, 2}
    for node, part in pdf.groupby("node"):
        want, r = _brute(part), got[node]
        assert all(r[c] == want[c] for c in ("feature", "bin", "pos", "dl"))
        assert all(r[c] == pytest.approx(want[c], rel=1e-12) for c in ("loss_chg", "wl", "wr"))
        total = part[part["feature"] == -1]
        assert (r["Gn"], r["Hn"], r["Ct"]) == (total["G"].sum() / 8, total["H"].sum(), total["C"].sum())
        if want["feature"] == 2:
            left = left_categories(cells, [BITS], [2], 1.0, [(0, node, 2, want["pos"])]).first()["left"]
            assert sorted(left) == want["left"]
    cells.unpersist()


def test_a_node_without_a_split_keeps_its_totals(spark):
    rows = [(0, 1, -1, 0, 0, -math.inf, math.inf, 8, 4, 4), (0, 1, 0, 2, 0, -math.inf, math.inf, 8, 4, 4)]
    r, = best_splits(level_cells(spark.createDataFrame(rows, CELLS)), [BITS], [], 1.0, 1.0).collect()
    assert (r["Gn"], r["Hn"], r["Ct"], r["feature"]) == (1.0, 4.0, 4, None)


def test_a_sibling_is_its_parent_less_the_other_child(spark):
    inf = math.inf
    parent = spark.createDataFrame([(0, 0, 0, b, 1, -inf, inf, g, h, h) for b, g, h in ((-1, 5, 2), (0, -3, 4), (1, 7, 1))], CELLS)
    small = spark.createDataFrame(
        [(0, 1, 0, 0, 1, -inf, 2.0, -2, 3, 3), (0, 1, 0, 1, 1, -inf, 2.0, 7, 1, 1),
         (0, 2, 0, 0, 1, 2.0, inf, 2, -3, -3), (0, 2, 0, 1, 1, 2.0, inf, -7, -1, -1)], CELLS)
    got = {(r["node"], r["bin"]): (r["G"], r["H"], r["C"]) for r in level_cells(small, parent, [(0, 0, 2)]).collect()}
    assert got == {(1, 0): (-2, 3, 3), (1, 1): (7, 1, 1), (2, -1): (5, 2, 2), (2, 0): (-1, 1, 1), (2, 1): (0, 0, 0)}


def test_a_derived_node_keeps_bounds_told_by_empty_cells_alone(spark):
    # The small child holds all rows of the bins it has; what is left to the sibling comes from the parent.
    inf = math.inf
    parent = spark.createDataFrame([(0, 0, 0, b, 1, -inf, inf, g, 40, 40) for b, g in ((0, 300), (1, 200), (2, -400))], CELLS)
    small = spark.createDataFrame([(0, 1, 0, 0, 1, -inf, -1.0, 300, 40, 40), (0, 2, 0, 0, 1, -1.0, 0.5, -300, -40, -40)], CELLS)
    cells = level_cells(small, parent, [(0, 0, 2)])
    r, = best_splits(cells.where("node = 2"), [BITS], [], 1.0, 1.0).collect()
    assert (r["feature"], r["bin"], r["pos"], r["CL"], r["CR"]) == (0, 1, 1, 40, 40)
    assert (r["wl"], r["wr"]) == (-25 / 41, 0.5)


def test_exact_sums_do_not_depend_on_order():
    rng = np.random.default_rng(1)
    v = rng.standard_normal(5000) * 10.0 ** rng.integers(-30, 30, 5000)
    want = float(sum((Fraction(x) for x in v.tolist()), Fraction(0)))
    for parts in (1, 7, 500):
        found: dict = {}
        for chunk in np.array_split(rng.permutation(v), parts):
            for e, h, lo in exact.split_sums(chunk):
                a, b = found.get(e, (0, 0))
                found[e] = a + h, b + lo
        assert exact.total((e, h, lo) for e, (h, lo) in found.items()) == want
    assert exact.total([]) == 0.0
    assert exact.total(exact.split_sums(np.array([1.0, np.inf]))) == math.inf


def test_scales_keep_sums_below_the_limits():
    for bound in (1e-12, 0.3, 1.0, 7.5, 1e20):
        for rows in (1, 1000, 10**12):
            q = exact.as_integers(np.array([bound]), exact.scale_bits(bound, rows))[0]
            assert q <= 2.0 ** exact.MAX_BITS and q * rows <= 2.0**61 and q >= 2.0**19
    assert exact.scale_bits(0.0, 5) == 0


def test_row_samples_are_near_their_share_and_differ_by_tree():
    kh = np.random.default_rng(0).integers(0, 1 << 60, 40_000)
    a, b = (sampled(kh, 42, t, 0.8) for t in (0, 1))
    assert abs(a.mean() - 0.8) < 0.01 and abs(b.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.015
    assert sampled(kh, 42, 0, 1.0).all()


def _folded(spark):
    return assign_folds(tables.charge_rows(spark, SF_SMALL), "row_key", 6, 42, stratify_col="charge").persist()


def test_trees_are_bit_equal_for_any_partitioning(spark):
    df = _folded(spark)
    p = BoostParams(objective="reg:gamma", learning_rate=0.3, max_trees=3, early_stopping_rounds=2, refresh_every=2)
    models = [ModelSpec(f"cv{k}", "g", k, 3, {"price": 1}) for k in (1, 2)] + [ModelSpec("f", "g", 6, 3, early_stop=False)]
    runs = []
    for n in (1, 4, 64):
        res = Trainer(df.repartition(n, F.rand(n)), "row_key", "fold", "charge", FEATS, models, p).run()
        runs.append([([[x.tolist() for x in (t.feature, t.split_bin, t.value, t.gain, t.cover, t.count, t.lower, t.upper)]
                       for t in m.trees], m.curve, m.base_margin) for m in res.models] +
                    [[e.tolist() for e in res.features.edges if e is not None]])
    assert repr(runs[0]) == repr(runs[1]) == repr(runs[2])


def test_cut_points_at_256_bins_are_numpys(spark):
    df = _folded(spark)
    spec = feature_spec(df, ["price", "quantity", "returnflag"])
    rows = df.select("price", "quantity", "returnflag").toPandas()
    for i, c in enumerate(["price", "quantity"]):
        want = np.unique(np.percentile(rows[c].dropna().to_numpy(float), np.arange(1, 256) * 100 / 256))
        assert len(want) == len(spec.edges[i]) and np.allclose(want, spec.edges[i], rtol=1e-12)
    assert spec.categories[2] == sorted(rows["returnflag"].unique())


def test_state_keeps_one_version_of_the_margins(spark):
    df = _folded(spark)
    spec = feature_spec(df, FEATS, 16)
    state = State(df, "row_key", "fold", "charge", spec, 2, 42)
    for k in range(3):
        state.refresh(lambda block, j, k=k: np.full(len(block.bins), 10.0 * k + j) + (0 if block.margins is None else block.margins[j]))
        names = {r["tableName"] for r in spark.sql(f"show tables in {state.database}").collect()}
        assert names == {"bins", f"margins{k + 1}"}
    def check(blocks):
        import pyarrow as pa
        for b in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([len(b.y)]), pa.array([float(b.margins[1][0])])], ["n", "m"])
    told = state.mapped(check, "n long, m double", "y", "bins")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = told.collect()
    assert sum(r["n"] for r in rows) == df.count() and {r["m"] for r in rows} == {33.0}
    state.close()
    assert not spark.catalog.databaseExists(state.database)


def test_a_dictionary_table_gives_the_trees_of_an_inline_one(spark, monkeypatch):
    from canopy.operators.boost import bins, score

    df = spark.range(3000).selectExpr(
        "id as key", "cast(id % 6 + 1 as int) as fold", "case when id % 41 > 0 then concat('c', id * 7919 % 37) end as c",
        "cast(id % 11 as double) as x", "cast(id * 7919 % 37 * 3 + id % 11 as double) as y")
    p = BoostParams(learning_rate=0.5, max_trees=2, colsample_bytree=1.0)
    m = [ModelSpec("m", "m", 6, 3, early_stop=False, n_trees=2)]
    runs = []
    for limit in (10_000, 5):
        monkeypatch.setattr(bins, "INLINE_CATEGORIES", limit)
        res = Trainer(df, "key", "fold", "y", ["c", "x"], m, p).run()
        more = df.unionByName(df.limit(1).withColumn("c", F.lit("unseen")).withColumn("key", F.lit(-1)))
        pred = score.predict(more, res.features, res.models[0].trees, res.models[0].base_margin, p.objective, ["key"])
        runs.append(([[t.feature.tolist(), t.value.tolist(), {n: c.tolist() for n, c in t.cat_left.items()}] for t in res.models[0].trees],
                     sorted(map(tuple, pred.collect()))))
        assert bool(res.features.tables) == (limit == 5)
    assert runs[0] == runs[1] and any(t[2] for t in runs[0][0])


def test_many_categories_train(spark):
    """More than the 100,000 that were the limit once; odd categories have twice the label, and the test fold a third of them."""
    n = 150_000
    df = spark.range(2 * n).selectExpr("id as key", "cast(id % 6 + 1 as int) as fold", f"concat('c', id % {n}) as c",
                                       "cast(1 + id % 2 as double) as y")
    p = BoostParams(learning_rate=1.0, max_trees=1, subsample=1.0, reg_lambda=0.0, min_child_weight=0.0)
    t = Trainer(df, "key", "fold", "y", ["c"], [ModelSpec("m", "m", 6, 1, early_stop=False, n_trees=1)], p).run().models[0].trees[0]
    assert t.is_cat[0] and t.count[1] + t.count[2] == t.count[0] and len(t.cat_left[0]) == 50_000
    assert sorted(t.weight[1:3].tolist()) == pytest.approx([-0.4, 0.6], abs=1e-6)


def test_dropped_features_leave_their_places_in_the_column_sample(spark):
    df = spark.range(600).selectExpr("id as key", "cast(id % 6 + 1 as int) as fold", "cast(id % 5 as double) as a",
                                     "cast(id % 7 as double) as b", "cast(id % 3 as double) as c", "cast(id % 4 as double) as d",
                                     "cast(id % 5 + id % 3 as double) as y")
    p = BoostParams(colsample_bytree=0.5, max_trees=1)
    tr = Trainer(df, "key", "fold", "y", list("abcd"), [ModelSpec("m", "m", 6, 2)], p)
    tr.state.close()
    for t in range(20):
        assert len(tr._colsample(t)) == 2 and len(tr._colsample(t, [0, 2])) == 1
        assert not set(tr._colsample(t, [0, 2])) & {0, 2}
    whole = BoostParams(colsample_bytree=1.0, subsample=1.0, max_trees=2)
    models = [ModelSpec(str(drop), str(drop), 6, 2, masked=["a"], mask_trees=2, drop_masked=drop, early_stop=False, n_trees=2)
              for drop in (False, True)]
    a, b = (m.trees for m in Trainer(df, "key", "fold", "y", list("abcd"), models, whole).run().models)
    assert all((x.feature == y.feature).all() and (x.value == y.value).all() for x, y in zip(a, b))


def test_labels_beyond_a_log_links_reach_are_errors(spark):
    for objective, y in (("count:poisson", 1e30), ("reg:gamma", 1e30), ("reg:gamma", 1e-30)):
        df = spark.createDataFrame([(1, 1, 1.0, y), (2, 2, 2.0, 1.0)], "key int, fold int, x double, y double")
        with pytest.raises(ValueError):
            Trainer(df, "key", "fold", "y", ["x"], [ModelSpec("m", "m", 6, 1)], BoostParams(objective=objective))


def test_touched_cells_equal_dense_ones(spark, monkeypatch):
    from canopy.plans.queries_boost import _root_hist

    monkeypatch.setattr(histogram, "SPARSE_MERGE", 10)
    dense, sparse = (sorted(map(tuple, _root_hist(spark, SF_SMALL, dense_max_cells=n)[0].collect())) for n in (None, 0))
    assert dense == sparse


def test_bounds_cut_weights_of_the_constrained_trees(spark):
    from canopy.plans.queries_trees import bounded_model

    cut = 0
    for t in bounded_model(spark, SF_SMALL).models[0].trees:
        for n in np.flatnonzero(t.used):
            assert t.lower[n] <= t.weight[n] <= t.upper[n]
            cut += t.weight[n] in (t.lower[n], t.upper[n])
    assert cut > 0


def test_prepare_all_records_a_failure_and_goes_on():
    written = []

    def broken():
        raise ValueError("no such file")

    status = prepare_all({"a": lambda: "A", "b": broken, "c": lambda: "C"}, lambda name, df: written.append((name, df)))
    assert written == [("a", "A"), ("c", "C")]
    assert status == [("a", "ok", None), ("b", "failed", "ValueError: no such file"), ("c", "ok", None)]
