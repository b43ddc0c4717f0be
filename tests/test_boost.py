"""Layer 2: boosting invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators.boost.fit import BoostParams, ModelSpec, Trainer
from canopy.operators.boost.score import case_when_sql, predict
from canopy.operators.explain import ice_curves, monotonicity_violations
from canopy.operators.folds import assign_folds
from canopy.sources import tables
from conftest import SF_MID, SF_SMALL

FEATS = ["price", "discount", "tax", "quantity", "returnflag", "linestatus"]


def _charge(spark, sf):
    return assign_folds(tables.charge_rows(spark, sf), "row_key", 6, 42, stratify_col="charge")


def test_histogram_bins_sum_to_node_totals(spark):
    from canopy.plans.queries_boost import _root_hist
    h = _root_hist(spark, SF_SMALL)[0].collect()
    tot = [r for r in h if r["feature"] == -1][0]
    for f in range(4):
        cells = [r for r in h if r["feature"] == f]
        assert sum(r["C"] for r in cells) == tot["C"]
        assert sum(r["G"] for r in cells) == tot["G"]


@pytest.fixture(scope="module")
def small_model(spark):
    df = _charge(spark, SF_SMALL)
    p = BoostParams(objective="reg:gamma", learning_rate=0.1, max_trees=3, subsample=1.0,
                    colsample_bytree=1.0)
    m = ModelSpec("final", "final", 6, 2, {"price": 1}, early_stop=False, n_trees=3)
    return df, Trainer(df, "row_key", "fold", "charge", FEATS, [m], p).run()


def test_case_when_scorer_matches_arrow_scorer(spark, small_model):
    df, res = small_model
    m = res.models[0]
    test = df.where("fold = 6")
    a = predict(test, res.features, m.trees, m.base_margin, "reg:gamma", ["row_key"])
    expr = case_when_sql(m.trees, res.features, m.base_margin, "reg:gamma")
    b = test.select("row_key", F.expr(expr).alias("p2"))
    j = a.join(b, "row_key").select(F.max(F.abs(F.col("prediction") - F.col("p2")) /
                                          F.abs(F.col("p2"))).alias("d"), F.count("*").alias("n")).first()
    assert j["n"] == test.count() and j["d"] < 1e-9


def test_tree_covers_add_up(small_model):
    df, res = small_model
    t = res.models[0].trees[0]
    for n in np.nonzero((t.feature >= 0))[0]:
        assert t.count[2 * n + 1] + t.count[2 * n + 2] == t.count[n]
    leaves = [n for n in np.nonzero(t.used)[0] if t.feature[n] < 0]
    assert sum(t.count[n] for n in leaves) == df.where("fold <> 6").count()


def test_warmup_phase1_never_splits_on_masked(spark):
    df = _charge(spark, SF_SMALL)
    p = BoostParams(objective="reg:squarederror", learning_rate=0.3, max_trees=5)
    m = ModelSpec("w", "w", 6, 3, {"price": 1, "discount": -1}, masked=["price", "discount"],
                  mask_trees=3, early_stop=False, n_trees=5)
    res = Trainer(df, "row_key", "fold", "charge", FEATS, [m], p).run()
    trees = res.models[0].trees
    masked = {FEATS.index("price"), FEATS.index("discount")}
    for t in trees[:3]:
        assert not (set(t.feature[t.feature >= 0].tolist()) & masked)
    assert any(set(t.feature[t.feature >= 0].tolist()) & masked for t in trees[3:])


def test_early_stop_keeps_best_round(spark):
    df = _charge(spark, SF_SMALL)
    p = BoostParams(objective="reg:gamma", learning_rate=0.5, max_trees=12, early_stopping_rounds=2)
    ms = [ModelSpec(f"cv{k}", "g", k, 2) for k in range(1, 6)] + [ModelSpec("f", "g", 6, 2, early_stop=False)]
    res = Trainer(df, "row_key", "fold", "charge", FEATS, ms, p).run()
    for r in res.models[:5]:
        losses = {c: v[0] / v[2] for c, v in r.curve.items() if c >= 1}
        assert r.best_trees == min(losses, key=lambda c: (losses[c], c))
        assert len(r.trees) == r.best_trees
    final = res.models[5]
    assert final.best_trees == int(np.median([r.best_trees for r in res.models[:5]]))


def test_monotone_constraint_holds_on_noise_and_bites_without(spark):
    df = assign_folds(tables.noise_rows(spark, SF_MID), "row_key", 6, 42, stratify_col="target")
    feats = ["discount", "tax", "quantity", "returnflag", "linestatus"]
    p = BoostParams(objective="reg:squarederror", learning_rate=0.3, max_trees=10,
                    subsample=1.0, colsample_bytree=1.0)
    free = ModelSpec("free", "free", 6, 4, {}, early_stop=False, n_trees=10)
    mono = ModelSpec("mono", "mono", 6, 4, {"quantity": 1}, early_stop=False, n_trees=10)
    res = Trainer(df, "row_key", "fold", "target", feats, [free, mono], p).run()
    test = df.where("fold = 6")
    grid = [float(v) for v in range(1, 51)]
    out = {}
    for m in res.models:
        ice = ice_curves(test, "row_key", res.features, m.trees, m.base_margin,
                         "reg:squarederror", "quantity", grid, 100)
        out[m.spec.name] = monotonicity_violations(ice, 1).count()
    assert out["mono"] == 0
    assert out["free"] > 0


def test_categorical_split_and_scorers_agree(spark):
    base = tables.charge_rows(spark, SF_SMALL)
    df = assign_folds(base.withColumn(
        "y", F.col("charge") * F.when(F.col("returnflag") == "R", 3.0)
        .when(F.col("returnflag") == "N", 1.5).otherwise(1.0)), "row_key", 6, 42, stratify_col="y")
    p = BoostParams(objective="reg:squarederror", learning_rate=0.5, max_trees=2,
                    subsample=1.0, colsample_bytree=1.0)
    m = ModelSpec("c", "c", 6, 2, early_stop=False, n_trees=2)
    res = Trainer(df, "row_key", "fold", "y", ["returnflag"], [m], p).run()
    t = res.models[0].trees[0]
    assert t.is_cat[0] and t.feature[0] == 0
    cats = res.features.categories[0]
    left = {cats[c] for c in t.cat_left[0]}
    assert left in ({"R"}, set(cats) - {"R"})
    mm = res.models[0]
    test = df.where("fold = 6")
    a = predict(test, res.features, mm.trees, mm.base_margin, "reg:squarederror", ["row_key"])
    b = test.select("row_key", F.expr(case_when_sql(mm.trees, res.features, mm.base_margin,
                                                    "reg:squarederror")).alias("p2"))
    d = a.join(b, "row_key").select(F.max(F.abs(F.col("prediction") - F.col("p2")))).first()[0]
    assert d < 1e-6


def test_warm_start_continues_identically(spark):
    from canopy.plans.study import fit_final
    df = _charge(spark, SF_SMALL)
    p = BoostParams(objective="reg:squarederror", learning_rate=0.3, max_trees=10)
    first_res = fit_final(df, "row_key", "charge", FEATS, 2, 2, p)
    spec = first_res.features
    first = first_res.models[0]
    full = fit_final(df, "row_key", "charge", FEATS, 2, 4, p, spec=spec).models[0]
    cont = fit_final(df, "row_key", "charge", FEATS, 2, 4, p, init_trees=first.trees,
                     spec=spec).models[0]
    assert len(cont.trees) == 4
    for a, b in zip(full.trees, cont.trees):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.split_bin, b.split_bin)
        assert np.allclose(a.value, b.value, rtol=1e-9, atol=1e-9)
    assert cont.mape_at(4) == pytest.approx(full.mape_at(4), rel=1e-9)


def test_train_transform_touches_training_rows_only(spark):
    from canopy.plans.study import fit_final
    df = _charge(spark, SF_SMALL)
    p = BoostParams(objective="reg:squarederror", learning_rate=0.3, max_trees=3)
    plain = fit_final(df, "row_key", "charge", FEATS, 2, 2, p).models[0]
    same = fit_final(df, "row_key", "charge", FEATS, 2, 2, p, train_transform=lambda d: d).models[0]
    assert same.mape_at(2) == plain.mape_at(2)
    zeroed = fit_final(df, "row_key", "charge", FEATS, 2, 2, p,
                       train_transform=lambda d: d.withColumn("charge", F.lit(0.0))).models[0]
    assert zeroed.mape_at(2) != pytest.approx(plain.mape_at(2), rel=1e-6)
