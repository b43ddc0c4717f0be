"""``m21_grid_search`` trains the whole grid of the original."""

from pyspark.sql import functions as F

from canopy.operators.boost.fit import BatchResult, ModelResult
from canopy.plans import queries_boost, study


def test_the_grid_search_trains_the_whole_grid(spark, monkeypatch):
    """The training itself is stood in for, as the whole grid takes long: what is asked of it counts here."""
    asked, params = [], []

    class Trained:
        def __init__(self, df, key, fold, target, features, models, p, after=None):
            asked.append((df.count(), models))
            params.append(p)
            self.models, self.state = models, self

        def close(self):
            pass

        def run(self, keep=False):
            groups = {m.group: {"cv_mape": 1.0 / (m.depth + m.mask_trees + 1), "test_mape": 0.5, "n_trees": 1000} for m in self.models}
            return BatchResult(None, params[-1], [ModelResult(m, [], {}) for m in self.models], groups)

    df = spark.range(60).select(F.col("id").alias("row_key"), F.lit(1.0).alias("charge"), (F.col("id") % 6 + 1).cast("int").alias("fold"))
    monkeypatch.setattr(study, "Trainer", Trained)
    monkeypatch.setattr(queries_boost, "_folded", lambda *_: df)
    monkeypatch.setattr(queries_boost, "_CACHE", {})
    rows = [(r["approach"], r["max_depth"], r["phase1_pct"], r["num_trees_phase1"])
            for r in queries_boost.q_m21(spark, "whole").orderBy("run_ix").collect()]
    fractions = [0.025, 0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2]
    assert rows == [(a, d, None, None) for a in ("baseline", "monotonic") for d in range(1, 11)] + \
        [("progressive", 10, f, round(1000 * f)) for f in fractions]
    first, second = asked
    assert first[0] == second[0] == 60
    assert sorted((m.group, m.holdout) for m in first[1]) == sorted(
        (f"{a}/{d}", k) for a in ("baseline", "monotonic") for d in range(1, 11) for k in range(1, 7))
    assert len(second[1]) == 8 * 6
    assert all((p.max_trees, p.early_stopping_rounds, p.subsample, p.colsample_bytree, p.max_bins) == (10_000, 50, 0.8, 0.8, 256) for p in params)
