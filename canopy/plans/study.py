"""Cross-validation, warm-up, grid search and the multi-dataset run
(M1, M2, M17-M19, M21, M22, M26).

Training is batched: all depths of the baseline and monotonic approaches,
with their fold models and final models, train in one ``Trainer`` run; the
warm-up configurations (which depend on the best monotonic depth) in a second.
Winners are not refitted: the final models of the batch are already the
refits, so diagnostics read their trees directly.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import mean, median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import col
from ..operators import explain, select
from ..operators.boost.bins import feature_spec
from ..operators.boost.fit import BatchResult, BoostParams, ModelSpec, Trainer
from ..operators.boost.score import model_table
from ..session import scratch_path
from ..sources.sinks import new_run, write_diagnostics, write_importances, write_results
from ..sources.text import read_results

# ---- Fixed values (must equal the reference's) ------------------------------
SEED = 42
PHASE1_PERCENTAGES = [0.025, 0.05, 0.075, 0.10, 0.125, 0.15, 0.175, 0.20]
MIN_PHASE1_TREES = 5
DEFAULT_MAX_DEPTHS = list(range(1, 11))
N_CV_FOLDS = 5
TEST_FOLD = 6
PDP_GRID_SIZE = 50
ICE_LINES = 50
# -----------------------------------------------------------------------------


def phase1_trees(n_trees: int, pct: float, minimum: int = MIN_PHASE1_TREES) -> int:
    """max(minimum, floor(n_trees * pct))."""
    return max(minimum, int(n_trees * pct))


def config_models(group: str, depth: int, constraints: dict, masked: Sequence[str] = (),
                  mask_trees: int = 0, folds: Sequence[int] = range(1, N_CV_FOLDS + 1),
                  test_fold: int = TEST_FOLD) -> list[ModelSpec]:
    """One fold model per CV fold plus the final model (holdout = test fold)."""
    ms = [ModelSpec(f"{group}/cv{k}", group, k, depth, dict(constraints), list(masked), mask_trees)
          for k in folds]
    ms.append(ModelSpec(f"{group}/final", group, test_fold, depth, dict(constraints),
                        list(masked), mask_trees, early_stop=False))
    return ms


def cross_validate(df: DataFrame, key: str, target: str, features: list[str], depth: int,
                   params: BoostParams, constraints: dict | None = None,
                   masked: Sequence[str] = (), mask_trees: int = 0,
                   train_transform: Callable[[DataFrame], DataFrame] | None = None, spec=None) -> BatchResult:
    """M2 (+ M1 for the final model, M19 when ``mask_trees`` > 0).

    ``train_transform`` (X1) is applied to the training rows of each fold
    model and of the final model only.  A row then differs from model to model,
    so the models train one after another instead of sharing passes; all use
    the cut points of the table as given."""
    models = config_models("cv", depth, constraints or {}, masked, mask_trees)
    if train_transform is None:
        return Trainer(df, key, "fold", target, features, models, params, spec=spec).run()
    spec = spec or feature_spec(df, features, params.max_bins)
    done = []
    for m in models[:-1]:
        seen = F.col("fold").isin(m.holdout, params.test_fold)
        part = train_transform(df.where(~seen)).unionByName(df.where(F.col("fold") == m.holdout))
        done += Trainer(part, key, "fold", target, features, [m], params, spec=spec).run().models
    n_trees = int(median(m.best_trees for m in done))
    final = fit_final(df, key, target, features, depth, n_trees, params, constraints, masked, mask_trees,
                      train_transform=train_transform, spec=spec).models[0]
    mapes = [m.mape_at(m.best_trees) for m in done]
    info = {"cv_mapes": mapes, "cv_trees": [m.best_trees for m in done], "cv_mape": mean(mapes),
            "n_trees": n_trees, "test_mape": final.mape_at(n_trees)}
    return BatchResult(spec, params, [*done, final], {"cv": info})


def fit_final(df: DataFrame, key: str, target: str, features: list[str], depth: int,
              n_trees: int, params: BoostParams, constraints: dict | None = None,
              masked: Sequence[str] = (), mask_trees: int = 0, init_trees: Sequence = (), init_base: float | None = None,
              train_transform: Callable[[DataFrame], DataFrame] | None = None,
              spec=None) -> BatchResult:
    """A fixed number of trees on all training rows, scored on test.

    ``init_trees`` continues a fitted model (M17, X2); its trees route on bin
    ids, so pass that model's cut points as ``spec`` (its
    ``BatchResult.features``).  ``train_transform`` (X1) is applied to the
    training rows only, the test rows stay as given."""
    if init_trees and spec is None:
        raise ValueError("continuing a model needs its feature spec (BatchResult.features)")
    if train_transform is not None:
        tf = F.col("fold") == params.test_fold
        df = train_transform(df.where(~tf)).unionByName(df.where(tf))
    m = ModelSpec("final", "final", params.test_fold, depth, constraints or {}, list(masked),
                  mask_trees, early_stop=False, n_trees=n_trees, init_trees=list(init_trees), init_base=init_base)
    return Trainer(df, key, "fold", target, features, [m], params, spec=spec).run()


@dataclass
class StudyResult:
    dataset: str
    results: DataFrame                     # grid rows with `chosen`
    rows: list                             # the same rows, driver-side
    batches: list = field(default_factory=list)
    winners: dict = field(default_factory=dict)   # approach -> (BatchResult, final ModelResult)
    features: list = field(default_factory=list)
    constraints: dict = field(default_factory=dict)


def run_grid_search(df: DataFrame, key: str, target: str, dataset: str,
                    constraints: dict | None = None, max_depths: Sequence[int] | None = None,
                    params: BoostParams | None = None, features: list[str] | None = None,
                    phase1_pcts: Sequence[float] = PHASE1_PERCENTAGES) -> StudyResult:
    """Baseline and monotonic over the depth grid, then warm-up at the
    best monotonic depth for each phase-1 fraction; flag the CV winners."""
    params = params or BoostParams()
    constraints = dict(constraints or {})
    depths = list(max_depths or DEFAULT_MAX_DEPTHS)
    feats = features or [c for c in df.columns if c not in (key, target, "fold")]
    mono_feats = [f for f in constraints if f in feats]
    models = []
    for d in depths:
        models += config_models(f"baseline/{d}", d, {})
        models += config_models(f"monotonic/{d}", d, constraints)
    first = Trainer(df, key, "fold", target, feats, models, params)
    try:
        return _grid(df, key, target, dataset, constraints, depths, params, feats, mono_feats, phase1_pcts, first)
    finally:
        first.state.close()


def _grid(df: DataFrame, key: str, target: str, dataset: str, constraints: dict, depths: list, params: BoostParams, feats: list,
          mono_feats: list, phase1_pcts: Sequence[float], first: Trainer) -> StudyResult:
    """``run_grid_search`` from the first batch's training on; the second batch goes on with its binned rows."""
    spark = df.sparkSession
    b1 = first.run(keep=True)
    rows = []
    run_ix = 0
    for approach in ("baseline", "monotonic"):
        for d in depths:
            g = b1.groups[f"{approach}/{d}"]
            rows.append((dataset, approach, d, g["cv_mape"], g["test_mape"], g["n_trees"],
                         None, None, False, run_ix))
            run_ix += 1
    mono = [r for r in rows if r[1] == "monotonic"]
    best_mono = min(mono, key=lambda r: (r[3] if r[3] is not None else float("inf"), r[9]))
    depth_m, trees_m = best_mono[2], best_mono[5] or 0
    p1s = {pct: phase1_trees(trees_m, pct) for pct in phase1_pcts}
    models2 = []
    for p1 in dict.fromkeys(p1s.values()):
        models2 += config_models(f"progressive/{p1}", depth_m, constraints, mono_feats, p1)
    b2 = Trainer(df, key, "fold", target, feats, models2, params, after=first).run()
    for pct, p1 in p1s.items():
        g = b2.groups[f"progressive/{p1}"]
        rows.append((dataset, "progressive", depth_m, g["cv_mape"], g["test_mape"], g["n_trees"],
                     p1, float(pct), False, run_ix))
        run_ix += 1
    res = select.choose_best(spark.createDataFrame(rows, select.RESULT_SCHEMA))
    out_rows = res.orderBy("run_ix").collect()
    winners = {}
    for r in out_rows:
        if r["chosen"]:
            if r["approach"] == "progressive":
                batch, grp = b2, f"progressive/{r['num_trees_phase1']}"
            else:
                batch, grp = b1, f"{r['approach']}/{r['max_depth']}"
            final = [m for m in batch.models if m.spec.group == grp and not m.spec.early_stop][0]
            winners[r["approach"]] = (batch, final)
    return StudyResult(dataset, res, out_rows, [b1, b2], winners, feats, constraints)


def importance_table(spark: SparkSession, study: StudyResult) -> DataFrame:
    """M25 for the three winners, long form (approach, feature, pct)."""
    if not study.winners:
        return spark.createDataFrame([], "approach string, feature string, pct double")
    spec = next(iter(study.winners.values()))[0].features
    mt = model_table(spark, {a: fm.trees for a, (b, fm) in study.winners.items()}, spec)
    imp = explain.gain_importance(mt, study.features)
    return imp.select(F.col("model").alias("approach"), "feature", "pct")


def curves(df_test: DataFrame, key: str, study: StudyResult, approach: str, feature: str,
           grid_size: int = PDP_GRID_SIZE, n_lines: int = ICE_LINES, ends: tuple | None = None, lines: DataFrame | None = None):
    """M24 for one winner and one feature: (PDP table, ICE table).  ``ends`` and ``lines``: the feature's least and greatest
    value and the rows of the ICE curves (``explain.sample_rows``), where they are known."""
    batch, fm = study.winners[approach]
    spec = batch.features
    lo, hi = ends or explain.min_max(df_test, feature)
    if lo is None:
        return None, None
    n = grid_size
    grid = [lo + i * (hi - lo) / (n - 1) for i in range(n)] if n > 1 else [lo]
    obj = batch.params.objective
    pdp = explain.partial_dependence(df_test, spec, fm.trees, fm.base_margin, obj, feature, grid)
    ice = explain.ice_curves(df_test if lines is None else lines, key, spec, fm.trees, fm.base_margin, obj, feature, grid,
                             n_lines)
    return pdp, ice


def diagnostics(spark: SparkSession, df_test: DataFrame, key: str, study: StudyResult,
                grid_size: int = PDP_GRID_SIZE, n_lines: int = ICE_LINES) -> dict:
    """Every diagnostic table of the three winners - gain importance
    (long and pivoted) and, for each constrained feature, PDP and ICE curves
    with their monotonicity violations."""
    imp = importance_table(spark, study)
    out = {"importance": imp, "importance_wide": select.pivot_importance(imp), "pdp": [], "ice": [],
           "violations": []}
    # All winners are shown on the same rows and grids, which are looked up once.
    shown = [f for f in study.constraints if f in study.features] if study.winners else []
    ends = {f: explain.min_max(df_test, f) for f in shown}
    lines = None
    if shown:
        path = scratch_path(spark, "ice-rows")
        explain.sample_rows(df_test.select(*[col(c) for c in dict.fromkeys([key, *study.features])]), key, n_lines).write.parquet(path)
        lines = spark.read.parquet(path)
    for approach in study.winners:
        for f, d in study.constraints.items():
            if f not in study.features:
                continue
            pdp, ice = curves(df_test, key, study, approach, f, grid_size, n_lines, ends[f], lines)
            if pdp is None:
                continue
            tag = [F.lit(approach).alias("approach"), F.lit(f).alias("feature")]
            out["pdp"].append(pdp.select(*tag, "*"))
            out["ice"].append(ice.select(*tag, "*"))
            out["violations"].append(explain.monotonicity_violations(ice, d).select(*tag, "*"))
    for k in ("pdp", "ice", "violations"):
        out[k] = select.union_all(out[k]) if out[k] else None
    return out


def run_all(spark: SparkSession, config: DataFrame, load: Callable[[str], tuple[DataFrame, str]],
            max_depths: Sequence[int] | None = None, params_for: Callable | None = None,
            out_path: str | None = None, phase1_pcts: Sequence[float] = PHASE1_PERCENTAGES):
    """Every configured dataset in config order; a failure is recorded,
    not raised.  Returns (status rows, summary of chosen rows).

    With ``out_path`` each dataset's result rows are committed below
    ``out_path/results`` (K2) under this run's id, its importances below ``out_path/importance``
    (K3) and its winners' curves below ``out_path/diagnostics`` (M26) as soon as it is done.  The summary is
    made of the rows that this run committed, read back, in config and report order, and written to
    ``out_path/summary`` (K4): what earlier runs left for a dataset that fails now stays out.

    ``config`` columns: dataset, target, monotonic (map feature -> direction),
    objective, lr.  ``load(dataset)`` gives (prepared DataFrame, key column).
    """
    status, chosen, run = [], [], new_run()
    for c in config.collect():           # the config table: a handful of rows
        name = c["dataset"]
        try:
            df, key = load(name)
            p = (params_for(c) if params_for else
                 BoostParams(objective=c["objective"], learning_rate=c["lr"]))
            st = run_grid_search(df, key, c["target"], name, dict(c["monotonic"] or {}),
                                 max_depths, p, phase1_pcts=phase1_pcts)
            if out_path:
                found = diagnostics(spark, df.where(F.col("fold") == TEST_FOLD), key, st)
                write_diagnostics(found, f"{out_path}/diagnostics/{name}")
                write_importances(found["importance_wide"], f"{out_path}/importance/{name}")
                write_results(st.results, f"{out_path}/results", run)
            else:
                chosen.append(select.chosen(st.results))
            status.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001 - isolate one dataset's failure
            status.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
            traceback.print_exc()
    st_df = spark.createDataFrame(status, "dataset string, status string, error string")
    done = [name for name, state, _ in status if state == "ok"]
    if out_path and done:
        summary = select.in_report_order(select.chosen(read_results(spark, f"{out_path}/results", done, run)), done)
        # a few rows per dataset, in order, as one file
        summary.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/summary")
        return st_df, spark.read.parquet(f"{out_path}/summary")
    summary = select.union_all(chosen) if chosen else spark.createDataFrame([], select.RESULT_SCHEMA)
    return st_df, select.in_report_order(summary, done)
