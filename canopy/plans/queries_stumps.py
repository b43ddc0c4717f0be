"""Registered queries: the training study on boosted stumps, which DuckDB SQL can
express (M1, M2, M15-M18, M20, M23, M25).

The models are trained by ``Trainer`` as any other; the settings (depth 1, exact
cut points, squared error, no sampling, a few rounds) let the SQL side unroll
the rounds as CTEs: histogram, split search, leaf weights, margins, next round.
All of lineitem is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MAPE_EPS
from ..operators import explain, select
from ..operators.boost.bins import feature_spec
from ..operators.boost.fit import BoostParams
from ..operators.boost.score import model_table, predict
from ..session import scratch_path
from ..sources import tables
from ..sources.sinks import write_diagnostics
from ..sources.text import read_diagnostics
from . import study
from .oracle import charge_folds_sql
from .queries_boost import SQL_BINS, _folded, _noise, _probs
from .registry import register

LR, ROUNDS = 0.5, 3
PARAMS = BoostParams(objective="reg:squarederror", learning_rate=LR, max_trees=ROUNDS, early_stopping_rounds=50,
                     subsample=1.0, colsample_bytree=1.0, max_bins=SQL_BINS)
CHARGE = ["price", "discount", "tax", "quantity", "returnflag"]
NOISE = ["discount", "tax", "quantity", "returnflag", "linestatus"]
TEXT = ("returnflag", "linestatus")


def _bin_sql(f: str, value: str | None = None) -> str:
    v = value or f
    n = (f"list_position((select e from e_{f}), {v})" if f in TEXT
         else f"len(list_filter((select e from e_{f}), lambda x: x <= {v}))")
    return f"case when {v} is null then -1 else cast({n} as integer){' - 1' if f in TEXT else ''} end"


def stumps_sql(fixture: str, y: str, features: list[str], dirs: dict | None = None, masked: tuple = (),
               mask_trees: int = 0, models: str = "6", rounds: int = ROUNDS) -> str:
    """CTEs r0..rN (rows x models ``k`` with margin m after each round) and best1..bestN (each round's split).
    Model k trains on the folds other than k and 6."""
    probs = ", ".join(repr(p) for p in _probs(SQL_BINS))
    sql = charge_folds_sql(cols=f", {y}, " + ", ".join(features), fixture=fixture, y=y)
    for f in features:
        e = (f"list(distinct {f} order by {f}) filter ({f} is not null)" if f in TEXT
             else f"list_sort(list_distinct(quantile_cont({f}, [{probs}])))")
        sql += f", e_{f} as (select {e} as e from _folded)\n"
    sql += f""", r0 as materialized (
  select row_key, fold, {y} as y, k, [{', '.join(_bin_sql(f) for f in features)}] as bs,
         avg({y}) filter (where fold <> 6 and fold <> k) over (partition by k) as m
  from _folded, (select unnest([{models}]) as k) ks)
"""
    cat = " or ".join(f"feature = {i}" for i, f in enumerate(features) if f in TEXT) or "false"
    dir_ = "case feature " + "".join(f"when {features.index(f)} then {d} " for f, d in (dirs or {}).items()) + \
        "else 0 end" if dirs else "0"
    for t in range(1, rounds + 1):
        off = [str(features.index(f)) for f in masked] if t <= mask_trees else []
        sql += f""", h{t} as (
  select k, feature, bin, sum(m - y) as G, count(*)::double as H, count(*) as C, {cat} as is_cat
  from (select k, m, y, unnest(bs) as bin, unnest(range(0, {len(features)})) as feature
        from r{t - 1} where fold <> 6 and fold <> k) x group by k, feature, bin),
w{t} as (
  select *, sum(G) over p as Gt, sum(H) over p as Ht, sum(C) over p as Ct,
         sum(case when bin < 0 then G else 0 end) over p as Gm, sum(case when bin < 0 then H else 0 end) over p as Hm,
         sum(case when bin < 0 then C else 0 end) over p as Cm, row_number() over o as pos, list(bin) over o as left_bins,
         sum(case when bin < 0 then 0 else G end) over o as GL0, sum(case when bin < 0 then 0 else H end) over o as HL0,
         sum(case when bin < 0 then 0 else C end) over o as CL0
  from h{t}
  window p as (partition by k, feature),
         o as (partition by k, feature order by case when bin < 0 then -1e300 when is_cat then G / (H + 1) else bin end, bin
               rows between unbounded preceding and current row)),
c{t} as (
  select *, GL0 + (case when dl then Gm else 0 end) as GL, HL0 + (case when dl then Hm else 0 end) as HL,
         CL0 + (case when dl then Cm else 0 end) as CL
  from w{t}, (select unnest([false, true]) as dl) d where bin >= 0 and (not dl or Cm > 0)),
s{t} as (
  select *, Ct - CL as CR, -GL / (HL + 1) as wl, -(Gt - GL) / (Ht - HL + 1) as wr,
         GL * GL / (HL + 1) + (Gt - GL) * (Gt - GL) / (Ht - HL + 1) - Gt * Gt / (Ht + 1) as loss_chg from c{t}),
best{t} as (
  select * from s{t} where HL >= 1 and Ht - HL >= 1 and CL > 0 and CR > 0 and loss_chg > 1e-6
  and ({dir_}) * (wr - wl) >= 0{f" and feature not in ({', '.join(off)})" if off else ""}
  qualify row_number() over (partition by k order by loss_chg desc, feature, pos, dl) = 1),
r{t} as materialized (
  select r.row_key, r.fold, r.y, r.k, r.bs, r.m + {LR} * case when {_left('r.bs[b.feature + 1]')} then wl else wr end as m
  from r{t - 1} r join best{t} b using (k))
"""
    return sql


def _left(bin_: str) -> str:
    return f"case when {bin_} < 0 then b.dl when b.is_cat then list_contains(b.left_bins, {bin_}) else {bin_} <= b.bin end"


def _curve_sql(rounds: int = ROUNDS) -> str:
    return ", curve as (" + " union all ".join(
        f"select k, {t} as t, avg((m - y) * (m - y)) as loss, avg(abs(y - m) / greatest(abs(y), {MAPE_EPS!r})) as mape "
        f"from r{t} where fold = k group by k" for t in range(1, rounds + 1)) + ")\n"


def _cv(spark, sf_dir):
    """Five fold models and the final model on a target that the features hardly explain, so that the
    best rounds differ and the monotone direction of quantity bites."""
    df = _noise(spark, sf_dir)
    return study.cross_validate(df, "row_key", "target", NOISE, 1, PARAMS, {"quantity": 1},
                                spec=feature_spec(df, NOISE, SQL_BINS))


_CV_SQL = stumps_sql("noise", "target", NOISE, {"quantity": 1}, models="1, 2, 3, 4, 5, 6") + _curve_sql()


@register("m16_stump_curves", _CV_SQL + "select k as holdout, t as n_trees, round(loss, 1) as loss, round(mape, 9) as mape from curve")
def q_curves(spark, sf_dir):
    rows = [(m.spec.holdout, t, round(v[0] / v[2], 1), round(v[1] / v[2], 9))
            for m in _cv(spark, sf_dir).models for t, v in m.curve.items()]
    return spark.createDataFrame(rows, "holdout int, n_trees int, loss double, mape double")


@register("m2_stump_cv", _CV_SQL + """
, kept as (select k, t, mape from curve where k <= 5 qualify row_number() over (partition by k order by loss, t) = 1),
total as (select cast(floor(median(t)) as integer) as t, avg(mape) as mape from kept)
select k as holdout, t as n_trees, round(mape, 9) as mape from kept
union all select 0, t, round(mape, 9) from total
union all select 6, total.t, round(curve.mape, 9) from total join curve on curve.k = 6 and curve.t = total.t""")
def q_cv(spark, sf_dir):
    """Best round and error per fold model, the mean over folds (holdout 0) and the final model's test error."""
    g = _cv(spark, sf_dir).groups["cv"]
    rows = [(k + 1, t, round(m, 9)) for k, (t, m) in enumerate(zip(g["cv_trees"], g["cv_mapes"]))]
    rows += [(0, g["n_trees"], round(g["cv_mape"], 9)), (6, g["n_trees"], round(g["test_mape"], 9))]
    return spark.createDataFrame(rows, "holdout int, n_trees int, mape double")


def _charge_model(spark, sf_dir, n_trees=ROUNDS, masked=(), mask_trees=0, before=None):
    df = _folded(spark, sf_dir)
    spec = before.features if before else feature_spec(df, CHARGE, SQL_BINS)
    first = before.models[0] if before else None
    return study.fit_final(df, "row_key", "charge", CHARGE, 1, n_trees, PARAMS, masked=masked, mask_trees=mask_trees,
                           init_trees=first.trees if first else (), init_base=first.base_margin if first else None, spec=spec)


def _tree_rows(spark, res) -> DataFrame:
    nodes = model_table(spark, {"final": res.models[0].trees}, res.features)
    leaf = [F.max(F.when(F.col("node_id") == n, F.round(c, d))).alias(f"{side}_{c}")
            for n, side in ((1, "left"), (2, "right")) for c, d in (("weight", 6), ("n_rows", 0))]
    root = F.col("node_id") == 0
    return nodes.groupBy("tree_id").agg(
        F.max(F.when(root, F.col("feature"))).alias("feature"), F.max(F.when(root, F.col("default_left"))).alias("default_left"),
        F.max(F.when(root, F.round(F.col("gain") / 1e6, 3))).alias("gain_m"), *leaf)


def _trees_sql(features: list[str]) -> str:
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    return " union all ".join(
        f"select {t - 1} as tree_id, {names}[feature + 1] as feature, dl as default_left, round(loss_chg / 1e6, 3) as gain_m, "
        f"round(wl, 6) as left_weight, cast(CL as bigint) as left_n_rows, round(wr, 6) as right_weight, "
        f"cast(CR as bigint) as right_n_rows from best{t} where k = 6" for t in range(1, ROUNDS + 1))


_FIT_SQL = stumps_sql("charge", "charge", CHARGE)


@register("m1_stump_fit", _FIT_SQL + _trees_sql(CHARGE))
def q_fit(spark, sf_dir):
    return _tree_rows(spark, _charge_model(spark, sf_dir))


@register("m18_stump_warmup", stumps_sql("charge", "charge", CHARGE, masked=("price", "quantity"), mask_trees=2) + _trees_sql(CHARGE))
def q_warmup(spark, sf_dir):
    """Two rounds without price and quantity (so returnflag, discount and tax split), then one with all."""
    return _tree_rows(spark, _charge_model(spark, sf_dir, masked=("price", "quantity"), mask_trees=2))


_PRED_SQL = _FIT_SQL + f"select row_key, round(m, 4) as prediction from r{ROUNDS} where fold = 6"


def _predicted(spark, sf_dir, res) -> DataFrame:
    m = res.models[0]
    test = _folded(spark, sf_dir).where("fold = 6")
    out = predict(test, res.features, m.trees, m.base_margin, PARAMS.objective, ["row_key"])
    return out.select("row_key", F.round("prediction", 4).alias("prediction"))


@register("m20_stump_predict", _PRED_SQL)
def q_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, _charge_model(spark, sf_dir))


@register("m17_stump_warm_start", _PRED_SQL)
def q_warm_start(spark, sf_dir):
    """One tree, then the rest on top of it: the predictions are those of the whole fit."""
    first = _charge_model(spark, sf_dir, 1)
    return _predicted(spark, sf_dir, _charge_model(spark, sf_dir, ROUNDS, before=first))


@register("m25_stump_importance", _FIT_SQL + ", raw as (" + " union all ".join(
    f"select feature, loss_chg as gain from best{t}" for t in range(1, ROUNDS + 1)) + """),
shares as (select names.feature, coalesce(avg(gain), 0) as gain
           from (select unnest(['""" + "', '".join(CHARGE) + """']) as feature, unnest(range(0, """ + str(len(CHARGE)) + """)) as ix) names
           left join raw on raw.feature = ix group by names.feature)
select feature, round(100 * gain / sum(gain) over (), 6) as pct from shares""")
def q_importance(spark, sf_dir):
    res = _charge_model(spark, sf_dir)
    table = model_table(spark, {"final": res.models[0].trees}, res.features)
    return explain.gain_importance(table, CHARGE).select("feature", F.round("pct", 6).alias("pct"))


_GRID = 25


@register("m23_stump_pdp", _FIT_SQL + f"""
, span as (select min(price) as lo, max(price) as hi from _folded where fold = 6),
grid as (select i as grid_ix, lo + i * (hi - lo) / {_GRID - 1} as v from span, range(0, {_GRID}) g(i)),
gb as (select grid_ix, v, {_bin_sql('price', 'v')} as bin from grid)
select cast(grid_ix as integer) as grid_ix, round(any_value(v), 6) as grid_value, round(avg(r0.m""" + "".join(
    f" + {LR} * (select case when {_left('case when b.feature = 0 then gb.bin else r0.bs[b.feature + 1] end')} "
    f"then wl else wr end from best{t} b)" for t in range(1, ROUNDS + 1)) + """), 4) as pdp
from gb, r0 where r0.fold = 6 group by grid_ix""")
def q_pdp(spark, sf_dir):
    res = _charge_model(spark, sf_dir)
    m = res.models[0]
    test = _folded(spark, sf_dir).where("fold = 6")
    lo, hi = explain.min_max(test, "price")
    grid = [lo + i * (hi - lo) / (_GRID - 1) for i in range(_GRID)]
    out = explain.partial_dependence(test, res.features, m.trees, m.base_margin, PARAMS.objective, "price", grid)
    return out.select("grid_ix", F.round("grid_value", 6).alias("grid_value"), F.round("pdp", 4).alias("pdp"))


_PRED_AT = "r0.m" + "".join(
    f" + {LR} * (select case when {_left('case when b.feature = 0 then gb.bin else r0.bs[b.feature + 1] end')} "
    f"then wl else wr end from best{t} b)" for t in range(1, ROUNDS + 1))
_GRID_SQL = f"""
, span as (select min(price) as lo, max(price) as hi from _folded where fold = 6),
grid as (select i as grid_ix, lo + i * (hi - lo) / {_GRID - 1} as v from span, range(0, {_GRID}) g(i)),
gb as (select grid_ix, v, {_bin_sql('price', 'v')} as bin from grid),
lines as (select * from r0 where fold = 6 order by md5('42:' || row_key), row_key limit {study.ICE_LINES}),
ice as (select r0.row_key, cast(grid_ix as integer) as grid_ix, v as grid_value, {_PRED_AT} as pred from gb, lines r0)
"""


@register("m24_stump_ice", _FIT_SQL + _GRID_SQL + "select row_key, grid_ix, round(grid_value, 6) as grid_value, "
          "round(pred, 4) as pred from ice")
def q_ice(spark, sf_dir):
    """O4 + J6: the model's predictions of fifty sampled test rows at 25 prices."""
    m = (res := _charge_model(spark, sf_dir)).models[0]
    test = _folded(spark, sf_dir).where("fold = 6")
    lo, hi = explain.min_max(test, "price")
    grid = [lo + i * (hi - lo) / (_GRID - 1) for i in range(_GRID)]
    out = explain.ice_curves(test, "row_key", res.features, m.trees, m.base_margin, PARAMS.objective, "price", grid,
                             study.ICE_LINES)
    return out.select("row_key", "grid_ix", F.round("grid_value", 6).alias("grid_value"), F.round("pred", 4).alias("pred"))


_STEPS = "(select *, pred - lag(pred) over (partition by row_key order by grid_ix) as step from ice)"


@register("m26_stump_diagnostics", _FIT_SQL + _GRID_SQL + f"""
, raw as ({' union all '.join(f"select feature, loss_chg as gain from best{t}" for t in range(1, ROUNDS + 1))}),
shares as (select names.feature, coalesce(avg(gain), 0) as gain
           from (select unnest(['{"', '".join(CHARGE)}']) as feature, unnest(range(0, {len(CHARGE)})) as ix) names
           left join raw on raw.feature = ix group by names.feature),
pdp as (select cast(grid_ix as integer) as grid_ix, avg({_PRED_AT}) as pdp from gb, r0 where r0.fold = 6 group by grid_ix)
select 'importance' as kind, feature, cast(null as varchar) as row_key, cast(null as integer) as grid_ix,
       round(100 * gain / sum(gain) over (), 6) as value from shares
union all select 'pdp', 'price', null, grid_ix, round(pdp, 4) from pdp
union all select 'ice', 'price', row_key, grid_ix, round(pred, 4) from ice
union all select 'violations', 'price', row_key, grid_ix, round(step, 4) from {_STEPS} where -1 * step < -1e-9""")
def q_diagnostics(spark, sf_dir):
    """Importance, partial dependence, ICE curves and steps against a (wrong) falling price, written and
    read back."""
    res = _charge_model(spark, sf_dir)
    st = study.StudyResult("charge", None, [], [res], {"monotonic": (res, res.models[0])}, CHARGE, {"price": -1})
    path = scratch_path(spark, "diagnostics")
    write_diagnostics(study.diagnostics(spark, _folded(spark, sf_dir).where("fold = 6"), "row_key", st, _GRID), path)
    none = {"row_key": F.lit(None).cast("string"), "grid_ix": F.lit(None).cast("int")}
    parts = [read_diagnostics(spark, path, "importance").withColumns(none).withColumn("value", F.round("pct", 6)),
             read_diagnostics(spark, path, "pdp").withColumn("row_key", none["row_key"]).withColumn("value", F.round("pdp", 4)),
             read_diagnostics(spark, path, "ice").withColumn("value", F.round("pred", 4)),
             read_diagnostics(spark, path, "violations").withColumn("value", F.round("step", 4))]
    return select.union_all([p.select(F.lit(k).alias("kind"), "feature", "row_key", "grid_ix", "value")
                             for k, p in zip(("importance", "pdp", "ice", "violations"), parts)])
