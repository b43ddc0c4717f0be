"""Registered queries: whole trees deeper than a stump against DuckDB (M9, M11-M13, M5 in training).

The SQL side grows each tree level by level: rows carry their node, every level's histogram,
split search and routing are CTEs over (model, node), and children inherit their parent's bounds, cut
at the midpoint of the two child weights where the split feature is constrained.  Row and column samples
are replayed from md5.  All of lineitem is used; the models are trained by ``Trainer`` as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MAPE_EPS
from ..operators import explain
from ..operators.boost.fit import BoostParams, ModelSpec, Trainer
from ..operators.boost.histogram import sample_constants
from ..operators.boost.score import model_table
from ..operators.boost.state import HASH_DIGITS
from ..sources import tables
from . import study
from .oracle import charge_folds_sql
from .queries_boost import ALL_FEATURES, CONSTRAINTS, ROUTINE, SQL_BINS, _folded, _noise, _probs
from .queries_stumps import CHARGE, NOISE, TEXT, _bin_sql, _left
from .registry import register

DEPTH, LR = 3, 0.5

#: Gradient, hessian and start margin in SQL, of margin m and label y.
_SQL_OBJECTIVE = {
    "reg:squarederror": ("m - y", "1.0", "avg(y)"),
    "reg:gamma": ("1.0 - y * exp(-m)", "y * exp(-m)", "ln(avg(y))"),
    "count:poisson": ("exp(m) - y", "exp(m + 0.7)", "ln(avg(y))"),
}


def _allowed_sql(features: list[str], seed: int, tree: int, share: float) -> str:
    """The feature numbers that a tree's column sample keeps."""
    names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(features))
    keep = max(1, int(share * len(features)))
    return (f"(select i from (values {names}) v(i, f) qualify row_number() over "
            f"(order by md5('{seed}:{tree}:' || f), i) <= {keep})")


def _sampled_sql(seed: int, tree: int, share: float) -> str:
    a, b = sample_constants(seed, tree)
    return f"(kh::hugeint * {a}::hugeint + {b}::hugeint) % 18446744073709551616::hugeint < {int(share * 2.0**64)}::hugeint"


def trees_sql(fixture: str, y: str, features: list[str], depth: int, rounds: int, dirs: dict | None = None,
              objective: str = "reg:squarederror", rows: float = 1.0, columns: float = 1.0, seed: int = 42,
              models: str = "6", lr: float = LR, bins: int = SQL_BINS, masked: tuple = (), mask_trees: int = 0) -> str:
    """CTEs r0..rN (rows x models ``k`` with the margin after each round) and node1..nodeN (each round's nodes).
    ``masked`` features are left out of the first ``mask_trees`` trees, after the columns are sampled."""
    probs = ", ".join(repr(p) for p in _probs(bins))
    g, h, start = _SQL_OBJECTIVE[objective]
    sql = charge_folds_sql(cols=f", {y}, " + ", ".join(features), fixture=fixture, y=y)
    for f in features:
        e = (f"list(distinct {f} order by {f}) filter ({f} is not null)" if f in TEXT
             else f"list_sort(list_distinct(quantile_cont({f}, [{probs}])))")
        sql += f", e_{f} as (select {e} as e from _folded)\n"
    sql += f""", r0 as materialized (
  select row_key, fold, y, k, bs, kh, {start.replace('(y)', '(y) filter (where fold <> 6 and fold <> k) over (partition by k)')} as m
  from (select row_key, fold, {y} as y, [{', '.join(_bin_sql(f) for f in features)}] as bs,
               cast('0x' || substr(md5('{seed}:' || row_key), 1, {HASH_DIGITS}) as bigint) as kh from _folded) f,
       (select unnest([{models}]) as k) ks)
"""
    cat = " or ".join(f"feature = {i}" for i, f in enumerate(features) if f in TEXT) or "false"
    of_feature = "case feature " + "".join(f"when {features.index(f)} then {d} " for f, d in (dirs or {}).items()) + "else 0 end" \
        if dirs else "0"
    clamp = "greatest(least({}, upper), lower)".format
    for t in range(1, rounds + 1):
        sampled = _sampled_sql(seed, t - 1, rows) if rows < 1 else "true"
        some = [f"feature in {_allowed_sql(features, seed, t - 1, columns)}"] if columns < 1 else []
        if masked and t <= mask_trees:
            some.append(f"feature not in ({', '.join(str(features.index(f)) for f in masked)})")
        allowed = f" where {' and '.join(some)}" if some else ""
        sql += f""", x{t}_0 as materialized (
  select *, {g} as g, {h} as h, 0 as node, fold <> 6 and fold <> k and {sampled} as used from r{t - 1}),
n{t}_0 as (select distinct k, 0 as node, '-infinity'::double as lower, 'infinity'::double as upper from r{t - 1})
"""
        for d in range(depth):
            p, s = f"{t}_{d}", f"{t}_{d + 1}"
            sql += f""", h{p} as (
  select k, node, feature, bin, sum(g) as G, sum(h) as H, count(*) as C, {cat} as is_cat
  from (select k, node, g, h, unnest(bs) as bin, unnest(range(0, {len(features)})) as feature
        from x{p} where used and node >= {2 ** d - 1}) x{allowed} group by k, node, feature, bin),
w{p} as (
  select *, sum(G) over p as Gt, sum(H) over p as Ht, sum(C) over p as Ct,
         sum(case when bin < 0 then G else 0 end) over p as Gm, sum(case when bin < 0 then H else 0 end) over p as Hm,
         sum(case when bin < 0 then C else 0 end) over p as Cm, row_number() over o as pos, list(bin) over o as left_bins,
         sum(case when bin < 0 then 0 else G end) over o as GL0, sum(case when bin < 0 then 0 else H end) over o as HL0,
         sum(case when bin < 0 then 0 else C end) over o as CL0
  from h{p}
  window p as (partition by k, node, feature),
         o as (partition by k, node, feature order by case when bin < 0 then -1e300 when is_cat then G / (H + 1) else bin end, bin
               rows between unbounded preceding and current row)),
c{p} as (
  select w.*, dl, GL0 + (case when dl then Gm else 0 end) as GL, HL0 + (case when dl then Hm else 0 end) as HL,
         CL0 + (case when dl then Cm else 0 end) as CL, lower, upper, {of_feature} as dir
  from w{p} w join n{p} using (k, node), (select unnest([false, true]) as dl) d where bin >= 0 and (not dl or Cm > 0)),
v{p} as (select *, Gt - GL as GR, Ht - HL as HR, Ct - CL as CR, {clamp('-GL / (HL + 1)')} as wl,
                {clamp('-(Gt - GL) / (Ht - HL + 1)')} as wr, {clamp('-Gt / (Ht + 1)')} as wp from c{p}),
s{p} as (select *, (2 * Gt * wp + (Ht + 1) * wp * wp) - (2 * GL * wl + (HL + 1) * wl * wl)
                   - (2 * GR * wr + (HR + 1) * wr * wr) as loss_chg from v{p}),
best{p} as (
  select * from s{p} where HL >= 1 and HR >= 1 and CL > 0 and CR > 0 and loss_chg > 1e-6 and dir * (wr - wl) >= 0
  qualify row_number() over (partition by k, node order by loss_chg desc, feature, pos, dl) = 1),
n{s} as (
  select k, 2 * node + 1 as node, case when dir < 0 then (wl + wr) / 2 else lower end as lower,
         case when dir > 0 then (wl + wr) / 2 else upper end as upper from best{p}
  union all
  select k, 2 * node + 2, case when dir > 0 then (wl + wr) / 2 else lower end,
         case when dir < 0 then (wl + wr) / 2 else upper end from best{p}),
x{s} as materialized (
  select x.* exclude (node), case when b.node is null then x.node when {_left('x.bs[b.feature + 1]')} then 2 * x.node + 1
                                  else 2 * x.node + 2 end as node
  from x{p} x left join best{p} b on x.k = b.k and x.node = b.node)
"""
        bounds = " union all ".join(f"select * from n{t}_{d}" for d in range(depth + 1))
        splits = " union all ".join(f"select k, node, feature, dl, loss_chg, Gt, Ht, Ct, wp from best{t}_{d}" for d in range(depth))
        sql += f""", bounds{t} as ({bounds}), split{t} as ({splits}),
leaf{t} as (
  select k, node, any_value(lower) as lower, any_value(upper) as upper, sum(g) as G, sum(h) as H, count(*) as C,
         greatest(least(-sum(g) / (sum(h) + 1), any_value(upper)), any_value(lower)) as w
  from x{t}_{depth} join bounds{t} using (k, node) where used group by k, node),
node{t} as (
  select k, node, feature, dl, loss_chg, wp as w, Ct as C, lower, upper from split{t} join bounds{t} using (k, node)
  union all select k, node, null, null, null, w, C, lower, upper from leaf{t}),
r{t} as materialized (
  select x.row_key, x.fold, x.y, x.k, x.bs, x.kh, x.m + {lr} * w as m from x{t}_{depth} x join leaf{t} using (k, node))
"""
    return sql


def _nodes_sql(features: list[str], rounds: int) -> str:
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    return " union all ".join(
        f"select {t - 1} as tree_id, cast(node as integer) as node_id, {names}[feature + 1] as feature, dl as default_left, "
        f"round(loss_chg, 2) as gain, round(w, 6) as weight, cast(C as bigint) as n_rows, "
        f"case when isfinite(lower) then round(lower, 6) end as lower, case when isfinite(upper) then round(upper, 6) end as upper "
        f"from node{t} where k = 6" for t in range(1, rounds + 1))


def _nodes(spark, model, spec) -> DataFrame:
    inner = [F.when(F.abs(F.col(c)) < float("inf"), F.round(c, 6)).alias(c) for c in ("lower", "upper")]
    return model_table(spark, {"final": model.trees}, spec).select(
        "tree_id", "node_id", "feature", "default_left", F.round("gain", 2).alias("gain"), F.round("weight", 6).alias("weight"),
        "n_rows", *inner)


def _params(objective: str = "reg:squarederror", rows: float = 1.0, columns: float = 1.0, rounds: int = 2) -> BoostParams:
    return BoostParams(objective=objective, learning_rate=LR, max_trees=rounds, subsample=rows, colsample_bytree=columns,
                       max_bins=SQL_BINS)


def _fit(df: DataFrame, label: str, features: list[str], params: BoostParams, dirs: dict | None = None, depth: int = DEPTH):
    m = ModelSpec("final", "final", 6, depth, dirs or {}, early_stop=False, n_trees=params.max_trees)
    return Trainer(df, "row_key", "fold", label, features, [m], params).run()


_UP = {"quantity": 1, "tax": 1, "discount": 1}


def bounded_model(spark, sf_dir):
    """Two trees of depth 3 on a target that the features hardly explain, three features constrained: bounds cut weights."""
    return _fit(_noise(spark, sf_dir), "target", NOISE, _params(), _UP)


@register("m9_bounded_trees", trees_sql("noise", "target", NOISE, DEPTH, 2, _UP) + _nodes_sql(NOISE, 2))
def q_bounded(spark, sf_dir):
    res = bounded_model(spark, sf_dir)
    return _nodes(spark, res.models[0], res.features)


_DIRS = {"price": 1, "discount": -1, "tax": 1}


@register("m11_deep_trees", trees_sql("charge", "charge", CHARGE, DEPTH, 2, _DIRS, "reg:gamma") + _nodes_sql(CHARGE, 2))
def q_deep(spark, sf_dir):
    """Gamma objective, three constrained features."""
    res = _fit(_folded(spark, sf_dir), "charge", CHARGE, _params("reg:gamma"), _DIRS)
    return _nodes(spark, res.models[0], res.features)


@register("m12_sampled_trees", trees_sql("charge", "charge", CHARGE, DEPTH, 3, objective="reg:gamma", rows=0.8, columns=0.8)
          + _nodes_sql(CHARGE, 3))
def q_sampled(spark, sf_dir):
    """Rows and columns sampled at 0.8 for each of three trees."""
    res = _fit(_folded(spark, sf_dir), "charge", CHARGE, _params("reg:gamma", 0.8, 0.8, 3))
    return _nodes(spark, res.models[0], res.features)


@register("m13_sampled_predict", trees_sql("charge", "charge", CHARGE, 2, 2, objective="count:poisson", rows=0.8, columns=0.8)
          + "select row_key, round(exp(m), 4) as prediction from r2 where fold = 6")
def q_sampled_predict(spark, sf_dir):
    """Predictions of a Poisson model on sampled rows and columns."""
    from ..operators.boost.score import predict

    p = _params("count:poisson", 0.8, 0.8)
    res = _fit(_folded(spark, sf_dir), "charge", CHARGE, p, depth=2)
    m = res.models[0]
    test = _folded(spark, sf_dir).where("fold = 6")
    out = predict(test, res.features, m.trees, m.base_margin, p.objective, ["row_key"])
    return out.select("row_key", F.round("prediction", 4).alias("prediction"))


# ---------------------------------------------------------------- the routine cross-validation and warm-up fit
def _curve_sql(rounds: int) -> str:
    return ", curve as (" + " union all ".join(
        f"select k, {t} as t, avg((m - y) * (m - y)) as loss, avg(abs(y - m) / greatest(abs(y), {MAPE_EPS!r})) as mape "
        f"from r{t} where fold = k group by k" for t in range(1, rounds + 1)) + ")\n"


_TREES, _PATIENCE, _RATE = ROUTINE["max_trees"], ROUTINE["early_stopping_rounds"], ROUTINE["learning_rate"]
_DEFAULTS = BoostParams()
_ROUTINE_SQL = dict(rows=_DEFAULTS.subsample, columns=_DEFAULTS.colsample_bytree, lr=_RATE, bins=_DEFAULTS.max_bins)


@register("m2_cross_validate", trees_sql("charge", "charge", ALL_FEATURES, 3, _TREES, models="1, 2, 3, 4, 5, 6", **_ROUTINE_SQL)
          + _curve_sql(_TREES) + f"""
, best as (select a.k, a.t, arg_min(b.t, (b.loss, b.t)) as best from curve a join curve b on a.k = b.k and b.t <= a.t
           where a.k <= 5 group by a.k, a.t),
stop as (select k, coalesce(min(t) filter (where t - best >= {_PATIENCE}), max(t)) as t from best group by k)
select cast(k as integer) as fold, best as n_trees, round(curve.mape, 9) as mape
from stop join best using (k, t) join curve on curve.k = stop.k and curve.t = best.best""")
def q_m2(spark, sf_dir):
    """Five fold models of depth 3 with the default sampling and bins, each stopped by its own fold."""
    p = BoostParams(objective="reg:squarederror", **ROUTINE)
    res = study.cross_validate(_folded(spark, sf_dir), "row_key", "charge", ALL_FEATURES, 3, p)
    g = res.groups["cv"]
    rows = [(k + 1, int(t), round(float(m), 9)) for k, (t, m) in enumerate(zip(g["cv_trees"], g["cv_mapes"]))]
    return spark.createDataFrame(rows, "fold int, n_trees int, mape double")


@register("m18_warmup_fit", trees_sql("charge", "charge", ALL_FEATURES, 3, _TREES, CONSTRAINTS, masked=tuple(CONSTRAINTS), mask_trees=3,
                                      **_ROUTINE_SQL) + _curve_sql(_TREES) + "select t as n_trees, round(mape, 9) as test_mape from curve")
def q_m18(spark, sf_dir):
    p = BoostParams(objective="reg:squarederror", **ROUTINE)
    res = study.fit_final(_folded(spark, sf_dir), "row_key", "charge", ALL_FEATURES, 3, _TREES, p,
                          CONSTRAINTS, masked=list(CONSTRAINTS), mask_trees=3)
    m = res.models[0]
    rows = [(c, round(float(v[1] / v[2]), 9)) for c, v in sorted(m.curve.items()) if v[2]]
    return spark.createDataFrame(rows, "n_trees int, test_mape double")


# ---------------------------------------------------------------- partial dependence behind a log link
_GRID = 12


def _routed_sql(rounds: int, depth: int) -> str:
    """CTE at0..: test rows at each grid value of the first feature, routed through every tree again."""
    sql = f""", span as (select min(price) as lo, max(price) as hi from _folded where fold = 6),
grid as (select i as grid_ix, lo + i * (hi - lo) / {_GRID - 1} as v from span, range(0, {_GRID}) g(i)),
gb as (select grid_ix, v, {_bin_sql('price', 'v')} as bin from grid),
at0 as materialized (select row_key, grid_ix, v, k, list_concat([bin], bs[2:]) as bs, m from r0, gb where fold = 6)
"""
    for t in range(1, rounds + 1):
        sql += f", y{t}_0 as (select *, 0 as node from at{t - 1})\n"
        for d in range(depth):
            sql += f""", y{t}_{d + 1} as materialized (
  select x.* exclude (node), case when b.node is null then x.node when {_left('x.bs[b.feature + 1]')} then 2 * x.node + 1
                                  else 2 * x.node + 2 end as node
  from y{t}_{d} x left join best{t}_{d} b on x.k = b.k and x.node = b.node)
"""
        sql += (f", at{t} as materialized (select x.row_key, x.grid_ix, x.v, x.k, x.bs, x.m + {LR} * w as m "
                f"from y{t}_{depth} x join leaf{t} using (k, node))\n")
    return sql


@register("m23_deep_pdp", trees_sql("charge", "charge", CHARGE, DEPTH, 2, _DIRS, "reg:gamma") + _routed_sql(2, DEPTH) + """
select cast(grid_ix as integer) as grid_ix, round(any_value(v), 6) as grid_value, round(avg(exp(m)), 4) as pdp from at2 group by grid_ix""")
def q_deep_pdp(spark, sf_dir):
    res = _fit(_folded(spark, sf_dir), "charge", CHARGE, _params("reg:gamma"), _DIRS)
    m, test = res.models[0], _folded(spark, sf_dir).where("fold = 6")
    lo, hi = explain.min_max(test, "price")
    grid = [lo + i * (hi - lo) / (_GRID - 1) for i in range(_GRID)]
    out = explain.partial_dependence(test, res.features, m.trees, m.base_margin, "reg:gamma", "price", grid)
    return out.select("grid_ix", F.round("grid_value", 6).alias("grid_value"), F.round("pdp", 4).alias("pdp"))


@register("m23_bounded_pdp", trees_sql("noise", "target", NOISE, DEPTH, 2, _UP) + _routed_sql(2, DEPTH).replace("price", "discount") + """
select cast(grid_ix as integer) as grid_ix, round(any_value(v), 6) as grid_value, round(avg(m), 4) as pdp from at2 group by grid_ix""")
def q_bounded_pdp(spark, sf_dir):
    """Without a link: from the rows that can reach each leaf."""
    res = bounded_model(spark, sf_dir)
    m, test = res.models[0], _noise(spark, sf_dir).where("fold = 6")
    lo, hi = explain.min_max(test, "discount")
    grid = [lo + i * (hi - lo) / (_GRID - 1) for i in range(_GRID)]
    out = explain.partial_dependence(test, res.features, m.trees, m.base_margin, "reg:squarederror", "discount", grid)
    return out.select("grid_ix", F.round("grid_value", 6).alias("grid_value"), F.round("pdp", 4).alias("pdp"))
