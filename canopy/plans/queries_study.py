"""Registered queries: the grid search and the run over several datasets, under SQL (M19, M21, M22, P11, W1, U1, K4), and the
operators that feed them: config scan (S3), warm-up sizes (F15), preparing all datasets (D5).

The grid is that of the original with one depth: baseline, monotonic, and four warm-up fractions at the best monotonic
depth.  The SQL side trains every configuration's six models as unrolled stumps, for each warm-up size that the
fractions can ask for, and picks rounds, sizes and winners by the same rules.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import warmup_trees
from ..operators import select
from ..operators.boost.fit import BoostParams
from ..operators.boost.score import predict
from ..session import scratch_path
from ..sources import tables
from ..sources.sinks import format_2dp, write_processed, write_results
from ..sources.text import read_config, read_processed, read_results
from . import datasets, registry, study
from .queries_boost import _folded, _noise
from .queries_stumps import CHARGE, NOISE, PARAMS, _curve_sql, stumps_sql
from .registry import register

ROUNDS, FRACTIONS = 10, [0.5, 0.6, 0.7, 0.8]
GRID: BoostParams = replace(PARAMS, max_trees=ROUNDS)
SIZES = sorted({study.phase1_trees(n, f) for n in range(1, ROUNDS + 1) for f in FRACTIONS})


def _config_sql(fixture: str, y: str, features: list[str], dirs: dict, warm: int = 0) -> str:
    """(cv_mape, test_mape, n_trees) of one configuration: best eligible round per fold, the median of those for the final model."""
    return stumps_sql(fixture, y, features, dirs, tuple(dirs) if warm else (), warm, "1, 2, 3, 4, 5, 6", ROUNDS) + _curve_sql(ROUNDS) + f"""
, kept as (select k, t, mape from curve where k <= 5 and t > {warm} qualify row_number() over (partition by k order by loss, t) = 1),
total as (select cast(floor(median(t)) as integer) as n_trees, avg(mape) as cv_mape from kept)
select cv_mape, curve.mape as test_mape, n_trees from total join curve on curve.k = 6 and curve.t = total.n_trees"""


def grid_sql(dataset: str, fixture: str, y: str, features: list[str], dirs: dict) -> str:
    """The result rows of one dataset's grid search, as a subquery."""
    made = ", ".join(
        [f"base as ({_config_sql(fixture, y, features, {})})", f"mono as ({_config_sql(fixture, y, features, dirs)})"]
        + [f"warm{w} as ({_config_sql(fixture, y, features, dirs, w)})" for w in SIZES])
    warm = " union all ".join(f"select {w} as p1, * from warm{w}" for w in SIZES)
    asked = ", ".join(f"({i}, {f}::double)" for i, f in enumerate(FRACTIONS))
    return f"""(with {made}, warm as ({warm}),
asked as (select i, pct, greatest({study.MIN_PHASE1_TREES}, cast(floor(n_trees * pct) as integer)) as p1
          from mono, (values {asked}) v(i, pct)),
res as (
  select 'baseline' as approach, cv_mape, test_mape, n_trees, null::integer as num_trees_phase1, null::double as phase1_pct,
         0 as run_ix from base
  union all select 'monotonic', cv_mape, test_mape, n_trees, null, null, 1 from mono
  union all select 'progressive', cv_mape, test_mape, n_trees, p1, pct, 2 + i from asked join warm using (p1))
select '{dataset}' as dataset, approach, 1 as max_depth, round(cv_mape, 9) as cv_mape, round(test_mape, 9) as test_mape, n_trees,
       num_trees_phase1, phase1_pct,
       row_number() over (partition by approach order by cv_mape, run_ix) = 1 as chosen, run_ix from res)"""


def _rounded(results: DataFrame) -> DataFrame:
    return results.withColumns({c: F.round(c, 9) for c in ("cv_mape", "test_mape")})


_NOISE_GRID = grid_sql("noise", "noise", "target", NOISE, {"quantity": 1})


@register("m21_stump_grid", f"select * from {_NOISE_GRID}")
def q_grid(spark, sf_dir):
    """M21 with M19 and W1: six configurations of six models each, ten rounds."""
    st = study.run_grid_search(_noise(spark, sf_dir), "row_key", "target", "noise", {"quantity": 1}, [1], GRID,
                               features=NOISE, phase1_pcts=FRACTIONS)
    return _rounded(st.results)


@register("m22_stump_run_all", f"""
with rows as (select * from {_NOISE_GRID} union all select * from {grid_sql("charge", "charge", "charge", CHARGE, {"price": 1})}),
status as (select * from (values ('noise', 'ok'), ('broken', 'failed'), ('charge', 'ok')) v(dataset, status))
select * from (select * from rows where chosen) r full outer join status using (dataset)""")
def q_run_all(spark, sf_dir):
    """M22 over two datasets and one that fails: rows of this run only, although the broken dataset has rows of an earlier one."""
    path = scratch_path(spark, "study")
    earlier = spark.createDataFrame([("broken", "baseline", 1, 0.1, 0.1, 1, None, None, True, 0)], select.RESULT_SCHEMA)
    study.write_results(earlier, f"{path}/results")
    config = spark.createDataFrame(
        [("noise", "target", {"quantity": 1}, "reg:squarederror", 0.5), ("broken", "charge", {}, "no:such", 0.5),
         ("charge", "charge", {"price": 1}, "reg:squarederror", 0.5)],
        "dataset string, target string, monotonic map<string,int>, objective string, lr double").coalesce(1)

    def load(name):
        if name == "noise":
            return _noise(spark, sf_dir), "row_key"
        return _folded(spark, sf_dir).select("row_key", "fold", "charge", *CHARGE), "row_key"

    status, summary = study.run_all(
        spark, config, load, [1], lambda c: replace(GRID, objective=c["objective"], learning_rate=c["lr"]), path, FRACTIONS)
    return _rounded(summary).join(status.drop("error"), "dataset", "full_outer")


# ---------------------------------------------------------------- reports of one saved run
_RUNS: dict = {}


def saved_run(spark, sf_dir) -> str:
    """Where the noise grid's run was saved: results, winners' importances and model table.  The first report of a
    session trains it; all of them read what was written."""
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _RUNS:
        path = scratch_path(spark, "run")
        st = study.run_grid_search(_noise(spark, sf_dir), "row_key", "target", "noise", {"quantity": 1}, [1], GRID,
                                   features=NOISE, phase1_pcts=FRACTIONS)
        batch, winner = st.winners["monotonic"]
        predict(_noise(spark, sf_dir).where("fold = 6"), batch.features, winner.trees, winner.base_margin, GRID.objective,
                ["row_key", "target"]).write.parquet(f"{path}/predictions")
        study.importance_table(spark, st).write.parquet(f"{path}/importance")
        write_results(st.results, f"{path}/results")
        _RUNS[k] = path
    return _RUNS[k]


def _results(spark, sf_dir, datasets: list[str] | None = None) -> DataFrame:
    return _rounded(read_results(spark, f"{saved_run(spark, sf_dir)}/results", datasets))


@register("s4_results_readback", f"select * from {_NOISE_GRID}")
def q_s4(spark, sf_dir):
    """K2 + S4: grid results committed, read back with a dataset filter (partition pruning)."""
    return _results(spark, sf_dir, ["noise", "absent_dataset"])


@register("w1_chosen", f"select * from {_NOISE_GRID} where chosen")
def q_w1(spark, sf_dir):
    return select.chosen(_results(spark, sf_dir))


@register("w2_best_monotonic", f"select * from {_NOISE_GRID} where approach = 'monotonic' and chosen")
def q_w2(spark, sf_dir):
    return select.best_of(_results(spark, sf_dir), "monotonic")


@register("w5_deltas", f"""with ch as (select * from {_NOISE_GRID} where chosen),
d as (select a.dataset, a.approach, a.test_mape, a.test_mape - b.test_mape as delta, 100.0 * (a.test_mape - b.test_mape) / b.test_mape as delta_pct
      from ch a join ch b on a.dataset = b.dataset and b.approach = 'baseline' where a.approach <> 'baseline')
select dataset, approach, test_mape, round(delta, 8) as delta, round(delta_pct, 5) as delta_pct, printf('%+.1f', delta_pct) || '%' as delta_text from d""")
def q_w5(spark, sf_dir):
    return select.deltas(_results(spark, sf_dir)).withColumns({"delta": F.round("delta", 8), "delta_pct": F.round("delta_pct", 5)})


def _kept_sql(dirs: dict, warm: int, tail: str) -> str:
    """``tail`` over the final model's rounds up to its number of trees."""
    head, _, _ = _config_sql("noise", "target", NOISE, dirs, warm).rpartition("select cv_mape")
    return f"{head} {tail}"


def _gains_sql(dirs: dict, warm: int = 0) -> str:
    return _kept_sql(dirs, warm, ", gains as (" + " union all ".join(
        f"select {t} as t, feature, loss_chg from best{t} where k = 6" for t in range(1, ROUNDS + 1)) +
        ") select feature, loss_chg from gains, total where t <= n_trees")


_SHARES = f"""with {', '.join([f"base_g as ({_gains_sql({})})", f"mono_g as ({_gains_sql({'quantity': 1})})"]
    + [f"warm{w}_g as ({_gains_sql({'quantity': 1}, w)})" for w in SIZES])},
winner as (select num_trees_phase1 as p1 from {_NOISE_GRID} where chosen and approach = 'progressive'),
raw as (select 'baseline' as approach, * from base_g union all select 'monotonic', * from mono_g
        {' '.join(f"union all select 'progressive', g.* from warm{w}_g g, winner where p1 = {w}" for w in SIZES)}),
names as (select unnest({NOISE!r}) as feature, unnest(range(0, {len(NOISE)})) as ix),
mean as (select a.approach, names.feature, coalesce(avg(loss_chg), 0) as gain
         from (values ('baseline'), ('monotonic'), ('progressive')) a(approach), names left join raw on raw.approach = a.approach and raw.feature = ix
         group by all),
shares as (select approach, feature, 100 * gain / sum(gain) over (partition by approach) as pct from mean),
wide as (select feature, {', '.join(f"max(pct) filter (where approach = '{a}') as {a}" for a in select.APPROACHES)} from shares group by feature)
"""


def _importance(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{saved_run(spark, sf_dir)}/importance")


@register("m25_gain_importance", _SHARES + "select approach, feature, round(pct, 5) as pct from shares")
def q_m25(spark, sf_dir):
    return _importance(spark, sf_dir).withColumn("pct", F.round("pct", 5))


@register("j7_importance_pivot", _SHARES + "select feature, " + ", ".join(f"round({a}, 5) as {a}" for a in select.APPROACHES) + " from wide")
def q_j7(spark, sf_dir):
    return select.pivot_importance(_importance(spark, sf_dir)).withColumns({a: F.round(a, 5) for a in select.APPROACHES})


@register("k3_importance_2dp", _SHARES + "select feature, " + ", ".join(f"printf('%.2f', {a}) as {a}" for a in select.APPROACHES) + " from wide")
def q_k3(spark, sf_dir):
    return format_2dp(select.pivot_importance(_importance(spark, sf_dir)), list(select.APPROACHES))


@register("m20_predict", _kept_sql({"quantity": 1}, 0, ", scored as (" + " union all ".join(
    f"select {t} as t, row_key, y, m from r{t} where k = 6 and fold = 6" for t in range(1, ROUNDS + 1)) +
    ") select row_key, y as target, round(m, 4) as prediction from scored, total where t = n_trees"))
def q_m20(spark, sf_dir):
    """The monotonic winner's predictions of the test rows."""
    return spark.read.parquet(f"{saved_run(spark, sf_dir)}/predictions").withColumn("prediction", F.round("prediction", 4))


# ---------------------------------------------------------------- what feeds the study
_WARMUP = "select o_orderkey, cast(o_totalprice / 1000 as integer) as n_trees, (o_orderkey % 8 + 1) * 0.025::double as pct from orders"


@register("f15_warmup_size", f"select o_orderkey, greatest(5, cast(floor(n_trees * pct) as integer)) as size from "
          f"({_WARMUP.replace('cast(o_totalprice / 1000 as integer)', 'cast(floor(o_totalprice / 1000) as integer)')}) x")
def q_warmup_size(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("int").alias("n_trees"),
        ((F.col("o_orderkey") % 8 + 1) * F.lit(0.025)).alias("pct"))
    return rows.select("o_orderkey", warmup_trees("n_trees", "pct").alias("size"))


_CONFIG = """select 'data/' || c_mktsegment || '/' || c_custkey || '.csv' as dataset, 'bal' as target,
  case c_custkey % 4 when 0 then null when 1 then 'a:1; b:-1' when 2 then ' a ;;x:y:+1' else 'a:1;a:-1' end as monotonic,
  case when c_custkey % 3 > 0 then 'reg:gamma' end as objective, case c_custkey % 5 when 0 then null when 1 then 'n/a' else '0.02' end as lr
from customer"""


@register("s3_config_scan", f"""select dataset, target, coalesce(objective, 'count:poisson') as objective,
  coalesce(try_cast(lr as double), 0.1::double) as lr, regexp_extract(dataset, '([^/]+)[.]csv$', 1) as name,
  case when monotonic is null then '' when monotonic = 'a:1; b:-1' then 'a=1,b=-1' when monotonic = 'a:1;a:-1' then 'a=-1'
       else 'a=1,x:y=1' end as monotonic from ({_CONFIG}) c""")
def q_config(spark, sf_dir):
    """S3: a config file with gaps, a row per customer, written and scanned with its defaults."""
    spark_sql = _CONFIG.replace("from customer", "from {customer}")
    path = scratch_path(spark, "config")
    spark.sql(spark_sql, customer=tables.read(spark, sf_dir, "customer")).write.option("header", True).csv(path)
    pairs = F.array_sort(F.transform(F.map_entries("monotonic"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return read_config(spark, path).select("dataset", "target", "objective", "lr", "name",
                                           F.array_join(pairs, ",").alias("monotonic"))


_PREPARED = {"simple": "d1_simple_prepare", "auto_mpg": "d2_auto_mpg_prepare", "ames": "d3_ames_prepare",
             "california": "d4_california_prepare"}


def _prepared_sql() -> str:
    from . import queries_clean  # noqa: F401 - registers the preparations

    parts = [f"select '{name}' as dataset, fold, count(*) as n from ({registry._SQL[q]}) x group by fold" for name, q in _PREPARED.items()]
    return " union all ".join(parts) + " union all select 'missing', null, 0"


@register("d5_prepare_all", _prepared_sql())
def q_prepare_all(spark, sf_dir):
    """Every dataset prepared and written, one that can't be loaded recorded; rows per fold as loaded again."""
    path = scratch_path(spark, "datasets")

    def loader(query):
        return lambda: registry._QUERIES[query](spark, sf_dir)

    status = datasets.prepare_all(
        {**{name: loader(q) for name, q in _PREPARED.items()}, "missing": lambda: tables.read(spark, sf_dir, "no_such_table")},
        lambda name, df: write_processed(df, f"{path}/{name}"))
    parts = [read_processed(spark, f"{path}/{name}").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("dataset"), "fold", "n") for name, state, _ in status if state == "ok"]
    failed = spark.createDataFrame([(name, None, 0) for name, state, _ in status if state != "ok"], "dataset string, fold int, n long")
    return select.union_all([*parts, failed])
