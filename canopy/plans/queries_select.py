"""Registered queries: the selection and reporting operators (W1, W2, W5, P9,
P10, U1, J7, K2-S4, K3, F19) over result rows computed from lineitem,
and the processed table written and loaded again (K1, D6), with DuckDB SQL.

The configurations are scaled-mean predictors: per return flag (the "dataset")
the training rows' mean charge times a factor, scored per fold by MAPE.  Their
result rows have the grid search's schema, so the operators run as they do
behind a real study, but plain SQL can compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MAPE_EPS
from ..functions.scalar import fold_label
from ..operators import select
from ..session import scratch_path
from ..sources.sinks import ROWS, format_2dp, write_processed, write_results
from ..sources.text import read_processed, read_results
from .oracle import charge_folds_sql
from .queries_boost import _folded
from .registry import register

#: (approach, depth, factor of the mean) of each configuration, in run order.
CONFIGS = [("baseline", 1, 0.5), ("baseline", 2, 0.7), ("baseline", 3, 0.9),
           ("monotonic", 1, 0.45), ("monotonic", 2, 0.65), ("monotonic", 3, 0.85),
           ("progressive", 1, 0.4), ("progressive", 2, 0.6), ("progressive", 3, 0.8)]


def mean_predictor_results(spark, sf_dir) -> DataFrame:
    """One result row per (return flag, configuration).  Rows fan out to the nine
    configurations inside the task; the sums per fold are combined before the shuffle."""
    rows = _folded(spark, sf_dir).select("returnflag", "fold", "charge")
    mean = rows.where("fold <> 6").groupBy("returnflag").agg(F.avg("charge").alias("_mu"))
    configs = F.array(*[F.struct(F.lit(a).alias("approach"), F.lit(d).alias("max_depth"),
                                 F.lit(f).alias("factor"), F.lit(i).alias("run_ix"))
                        for i, (a, d, f) in enumerate(CONFIGS)])
    scored = rows.join(mean, "returnflag").select("*", F.explode(configs).alias("c"))
    err = F.abs(F.col("charge") - F.col("c.factor") * F.col("_mu")) / F.greatest(
        F.abs("charge"), F.lit(MAPE_EPS))
    folds = scored.groupBy("returnflag", "fold", "c").agg(F.avg(err).alias("mape"), F.count(F.lit(1)).alias("n"))
    test = F.col("fold") == 6
    out = folds.groupBy("returnflag", "c").agg(
        F.avg(F.when(~test, F.col("mape"))).alias("cv"), F.max(F.when(test, F.col("mape"))).alias("test"),
        F.max(F.when(test, F.col("n"))).alias("n"))
    late = F.col("c.approach") == "progressive"
    return out.select(
        F.col("returnflag").alias("dataset"), F.col("c.approach").alias("approach"),
        F.col("c.max_depth").alias("max_depth"), F.round("cv", 9).alias("cv_mape"),
        F.round("test", 9).alias("test_mape"), F.col("n").cast("int").alias("n_trees"),
        F.when(late, F.col("c.max_depth") * 5).alias("num_trees_phase1"),
        F.when(late, F.col("c.factor") / 4).alias("phase1_pct"),
        F.lit(False).alias("chosen"), F.col("c.run_ix").alias("run_ix"))


_VALUES = ", ".join(f"('{a}', {d}, {f}::double, {i})" for i, (a, d, f) in enumerate(CONFIGS))
_RESULTS = charge_folds_sql(cols=", charge, returnflag") + f"""
, mu as (select returnflag, avg(charge) as mu from _folded where fold <> 6 group by 1),
per_fold as (
  select f.returnflag as dataset, f.fold, approach, max_depth, factor, run_ix, count(*) as n,
         avg(abs(charge - factor * mu) / greatest(abs(charge), {MAPE_EPS!r})) as mape
  from _folded f join mu using (returnflag), (values {_VALUES}) c(approach, max_depth, factor, run_ix)
  group by all),
res as (
  select dataset, approach, max_depth, round(avg(mape) filter (where fold <> 6), 9) as cv_mape,
         round(max(mape) filter (where fold = 6), 9) as test_mape,
         cast(max(n) filter (where fold = 6) as integer) as n_trees,
         case when approach = 'progressive' then max_depth * 5 end as num_trees_phase1,
         case when approach = 'progressive' then factor / 4 end as phase1_pct, run_ix
  from per_fold group by dataset, approach, max_depth, factor, run_ix),
best as (
  select dataset, approach, max_depth, cv_mape, test_mape, n_trees, num_trees_phase1, phase1_pct,
         row_number() over (partition by dataset, approach order by cv_mape nulls last, run_ix) = 1 as chosen, run_ix
  from res)
"""


@register("w1_choose_best", _RESULTS + "select * from best")
def q_choose(spark, sf_dir):
    return select.choose_best(mean_predictor_results(spark, sf_dir))


@register("p9_chosen_rows", _RESULTS + "select * from best where chosen")
def q_chosen(spark, sf_dir):
    return select.chosen(select.choose_best(mean_predictor_results(spark, sf_dir)))


@register("p10_of_approach", _RESULTS + "select * from best where approach = 'progressive'")
def q_of_approach(spark, sf_dir):
    return select.of_approach(select.choose_best(mean_predictor_results(spark, sf_dir)), "progressive")


@register("w2_best_of_approach", _RESULTS + "select *, false as chosen from (select * exclude (chosen) from best "
          "where approach = 'monotonic' and chosen)")
def q_best_of(spark, sf_dir):
    return select.best_of(mean_predictor_results(spark, sf_dir), "monotonic")


@register("w5_test_deltas", _RESULTS + """
, ch as (select dataset, approach, test_mape from best where chosen),
d as (select a.dataset, a.approach, a.test_mape, a.test_mape - b.test_mape as delta,
             100.0 * (a.test_mape - b.test_mape) / b.test_mape as delta_pct
      from ch a join ch b on a.dataset = b.dataset and b.approach = 'baseline' where a.approach <> 'baseline')
select *, printf('%+.1f', delta_pct) || '%' as delta_text from d""")
def q_deltas(spark, sf_dir):
    return select.deltas(select.choose_best(mean_predictor_results(spark, sf_dir)))


@register("u1_stacked_results", _RESULTS + "select * from best where approach <> 'monotonic'")
def q_union(spark, sf_dir):
    best = select.choose_best(mean_predictor_results(spark, sf_dir))
    return select.union_all([select.of_approach(best, a) for a in ("baseline", "progressive")])


_SHARES = """
, shares as (select approach, dataset as feature, 100 * test_mape / sum(test_mape) over (partition by approach) as pct
             from best where chosen and not (approach = 'progressive' and dataset = 'N')),
wide as (select feature, """ + ", ".join(
    f"coalesce(max(pct) filter (where approach = '{a}'), 0) as {a}" for a in select.APPROACHES) + """
         from shares group by feature)
"""


def _wide(spark, sf_dir) -> DataFrame:
    """Each flag's share of the chosen test errors, per approach; one pair is left out, so that the pivot has a gap."""
    ch = select.chosen(select.choose_best(mean_predictor_results(spark, sf_dir)))
    ch = ch.where("not (approach = 'progressive' and dataset = 'N')")
    total = ch.groupBy("approach").agg(F.sum("test_mape").alias("_total"))
    long = ch.join(total, "approach").select(
        "approach", F.col("dataset").alias("feature"), (F.lit(100) * F.col("test_mape") / F.col("_total")).alias("pct"))
    return select.pivot_importance(long)


@register("j7_share_pivot", _RESULTS + _SHARES + "select * from wide order by baseline desc, feature")
def q_pivot(spark, sf_dir):
    return _wide(spark, sf_dir)


@register("k3_share_2dp", _RESULTS + _SHARES + "select feature, " + ", ".join(
    f"printf('%.2f', {a}::double) as {a}" for a in select.APPROACHES) + " from wide")
def q_2dp(spark, sf_dir):
    return format_2dp(_wide(spark, sf_dir), list(select.APPROACHES))


@register("k2_results_readback", _RESULTS + "select * from best where dataset = 'R'")
def q_readback(spark, sf_dir):
    """K2 + S4: committed by one run, one dataset committed again by a later run, rows of a third that never were;
    read back with a dataset filter."""
    best = select.choose_best(mean_predictor_results(spark, sf_dir))
    path = scratch_path(spark, "results")
    write_results(best.withColumn("cv_mape", F.lit(0.0)), path)
    write_results(best.where("dataset = 'R'"), path)      # the later run of that dataset
    (best.withColumn("run", F.lit("z")).withColumn("version", F.lit("z"))
     .write.mode("append").partitionBy("dataset", "run", "version").parquet(f"{path}/{ROWS}"))
    return read_results(spark, path, ["R", "absent"])


@register("d6_load_processed", charge_folds_sql(cols=", charge, price, quantity, returnflag") + """
select fold, count(*) as n, round(sum(charge), 2) as charge, round(avg(price), 6) as price, count(quantity) as n_quantity
from _folded group by fold""")
def q_load_processed(spark, sf_dir):
    """K1 + D6: the table written with the fold labels of the original (1..5 and
    'test') and loaded again with numbers."""
    rows = _folded(spark, sf_dir).select("charge", "price", "quantity", "returnflag", "fold")
    path = scratch_path(spark, "processed")
    write_processed(rows.withColumn("fold", fold_label("fold", 6)), path)
    return read_processed(spark, path).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("charge"), 2).alias("charge"),
        F.round(F.avg("price"), 6).alias("price"), F.count("quantity").alias("n_quantity"))
