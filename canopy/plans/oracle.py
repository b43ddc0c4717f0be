"""DuckDB SQL text for the oracle side of the registered queries.

Helpers here only build SQL strings; nothing runs.  Each string reads the
pre-registered views (lineitem, part, orders, ...).
"""

from __future__ import annotations

from ..sources.tables import fixture_sql
from ..operators.folds import fold_sql


def quantile_stratum_sql(source: str, y: str, n_folds: int = 6) -> tuple[str, str]:
    """(cte text, stratum expression) for the numeric-target strata in DuckDB.

    Mirrors ``stratum_column``: bin count from the non-NULL count, exact
    percentiles, distinct sorted edges, digitize by the interior edges, or the
    above-median flag when two or fewer distinct edges remain.
    """
    lists = ", ".join(
        f"{nb}: quantile_cont({y}, [{', '.join(repr(i / nb) for i in range(nb + 1))}])"
        for nb in range(3, 11))
    cte = f"""
_n as (select count({y}) as n from ({source}) s0),
_nb as (select greatest(3, least(10, n // {2 * n_folds})) as nb from _n),
_ql as (select map {{{lists}}} as m, median({y}) as med from ({source}) s1),
_q as (select list_sort(list_distinct(m[(select nb from _nb)])) as e, med from _ql)"""
    stratum = (f"coalesce(case when len((select e from _q)) <= 2 "
               f"then cast({y} > (select med from _q) as integer) "
               f"else cast(len(list_filter((select e from _q)[2:len((select e from _q)) - 1], "
               f"lambda x: x <= {y})) as integer) end, -1)")
    return cte, stratum


def charge_folds_sql(n_folds: int = 6, seed: int = 42, cols: str = ", charge", fixture: str = "charge",
                     y: str = "charge") -> str:
    """Folds on the L1 fixture (or another one) stratified by the quantiles of its target."""
    src = fixture_sql(fixture)
    cte, stratum = quantile_stratum_sql(src, y, n_folds)
    body = fold_sql(f"select *, {stratum} as _strat from ({src}) s2", "row_key", "_strat",
                    n_folds, seed, extra_cols=cols)
    return "with " + cte.strip() + ",\n_folded as (" + body + ")\n"


MIN_SLICE_SQL = charge_folds_sql() + """
, med as (
  select k, median(charge) as median_pred
  from _folded, (select unnest(range(1, 6)) as k) ks
  where fold <> 6 and fold <> k
  group by k),
per_fold as (
  select f.fold as k, count(*) as n_val, any_value(m.median_pred) as median_pred,
         avg(abs(f.charge - m.median_pred) / greatest(abs(f.charge), 2.220446049250313e-16)) as mape
  from _folded f join med m on f.fold = m.k
  group by f.fold)
select cast(k as integer) as fold, n_val, round(median_pred, 6) as median_pred,
       round(mape, 9) as mape, round(avg(mape) over (), 9) as cv_mape
from per_fold
"""
