"""Plan checks: filters and column pruning reach the parquet scan."""

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_filter_is_pushed_and_columns_pruned(spark):
    plan = _plan(E.queries()["p5_range_filter"](spark, SF_SMALL))
    assert "LessThanOrEqual(o_totalprice,400000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_fixture_scan_reads_only_used_columns(spark):
    plan = _plan(E.queries()["f3_ratio_pct"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in plan \
        or "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
