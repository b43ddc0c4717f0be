"""Test tables and the derived training fixtures.

The fixtures are plain projections of the given tables, so every query built
on them scans whole tables and its work grows with them.  Each fixture has a
stable row key: Spark has no row order, so "first" means smallest key and
"random" means a hash of (seed, key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixture SQL, shared verbatim by the Spark side (selectExpr over the scan) and
# the DuckDB oracle (as a CTE).  Both engines accept these expressions.
CHARGE_COLS = [
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string), "
    "cast(cast(round(l_extendedprice*100) as bigint) as string)) as row_key",
    "l_extendedprice*(1-l_discount)*(1+l_tax) as charge",
    "l_extendedprice as price",
    "l_discount as discount",
    "l_tax as tax",
    "nullif(l_quantity, 13) as quantity",
    "l_returnflag as returnflag",
    "l_linestatus as linestatus",
]

NOISE_COLS = [
    CHARGE_COLS[0],
    "l_extendedprice as target",
    "l_discount as discount",
    "l_tax as tax",
    "nullif(l_quantity, 13) as quantity",
    "l_returnflag as returnflag",
    "l_linestatus as linestatus",
]

MESSY_PART_COLS = [
    "p_partkey",
    "case when p_partkey % 5 = 0 then upper(p_name) "
    "when p_partkey % 11 = 0 then concat(' ', replace(p_name, 'red', 'redd')) "
    "else p_name end as car_name",
    "case when p_partkey % 7 = 0 then '?' else cast(p_size as string) end as horsepower",
    "p_retailprice as mpg",
]

ORDINAL_ORDER_COLS = [
    "o_orderkey",
    "o_totalprice as sale_price",
    "o_totalprice*0.37 as part_area",
    "case o_orderpriority when '1-URGENT' then 'Ex' when '2-HIGH' then 'Gd' "
    "when '3-MEDIUM' then 'TA' when '4-NOT SPECIFIED' then null else 'Po' end as qual",
]

_FIXTURES = {
    "charge": ("lineitem", CHARGE_COLS),
    "noise": ("lineitem", NOISE_COLS),
    "messy_part": ("part", MESSY_PART_COLS),
    "ordinal_orders": ("orders", ORDINAL_ORDER_COLS),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, cols = _FIXTURES[name]
    return read(spark, sf_dir, table).selectExpr(*cols)


def fixture_sql(name: str) -> str:
    """The same fixture as SQL text, for the DuckDB oracle."""
    table, cols = _FIXTURES[name]
    return f"select {', '.join(cols)} from {table}"


def charge_rows(spark, sf_dir):
    return fixture(spark, sf_dir, "charge")


def noise_rows(spark, sf_dir):
    return fixture(spark, sf_dir, "noise")


def messy_parts(spark, sf_dir):
    return fixture(spark, sf_dir, "messy_part")


def ordinal_orders(spark, sf_dir):
    return fixture(spark, sf_dir, "ordinal_orders")
