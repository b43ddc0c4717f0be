"""Registered queries: scans, cleaning, folds, aggregates (S, F, P, J1-J4, A, W3, W4).

Each query runs over whole tables; the DuckDB SQL next to it computes the
same columns under the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import (constraint_direction, constraint_feature, file_stem,
                                first_token_lower, fold_from_label, fold_label, linspace_value,
                                lookup_keep, lookup_null, ratio_pct, split_list,
                                strata_bin_count_col, try_numeric)
from ..operators import clean, folds
from ..sources import tables
from . import datasets
from .oracle import charge_folds_sql, quantile_stratum_sql
from .registry import register
from ..operators.folds import fold_sql, percentiles_by

L1 = tables.fixture_sql("charge")
L3 = tables.fixture_sql("messy_part")
L4 = tables.fixture_sql("ordinal_orders")
MPG_MAP_L3 = {**datasets.MANUFACTURER_MAP, "redd": "red"}
CALIFORNIA_CAP_ORDERS = 400000.0


def _case_map(expr: str, mapping: dict, keep: bool) -> str:
    whens = " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in mapping.items())
    return f"(case {expr} {whens} else {expr if keep else 'null'} end)"


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else repr(v)


def _charge_folded(spark, sf_dir) -> DataFrame:
    return folds.assign_folds(tables.charge_rows(spark, sf_dir), "row_key", 6, 42,
                              stratify_col="charge")


F1_SQL = "lower(nullif(regexp_extract(trim(car_name), '^(\\S+)', 1), ''))"


@register("f1_first_token", f"select p_partkey, {F1_SQL} as manufacturer from ({L3}) t")
def q_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.messy_parts(spark, sf_dir).select(
        "p_partkey", first_token_lower("car_name").alias("manufacturer"))


@register("f2_try_numeric",
          f"select p_partkey, try_cast(horsepower as double) as horsepower from ({L3}) t")
def q_f2(spark, sf_dir):
    return tables.messy_parts(spark, sf_dir).select(
        "p_partkey", try_numeric("horsepower").alias("horsepower"))


@register("j2_lookup_keep",
          f"select p_partkey, {_case_map(F1_SQL, MPG_MAP_L3, True)} as manufacturer from ({L3}) t")
def q_j2(spark, sf_dir):
    return tables.messy_parts(spark, sf_dir).select(
        "p_partkey", lookup_keep(first_token_lower("car_name"), MPG_MAP_L3).alias("manufacturer"))


_MANU_SQL = f"select p_partkey, {_case_map(F1_SQL, MPG_MAP_L3, True)} as manufacturer from ({L3}) t"


@register("a1_value_counts",
          f"select manufacturer, count(*) as n from ({_MANU_SQL}) m group by manufacturer")
def q_a1(spark, sf_dir):
    return clean.value_counts(q_j2(spark, sf_dir), "manufacturer")


#: The stand-in's words are about equally frequent: "rare" is what has fewer rows than the mean, at any size.
_MEAN_SQL = "(select count(*) // count(distinct manufacturer) from {} where manufacturer is not null)".format


def _mean_count(words) -> int:
    r = words.where("manufacturer is not null").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("manufacturer").alias("d")).first()
    return r["n"] // max(r["d"], 1)


@register("a2_rare_values",
          f"select manufacturer, count(*) as n from ({_MANU_SQL}) m where manufacturer is not null "
          f"group by manufacturer having count(*) < {_MEAN_SQL(f'({_MANU_SQL})')}")
def q_a2(spark, sf_dir):
    words = q_j2(spark, sf_dir)
    return clean.rare_values(words, "manufacturer", _mean_count(words))


_RARE_SQL = f"""
with m as ({_MANU_SQL}),
c as (select manufacturer, count(*) as n from m where manufacturer is not null group by 1)
select m.p_partkey, case when c.n < {_MEAN_SQL('m')} then 'other' else m.manufacturer end
       as manufacturer
from m left join c on m.manufacturer = c.manufacturer"""


@register("j1_rare_to_other", _RARE_SQL)
def q_j1(spark, sf_dir):
    words = q_j2(spark, sf_dir)
    return clean.replace_rare(words, "manufacturer", _mean_count(words))


_D2_SQL = f"""
with m as (select p_partkey, {_case_map(F1_SQL, MPG_MAP_L3, True)} as manufacturer,
                  try_cast(horsepower as double) as horsepower, mpg from ({L3}) t),
c as (select manufacturer, count(*) as n from m where manufacturer is not null group by 1),
r as (select m.p_partkey, m.horsepower, m.mpg,
             case when c.n < {_MEAN_SQL('m')} then 'other' else m.manufacturer end as manufacturer
      from m left join c on m.manufacturer = c.manufacturer)
""" + "select * from (" + fold_sql("select * from r", "p_partkey", "coalesce(manufacturer, '')",
                                    extra_cols=", horsepower, mpg, manufacturer") + ") f"


@register("d2_auto_mpg_prepare", _D2_SQL)
def q_d2(spark, sf_dir):
    parts = tables.messy_parts(spark, sf_dir)
    words = parts.select(lookup_keep(first_token_lower("car_name"), MPG_MAP_L3).alias("manufacturer"))
    return datasets.prepare_auto_mpg(parts, "p_partkey", name_map=MPG_MAP_L3, rare_threshold=_mean_count(words))


@register("f3_ratio_pct", f"select o_orderkey, round_even(part_area / sale_price * 100, 2) "
                          f"as part_area_ratio from ({L4}) t")
def q_f3(spark, sf_dir):
    return tables.ordinal_orders(spark, sf_dir).select(
        "o_orderkey", ratio_pct("part_area", "sale_price").alias("part_area_ratio"))


@register("j3_lookup_null", f"select o_orderkey, cast({_case_map('qual', datasets.QUALITY_MAP, False)}"
                            f" as integer) as qual from ({L4}) t")
def q_j3(spark, sf_dir):
    return tables.ordinal_orders(spark, sf_dir).select(
        "o_orderkey", lookup_null("qual", datasets.QUALITY_MAP, "int").alias("qual"))


_F4_SQL = _case_map("coalesce(qual, 'NA')", datasets.BSMT_QUALITY_MAP, False)


@register("f4_fill_null", f"select o_orderkey, cast({_F4_SQL} as integer) as qual from ({L4}) t")
def q_f4(spark, sf_dir):
    from ..functions.scalar import fill_null
    return tables.ordinal_orders(spark, sf_dir).select(
        "o_orderkey", lookup_null(fill_null("qual", "NA"), datasets.BSMT_QUALITY_MAP, "int").alias("qual"))


def _d3_sql() -> str:
    src = (f"select o_orderkey, round_even(part_area / sale_price * 100, 2) as part_area_ratio, "
           f"cast({_F4_SQL} as integer) as qual, sale_price from ({L4}) t")
    cte, stratum = quantile_stratum_sql(src, "sale_price")
    body = fold_sql(f"select *, {stratum} as _strat from ({src}) s2", "o_orderkey", "_strat",
                    extra_cols=", part_area_ratio, qual, sale_price")
    return "with " + cte.strip() + "\nselect * from (" + body + ") f"


@register("d3_ames_prepare", _d3_sql())
def q_d3(spark, sf_dir):
    return datasets.prepare_ames(tables.ordinal_orders(spark, sf_dir), "o_orderkey",
                                 target="sale_price", keep=[], ratio=["part_area"],
                                 denominator="sale_price", unconstrained=["qual"],
                                 quality_cols=[], bsmt_col="qual")


def _d4_sql() -> str:
    src = f"select o_orderkey, o_totalprice from orders where o_totalprice <= {CALIFORNIA_CAP_ORDERS}"
    cte, stratum = quantile_stratum_sql(src, "o_totalprice")
    body = fold_sql(f"select *, {stratum} as _strat from ({src}) s2", "o_orderkey", "_strat",
                    extra_cols=", o_totalprice")
    return "with " + cte.strip() + "\nselect * from (" + body + ") f"


@register("d4_california_prepare", _d4_sql())
def q_d4(spark, sf_dir):
    df = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return datasets.prepare_california(df, "o_orderkey", "o_totalprice", CALIFORNIA_CAP_ORDERS)


@register("p5_range_filter",
          f"select o_orderkey, o_totalprice from orders where o_totalprice <= {CALIFORNIA_CAP_ORDERS}")
def q_p5(spark, sf_dir):
    return (tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
            .where(F.col("o_totalprice") <= F.lit(CALIFORNIA_CAP_ORDERS)))


@register("d1_simple_prepare", charge_folds_sql(cols=", charge") + "select * from _folded")
def q_d1(spark, sf_dir):
    return datasets.prepare_simple(tables.charge_rows(spark, sf_dir).select("row_key", "charge"),
                                   "charge", "row_key")


@register("w3_stratified_folds", charge_folds_sql(cols="") + "select * from _folded")
def q_w3(spark, sf_dir):
    return _charge_folded(spark, sf_dir).select("row_key", "fold")


@register("w4_unstratified_folds", "select * from (" + fold_sql(L1, "row_key", "0") + ") f")
def q_w4(spark, sf_dir):
    return folds.assign_folds(tables.charge_rows(spark, sf_dir), "row_key", 6, 42).select(
        "row_key", "fold")


_PROBS = [i / 10 for i in range(11)]


@register("a4_percentiles",
          f"select cast(i - 1 as integer) as q_ix, round(q[i], 6) as value from "
          f"(select quantile_cont(charge, [{', '.join(map(repr, _PROBS))}]) as q from ({L1}) t) s, "
          f"range(1, {len(_PROBS) + 1}) r(i)")
def q_a4(spark, sf_dir):
    q = percentiles_by(tables.charge_rows(spark, sf_dir), "charge", _PROBS, [])
    return q.select(F.round(F.col("p") * (len(_PROBS) - 1)).cast("int").alias("q_ix"),
                    F.round("value", 6).alias("value"))


@register("a6_median", f"select returnflag, round(median(charge), 6) as median_charge "
                       f"from ({L1}) t group by returnflag")
def q_a6(spark, sf_dir):
    return percentiles_by(tables.charge_rows(spark, sf_dir), "charge", [0.5], ["returnflag"]).select(
        "returnflag", F.round("value", 6).alias("median_charge"))


def _strata_sql() -> str:
    cte, stratum = quantile_stratum_sql(L1, "charge")
    return (f"with {cte.strip()}\nselect {stratum} as stratum, count(*) as n, "
            f"round(min(charge), 6) as lo, round(max(charge), 6) as hi from ({L1}) t group by 1")


@register("f5_quantile_strata", _strata_sql())
def q_f5(spark, sf_dir):
    df = tables.charge_rows(spark, sf_dir)
    s = folds.stratum_column(df, "charge", 6)
    return (df.withColumn("stratum", s).groupBy("stratum")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.min("charge"), 6).alias("lo"),
                 F.round(F.max("charge"), 6).alias("hi")))


@register("f6_above_median",
          f"select cast(charge > (select median(charge) from ({L1}) m) as integer) as above, "
          f"count(*) as n from ({L1}) t group by 1")
def q_f6(spark, sf_dir):
    df = tables.charge_rows(spark, sf_dir)
    med = folds.median(df, "charge")
    return df.groupBy((F.col("charge") > F.lit(med)).cast("int").alias("above")).agg(
        F.count(F.lit(1)).alias("n"))


@register("f7_strata_bin_count",
          f"select returnflag, count(*) as n, cast(greatest(3, least(10, count(*) // 12)) as integer)"
          f" as n_bins from ({L1}) t group by returnflag")
def q_f7(spark, sf_dir):
    return (tables.charge_rows(spark, sf_dir).groupBy("returnflag")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("n_bins", strata_bin_count_col("n", 6)))


@register("f9_fold_label",
          charge_folds_sql(cols="") + "select case when fold = 6 then 'test' else cast(fold as varchar)"
          " end as fold_label, cast(case when fold = 6 then null else fold end as integer) as fold_int,"
          " count(*) as n from _folded group by 1, 2")
def q_f9(spark, sf_dir):
    df = _charge_folded(spark, sf_dir).withColumn("fold_label", fold_label("fold", 6))
    return (df.withColumn("fold_int", fold_from_label("fold_label"))
            .groupBy("fold_label", "fold_int").agg(F.count(F.lit(1)).alias("n")))


@register("a9_load_summary",
          charge_folds_sql(cols="") + "select count(*) filter (where fold <> 6) as n_train, "
          "count(*) filter (where fold = 6) as n_test, "
          "count(distinct fold) filter (where fold <> 6) as n_folds, 6 as n_features from _folded")
def q_a9(spark, sf_dir):
    df = _charge_folded(spark, sf_dir)
    feats = clean.feature_columns(df, "charge", "fold", exclude=["row_key"])
    tr = F.col("fold") != 6
    return df.agg(F.count(F.when(tr, 1)).alias("n_train"),
                  F.count(F.when(~tr, 1)).alias("n_test"),
                  F.countDistinct(F.when(tr, F.col("fold"))).alias("n_folds"),
                  F.lit(len(feats)).alias("n_features"))


@register("o1_fold_ids", charge_folds_sql(cols="") + "select distinct fold from _folded where fold <> 6")
def q_o1(spark, sf_dir):
    return (_charge_folded(spark, sf_dir).where(F.col("fold") != 6).select("fold").distinct()
            .orderBy("fold"))


@register("a13_target_histogram",
          f"with b as (select min(charge) as lo, max(charge) as hi from ({L1}) t) "
          f"select cast(least(floor((charge - lo) / (hi - lo) * 50) + 1, 50) as integer) as bin, "
          f"count(*) as n from ({L1}) t, b group by 1")
def q_a13(spark, sf_dir):
    from ..operators.explain import target_histogram
    return target_histogram(tables.charge_rows(spark, sf_dir), "charge", 50)


@register("f11_dictionary_encode",
          f"with r as (select returnflag as v, cast(dense_rank() over (order by returnflag) - 1 as integer)"
          f" as code from (select distinct returnflag from ({L1}) a where returnflag is not null) x), "
          f"l as (select linestatus as v, cast(dense_rank() over (order by linestatus) - 1 as integer)"
          f" as code from (select distinct linestatus from ({L1}) a where linestatus is not null) y) "
          f"select t.row_key, r.code as returnflag, l.code as linestatus from ({L1}) t "
          f"left join r on t.returnflag = r.v left join l on t.linestatus = l.v")
def q_f11(spark, sf_dir):
    df = tables.charge_rows(spark, sf_dir).select("row_key", "returnflag", "linestatus")
    return clean.dictionary_encode(df, ["returnflag", "linestatus"])


@register("a3_distinct_count",
          f"select count(distinct returnflag) as returnflag, count(distinct linestatus) as linestatus,"
          f" count(distinct quantity) as quantity from ({L1}) t")
def q_a3(spark, sf_dir):
    return clean.distinct_count(tables.charge_rows(spark, sf_dir),
                                ["returnflag", "linestatus", "quantity"])


@register("p13_mask_first",
          f"select row_key, (select arg_min(price, row_key) from ({L1}) a) as price, "
          f"(select arg_min(discount, row_key) from ({L1}) b) as discount, tax from ({L1}) t")
def q_p13(spark, sf_dir):
    df = tables.charge_rows(spark, sf_dir).select("row_key", "price", "discount", "tax")
    return clean.mask_as_first(df, ["price", "discount", "absent_col"], "row_key")


# Constraint spec text derived from part rows: a type word with a direction,
# a bare name (direction defaults to +1), a name holding a colon, blanks.
_SPEC_SQL = ("concat(' ', lower(p_type), ':', case when p_size % 2 = 0 then '+1' else '-1' end, "
             "' ;; ', replace(p_name, ' ', '_'), ' ; ', p_brand, ':x:', "
             "case when p_size % 3 = 0 then '1' else '-1' end, ';', lower(p_type), ':1')")


@register("f12_parse_constraints", f"""
with s as (select p_partkey,
                  list_filter(list_transform(string_split({_SPEC_SQL}, ';'), lambda x: trim(x)),
                              lambda x: x <> '') as items from part),
e as (select p_partkey, generate_subscripts(items, 1) as pos, unnest(items) as item from s),
p as (select p_partkey, pos,
             case when strpos(item, ':') > 0 then regexp_extract(item, '^(.*):([^:]*)$', 1)
                  else item end as feature,
             case when strpos(item, ':') > 0
                  then try_cast(trim(regexp_extract(item, '^(.*):([^:]*)$', 2)) as integer)
                  else 1 end as direction from e)
select p_partkey, feature, cast(arg_max(direction, pos) as integer) as direction
from p group by p_partkey, feature""")
def q_f12(spark, sf_dir):
    parts = tables.read(spark, sf_dir, "part")
    items = parts.select("p_partkey", F.posexplode(split_list(F.expr(_SPEC_SQL))).alias("pos", "item"))
    parsed = items.select("p_partkey", "pos", constraint_feature("item").alias("feature"),
                          constraint_direction("item").alias("direction"))
    return parsed.groupBy("p_partkey", "feature").agg(
        F.max_by("direction", "pos").cast("int").alias("direction"))


@register("f14_file_stem", """
select page_id, case when regexp_matches(nm, '^.+\\.[^.]+$')
                     then regexp_extract(nm, '^(.+)\\.[^.]+$', 1) else nm end as stem
from (select page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) as nm
      from pages) t""")
def q_f14(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", file_stem("url").alias("stem"))


@register("f16_linspace_grid",
          f"with b as (select min(charge) as lo, max(charge) as hi from ({L1}) t) "
          f"select cast(i as integer) as grid_ix, round(lo + i * (hi - lo) / 49.0, 6) as grid_value "
          f"from b, range(50) r(i)")
def q_f16(spark, sf_dir):
    from ..operators.explain import linspace_grid
    g = linspace_grid(spark, tables.charge_rows(spark, sf_dir), "charge", 50)
    return g.select("grid_ix", F.round("grid_value", 6).alias("grid_value"))


# ---------------------------------------------------------------- scans
def _scratch(spark, name):
    from ..session import scratch_path
    return scratch_path(spark, name)


@register("s1_csv_scan", f"select cast(p_partkey as bigint) as p_partkey, car_name, horsepower, mpg "
                         f"from ({L3}) t")
def q_s1(spark, sf_dir):
    from ..sources.text import read_csv
    path = _scratch(spark, "s1")
    (tables.messy_parts(spark, sf_dir).write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_csv(spark, path, "p_partkey bigint, car_name string, horsepower string, mpg double")


@register("s2_whitespace_scan",
          "select p_retailprice as mpg, cast(p_size as integer) as cylinders, "
          "p_retailprice * 2 as displacement, case when p_partkey % 7 = 0 then null "
          "else cast(p_size as double) end as horsepower, cast(p_partkey as double) as weight, "
          "p_retailprice / 10 as acceleration, cast(p_size as integer) as model_year, "
          "cast(p_partkey % 3 as integer) as origin, p_name as car_name from part")
def q_s2(spark, sf_dir):
    from ..sources.text import read_whitespace
    path = _scratch(spark, "s2")
    p = tables.read(spark, sf_dir, "part")
    line = F.concat_ws(
        "   ", F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"),
        (F.col("p_retailprice") * 2).cast("string"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("?")).otherwise(F.col("p_size").cast("string")),
        F.col("p_partkey").cast("double").cast("string"), (F.col("p_retailprice") / 10).cast("string"),
        F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string"),
        F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
    p.select(line.alias("value")).write.text(path)
    return read_whitespace(spark, path).withColumn("horsepower", F.col("horsepower").try_cast("double"))
