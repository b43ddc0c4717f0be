"""Quantile strata and balanced k-fold assignment.

Fold assignment is exact and repeatable for any partitioning: rows are ranked
inside their stratum by ``md5(seed:key)`` (ties by key) and dealt round-robin
over the strata laid end to end, so every stratum and the whole table are
balanced to within one row.

Scale: the rank is computed in two levels so that no single task ever holds a
whole stratum.  The hash prefix (``bucket_bits`` bits) splits every stratum into
buckets; rows are ranked inside (stratum, bucket), and the offset of each
bucket comes from a small table of bucket counts.  A stratum holding a third of
the table is therefore spread over 2**bucket_bits groups instead of one
window partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import col, digitize, strata_bin_count
from ..session import scratch_path

#: Rows of a shuffled task, as good as, where the session's shuffle partitions would be given more: a task sorts them
#: twice (by hash and, when written, by fold), and holds both.
TASK_ROWS = 250_000
#: Hex digits of a bucket: the least keep a bucket small enough to sort quickly; with more than the most, the buckets' offsets
#: are no table to broadcast.
LEAST_DIGITS, MOST_DIGITS = 3, 4
#: Accuracy of the sketch that brackets ranks (its ranks are off by one part in so many), and how far to either side the brackets reach.
SKETCH, BRACKET = 20_000, 1.5e-4
#: Values within brackets that a task gathers before it counts them.
HELD_VALUES = 1_000_000


def _value_ranks(df: DataFrame, x: Column, by: list[Column]) -> DataFrame:
    """Distinct values with their counts, range-partitioned and written once:
    (by..., x, n, part).  Parts are in value order."""
    counts = (df.select(*[c.alias(f"g{i}") for i, c in enumerate(by)], F.nanvl(x.cast("double"), F.lit(None)).alias("x"))
              .where(F.col("x").isNotNull())
              .groupBy(*[f"g{i}" for i in range(len(by))], "x").agg(F.count(F.lit(1)).alias("n")))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranks")
    (counts.repartitionByRange(n, *[f"g{i}" for i in range(len(by))], "x")
     .withColumn("part", F.spark_partition_id()).write.parquet(path))
    return spark.read.parquet(path)


def percentiles_by(df: DataFrame, c: str, probs: list[float], by: list[str], count: bool = False) -> DataFrame:
    """A4 within groups: (by..., p, value), linear interpolation (NumPy's default rule); with ``count`` the
    group's number of values (``total``), too.

    Exact at every size and for any partitioning, and no task holds all values:
    values are counted map-side, the distinct ones range-partitioned, the
    parts' sums give each part's first rank, and the two order statistics
    around each rank are picked within their part.  The sums are one row per
    group and part."""
    names = [f"g{i}" for i in range(len(by))]
    ranks = _value_ranks(df, col(c), [col(b) for b in by])
    sums = ranks.groupBy(*names, "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*names)))
    want = sums.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "at", (F.col("total") - 1) * F.col("p"))
    # Parts that hold the lower or the upper order statistic of a rank.
    want = want.where((F.col("first") <= F.ceil("at")) & (F.floor("at") < F.col("first") + F.col("n"))).drop("n")
    inner = Window.partitionBy(*names, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranks.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    at = F.col("first") + F.col("inner")
    low, high = F.floor("at"), F.ceil("at")
    hits = placed.join(want, [*names, "part"]).withColumn("start", at).where(
        ((F.col("start") <= low) & (low < F.col("start") + F.col("n")))
        | ((F.col("start") <= high) & (high < F.col("start") + F.col("n"))))
    got = hits.groupBy(*names, "p", "at", "total").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return got.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "p", _between().alias("value"), *["total"] * count)


def percentiles_of_subsets(df: DataFrame, c: str, probs: list[float], subsets: dict[str, Column]) -> DataFrame:
    """A4 of overlapping subsets of the rows: (subset, p, value).  ``subsets``: name -> condition.

    The rows are not copied to their subsets: a subset is a column that holds the value where the condition does, and all are
    looked up together.  Exact and the same for any partitioning, as ``percentiles_of_columns``, which shuffles few values."""
    found = percentiles_of_columns(df, [F.when(s, col(c)) for s in subsets.values()], probs)
    rows = [(name, p, v) for name, (_, own) in zip(subsets, found) for p, v in own.items()]    # a row per subset and percentile
    return df.sparkSession.createDataFrame(rows, "subset string, p double, value double")


def _between() -> Column:
    """NumPy's interpolation between the order statistics a and b around the rank ``at``: from the nearer
    end, so that both ends are exact."""
    t, d = F.col("at") - F.floor("at"), F.col("b") - F.col("a")
    return F.when(t < 0.5, F.col("a") + d * t).otherwise(F.col("b") - d * (1 - t))


def _brackets(found: list[float], n: int) -> list[tuple[float, float]]:
    """Disjoint intervals from the approximate values below (the first n) and above each rank."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(zip(found[:n], found[n:])):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _bracketed(df: DataFrame, brackets: list[list[tuple[float, float]]]) -> DataFrame:
    """(f, code, x, n): rows of column ``x<f>`` within bracket i (code 2 i + 1, by value) and between brackets (even codes,
    without value)."""
    edges = [(np.array([low for low, _ in own]), np.array([high for _, high in own])) for own in brackets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 * len(low) + 1, np.int64) for low, _ in edges]
        held: list[list[np.ndarray]] = [[] for _ in edges]

        def told(f: int) -> pa.RecordBatch:
            low, _ = edges[f]
            x, n = np.unique(np.concatenate(held[f]), return_counts=True)
            held[f] = []
            code = 2 * np.searchsorted(low, x, side="right") - 1
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), f, np.int32)), pa.array(code.astype(np.int32)), pa.array(x),
                                               pa.array(n.astype(np.int64))], ["f", "code", "x", "n"])

        for batch in batches:
            for f, (low, high) in enumerate(edges):
                x = batch.column(f).drop_null().to_numpy() + 0.0      # one zero
                at = np.searchsorted(low, x, side="right")
                inside = (at > 0) & (x <= high[at - 1]) if len(low) else np.zeros(len(x), bool)
                counts[f] += np.bincount(2 * at - inside, minlength=len(counts[f]))
                held[f].append(x[inside])
                if sum(map(len, held[f])) >= HELD_VALUES:
                    yield told(f)
        for f, n in enumerate(counts):
            if held[f]:
                yield told(f)
            at = np.arange(0, len(n), 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), pa.array(at.astype(np.int32)),
                                              pa.nulls(len(at), pa.float64()), pa.array(n[at])], ["f", "code", "x", "n"])

    return df.mapInArrow(run, "f int, code int, x double, n long").groupBy("f", "code", "x").agg(F.sum("n").alias("n"))


def percentiles_of_columns(df: DataFrame, columns: list[Column], probs: list[float]) -> list[tuple[int, dict[float, float]]]:
    """A4 of several columns at once: per column how many values it has, and the percentiles.

    Exact at every size and for any partitioning, in two passes that shuffle few values: a sketch gives an interval
    around each rank, then the rows below are counted and only the values within intervals are shuffled and ranked.  A
    rank that its interval misses is looked up by ``percentiles_by``."""
    asked = sorted(set(map(float, probs)))
    rows = df.select(*[F.nanvl(c.cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(columns)])
    around = [max(p - BRACKET, 0.0) for p in asked] + [min(p + BRACKET, 1.0) for p in asked]
    if not columns or not asked:
        return [(0, {})] * len(columns)
    sketch = rows.agg(*[F.percentile_approx(f"x{i}", around, SKETCH).alias(f"x{i}") for i in range(len(columns))]).first()
    ends = [-np.inf if q == 0 else np.inf if q == 1 else None for q in around]
    brackets = [_brackets([e if e is not None else v for e, v in zip(ends, sketch[i])], len(asked)) if sketch[i] else []
                for i in range(len(columns))]
    path = scratch_path(df.sparkSession, "ranks")
    _bracketed(rows, brackets).write.parquet(path)
    ranks = df.sparkSession.read.parquet(path)
    # A few numbers per column and percentile.
    sums: dict[int, dict[int, int]] = {}
    for r in ranks.groupBy("f", "code").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(r["f"], {})[r["code"]] = r["n"]
    totals = [sum(sums.get(i, {}).values()) for i in range(len(columns))]
    want, missed = set(), set()
    for i, total in enumerate(totals):
        steps = sorted(sums.get(i, {}).items())
        first = np.cumsum([0, *[n for _, n in steps]])
        for p in asked if total else ():
            at = (total - 1) * p
            for rank in (math.floor(at), math.ceil(at)):
                k = int(np.searchsorted(first, rank, side="right")) - 1
                if steps[k][0] % 2:
                    want.add((i, steps[k][0], rank, rank - int(first[k])))
                else:
                    missed.add(i)
    values: dict[tuple[int, int], float] = {}
    if want:
        inner = Window.partitionBy("f", "code").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        asks = df.sparkSession.createDataFrame(sorted(want), "f int, code int, rank long, inner long")
        placed = ranks.where("x is not null").withColumn("start", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        for r in placed.join(F.broadcast(asks), ["f", "code"]).where("start <= inner and inner < start + n").select("f", "rank", "x").collect():
            values[r["f"], r["rank"]] = r["x"]
    out = []
    for i, total in enumerate(totals):
        if i in missed:
            out.append((total, {r["p"]: float(r["value"]) for r in percentiles_by(rows, f"x{i}", asked, []).collect()}))
            continue
        found = {}
        for p in asked if total else ():
            at = (total - 1) * p
            a, b, t = values[i, math.floor(at)], values[i, math.ceil(at)], at - math.floor(at)
            found[p] = a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)
        out.append((total, found))
    return out


def percentiles(df: DataFrame, c: str, probs: list[float]) -> list[float]:
    """A4: percentiles of the non-missing values (NULL and NaN are missing), in
    the order of ``probs``; empty without values.  See ``percentiles_of_columns``."""
    out = percentiles_of_columns(df, [col(c)], probs)[0][1]
    return [out[float(p)] for p in probs] if out else []


def distinct_edges(values: list[float]) -> list[float]:
    """A5: sorted distinct edges."""
    return sorted(set(values))


def median(df: DataFrame, c: str) -> float:
    """Exact median."""
    return percentiles(df, c, [0.5])[0]


def stratum_column(df: DataFrame, c: str, n_folds: int) -> Column:
    """The stratum of every row, as the reference derives it.

    Numeric column: quantile bins (F7 bin count, A4 edges, A5 distinct, F5
    digitize), or the above-median flag (F6) when at most two distinct edges
    remain.  Other types: the value itself.  The result is never NULL: NULL
    numbers form stratum -1, NULL text joins ''.
    """
    return _stratum(df, c, n_folds)[0]


def _stratum(df: DataFrame, c: str, n_folds: int) -> tuple[Column, int | None]:
    """``stratum_column`` and, of a number, how many rows have one."""
    field = df.schema[c]
    if not isinstance(field.dataType, NumericType):
        return F.coalesce(col(c).cast("string"), F.lit("")), None
    # One pass gives the count and the percentiles of every number of bins that the count may ask for.
    most = range(strata_bin_count(0, n_folds), strata_bin_count(1 << 60, n_folds) + 1)
    total, found = percentiles_of_columns(df, [col(c)], sorted({i / k for k in most for i in range(k + 1)} | {0.5}))[0]
    n_bins = strata_bin_count(total, n_folds)
    edges = distinct_edges([found[i / n_bins] for i in range(n_bins + 1)]) if found else []
    if len(edges) <= 2:
        s = (col(c) > F.lit(found.get(0.5))).cast("int")
    else:
        s = digitize(c, edges[1:-1])
    return F.coalesce(s, F.lit(-1)), total


def sums_before(df: DataFrame, order: str, n: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``n`` over the rows before, by the distinct values of ``order``.

    The rows are range-partitioned and written once; a row's sum is that of its part's rows before it and of the
    parts before, of which one number each reaches the driver.  No task holds all rows."""
    spark = df.sparkSession
    path = scratch_path(spark, "sums")
    df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn(
        "_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    totals = {r["_part"]: r["t"] for r in parts.groupBy("_part").agg(F.sum(n).alias("t")).collect()}
    first, run = [], 0
    for part in range(max(totals, default=-1) + 1):
        first.append(run)
        run += totals.get(part, 0)
    before = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.array(*[F.lit(v).cast("long") for v in first]), F.col("_part") + 1) if first else F.lit(0)
    return parts.withColumn(out, start + F.coalesce(F.sum(n).over(before), F.lit(0))).drop("_part")


def bucket_bits_for(partitions: int) -> int:
    """Hash-bucket bits that spread even a stratum holding every row over four groups a partition."""
    return min(24, max(0, (4 * partitions - 1).bit_length()))


def assign_folds(df: DataFrame, key: str, n_folds: int = 6, seed: int = 42,
                 stratify_col: str | None = None, stratum: Column | None = None,
                 bucket_bits: int | None = None, out: str = "fold", keep: list[str] | None = None) -> DataFrame:
    """Add an int column ``out`` in 1..n_folds.

    ``stratum`` overrides the stratum expression; with neither ``stratum``
    nor ``stratify_col`` all rows form one stratum (W4).  ``bucket_bits``
    (layout only, folds don't depend on it) follows the session's shuffle partitions.
    ``keep``: the columns wanted beside ``out``; no others are shuffled with the rows.  (Without the key, different keys
    of the same MD5 are dealt in no fixed order.)
    """
    n_parts, total, few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), None, False
    if stratum is None:
        few = not stratify_col or isinstance(df.schema[stratify_col].dataType, NumericType)
        stratum, total = _stratum(df, stratify_col, n_folds) if stratify_col else (F.lit(0), None)
    if bucket_bits is None:
        bucket_bits = bucket_bits_for(n_parts)
    h = F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))
    digits = max(LEAST_DIGITS, (bucket_bits + 3) // 4)
    if few and digits <= MOST_DIGITS:
        return _dealt(df.withColumns({"_s": stratum, "_h": h}), key, n_folds, digits,
                      -(-(total or 0) // TASK_ROWS) if (total or 0) > n_parts * TASK_ROWS else None, out, keep)
    # The hash's first hex digits: in hash order, at least as many buckets as asked for.
    base = df.withColumn("_s", stratum).withColumn("_b", F.substring(h, 1, (bucket_bits + 3) // 4))
    # Small table: rows per (stratum, bucket) -> offset of the bucket's first row
    # in the dealt order (strata in sorted order, buckets in hash order).
    path = scratch_path(df.sparkSession, "buckets")
    base.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    s_off = sums_before(counts.groupBy("_s").agg(F.sum("_n").alias("_sn")), "_s", "_sn", "_so").select("_s", "_so")
    b_off = counts.withColumn(
        "_bo", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = b_off.join(s_off, "_s").select("_s", "_b", (F.col("_so") + F.col("_bo")).alias("_off"))
    # The whole hash is taken again after the rows have moved, which is less than to move it.
    ranked = base.repartition("_s", "_b").withColumn("_h", h).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", col(key))))
    out_df = ranked.join(offsets, ["_s", "_b"])
    out_df = (out_df.withColumn(out, (F.pmod(F.col("_off") + F.col("_rn") - 1, F.lit(n_folds)) + 1)
                                .cast("int"))
                    .drop("_s", "_h", "_b", "_rn", "_off"))
    return out_df if keep is None else out_df.select(*map(col, keep), out)


def _dealt(rows: DataFrame, key: str, n_folds: int, digits: int, n_parts: int | None, out: str, keep: list[str] | None) -> DataFrame:
    """``assign_folds`` of rows with stratum ``_s`` (a dozen at most) and hash ``_h``: the rows are read, hashed and shuffled once, to
    ``n_parts`` tasks if given, and the buckets (the hash's first ``digits``) are counted from what was shuffled."""
    # Stratum and bucket as one number, in the order in which rows are dealt: cheap to compare, and all that a row takes along.
    # Rows without a key stand first in their stratum; they are counted, but get no fold.
    buckets = 16 ** digits + 1
    bucket = F.coalesce(F.conv(F.substring("_h", 1, digits), 16, 10).cast("long") + 1, F.lit(0))
    wide = rows.withColumns({"_g": (F.col("_s").cast("long") + 1) * F.lit(buckets) + bucket, "_h": F.unhex("_h")}).drop("_s")
    if keep is not None:
        wide = wide.select(*map(col, keep), "_g", "_h")
    ties = [col(key)] if keep is None or key in keep else []
    moved = wide.repartition(n_parts, "_g") if n_parts else wide.repartition("_g")
    # Every column is asked for, so that both sides have the same shuffle, which Spark then runs once.
    counts = moved.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_or(F.hash(*[col(c) for c in moved.columns])).alias("_all")).where("_all is not null")
    # Both sums share the counts.  (A stratum that can't be null adds no filter below the shuffle, which would make it two.)
    counts = counts.select("_g", "_n", F.coalesce(F.floor(F.col("_g") / buckets), F.lit(-1)).alias("_s")).repartition("_s")
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    s_off = counts.groupBy("_s").agg(F.sum("_n").alias("_sn")).select(
        "_s", F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_so"))          # a row per stratum
    inner = Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    b_off = counts.select("_s", "_g", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_bo"))
    offsets = b_off.join(F.broadcast(s_off), "_s").select("_g", (F.col("_so") + F.col("_bo")).alias("_off"))
    ranked = moved.withColumn("_rn", F.row_number().over(Window.partitionBy("_g").orderBy("_h", *ties)))
    dealt = ranked.join(F.broadcast(offsets), "_g").where("_h is not null")           # a row per stratum and bucket
    return dealt.withColumn(out, (F.pmod(F.col("_off") + F.col("_rn") - 1, F.lit(n_folds)) + 1).cast("int")).drop(
        "_g", "_h", "_rn", "_off")


def fold_sql(source_sql: str, key: str, stratum_sql: str, n_folds: int = 6, seed: int = 42,
             extra_cols: str = "") -> str:
    """DuckDB/ANSI SQL for the same fold assignment (used by the oracle)."""
    return f"""
with base as (select *, md5('{seed}:' || cast({key} as varchar)) as _h, {stratum_sql} as _s
              from ({source_sql}) src),
sizes as (select _s, count(*) as _n from base group by _s),
off as (select _s, coalesce(sum(_n) over (order by _s rows between unbounded preceding
                                           and 1 preceding), 0) as _so from sizes)
select {key}{extra_cols},
       cast(((_so + row_number() over (partition by _s order by _h, {key}) - 1) % {n_folds}) + 1
            as integer) as fold
from base join off using (_s)
"""
