"""Mixing sources to target weights under a time-varying curriculum.

A source's target is its weight's share of all words, stopped at ``MAX_REPEAT`` times its size, the
excess going to the others by weight.  The target is a number of words; in integers it is
numerator / denominator, so that engines and reruns agree.

Documents of a source stand in a fixed random order (md5 of seed, id and the text's md5, so that rows without an
id, or that share one, are spread as well).  Whole passes over the source are taken
first, and of the last pass the documents whose middle is within what is left.  The words taken
are the source's demand.  Its weight over training time t in [0, 1] is proportional to
1 + slope * (2 t - 1); integrated, that is F(t) = (1 - slope) t + slope t^2.  A copy of a document whose
words begin at cumulative demand u of the source's total D is trained at the t with F(t) = u / D.
Copies are range-sorted by position.

Cumulative sums are taken in two levels, sums of hash buckets and then rows within a bucket, so no
window holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored, with_columns_free

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"
#: Sources by rank have these slopes in turn: early, steady and late ones.
SLOPES = (-0.5, 0.0, 0.5)
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Rows a bucket is to hold.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of runs outside \\x20\\x09-\\x0D."""
    parts = F.split(text, SPACE, -1)
    edge = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce((F.size(parts) - edge).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT,
                   slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """From (source, source_size): numerator, denominator and slope of each source's target.

    Sources rank by code point, null last; weights and slopes repeat by rank.  Sources whose cap is
    below their share are those of the smallest size / weight: with the sources in that order, a source is
    capped if its cap is at most the level its prefix leaves.  One row per source is ranked in one place."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    ranked = sizes.withColumn("rank", k)
    pick = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), F.pmod("rank", F.lit(len(xs))).cast("int") + 1)
    ranked = ranked.withColumn("weight", pick(weights, "long")).withColumn("slope", pick(slopes, "double"))
    ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (ranked.withColumn("total", F.sum("source_size").over(everything))
              .withColumn("weights", F.sum("weight").over(everything))
              .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
              .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # The level left by the sources before, were all of them capped.
    capped = most * F.col("source_size") * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (
        F.col("total") - most * F.col("size_before"))
    ranked = ranked.withColumn("capped", capped)
    ranked = ranked.withColumn("capped_size", F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(everything)
                               ).withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything))
    return ranked.select(
        "source", "source_size", "slope", "rank",
        F.when(F.col("capped"), most * F.col("source_size")).otherwise(
            (F.col("total") - most * F.col("capped_size")) * F.col("weight")).cast("long").alias("numerator"),
        F.when(F.col("capped"), F.lit(1)).otherwise(F.col("free_weight")).cast("long").alias("denominator"))


def position(u: Column, slope: Column) -> Column:
    """The t in [0, 1] at which (1 - slope) t + slope t^2 = u."""
    a = 1 - slope
    return F.when(F.abs(slope) < 1e-9, u).otherwise((F.sqrt(a * a + 4 * slope * u) - a) / (2 * slope))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT,
        slopes: tuple[float, ...] = SLOPES, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, source, key (hash of the text), size, source_size, target, copies, taken,
    first_position (of its first copy, null if not taken), step (passes are this far apart in
    cumulative demand), source_taken, slope.

    Null and empty texts have size 0: they are taken with the passes they stand in, at 0 words.  A null
    source ranks last; null ids count as empty ones; rows alike in id and text
    are interchangeable.  An empty table gives no rows; other columns are not read."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.xxhash64("text").alias("key"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"),
        F.when(F.col("text").isNull(), 0).otherwise(word_count(F.col("text"))).cast("long").alias("size"))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest"))
    base = stored(base.withColumn("order", order).drop("digest"), "sizes")
    rows = base.count()
    # Hexadecimal digits of the order that name a bucket.
    digits = max(1, next(d for d in range(1, 13) if rows / 16 ** d <= BUCKET_ROWS))
    base = base.withColumn("bucket", F.substring("order", 1, digits))
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("s")
    sums = stored(base.groupBy(named, "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    totals = sums.groupBy("s").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(totals.select(
        F.when(~F.col("s.none"), F.col("s.name")).alias("source"), "source_size"), weights, most, slopes)
    targets = targets.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("s"),
                             "source_size", "numerator", "denominator", "slope")
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(targets, "s").drop("bucket_size")
    within = Window.partitionBy("s", "bucket").orderBy("order", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("s", named).withColumn(
        "inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["s", "bucket"])
    at = F.col("start") + F.col("inner")
    scale = F.col("denominator") * F.col("source_size")
    full = F.when(scale > 0, F.expr("numerator div (denominator * source_size)")).otherwise(0)
    left = F.col("numerator") - F.col("full") * scale  # over the denominator
    placed = placed.withColumn("at", at).withColumn("full", full).withColumn(
        "copies", (F.col("full") + F.when((F.col("full") < most) & (
            (2 * F.col("at") + F.col("size")) * F.col("denominator") <= 2 * left), 1).otherwise(0)).cast("long"))
    placed = placed.withColumn("target", F.col("numerator") / F.col("denominator"))
    demand = F.greatest(F.col("target"), F.lit(1.0))
    u = F.least(F.col("at") / demand, F.lit(1.0))
    return placed.select(
        "doc_id", "source", "key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, position(u, F.col("slope"))).alias("first_position"),
        F.least(F.col("source_size") / demand, F.lit(1.0)).alias("step"), F.col("slope"), u.alias("demand_at"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order, a row per copy, with the columns of ``docs``; see ``mix``."""
    p = with_columns_free(docs, "id", "source", "key", "copies", "step", "slope", "at", "t")
    plan = mix(docs, **options).where("copies > 0").select(
        *[F.col(c).alias(p + n) for c, n in (("doc_id", "id"), ("source", "source"), ("key", "key"), ("copies", "copies"),
                                             ("step", "step"), ("slope", "slope"), ("demand_at", "at"))])
    # Rows alike in all of these are interchangeable; their copies are summed and met once.
    plan = plan.groupBy(p + "id", p + "source", p + "key").agg(
        F.sum(p + "copies").alias(p + "copies"), F.max(p + "step").alias(p + "step"),
        F.max(p + "slope").alias(p + "slope"), F.min(p + "at").alias(p + "at"))
    on = (F.col("doc_id").eqNullSafe(F.col(p + "id")) & F.col("source").eqNullSafe(F.col(p + "source"))
          & (F.xxhash64("text") == F.col(p + "key")))
    again = docs.groupBy("doc_id", "source", F.xxhash64("text").alias(p + "key")).agg(F.count("*").alias("c")).where("c > 1")
    once = docs.dropDuplicates(["doc_id", "source", "text"]) if again.limit(1).count() else docs
    copies = once.join(plan, on).withColumn(p + "t", F.explode(F.sequence(F.lit(0), F.col(p + "copies") - 1)))
    t = position(F.least(F.col(p + "at") + F.col(p + "t") * F.col(p + "step"), F.lit(1.0)), F.col(p + "slope"))
    return copies.withColumn(p + "t", t).orderBy(p + "t", "doc_id").select(docs.columns)
