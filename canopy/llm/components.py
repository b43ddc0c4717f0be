"""Connected components by alternating star contractions, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Tasks a hub's edges are dealt over.
SALTS = 16


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns ``u`` and ``v``.  Returns (node, component), component
    the smallest node reachable, for every node of an edge.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest;
    rounds are logarithmic in practice.  ``now`` holds each edge once, the larger end first, so a
    node's smallest neighbour is a minimum over its own rows, aggregated map-side, and a hub is
    met as ``v`` alone, in a join whose keys are salted.  Nothing is collected but a flag."""
    now = stored(_oriented(edges), "edges")
    while not _stars(now):
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(F.col("u").alias("v"), "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        salted = now.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = salted.join(low, ["v", "salt"], "left").select(
            "u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        now = stored(_oriented(small), "edges")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up + down > 1").limit(1).count() == 0
