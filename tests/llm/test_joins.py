"""Helpers of the joins: the bit filter and the components."""

import random

from canopy.llm import store
from canopy.llm.components import connected_components


def test_the_filter_keeps_every_row_that_has_a_partner(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "id % 7 as _word", "'x' as _bits")
    keys = spark.range(0, 3000, 30)
    got = store.perhaps_in(df, "id", keys)
    assert got.columns == df.columns
    found = {r["id"] for r in got.select("id").collect()}
    assert found >= set(range(0, 3000, 30)) and len(found) < 200
    monkeypatch.setattr(store, "FILTER_BITS", 64)       # outgrown: it passes more, and loses none
    assert {r["id"] for r in store.perhaps_in(df, "id", keys).select("id").collect()} >= set(range(0, 3000, 30))
    assert store.perhaps_in(df, "id", keys.limit(0)).count() == 0


def test_components_of_a_chain_a_hub_and_random_edges(spark):
    rnd = random.Random(1)
    edges = ([(i, i + 1) for i in range(200)] + [(5000 + i, 1000) for i in range(1000)] + [(7, 7), (9001, 9000)]
             + [(rnd.randrange(10000, 11000), rnd.randrange(10000, 11000)) for _ in range(500)])
    up: dict[int, int] = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in up} and len(got) == len(up)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
