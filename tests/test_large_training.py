"""Training on many rows: what is shuffled, written and read again, and sums taken together."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from canopy.operators.boost import histogram, state
from canopy.operators.boost.bins import feature_spec
from canopy.operators.boost.fit import BoostParams, ModelSpec, Trainer
from canopy.operators.boost.histogram import BUNDLE_CELLS, Table, bundles, margin_of
from canopy.operators.boost.state import Block, State
from canopy.operators.boost.tree import Tree


def _rows(spark, n=1200):
    return spark.range(n, numPartitions=3).selectExpr(
        "id as key", "cast(id % 6 + 1 as int) as fold", "cast(id * 7919 % 13 as double) as x",
        "case when id % 11 > 0 then concat('c', id % 5) end as c", "cast(id % 13 + id * 31 % 7 as double) as y")


def test_blocks_are_packed_where_rows_are_read(spark):
    """One task, one file: a shuffle by key would have dealt them anew."""
    df = _rows(spark)
    state = State(df, "key", "fold", "y", feature_spec(df, ["x", "c"], 8), 2, 42)
    blocks = spark.table(f"{state.database}.bins").select((F.col("block") / 2**32).cast("int").alias("task"), "n").collect()
    state.close()
    assert sorted((r["task"], r["n"]) for r in blocks) == [(0, 400), (1, 400), (2, 400)]


def test_no_margins_are_written_for_losses_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(State, "refresh", lambda self, margin_of: written.append(1))
    p = BoostParams(max_trees=2, refresh_every=2, subsample=1.0, colsample_bytree=1.0)
    Trainer(_rows(spark), "key", "fold", "y", ["x"], [ModelSpec("m", "m", 6, 1, early_stop=False, n_trees=2)], p).run()
    assert not written


def test_a_trainer_goes_on_with_another_ones_rows(spark):
    df, p = _rows(spark), BoostParams(max_trees=3, refresh_every=2, learning_rate=0.5)

    def models(depth):
        return [ModelSpec(f"cv{k}", "g", k, depth) for k in (1, 2)] + [ModelSpec("f", "g", 6, depth, early_stop=False)]

    first = Trainer(df, "key", "fold", "y", ["x", "c"], models(1), p)
    first.run(keep=True)
    second = Trainer(df, "key", "fold", "y", ["x", "c"], models(2), p, after=first).run()
    alone = Trainer(df, "key", "fold", "y", ["x", "c"], models(2), p).run()
    assert [m.curve for m in second.models] == [m.curve for m in alone.models]
    assert not spark.catalog.databaseExists(first.state.database)


@pytest.mark.parametrize("depth", [1, 3, 7])
def test_trees_met_by_split_equal_those_met_by_row(depth):
    rng = np.random.default_rng(depth)
    t = Tree.empty(depth)
    inner = (1 << depth) - 1
    t.feature[:inner] = np.where(rng.random(inner) < 0.9, rng.integers(0, 3, inner), -1)
    t.split_bin[:inner] = rng.integers(0, 6, inner)
    t.default_left[:] = rng.random(len(t.feature)) < 0.5
    for n in np.flatnonzero(t.feature == 2):
        t.is_cat[n], t.cat_left[int(n)] = True, np.array([1, 4])
    t.value[:] = rng.random(len(t.feature))
    bins = rng.integers(-1, 8, (500, 3)).astype(np.int8)

    def walk(row, levels):
        n = 0
        for _ in range(levels):
            f = t.feature[n]
            if f < 0:
                break
            b = row[f]
            left = t.default_left[n] if b < 0 else b in (1, 4) if t.is_cat[n] else b <= t.split_bin[n]
            n = 2 * n + (1 if left else 2)
        return n

    for levels in (0, 1, depth):
        assert t.route(bins, levels).tolist() == [walk(r, levels) for r in bins]
    assert t.predict(bins).tolist() == [t.value[walk(r, depth)] for r in bins]


def test_bundles_hold_every_feature_once():
    widths = [12, 10, 18, 4, 3, 257, 20_000]
    found = bundles(np.arange(7), widths)
    assert sorted(f for g in found for f in g) == list(range(7))
    assert all(len(g) == 1 or np.prod([widths[f] for f in g]) <= BUNDLE_CELLS for g in found) and len(found) < 7


@pytest.mark.parametrize("depth, n", [(1, 9), (2, 6), (4, 3)])
def test_pending_trees_as_one_table_equal_tree_by_tree(depth, n):
    rng = np.random.default_rng(depth)
    widths = [257, 9, 4, 6]
    bins = np.stack([rng.integers(-1, w - 1, 3000) for w in widths]).astype(np.int16).T
    trees = []
    for _ in range(n):
        t = Tree.empty(depth)
        inner = (1 << depth) - 1
        t.feature[:inner] = np.where(rng.random(inner) < 0.9, rng.integers(0, 4, inner), -1)
        t.split_bin[:inner] = rng.integers(0, 8, inner)
        t.default_left[:] = rng.random(len(t.feature)) < 0.5
        for k in np.flatnonzero(t.feature == 2):
            t.is_cat[k], t.cat_left[int(k)] = True, np.array([0, 2])
        t.value[:] = rng.normal(size=len(t.feature))
        t.used[:] = True
        trees.append(t.routing())
    block = Block(0, None, None, None, bins, None)
    table = Table.of(trees, 0.1, widths)
    assert len(table.values) < 1 << 16
    found = table.margins(lambda f: bins[:, f].astype(np.intp) + 1, len(bins))
    assert found.tolist() == margin_of(block, 0, [0.1], {0: trees}).tolist()


def test_too_many_ways_are_no_table(monkeypatch):
    monkeypatch.setattr(histogram, "TABLE_CELLS", 3)
    trees = []
    for f in (0, 1):
        t = Tree.empty(1)
        t.feature[0], t.split_bin[0], t.used[:] = f, 2, True
        trees.append(t)
    assert Table.of(trees, 0.0, [9, 9]) is None and Table.of(trees[:1], 0.0, [9, 9]) is None


def test_blocks_lie_in_small_row_groups(spark, monkeypatch):
    """A reader holds a row group at a time."""
    monkeypatch.setattr(state, "GROUP_BYTES", 1 << 18)
    df = spark.range(100_000, numPartitions=1).selectExpr("id as key", "cast(id % 6 + 1 as int) as fold", "cast(id % 97 as double) as x",
                                                          "cast(id as double) as y")
    made = State(df, "key", "fold", "y", feature_spec(df, ["x"], 8), 1, 42)
    files = [f.removeprefix("file:") for f in spark.table(f"{made.database}.bins").inputFiles()]
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in files]
    made.close()
    assert len(groups) == 1 and groups[0] > 2


def _warmups(sizes):
    return [ModelSpec(f"{s}/{k}", str(s), k, 1, {"x": 1}, ["x"], s, early_stop=k != 6) for s in sizes for k in (1, 2, 6)]


def test_warmups_share_trees_until_they_part(spark, monkeypatch):
    """A tree that several sizes have in common is built once, and what comes out is what each size gives alone; sizes that
    stop early don't take the others along."""
    built = []
    monkeypatch.setattr("canopy.operators.boost.fit.run_pass",
                        lambda state, plan: built.append((plan.tree_index, len(plan.builders), len(plan.metrics))) or histogram.run_pass(state, plan))
    df = _rows(spark)
    p = BoostParams(max_trees=4, early_stopping_rounds=1, learning_rate=0.9, refresh_every=2, colsample_bytree=1.0)
    together = Trainer(df, "key", "fold", "y", ["x", "c"], _warmups((1, 2)), p).run()
    counts = {t: (b, m) for t, b, m in built}
    assert counts[0] == (3, 0) and counts[1] == (6, 3)
    alone = [m for s in (1, 2) for m in Trainer(df, "key", "fold", "y", ["x", "c"], _warmups((s,)), p).run().models]
    for a, b in zip(together.models, alone, strict=True):
        assert a.curve == b.curve and a.best_trees == b.best_trees and len(a.trees) == len(b.trees)
        for s, t in zip(a.trees, b.trees):
            assert (s.feature == t.feature).all() and (s.value == t.value).all() and (s.split_bin == t.split_bin).all()


def test_blocks_go_to_python_a_few_at_a_time(spark, monkeypatch):
    """Not all of a task's blocks as one batch; the session's own setting is there again afterwards."""
    monkeypatch.setattr(state, "BLOCK_ROWS", 16)
    monkeypatch.setattr(state, "BATCH_BYTES", 2048)
    sizes = spark.sparkContext.accumulator(0)
    over = state._blocks

    def counted(batches, *more):
        held = list(batches)
        sizes.add(sum(b.num_rows > 15 for b in held))
        return over(iter(held), *more)

    monkeypatch.setattr(state, "_blocks", counted)
    before = spark.conf.get(state.BATCH_CONF, None)
    p = BoostParams(max_trees=1, subsample=1.0, colsample_bytree=1.0)
    Trainer(_rows(spark), "key", "fold", "y", ["x"], [ModelSpec("m", "m", 6, 1, early_stop=False, n_trees=1)], p).run()
    assert sizes.value == 0 and spark.conf.get(state.BATCH_CONF, None) == before
