"""N-gram Jaccard join with signature trees.

1. One pass hashes each text's distinct shingles (64 bit) to a set key (128 bit, with the
   size), so that equal sets become one class, named by its smallest id.
2. Candidate blocks: each class has ``BANDS`` keys of ``ROWS`` minimum hashes; classes that
   share a key are linked to the smallest of the key, and the connected components of these
   links are the blocks.  Two sets of similarity s miss all keys with probability
   (1 - s**ROWS)**BANDS, 1.3e-10 at s = 0.75, and a block also joins them by way of others.
3. A block's classes form signature trees: nodes carry OR-combined bitmaps, size ranges and the
   largest number of bit collisions of a set below.  The dual traversal drops a pair of nodes
   when sizes are too far apart, when all below them is known to be connected, or when
   popcount(a & b) + collisions, which no overlap below can exceed, is less than the overlap
   needed.  Pairs of sets that remain are compared exactly.
4. A block of more than ``NODE_SETS`` sets or ``NODE_SHINGLES`` shingles is spread over nodes
   (size class x hash), each with the block's first class besides its own; pairs of nodes that
   are not yet in one component are traversed in a second round.  So no task holds a block,
   and no link is given up.

Links written are spanning links: a cluster of m classes gives m - 1, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import connected_components
from .store import partitions, perhaps_in, stored, with_columns_free

BANDS, ROWS = 60, 4
NODE_SETS, NODE_SHINGLES = 2000, 3_000_000
LEAF, FAN = 8, 8

_rng = np.random.default_rng(75)
_MIN_MULT = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MIN_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _rng.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)


def band_keys(s: np.ndarray) -> np.ndarray:
    """Keys of a non-empty set: per band a hash of ``ROWS`` minima."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 16) // (BANDS * ROWS))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        np.minimum(low, (part[:, None] * _MIN_MULT[None] + _MIN_ADD[None]).min(axis=0), out=low)
    m = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = _BAND.copy()
    for r in range(ROWS):
        h = tx.mix(h ^ (m[:, r] + np.uint64(r + 1) * _BAND))
    return h.view(np.int64)


def _describe(k: int):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()),
                        ("key_b", pa.int64()), ("keys", pa.list_(pa.int64()))])
    second = np.uint64(0xD6E8FEB86659FD93)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                data, off = tx.buffers(part.column("text"))
                h, _, first = tx.words(data, off, lower=True)
                sets = tx.shingle_sets(h, first, k)
                n = np.array([len(s) for s in sets], np.int64)
                a = np.array([np.add.reduce(s) for s in sets], np.uint64)
                b = np.array([np.add.reduce(tx.mix(s ^ second)) for s in sets], np.uint64)
                keys = [band_keys(s) for s in sets if len(s)]
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), pa.array(n), pa.array(a.view(np.int64)),
                     pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    schema=schema)

    return run


class Tree:
    """Signature tree over sets sorted by size.  Level 0 are the sets themselves."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], bits: int):
        order = np.lexsort((ids, np.array([s[0] for s in sets], np.uint64),
                            np.array([len(s) for s in sets])))
        self.ids, self.sets = ids[order], [sets[i] for i in order]
        size = np.array([len(s) for s in self.sets], np.int64)
        maps = np.zeros((len(size), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            slot = (s >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (slot >> np.uint64(6)).astype(np.int64),
                             np.uint64(1) << (slot & np.uint64(63)))
        lost = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, size, size, lost)]
        self.width = [1]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, lost = self.levels[-1]
            fan = LEAF if len(self.levels) == 1 else FAN
            cut = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut),
                                np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)))
            self.width.append(self.width[-1] * fan)


class Union:
    """Union-find over positions; the root is the smallest id."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.up = ids.tolist(), list(range(len(ids)))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            if self.ids[a] > self.ids[b]:
                a, b = b, a
            self.up[b] = a


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def dual_join(x: Tree, y: Tree, union: Union, at_x: int, at_y: int, percent: int) -> None:
    """Joins in ``union`` what the two trees link; ``x is y`` joins a tree with itself.  ``at_x``
    and ``at_y`` are the positions of the trees' first sets in ``union``."""
    top_x, top_y = len(x.levels) - 1, len(y.levels) - 1
    todo = [(top_x, 0, top_y, 0)]
    n_x, n_y = len(x.ids), len(y.ids)
    while todo:
        lx, i, ly, j = todo.pop()
        mx, lox, hix, cx = x.levels[lx]
        my, loy, hiy, cy = y.levels[ly]
        if 100 * hix[i] < percent * loy[j] or 100 * hiy[j] < percent * lox[i]:
            continue
        if x is not y or lx != ly or i != j:
            need = percent * (int(lox[i]) + int(loy[j]))
            most = int(np.bitwise_count(mx[i] & my[j]).sum()) + min(int(cx[i]), int(cy[j]))
            if (100 + percent) * most < need:  # |a & b| >= p / (1 + p) * (|a| + |b|)
                continue
        elif lx == 0:
            continue
        if lx == 0 and ly == 0:
            a, b = at_x + i, at_y + j
            if union.root(a) != union.root(b) and similar(x.sets[i], y.sets[j], percent):
                union.join(a, b)
            continue
        wx, wy = x.width[lx], y.width[ly]
        below = [*range(at_x + i * wx, at_x + min((i + 1) * wx, n_x)),
                 *range(at_y + j * wy, at_y + min((j + 1) * wy, n_y))]
        root = union.root(below[0])
        if all(union.root(p) == root for p in below):
            continue
        if lx >= ly and lx > 0:
            fan = x.width[lx] // x.width[lx - 1]
            kids_x = [(lx - 1, k) for k in range(i * fan, min((i + 1) * fan, len(x.levels[lx - 1][1])))]
        else:
            kids_x = [(lx, i)]
        if ly >= lx and ly > 0:
            fan = y.width[ly] // y.width[ly - 1]
            kids_y = [(ly - 1, k) for k in range(j * fan, min((j + 1) * fan, len(y.levels[ly - 1][1])))]
        else:
            kids_y = [(ly, j)]
        same = x is y and lx == ly and i == j
        todo += [(*p, *q) for p in kids_x for q in kids_y if not same or p[1] <= q[1]]


def _bits(sets: list[np.ndarray]) -> int:
    want = 4 * int(np.median([len(s) for s in sets]))
    return 1 << min(15, max(8, want.bit_length()))


def link_sets(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: np.ndarray,
              percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (id, smallest id).  ``side`` 0: joined with themselves; with sides 1 and 2,
    side 1 is joined with side 2.  ``known`` are ids of components known already."""
    bits = _bits(sets)
    trees = [Tree(ids[side == s], [sets[i] for i in np.flatnonzero(side == s)], bits)
             for s in np.unique(side)]
    order = np.concatenate([t.ids for t in trees])
    union = Union(order)
    where = {int(i): p for p, i in reversed(list(enumerate(order.tolist())))}
    seen: dict[int, int] = {}
    for i, c in zip(ids.tolist(), known.tolist()):
        union.join(where[i], seen.setdefault(c, where[i]))
    before = [union.root(p) for p in range(len(order))]
    if len(trees) == 1:
        dual_join(trees[0], trees[0], union, 0, 0, percent)
    else:
        dual_join(trees[0], trees[1], union, 0, len(trees[0].ids), percent)
    root = np.array([union.root(p) for p in range(len(order))])
    moved = [p for p in range(len(order)) if before[p] == p and root[p] != p]
    return order[moved], order[root[moved]]


def _link_nodes(k: int, percent: int):
    """Rows sorted by node -> links.  A node's rows are gathered, joined and let go."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        # Rows alike in id and text come once each; one of them stands for all.
        _, once = np.unique(table.column("id").to_numpy(), return_index=True)
        if len(once) < table.num_rows:
            table = table.take(pa.array(np.sort(once)))
        ids, side, known = (table.column(c).to_numpy() for c in ("id", "side", "known"))
        sets = []
        for part in table.to_batches():
            for piece in tx.slices(part, "text"):
                data, off = tx.buffers(piece.column("text"))
                h, _, first = tx.words(data, off, lower=True)
                sets += tx.shingle_sets(h, first, k)
        if len(ids) < 2:
            return None
        u, v = link_sets(ids, sets, side, known, percent)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            node = batch.column("node").to_numpy()
            cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
                if b == a:
                    continue
                if name is not None and node[a] != name:
                    if (out := flush(held)) is not None:
                        yield out
                    held = []
                name = node[a]
                held.append(batch.slice(a, b - a))
        if held and (out := flush(held)) is not None:
            yield out

    return run


def _row_key(id_col: str, text_col: str):
    """A row's key: a hash of its id and its text, so that rows that repeat an id, or have none, are told apart."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.xxhash64(text_col))


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(row, id, n, component) per row of ``docs``: component is one number per component of rows with words, null
    for rows without."""
    base = docs.select(_row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text"))
    told = stored(base.mapInArrow(_describe(k), "row long, id long, n long, key_a long, key_b long, keys array<long>"),
                  "sets")
    texts = base.select(F.col("row").alias("id"), "text")
    # A class of equal sets is named by the smallest key of its rows.
    classes = stored(told.where("n > 0").groupBy("n", "key_a", "key_b").agg(F.min("row").alias("rep")),
                     "classes")
    # Joins on tables that grow with the input are sort-merge joins at every size.
    reps = stored(told.select(F.col("row").alias("id"), "keys").hint("merge").join(
        classes.select(F.col("rep").alias("id")), "id", "left_semi"), "reps")
    postings = reps.select("id", F.explode("keys").alias("key"))
    first = stored(postings.groupBy("key").agg(F.min("id").alias("m"), F.max("id").alias("x")).where(
        "m < x").select("key", "m"), "keys")
    edges = perhaps_in(postings, "key", first).hint("merge").join(first, "key").where("id != m").select(
        F.col("id").alias("u"), F.col("m").alias("v"))
    blocks = connected_components(edges).withColumnRenamed("component", "block")
    sized = blocks.join(classes.select(F.col("rep").alias("node"), "n"), "node").select(
        F.col("node").alias("id"), "block", "n")
    sized = stored(sized.withColumn("size_class", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))), "blocks")

    whole = sized.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    large = whole.where((F.col("c") > NODE_SETS) | (F.col("s") > NODE_SHINGLES)).select("block")
    parts = F.greatest(F.ceil(F.count("*") / NODE_SETS), F.ceil(F.sum("n") / NODE_SHINGLES))
    spread = sized.join(large, "block", "left_semi").groupBy("block", "size_class").agg(parts.alias("k"))
    node = F.xxhash64("block", "size_class", "salt")
    own = sized.join(spread, ["block", "size_class"], "left").select(
        "id", "block", F.when(F.col("k").isNull(), -1).otherwise(F.col("size_class")).alias("size_class"),
        F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).alias("salt")).withColumn("node", node)
    any_large = large.limit(1).count() > 0
    if any_large:
        own = stored(own, "nodes")
        more = own.where("size_class >= 0").select("block", "size_class", "salt", "node").distinct()
        own_all = own.select("id", "node").unionByName(more.select(F.col("block").alias("id"), "node")).distinct()
    else:
        own_all = own.select("id", "node")

    spark = docs.sparkSession

    def linked(members: DataFrame) -> DataFrame:
        """members: id, node, side, known."""
        rows = members.hint("merge").join(perhaps_in(texts, "id", members), "id").select("node", "id", "side", "known", "text")
        dealt = rows.repartition(max(partitions(spark), 12), "node").sortWithinPartitions("node")
        return stored(dealt.mapInArrow(_link_nodes(k, percent), "u long, v long"), "links")

    links = linked(own_all.select("id", "node", F.lit(0).alias("side"), F.col("id").alias("known")))
    if any_large:
        grown = connected_components(links)
        known = stored(own.where("size_class >= 0").join(grown.withColumnRenamed("node", "id"), "id", "left")
                       .withColumn("known", F.coalesce("component", "id")), "known")
        ends = known.groupBy("block", "size_class", "node").agg(
            F.min("known").alias("low"), F.max("known").alias("high"))
        a, b = ends.alias("a"), ends.alias("b")
        pairs = a.join(b, F.expr(
            "a.block = b.block and b.size_class between a.size_class and a.size_class + 1 and "
            "(a.size_class < b.size_class or a.node < b.node) and "
            "not (a.low = a.high and b.low = b.high and a.low = b.low)")).select(
            F.col("a.node").alias("left"), F.col("b.node").alias("right"))
        pairs = stored(pairs.withColumn("pair", F.xxhash64("left", "right")), "pairs")
        members = known.select("id", "known", "node")
        both = (pairs.select(F.col("left").alias("node"), "pair", F.lit(1).alias("side"))
                .unionByName(pairs.select(F.col("right").alias("node"), "pair", F.lit(2).alias("side"))))
        across = linked(both.join(members, "node").select("id", F.col("pair").alias("node"), "side", "known"))
        labels = connected_components(links.unionByName(across)).withColumnRenamed("node", "rep")
    else:  # each block was joined whole: its links already name the smallest id
        labels = links.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    named = classes.join(labels, "rep", "left").select(
        "n", "key_a", "key_b", F.coalesce("component", "rep").alias("component"))
    return told.select("row", "id", "n", "key_a", "key_b").hint("merge").join(named, ["n", "key_a", "key_b"], "left").select(
        "row", "id", "n", "component")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             k: int = 5, percent: int = 75) -> DataFrame:
    """(``id_col``, n_shingles, component_id), one row for each row of ``docs``.

    Words are A-Z lower-cased; sets are distinct ``k``-word shingles (a shorter text is one
    shingle); texts link at 100 * intersection >= percent * union.  component_id is the smallest
    id reachable by links.  Null and wordless texts have no shingles and stand alone.  Rows with a null id
    take part and are returned; a component of null ids alone has a null component_id.  Rows that repeat an id
    are judged each by its own text.  An empty table gives no rows; other columns are not read."""
    found = stored(_components(docs, id_col, text_col, k, percent), "rows")
    least = found.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = found.hint("merge").join(least, "component", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id (null last, then by a hash of the text), with the
    columns of ``docs``; rows without words are all kept.  Rows alike in id and text are one document."""
    p = with_columns_free(docs, "row", "once")
    found = stored(_components(docs, "doc_id", "text", 5, 75), "rows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = found.where("component is not null").groupBy("component").agg(F.min(place).alias("p")).select(
        F.col("p.row").alias(p + "row"), F.lit(True).alias(p + "once"))
    wordless = found.where("component is null").select(F.col("row").alias(p + "row"), F.lit(False).alias(p + "once")).distinct()
    kept = docs.withColumn(p + "row", _row_key("doc_id", "text")).join(first.unionByName(wordless), p + "row")
    again = found.where("component is not null").groupBy("row").agg(F.count("*").alias("c")).where("c > 1")
    if again.limit(1).count() > 0:
        kept = kept.where(p + "once").dropDuplicates([p + "row"]).unionByName(kept.where(f"not {p}once"))
    return kept.select(docs.columns)
