"""Variable-capacity best-fit packing.

Several sequence lengths are permitted.  Documents are dealt to shards of about ``shard_rows`` rows: contiguous
stretches of the training order where rows come in one (a Parquet table's own order), else by a hash.  A shard packs
alone, longest first: a document goes to the open bin it fills best, over the bins of all lengths
together, but not to one that holds a copy of it (of up to ``APART`` copies); if none fits, the bin length of least cost for it is opened.  A bin of
length c costs c + overhead + c * c / attention (the last for attention's square), by word that it can
be expected to hold: the document, and a share of the words still to come in documents that fit beside it,
where all longer documents still to come share alike.  In the end each bin is downsized to the shortest
length that holds its contents.  Documents longer than the longest length are cut into pieces of that
length and a rest; nothing is dropped.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64
ATTENTION = 65_536
SHARD_ROWS = 50_000
#: Copies of a document that are kept out of each other's bins; a mix takes fewer.
APART = 16


def pack(sizes: np.ndarray, lengths: tuple[int, ...], overhead: int = OVERHEAD, attention: int = ATTENTION,
         copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes in descending order: bin and offset of each, and each bin's final length.  ``copies``: a
    number per item, equal for neighbours that must not share a bin."""
    n = len(sizes)
    copies = np.arange(n) if copies is None else copies
    # Words from each item on: sizes fall, so those that fit beside an item are a suffix.
    words = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]]).tolist()
    beside = {c: np.searchsorted(-sizes, sizes - c, side="left").tolist() for c in lengths}  # first item of at most c - size
    room: list[int] = []  # distinct remaining capacities, ascending
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    capacity: list[int] = []
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    same, taken = -1, set()  # bins that hold the item's copies

    def cost(c: int, i: int, size: int) -> tuple[float, int]:
        first = max(beside[c][i], i + 1)
        fill = size + min(c - size, words[first] / (first - i))
        return (c + overhead + c * c / attention) / max(1.0, fill), c

    for i, (size, copy) in enumerate(zip(sizes.tolist(), copies.tolist())):
        if copy != same or len(taken) > APART:
            same, taken = copy, set()
        at, b = bisect.bisect_left(room, size), -1
        while at < len(room):
            left = room[at]
            held = open_bins[left]
            k = next((k for k in range(len(held) - 1, -1, -1) if held[k] not in taken), -1)
            if k >= 0:
                b = held.pop(k)
                if not held:
                    del open_bins[left], room[at]
                break
            at += 1
        if b < 0:
            left = min((c for c in lengths if c >= size), key=lambda c: cost(c, i, size))
            b = len(used)
            used.append(0)
            capacity.append(left)
        taken.add(b)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        left -= size
        if left > 0:
            if left not in open_bins:
                bisect.insort(room, left)
                open_bins[left] = []
            open_bins[left].append(b)
    final = np.array([lengths[bisect.bisect_left(lengths, u)] for u in used], np.int64)
    return bins, offsets, final


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text"):
            _, _, first = tx.words(*tx.buffers(part.column("text")))
            more = [c for c in ("file", "at") if c in part.schema.names]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tie"), pa.array(np.diff(first)), *map(part.column, more)],
                ["doc_id", "tie", "size", *more])


def _pack_group(lengths: tuple[int, ...], overhead: int, attention: int):
    most = lengths[-1]
    names = ["doc_id", "piece", "start", "size", "shard", "bin", "bin_offset", "bin_length", "bin_used"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("tie", "ascending")])
        size = table.column("size").to_numpy()
        count = np.maximum(1, -(-size // most))  # pieces of each document
        owner = np.repeat(np.arange(len(size)), count)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * most
        length = np.minimum(most, size[owner] - start)
        ids, tie = (table.column(c).fill_null(0).to_numpy() for c in ("doc_id", "tie"))
        none = table.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        other = np.ones(len(size), dtype=bool)  # rows that are no copies of the one before
        other[1:] = (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1]) | (none[1:] != none[:-1]) | (size[1:] != size[:-1])
        name = np.cumsum(other)[owner] * (piece.max(initial=0) + 1) + piece
        order = np.lexsort((name, -length))
        b, at, final = pack(length[order], lengths, overhead, attention, name[order])
        used = np.bincount(b, length[order], len(final)).astype(np.int64)
        shard = np.full(len(order), table.column("shard")[0].as_py(), np.int64)
        ids = table.column("doc_id").take(pa.array(owner[order]))
        return pa.table([ids, *map(pa.array, (piece[order], start[order], length[order], shard, b, at, final[b], used[b]))],
                        names=names)

    return run


def best_fit_pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD,
                  attention: int = ATTENTION, shard_rows: int = SHARD_ROWS, in_order: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start and size (words), shard, bin (within the
    shard), bin_offset, bin_length (a permitted length), bin_used.

    Sizes are word counts of whole texts.  Null and empty texts have size 0 and take a place of
    size 0 in some bin; null ids are packed like others; repeated rows are packed each (they agree in all,
    so which is which is immaterial).  An empty table gives no rows; other columns are not read.

    With ``in_order`` the rows of ``docs``, a scan of Parquet files, are in training order: by file name, then by
    place in the file.  A shard is then a stretch of that order, and its number says which.

    The number of shards follows the row count, so a task holds ``shard_rows`` ids and sizes, however
    skewed the sources.  Shards cost at most their last open bins in fill."""
    if not lengths or list(lengths) != sorted(set(lengths)) or lengths[0] < 1:
        raise ValueError(f"lengths must ascend and be positive: {lengths}")
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")] if in_order else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"),
                       F.col("text").alias("text"), *place)
    kept = ", file string, at long" if in_order else ""
    sized = base.mapInArrow(_sizes, "doc_id long, tie long, size long" + kept)
    if in_order:
        # A file's first place is the rows of the files before: one row per file is ranked in one place.
        files = docs.select(place[0]).groupBy("file").agg(F.count("*").alias("n"))
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        salted = sized.join(files, "file").withColumn("shard", F.expr(f"(start + at) div {shard_rows}")).select(
            "doc_id", "tie", "size", "shard")
    else:
        shards = max(1, -(-docs.count() // shard_rows))
        # Rows without an id are dealt by their place, so that many null rows don't meet in one shard.
        salted = sized.withColumn("shard", F.pmod(F.when(
            F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(
            F.xxhash64("doc_id", "tie")), F.lit(shards)))
    return salted.groupBy("shard").applyInArrow(
        _pack_group(tuple(lengths), overhead, attention),
        "doc_id long, piece long, start long, size long, shard long, bin long, bin_offset long, bin_length long, "
        "bin_used long")
