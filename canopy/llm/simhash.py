"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. A fingerprint bit is set if it is in more than half of the XXH64 hashes of a text's shingles.
2. Every distinct fingerprint emits all variants within half the radius (65 for radius 2) and is
   shuffled on them.  Two fingerprints within the radius share a variant, the one halfway; those that
   share one lie within the radius of each other.  A variant is met by at most as many distinct
   fingerprints as its own ball holds (65), so no group grows with the data, however hot a text is.
3. Neighbours in a variant's sorted list are the colliding pairs; they link what all pairs of the list
   would.  Pairs are deduplicated and verified by their differing bits.
4. Connected components of the fingerprints name the rows' components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .components import connected_components
from .store import stored

BITS, WORDS, RADIUS, SEED = 64, 3, 2, 42
#: Shingles hashed and counted at once.
PORTION = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _normal(data: np.ndarray, off: np.ndarray):
    """Lower-cased words with one blank after each, the words' starts and ends there, and per text the
    index of its first word."""
    inside = ~tx._SPACE[data]
    bound = np.zeros(len(data) + 1, dtype=bool)
    bound[off] = True
    first = inside & (bound[:-1] | ~np.concatenate([[False], inside[:-1]]))
    word = np.cumsum(first)
    kept = np.flatnonzero(inside)
    where = np.arange(len(kept)) + word[kept] - 1
    starts = where[np.searchsorted(kept, np.flatnonzero(first))]
    out = np.full(len(kept) + len(starts), 32, np.uint8)
    out[where] = _LOWER[data[kept]]
    ends = np.append(starts[1:], len(out)) - 1 if len(starts) else starts
    return out.tobytes(), starts, ends, np.concatenate([[0], word])[off]


def fingerprints(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    raw, start, end, first = _normal(data, off)
    n = np.diff(first)
    shingles = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(n)), shingles)
    at = first[owner] + np.arange(begin[-1]) - begin[owner]
    stop = end[at + np.minimum(n[owner], k) - 1] if len(at) else at
    at = start[at] if len(at) else at
    counts = np.zeros((len(n), BITS), np.int64)
    digest = xxhash.xxh64_digest
    for p in range(0, len(at), PORTION):
        some = [digest(raw[a:b], SEED) for a, b in zip(at[p:p + PORTION].tolist(), stop[p:p + PORTION].tolist())]
        bits = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(-1, 8), axis=1)
        texts, cut = np.unique(owner[p:p + PORTION], return_index=True)
        counts[texts] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > shingles[:, None], axis=1).reshape(-1, 8).view(">u8")[:, 0].astype(np.uint64)


def _fingerprint_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                f = fingerprints(*tx.buffers(part.column("text")), k)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(f.view(np.int64))], ["id", "fingerprint"])

    return run


def ball(radius: int) -> list[int]:
    """Masks of up to ``radius`` bits, signed: what a fingerprint is XORed with to give its variants."""
    masks = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def colliding_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of a table of distinct longs ``fingerprint``: verified pairs within ``radius`` bits (an even
    number), enough of them that what is linked within the radius is connected."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: the variants of half of it meet in the middle")
    masks = F.lit(ball(radius // 2)).cast("array<long>")
    variants = distinct.select("fingerprint", F.explode(
        F.transform(masks, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fingerprint").over(Window.partitionBy("variant").orderBy("fingerprint"))
    return variants.select(F.col("fingerprint").alias("u"), before.alias("v")).where("v is not null").distinct().where(
        f"bit_count(u ^ v) <= {radius}")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                       radius: int = RADIUS) -> DataFrame:
    """(``id_col``, fingerprint, component_id), one row per row of ``docs``.

    Texts are A-Z lower-cased; shingles are runs of ``k`` words joined by a blank, repeats included; a
    shorter text is one shingle; null texts and texts without words have fingerprint zero, linked like any
    other.  Rows link at ``radius`` or fewer differing bits; component_id is the smallest id reachable.
    Rows with a null id take part and are returned; a component of null ids alone has a null
    component_id.  Rows that repeat an id are each returned with their own component.  An empty
    table gives no rows; other columns are not read.  Memory follows a slice of texts or the longest one."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    told = stored(base.mapInArrow(_fingerprint_batches(k), "id long, fingerprint long"), "fingerprints")
    classes = stored(told.groupBy("fingerprint").agg(F.min("id").alias("least")), "classes")
    links = connected_components(colliding_pairs(classes.select("fingerprint"), radius))
    named = classes.join(links.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint"))
    named = stored(named, "named")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(first, "component").select("fingerprint", "component_id")
    return told.hint("merge").join(of, "fingerprint").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), BITS // 4, "0")).alias("fingerprint"), "component_id")
