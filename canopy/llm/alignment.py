"""Alignment of two tokenizers' tokens over the bytes they share.

1. A task encodes texts with both tokenizers and, per text, keeps two dictionaries from a token's
   cumulative end (in bytes) to its index.  The intersection of their key sets, sorted, holds the
   common ends: they slice both id lists into groups.  Links are expanded per slice: where one side has
   one token, it links to all of the other; else a token links to those whose bytes it overlaps, which
   is a staircase along the slice's ends.  All slices of a portion are expanded together.
2. Portions are written as blocks: the texts' results, the block's distinct id pairs with their numbers
   of links, and per link its pair's place among them (compressed).  Tokens are made once.
3. Pairs are summed over the blocks, each B id's highest count is found, and each block is answered
   with its own pairs' counts; a block then sums its texts' links.  What is shuffled is distinct pairs
   per block, both ways, never links.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import stored

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes of a block and of a portion encoded at once.
BLOCK, PORTION = 8 << 20, 1 << 20
#: Blocks handed to a task at once.
BATCH_BLOCKS = 2
#: Fixed value: what byte-level BPE takes for words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in a run that the faster matcher is given at most.
MOST_BLANKS = 100_000
#: An id pair is one long: A's id above, B's id below.
B_BITS = 32

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = pa.schema([
    ("block", pa.int64()), ("docs", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _COUNTS],
    ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())),
    ("places", pa.binary())])
_TYPES = ("block long, docs array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, pairs array<long>, links array<long>, places binary")


class Side:
    """One tokenizer: ids of texts, and each id's bytes."""

    def __init__(self, encode, of_id: list[bytes]):
        self.encode, self.of_id = encode, of_id
        self.size = np.array([len(b) for b in of_id], np.int64)
        numbers = [b"%d" % i for i in range(len(of_id))]
        #: The id as decimals, followed by what separates it from the next token.
        self.written = np.array([n + s for n in numbers for s in (b",", b"|", b";")], dtype=object)


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


@lru_cache(maxsize=2)
def byte_level(path: str = TOKENIZER_A) -> Side:
    """A byte-level BPE file.  Where its merges are numbered in order, so that a token's id is its rank, tiktoken
    gives the file's tokens at four times the speed; runs of white space too long for its pattern matcher,
    and other files, are left to the tokenizers library.  The ids are the same (tests/llm compare them)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    byte_of = _byte_of()
    told = json.loads(Path(path).read_text())
    of_id = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        of_id[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    model, added = told["model"], {x["id"] for x in told["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranked = (told["normalizer"] is None and told["pre_tokenizer"] == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(model["vocab"].get("".join(m)) == len(byte_of) + i for i, m in enumerate(merges)))

    def slow(text: str) -> list[int]:
        return t.encode(" " + text, add_special_tokens=False).ids

    if not ranked:
        return Side(lambda texts: [slow(x) for x in texts], of_id)
    fast = tiktoken.Encoding("file", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks={b: i for i, b in enumerate(of_id) if i not in added})
    blanks = re.compile(r"\s{%d}" % MOST_BLANKS)

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow(x) if len(x) > MOST_BLANKS and blanks.search(x) else fast.encode_ordinary(" " + x) for x in texts]

    return Side(encode, of_id)


@lru_cache(maxsize=2)
def pieces(path: str = TOKENIZER_B) -> Side:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    of_id = [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
             for i in range(p.get_piece_size())]
    return Side(lambda texts: p.encode(texts, num_threads=1), of_id)


def groups(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """The indices of the last token of each group, in A and in B."""
    at_a = dict(zip(ends_a, range(len(ends_a))))
    at_b = dict(zip(ends_b, range(len(ends_b))))
    common = sorted(at_a.keys() & at_b.keys())
    return [at_a[e] for e in common], [at_b[e] for e in common]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def links(last_a: np.ndarray, last_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray):
    """(A's index, B's index) of each overlapping pair, slice by slice.  ``last_*``: last token of each slice;
    ``end_*``: cumulative ends, rising over all slices."""
    first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
    plain = (n_a == 1) | (n_b == 1)
    many = np.where(plain, np.maximum(n_a, n_b), 0)
    step = _within(many)
    a = np.repeat(first_a, many) + step * np.repeat(n_a > 1, many)
    b = np.repeat(first_b, many) + step * np.repeat(n_b > 1, many)
    if plain.all():
        return a, b
    # A staircase: each end of either side closes one overlap.
    odd = ~plain
    in_a = np.repeat(first_a[odd], n_a[odd]) + _within(n_a[odd])
    in_b = np.repeat(first_b[odd], n_b[odd]) + _within(n_b[odd])
    ends = np.union1d(end_a[in_a], end_b[in_b])
    return (np.append(a, in_a[np.searchsorted(end_a[in_a], ends)]), np.append(b, in_b[np.searchsorted(end_b[in_b], ends)]))


def _digests(ids_a, ids_b, last_a, last_b, cuts, side_a: Side, side_b: Side) -> list[str]:
    """Per text the hash of its groups as written out.  ``cuts``: first token, of both sides, of each text."""
    n_a, n_b, k = len(ids_a), len(ids_b), len(last_a)
    close_a, close_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    close_a[last_a], close_b[last_b] = 1, 2
    group_a = np.repeat(np.arange(k), np.diff(last_a, prepend=-1))
    group_b = np.repeat(np.arange(k), np.diff(last_b, prepend=-1))
    flat = np.empty(n_a + n_b, dtype=object)
    flat[np.arange(n_a) + np.append(0, last_b + 1)[group_a]] = side_a.written[3 * ids_a + close_a]
    flat[np.arange(n_b) + (last_a + 1)[group_b]] = side_b.written[3 * ids_b + close_b]
    flat = flat.tolist()
    return [hashlib.sha256(b"".join(flat[p:q])[:-1]).hexdigest() if q > p else "" for p, q in zip(cuts[:-1], cuts[1:])]


def align(texts: list[str], side_a: Side, side_b: Side):
    """Per text n_a, n_b, n_groups, n_links (rows of one array) and groups_sha256; per link its id pair."""
    out = np.zeros((4, len(texts)), np.int64)
    ids_a, ids_b, last_a, last_b = [], [], [], []
    some = [i for i, t in enumerate(texts) if t]
    for i, a, b in zip(some, side_a.encode([texts[i] for i in some]), side_b.encode([texts[i] for i in some])):
        raw = b" " + texts[i].encode()
        if b"".join(map(side_a.of_id.__getitem__, a)) != raw or b"".join(map(side_b.of_id.__getitem__, b)) != raw:
            continue
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        x, y = groups(np.cumsum(side_a.size[a]).tolist(), np.cumsum(side_b.size[b]).tolist())
        out[:3, i] = len(a), len(b), len(x)
        ids_a.append(a)
        ids_b.append(b)
        last_a += x
        last_b += y
    if not ids_a:
        return out, [""] * len(texts), np.zeros(0, np.int64)
    ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
    begin_a, begin_b = np.cumsum(out[0]) - out[0], np.cumsum(out[1]) - out[1]
    last_a = np.array(last_a) + np.repeat(begin_a, out[2])
    last_b = np.array(last_b) + np.repeat(begin_b, out[2])
    a, b = links(last_a, last_b, np.cumsum(side_a.size[ids_a]), np.cumsum(side_b.size[ids_b]))
    owner = np.repeat(np.arange(len(texts)), out[0])
    whose = owner[a]
    out[3] = np.bincount(whose, minlength=len(texts))
    order = np.argsort(whose, kind="stable")  # plain slices come before staircases
    cuts = np.append(0, np.cumsum(out[0] + out[1])).tolist()
    return (out, _digests(ids_a, ids_b, last_a, last_b, cuts, side_a, side_b),
            (ids_a[a] << B_BITS | ids_b[b])[order])


def _encode_blocks(path_a: str, path_b: str, block_bytes: int):
    def block(name: int, docs: list, counts: list, shas: list, pairs: list) -> pa.RecordBatch:
        place, distinct = pd.factorize(np.concatenate(pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        packed = pa.compress(place.astype(np.int32).tobytes(), codec="zstd", asbytes=True)
        values = [[name], [pa.concat_arrays(docs)], *[[c] for c in np.concatenate(counts, axis=1)], [shas], [distinct],
                  [np.bincount(place, minlength=len(distinct))], [packed]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        side_a, side_b = byte_level(path_a), pieces(path_b)
        name = TaskContext.get().partitionId() << 32
        held, size = ([], [], [], []), 0
        for batch in batches:
            for part in tx.slices(batch, "text", PORTION):
                counts, shas, pairs = align(part.column("text").to_pylist(), side_a, side_b)
                for kept, new in zip(held, (part.column("id"), counts, shas, pairs)):
                    kept += new if new is shas else [new]
                size += part.column("text").nbytes
                if size >= block_bytes:
                    yield block(name, *held)
                    name, held, size = name + 1, ([], [], [], []), 0
        if held[0]:
            yield block(name, *held)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            n_links = row["n_links"].values.to_numpy()
            n = int(n_links.sum())
            raw = pa.decompress(row["places"].as_buffer(), decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
            place = np.frombuffer(raw, np.int32)
            total, best = np.zeros((2, len(row["pairs"].values)), np.int64)
            if n:
                told = row["counts"].values
                at = told.field("place").to_numpy()
                total[at] = told.field("total").to_numpy()
                best[at] = told.field("best").to_numpy()
            off = np.append(0, np.cumsum(n_links))
            sums = [tx.per_text(x[place], off) for x in (best, total)]
            yield pa.RecordBatch.from_arrays(
                [row["docs"].values, *[row[c].values for c in _COUNTS], *map(pa.array, sums), row["groups_sha256"].values],
                ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best) of all id pairs: links that hold it, and whether no pair of its B id has more."""
    total = stored(blocks.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.links").alias("total")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b")
    most = total.groupBy(b).agg(F.max("total").alias("most"))
    return total.select("pair", "total", b).join(most, "b").select(
        "pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align_tokenizers(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B,
                     id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    ``tokenizer_a`` (a byte-level BPE file) encodes a blank and the text, ``tokenizer_b`` (a piece file that
    adds the blank) the text, both without special tokens.  Null and empty texts, and those whose
    tokens' bytes don't give blank and text, have zeros and an empty hash.  Null ids and repeated rows are
    returned as they come, and count; an empty table gives no rows; other columns are not read.  A whole
    text is encoded at once, so memory follows the longest text, or a portion, and a block's links."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = stored(base.mapInArrow(_encode_blocks(tokenizer_a, tokenizer_b, block_bytes), _TYPES), "blocks", batch_rows=1000)
    own = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    counts = own.hint("merge").join(pair_counts(blocks), "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "total", "best")).alias("counts"))
    answered = blocks.drop("links").hint("merge").join(counts.hint("merge"), "block", "left").select(
        "docs", *_COUNTS, "groups_sha256", "pairs", "places", "counts")
    return stored(answered.mapInArrow(_sum_blocks, T.StructType([
        T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType())
        for c in ("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")])), "aligned", BATCH_BLOCKS)
