"""LM scoring: a gated recurrent model over whole documents, with corpus-wide counts.

1. Texts become blocks: per block the distinct words (64-bit hashes, with a shape code) and, per token,
   the word's index in its block.  Blocks are written once; later steps read them, not the texts.
2. Word counts of the training documents: blocks send their distinct words with local counts to hash
   buckets, buckets sum and answer each block.  The traffic is distinct words per block, both ways.
   The number of buckets follows the traffic.
3. The model (``gru``): the ``VOCABULARY`` most frequent words are symbols, the others are classes by
   shape, in which a word has its smoothed corpus count's share.  Class and word biases start from
   whole-corpus counts.
4. Every training document goes to a shard by a hash of its id and text, and stands there in the order of that
   hash; the number of shards follows the corpus.  Recurrent weights start from the first part of one shard.  In
   ``ROUNDS`` rounds each shard then learns its next part from the weights that all share, and the shards' weights
   are averaged as integers, so that neither partitions nor the order of tasks changes them.
5. Each block is scored with its counts; a document's state is carried over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from . import text as tx
from .store import partitions, stored

VOCABULARY, CLASSES, SHAPES = 1536, 24, 32
#: Tokens of a shard, and the learning rates: of the start's passes, and of the rounds.
SHARD_TOKENS = 8_000_000
START_RATES, RATES = (0.006, 0.002), (0.003, 0.002, 0.001)
ROUNDS = len(RATES)
#: Weights are averaged in units of this.
UNIT = 2.0 ** -40
BLOCK = 5 << 20
#: Texts, and blocks of texts, handed to a task at once.  Blocks are scored together, so that a long text's last steps
#: stand beside more others.
BATCH_ROWS, BATCH_BLOCKS = 1600, 6
BUCKET_WORDS = 1_000_000
SMOOTH = 0.1

_LAST = np.full(256, 7, np.uint8)
_LAST[97:123] = 0
_LAST[128:] = 0
for _i, _c in enumerate((b".", b",", b"!", b"#*$%&", b"|", b"0123456789"), 1):
    _LAST[list(_c)] = _i


def tokenise(data: np.ndarray, off: np.ndarray):
    """(word hashes, shape codes, first word per text)."""
    h, start, first = tx.words(data, off, lower=True)
    stop = np.ones(len(data) + 1, dtype=bool)
    stop[:-1] = tx._SPACE[data]
    stop[off] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, side="right")] if len(start) else start
    wide = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data >= 0x80, dtype=np.int32, out=wide[1:])
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    last = np.where((last >= 65) & (last < 91), 97, last)
    shape = _LAST[last] * 4 + 2 * (wide[end] > wide[start]) + ((end - start) > 6)
    return h, shape.astype(np.uint8), first


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one at a time, as a block's row is large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in tx.slices(batch, "text", BLOCK):
            h, shape, first = tokenise(*tx.buffers(part.column("text")))
            words, at, index = np.unique(h, return_index=True, return_inverse=True)
            train = np.repeat(~part.column("held").to_numpy(zero_copy_only=False), np.diff(first))
            counts = np.bincount(index, train, len(words)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([part.column("held").to_pylist()], pa.list_(pa.bool_())),
                 pa.array([part.column("mark").to_pylist()], pa.list_(pa.int64())),
                 pa.array([len(words)], pa.int64()),
                 *(pa.array([x], pa.binary()) for x in (
                     first.astype(np.int64).tobytes(), _packed(index.astype(np.uint32)), words.tobytes(),
                     shape[at].tobytes(), counts.tobytes()))],
                ["block", "ids", "held", "marks", "distinct", "first", "index", "words", "shapes", "counts"])
            name += 1


def _scatter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words = np.frombuffer(row["words"], np.uint64)
                shapes, counts = np.frombuffer(row["shapes"], np.uint8), np.frombuffer(row["counts"], np.uint32)
                own = (words % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(buckets + 1))
                some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                take = [order[cuts[b]:cuts[b + 1]] for b in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()),
                     *(pa.array([x[i].tobytes() for i in take], pa.binary()) for x in (words, shapes, counts))],
                    ["bucket", "block", "words", "shapes", "counts"])

    return run


_ANSWER = ("bucket long, block long, counts binary, types long, tokens long, top array<struct<word:long,n:long,shape:int>>, "
           "shape_tokens array<long>, shape_types array<long>")


def _sum_bucket(table: pa.Table) -> pa.Table:
    """Total of each word over the blocks: an answer per block, and a row (block null) of totals."""
    words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    shapes = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("shapes").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    cuts = np.cumsum([len(w) for w in words])[:-1]
    all_words, at, index = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    total = np.bincount(index, counts, len(all_words)).astype(np.int64)
    shape = shapes[at]
    top = np.lexsort((all_words, -total))[:VOCABULARY]
    top = top[total[top] > 0]
    known = total > 0
    entries = [{"word": int(w), "n": int(n), "shape": int(s)} for w, n, s in
               zip(all_words[top].view(np.int64).tolist(), total[top].tolist(), shape[top].tolist())]
    answers = np.split(total[index], cuts)
    n = len(answers) + 1
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "bucket": pa.array([bucket] * n, pa.int64()),
        "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
        "counts": pa.array([*(a.tobytes() for a in answers), None], pa.binary()),
        "types": pa.array([None] * (n - 1) + [int(known.sum())], pa.int64()),
        "tokens": pa.array([None] * (n - 1) + [int(total.sum())], pa.int64()),
        "top": pa.array([None] * (n - 1) + [entries], pa.list_(pa.struct(
            [("word", pa.int64()), ("n", pa.int64()), ("shape", pa.int32())]))),
        "shape_tokens": pa.array([None] * (n - 1) + [np.bincount(shape, total, SHAPES).astype(np.int64).tolist()],
                                 pa.list_(pa.int64())),
        "shape_types": pa.array([None] * (n - 1) + [np.bincount(shape[known], minlength=SHAPES).tolist()],
                                pa.list_(pa.int64()))})


class Model:
    """Vocabulary, layout and weights.  Symbols: frequent words, then shapes, then the end mark."""

    def __init__(self, top: list[tuple[int, int, int]], shape_tokens: np.ndarray, shape_types: np.ndarray,
                 documents: int):
        words = np.array([w for w, _, _ in top], np.int64).view(np.uint64)
        n = np.array([c for _, c, _ in top], np.int64)
        shape = np.array([s for _, _, s in top], np.int64)
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.known = len(words)
        self.rest = shape_tokens - np.bincount(shape, n, SHAPES).astype(np.int64)
        types = shape_types - np.bincount(shape, minlength=SHAPES)
        self.norm = np.log10(self.rest + SMOOTH * (types + 1))
        self.layout = gru.Layout(np.concatenate([n, self.rest, [documents]]), SHAPES + 1, CLASSES)
        self.weights = gru.initial(self.layout)

    def symbols(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = self.known + shapes.astype(np.int64)
        if self.known:
            at = np.searchsorted(self.words, words)
            at[at == self.known] = 0
            hit = self.words[at] == words
            out[hit] = self.order[at[hit]]
        return out

    @property
    def end(self) -> int:
        return self.known + SHAPES

    def with_ends(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with the end mark after each text, and the texts' offsets."""
        docs = len(first) - 1
        out = np.full(len(symbols) + docs, self.end, np.int64)
        out[np.arange(len(symbols)) + np.repeat(np.arange(docs), np.diff(first))] = symbols
        return out, first + np.arange(docs + 1)


def _flat(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_SHARD = pa.schema([("shard", pa.int64()), ("marks", pa.binary()), ("sizes", pa.binary()), ("symbols", pa.binary())])
_SHARD_TYPES = "shard long, marks binary, sizes binary, symbols binary"


def _shard_row(shard: int, marks: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in (
            marks.tobytes(), sizes.tobytes(), _packed(symbols)))], schema=_SHARD)


def _read_shard(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], np.int64)
    return np.frombuffer(row["marks"], np.int64), sizes, _unpacked(row["symbols"], int(sizes.sum()), np.uint16)


def _take(symbols: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The symbols of the given documents, one after the other."""
    start = np.cumsum(sizes) - sizes
    n = sizes[docs]
    return symbols[np.repeat(start[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _deal(model: Model, shards: int):
    """A block's training documents as symbols, a row per shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                first = np.frombuffer(row["first"], np.int64)
                index = _unpacked(row["index"], int(first[-1]), np.uint32)
                by_word = model.symbols(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["shapes"], np.uint8))
                symbols, off = model.with_ends(by_word[index], first)
                marks, sizes = np.array(row["marks"], np.int64), np.diff(off)
                own = (marks.view(np.uint64) % np.uint64(shards)).astype(np.int64)
                own[np.array(row["held"], dtype=bool)] = -1
                for s in np.unique(own[own >= 0]).tolist():
                    docs = np.flatnonzero(own == s)
                    yield _shard_row(s, marks[docs], sizes[docs], _take(symbols, sizes, docs).astype(np.uint16))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard (rows come sorted by it), its documents in the order of their marks."""
    held, name = [], None

    def done() -> pa.RecordBatch:
        marks, sizes, symbols = (np.concatenate(x) for x in zip(*held))
        # Documents alike in id and text have one mark and the same symbols.
        order = np.lexsort((sizes, marks))
        return _shard_row(name, marks[order], sizes[order], _take(symbols, sizes, order))

    for batch in batches:
        for row in _rows(batch):
            if name is not None and row["shard"] != name:
                yield done()
                held = []
            name = row["shard"]
            held.append(_read_shard(row))
    if held:
        yield done()


def _learn(model: Model, part: int, parts: int, rates: tuple[float, ...]):
    """Per shard its tokens of a part, and the weights that it learns from them (a pass per rate) in units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, sizes, symbols = _read_shard(row)
                off = np.concatenate([[0], np.cumsum(sizes)])
                a, b = part * len(sizes) // parts, (part + 1) * len(sizes) // parts
                weights, opt = {k: v.copy() for k, v in model.weights.items()}, None
                own = symbols[off[a]:off[b]].astype(np.int64)
                for rate in rates:
                    if opt is not None:
                        opt.rate = rate
                    opt = gru.train(weights, model.layout, own, off[a:b + 1] - off[a], rate, opt=opt)
                if b > a:
                    units = np.rint(_flat(weights).astype(np.float64) / UNIT).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([1], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([units.tobytes()], pa.binary())],
                        ["shards", "tokens", "weights"])

    return run


def _add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards, tokens, total = 0, 0, 0
    for batch in batches:
        for k, n, w in zip(batch.column("shards").to_pylist(), batch.column("tokens").to_pylist(), batch.column("weights")):
            total = total + np.frombuffer(w.as_buffer(), np.int64)
            shards, tokens = shards + k, tokens + n
    if shards:
        yield pa.RecordBatch.from_arrays([pa.array([shards], pa.int64()), pa.array([tokens], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], ["shards", "tokens", "weights"])


_WEIGHTS = "shards long, tokens long, weights binary"


def _fitted(model: Model, blocks: DataFrame, train_tokens: int) -> dict:
    """The weights learned from all training documents."""
    spark = blocks.sparkSession
    shards = max(1, -(-train_tokens // SHARD_TOKENS))
    dealt = blocks.select("held", "marks", "first", "index", "words", "shapes").mapInArrow(_deal(model, shards), _SHARD_TYPES)
    table = stored(dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_gather, _SHARD_TYPES), "shards", 64)

    def averaged(learned: DataFrame) -> tuple[int, dict]:
        """Tokens learned and the mean of the shards' weights; sums of integers, in any order."""
        sums = learned.repartition(max(1, min(shards, int(partitions(spark) ** 0.5)))).mapInArrow(_add_weights, _WEIGHTS).collect()
        total = sum(np.frombuffer(r["weights"], np.int64).astype(object) for r in sums)
        mean = (total / sum(r["shards"] for r in sums)).astype(np.float64) * UNIT
        return sum(r["tokens"] for r in sums), _shaped(mean, model.weights)

    first = table.agg(F.min("shard")).first()[0]
    _, model.weights = averaged(table.where(F.col("shard") == first).mapInArrow(_learn(model, 0, ROUNDS, START_RATES), _WEIGHTS))
    seen = 0
    for part, rate in enumerate(RATES):
        tokens, model.weights = averaged(table.mapInArrow(_learn(model, part, ROUNDS, (rate,)), _WEIGHTS))
        seen += tokens
    if seen != train_tokens:
        raise RuntimeError(f"learned from {seen} tokens of {train_tokens}")
    return model.weights


def _score_blocks(model: Model, types: int, train_tokens: int):
    norm = np.log10(train_tokens + SMOOTH * (types + 1))

    def told(row: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """A block's columns but the score, its symbols and their offsets, and what rare words add to a score."""
        words, shapes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["shapes"], np.uint8)
        first = np.frombuffer(row["first"], np.int64)
        index = _unpacked(row["index"], int(first[-1]), np.uint32)
        count = np.zeros(len(words), np.int64)
        own = words % np.uint64(row["buckets"])
        for a in row["answers"] or ():
            count[own == a["bucket"]] = np.frombuffer(a["counts"], np.int64)
        docs = len(first) - 1
        lg = np.log10(count + SMOOTH)
        by_word = model.symbols(words, shapes)
        inner = np.where(by_word >= model.known, lg - model.norm[shapes], 0.0)
        per = lambda x: tx.per_text_float(x[index], first)
        sizes = np.diff(first) + 1
        base = per(lg) + np.log10(row["documents"] + SMOOTH) - sizes * norm
        known = tx.per_text((count > 0)[index], first) + (row["documents"] > 0)
        columns = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(known),
                   pa.array(np.full(docs, train_tokens, np.int64)), pa.array(base)]
        symbols, off = model.with_ends(by_word[index], first)
        return columns, symbols, off, per(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = [told(row) for row in _rows(batch)]
            ends = np.cumsum([0, *(len(symbols) for _, symbols, _, _ in blocks)])
            p = gru.score(model.weights, model.layout, np.concatenate([symbols for _, symbols, _, _ in blocks]),
                          np.concatenate([[0], *(off[1:] + e for (_, _, off, _), e in zip(blocks, ends))]))
            for (columns, _, off, inner), a, b in zip(blocks, ends, ends[1:]):
                total = tx.per_text_float(p[a:b].astype(np.float64), off) / np.log(10) + inner
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(total)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probabilities of the whole text).

    Learns from rows with crc32(id as text) mod 10 not 0 (a null id counts as the empty string).  Null
    and empty texts are just the end mark; repeated rows are counted and returned each; with no
    training rows the model scores with its smoothed start; an empty table gives no rows; other columns
    are not read.  Scores don't depend on how the rows are partitioned, beyond the last digits of single-precision
    products."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held"),
        F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("mark"), F.col(text_col).alias("text"))
    blocks = stored(base.mapInArrow(
        _block_batches, "block long, ids array<long>, held array<boolean>, marks array<long>, distinct long, first binary, "
        "index binary, words binary, shapes binary, counts binary"), "blocks", BATCH_ROWS)
    traffic, documents = blocks.agg(
        F.sum("distinct"), F.sum(F.size(F.filter("held", lambda x: ~x)).cast("long"))).first()
    documents = int(documents or 0)
    buckets = max(1, -(-int(traffic or 0) // BUCKET_WORDS))
    parts = blocks.select("block", "words", "shapes", "counts").mapInArrow(
        _scatter(buckets), "bucket long, block long, words binary, shapes binary, counts binary")
    answers = stored(parts.groupBy("bucket").applyInArrow(_sum_bucket, _ANSWER), "counts")

    totals = answers.where("block is null")
    types, tokens = totals.agg(F.sum("types"), F.sum("tokens")).first()
    types, train_tokens = int(types or 0) + (documents > 0), int(tokens or 0) + documents
    by_shape = totals.select(F.posexplode(F.arrays_zip("shape_tokens", "shape_types"))).groupBy("pos").agg(
        F.sum("col.shape_tokens").alias("t"), F.sum("col.shape_types").alias("y")).collect()
    shape_tokens, shape_types = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in by_shape:
        shape_tokens[r["pos"]], shape_types[r["pos"]] = r["t"], r["y"]
    top = totals.select(F.inline("top")).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    model = Model([(r["word"], r["n"], r["shape"]) for r in top], shape_tokens, shape_types, documents)

    if documents:
        model.weights = _fitted(model, blocks, train_tokens)
    reply = answers.where("block is not null").groupBy("block").agg(
        F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    full = blocks.drop("counts", "distinct", "marks").join(reply, "block", "left").withColumn(
        "buckets", F.lit(buckets).cast("long")).withColumn("documents", F.lit(documents).cast("long"))
    return stored(full.drop("block").mapInArrow(
        _score_blocks(model, types, train_tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double"), "scores", BATCH_BLOCKS)
