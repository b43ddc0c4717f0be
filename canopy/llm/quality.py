"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits as 0, white space as one blank, trimmed) and hashed.
Per host the distinct documents (by content: copies of a text are one document) with a line are
counted.  Lines in more than ``MIN_DOCUMENTS`` documents of a host and in more than ``max_percent``
percent of its distinct documents with words are removed from all of them, so a line's fate does not
depend on the table's size.  A document that keeps less than ``min_left_percent`` of its words, or fewer
than ``MIN_WORDS``, is depleted and rejected, and so is one that fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import stored

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MIN_DOCUMENTS, MAX_PERCENT, MIN_LEFT_PERCENT = 5, 2, 50

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_NORMAL = tx._BYTE_LOWER.copy()
_NORMAL[48:58] = _NORMAL[48]

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("key", pa.int64()),
                     *[(c, pa.int64()) for c in STATS.replace(" long", "").split(", ")],
                     ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))])


def _duplicates(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more within their owner."""
    k = key ^ tx.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(k)
    same = k[order[1:]] == k[order[:-1]]
    flag = np.zeros(len(k), dtype=bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def _line_hashes(data: np.ndarray, off: np.ndarray):
    """(normalised hash, words, first byte) per non-empty line, first line of each text."""
    raw, at, first = tx.words(data, off, separator=_NEWLINE)
    h, start, _ = tx.words(data, off, table=_NORMAL)
    cut = np.append(np.searchsorted(start, at), len(h))
    return raw, tx.sequences(h, cut), np.diff(cut), at, first


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text, and its lines."""
    h, _, first = tx.words(data, off)
    n = np.diff(first)
    inside = ~tx._SPACE[data] & ((data & 0xC0) != 0x80)
    raw, line, in_line, _, first_line = _line_hashes(data, off)
    owner = np.repeat(np.arange(len(n)), np.diff(first_line))
    real = in_line > 0
    r, o = raw[real], owner[real]
    k = r ^ tx.mix(o.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(k, return_index=True)
    earlier = np.ones(len(k), np.int64)
    earlier[at] = 0
    w = tx.windows(h, WINDOW)
    word_owner = np.repeat(np.arange(len(n)), n)
    whole = word_owner[:len(w)] == word_owner[WINDOW - 1:] if len(w) else np.zeros(0, dtype=bool)
    spots = np.flatnonzero(whole)
    twice = spots[_duplicates(w[spots], word_owner[spots])]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return {"n_words": n, "word_chars": tx.per_text(inside, off), "n_symbols": tx.per_text(_SYMBOL[data], off),
            "n_dup_lines": np.bincount(o, earlier, len(n)).astype(np.int64),
            "n_repeat_words": tx.per_text(np.cumsum(cover[:-1]) > 0, first),
            "line": line[real].view(np.int64), "line_words": in_line[real], "line_owner": o}


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text"):
            m = measure(*tx.buffers(part.column("text")))
            order = np.lexsort((m["line"], m["line_owner"]))
            line, own, many = (m[c][order] for c in ("line", "line_owner", "line_words"))
            new = np.ones(len(line), dtype=bool)
            new[1:] = (line[1:] != line[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(new)
            total = np.add.reduceat(many, at) if len(at) else np.zeros(0, np.int64)
            ends = np.searchsorted(own[at], np.arange(part.num_rows + 1)).astype(np.int32)
            lines = pa.StructArray.from_arrays([pa.array(line[at]), pa.array(total.astype(np.int64))], ["line", "words"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host"), part.column("key"),
                 *[pa.array(m[c].astype(np.int64)) for c in _SCHEMA.names[3:8]],
                 pa.ListArray.from_arrays(pa.array(ends), lines)], schema=_SCHEMA)


def line_frequency(docs: DataFrame, host_col: str = "source", min_documents: int = MIN_DOCUMENTS,
                   max_percent: int = MAX_PERCENT, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, host, key (hash of the text), the base measures, base_failed,
    words_removed, removed (hashes of the lines to remove, null if none), kept.

    A null text has no words (and fails); a null host is a host of its own; rows with a null id
    count and are judged; repeated rows are each returned, and share their verdict.  An empty table
    gives no rows; other columns are not read.

    Lines are counted per (host, line, text), and a host's texts once, both summed map-side.  Only lines in
    more than ``min_documents`` documents meet their host's count, and only lines above the limit meet
    the rows again; AQE can split both joins' hot keys."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).alias("host"),
                       F.xxhash64("text").alias("key"), F.col("text").alias("text"))
    told = base.mapInArrow(_measure_batches, "doc_id long, host string, key long, " + STATS +
                           ", lines array<struct<line:long,words:long>>")
    told = stored(told.withColumn("row", F.monotonically_increasing_id()), "lines")
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("host")
    lines = told.select("row", host, "key", F.explode("lines").alias("l")).select("row", "host", "key", "l.line", "l.words")
    often = (lines.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count("*").alias("documents"))
             .where(F.col("documents") > min_documents))
    texts = told.where("n_words > 0").select(host, "key").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    frequent = often.join(texts, "host").where(100 * F.col("documents") > max_percent * F.col("texts")).select("host", "line")
    gone = lines.join(frequent, ["host", "line"]).groupBy("row").agg(
        F.sum("words").alias("words_removed"), F.collect_list("line").alias("removed"))
    left = F.col("n_words") - F.col("words_removed")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (told.drop("lines").join(gone, "row", "left").drop("row")
            .withColumn("words_removed", F.coalesce("words_removed", F.lit(0)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (left >= MIN_WORDS) & (100 * left >= min_left_percent * F.col("n_words"))))


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes from each text the lines whose hashes ``removed`` lists."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts, gone = [], batch.column("removed")
        for i in range(batch.num_rows):
            value = batch.column(at)[i]
            if gone[i].is_valid and value.is_valid:
                raw = value.as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                _, line, n, first, _ = _line_hashes(data, np.array([0, len(data)]))
                drop = set(first[np.isin(line.view(np.int64), np.array(gone[i].as_py(), np.int64)) & (n > 0)].tolist())
                pieces, p = [], 0
                for piece in raw.split(b"\n"):
                    if p not in drop:
                        pieces.append(piece)
                    p += len(piece) + 1
                value = pa.scalar(b"\n".join(pieces).decode())
            texts.append(value.as_py())
        out = batch.set_column(at, pa.field("text", pa.string()), pa.array(texts, pa.string()))
        yield out.drop_columns(["removed"])


def clean_documents(docs: DataFrame, **limits: int) -> DataFrame:
    """The kept documents without their removed lines (n_chars follows), with the columns of
    ``docs``; see ``line_frequency`` for its cases."""
    from .store import with_columns_free

    p = with_columns_free(docs, "key", "id", "host")
    found = line_frequency(docs, **limits).where("kept").select(
        F.col("doc_id").alias(p + "id"), F.col("host").alias(p + "host"), F.col("key").alias(p + "key"),
        "removed").dropDuplicates([p + "id", p + "host", p + "key"])
    on = (F.col("doc_id").eqNullSafe(F.col(p + "id")) & F.col("source").eqNullSafe(F.col(p + "host"))
          & (F.xxhash64("text") == F.col(p + "key")))
    held = [c for c in docs.columns if c.lower() == "removed"]
    kept = docs.drop(*held).join(found, on).select(*[c for c in docs.columns if c not in held], "removed")
    stripped = kept.where("removed is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    out = kept.where("removed is null").drop("removed").unionByName(
        stripped.mapInArrow(_strip_batches, fields).withColumn(
            "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[c for c in docs.columns if c not in held])
