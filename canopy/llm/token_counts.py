"""Token counts of a unigram tokenizer by trie-shared dynamic programming.

The vocabulary's pieces come from a public tokenizer file; nothing is trained.  The file ranks its
pieces, and a piece of rank r gets the log probability of a Zipf law over ranks,
ln(1 / (r + ZIPF_SHIFT)) less the log of their sum; a character without a piece costs its UTF-8
bytes as byte pieces (the file's fallback), at the lowest piece's score each.  A pre-token is a word
with the word-start mark before it; its segmentation is the one of greatest score (the fewest
pieces, if equal).

The distinct pre-tokens of a portion of a task's text are inserted in a trie, level by level.  A node's
forward score depends on its prefix alone, so it is computed once for all pre-tokens that share
it; terminals store the score and the number of pieces.  Texts then sum their words' terminals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ZIPF_SHIFT = 2.7
#: Text bytes whose distinct pre-tokens share a trie, and pre-tokens inserted at once.
PORTION, INSERT = 16 << 20, 100_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def pieces(path: str = TOKENIZER) -> list[str]:
    """The file's ordinary pieces by rank."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


def scores(vocabulary: list[str]) -> np.ndarray:
    raw = -np.log(np.arange(len(vocabulary)) + ZIPF_SHIFT)
    return raw - np.log(np.exp(raw).sum())


class Vocabulary:
    """Pieces by length, looked up by the hash of their code points."""

    def __init__(self, vocabulary: list[str]):
        points = [np.array([ord(c) for c in p], np.uint64) for p in vocabulary]
        score = scores(vocabulary)
        self.longest = max(map(len, points))
        self.fallback = float(score.min())
        self.hashes, self.scores, self.sieve = [], [], []
        for n in range(1, self.longest + 1):
            at = [i for i, p in enumerate(points) if len(p) == n]
            h = np.array([self.hash(points[i]) for i in at], np.uint64)
            order = np.argsort(h)
            self.hashes.append(h[order])
            self.scores.append(score[at][order])
            sieve = np.zeros(1 << 18, dtype=bool)
            sieve[tx.mix(h) >> np.uint64(46)] = True
            self.sieve.append(sieve)

    @staticmethod
    def hash(points: np.ndarray) -> int:
        out = 0
        for c in points.tolist():
            out = (out * int(_MULT) + c + 1) % (1 << 64)
        return out

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``h`` holds pieces of length ``n``, and their scores."""
        table = self.hashes[n - 1]
        maybe = np.flatnonzero(self.sieve[n - 1][tx.mix(h) >> np.uint64(46)])
        if not len(maybe) or not len(table):
            return maybe[:0], np.zeros(0)
        at = np.searchsorted(table, h[maybe])
        at[at == len(table)] = 0
        hit = table[at] == h[maybe]
        return maybe[hit], self.scores[n - 1][at[hit]]


@lru_cache(maxsize=2)
def _vocabulary(names: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(list(names))


def trie_forward(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best score and number of pieces of each word (with its mark), one trie over all of them."""
    most = vocabulary.longest
    size = np.array([len(w) for w in words], np.int64) + 1
    flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    best, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
    alive = np.arange(len(words))
    node = np.zeros(len(words), np.int64)
    # Of the nodes of the level: hashes of their last 1.. characters, forward scores and counts of
    # themselves (column 0) and their ancestors.
    suffix = np.zeros((1, most), np.uint64)
    score, made = np.full((1, most), -np.inf), np.zeros((1, most), np.int64)
    score[0, 0] = 0.0
    depth = 0
    while len(alive):
        char = flat[start[alive] + depth].astype(np.int64)
        keys, first, inverse = np.unique(node[alive] << 21 | char, return_index=True, return_inverse=True)
        parent, c = node[alive][first], char[first].astype(np.uint64) + np.uint64(1)
        above, above_n = score[parent], made[parent]
        h = np.empty((len(keys), most), np.uint64)
        h[:, 0] = c
        h[:, 1:] = suffix[parent][:, :-1] * _MULT + c[:, None]
        bytes_of = np.searchsorted([0x80, 0x800, 0x10000], keys & 0x1FFFFF, side="right") + 1
        new, new_n = above[:, 0] + bytes_of * vocabulary.fallback, above_n[:, 0] + bytes_of
        known = np.zeros(len(keys), dtype=bool)
        for n in range(1, min(most, depth + 1) + 1):
            at, s = vocabulary.find(n, h[:, n - 1])
            if not len(at):
                continue
            s, m = s + above[at, n - 1], above_n[at, n - 1] + 1
            if n == 1:  # a character with a piece has no byte fallback
                known[at] = True
                new[at], new_n[at] = s, m
                continue
            better = (s > new[at]) | ((s == new[at]) & (m < new_n[at]))
            new[at[better]], new_n[at[better]] = s[better], m[better]
        suffix = h
        score, made = np.empty((len(keys), most)), np.empty((len(keys), most), np.int64)
        score[:, 0], score[:, 1:] = new, above[:, :-1]
        made[:, 0], made[:, 1:] = new_n, above_n[:, :-1]
        node[alive] = inverse
        depth += 1
        ends = size[alive] == depth
        best[alive[ends]], count[alive[ends]] = new[inverse[ends]], new_n[inverse[ends]]
        alive = alive[~ends]
    return best, count


def _count_batches(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(names)
        for batch in batches:
            for part in tx.slices(batch, "text", PORTION):
                data, off = tx.buffers(part.column("text"))
                h, at, first = tx.words(data, off)
                _, where, inverse = np.unique(h, return_index=True, return_inverse=True)
                raw = data.tobytes()
                inside = ~tx._SPACE[data]
                stop = np.zeros(len(data) + 1, dtype=bool)
                stop[:-1] = ~inside
                stop[off] = True
                stops = np.flatnonzero(stop)
                begin = at[where]
                end = stops[np.searchsorted(stops, begin, side="right")] if len(begin) else begin
                distinct = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist())]
                order = sorted(range(len(distinct)), key=distinct.__getitem__)
                score, count = np.zeros(len(order)), np.zeros(len(order), np.int64)
                for i in range(0, len(order), INSERT):
                    some = order[i:i + INSERT]
                    score[some], count[some] = trie_forward([distinct[j] for j in some], vocabulary)
                run_s = np.concatenate([[0.0], np.cumsum(score[inverse])]) if len(h) else np.zeros(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)),
                     pa.array(tx.per_text(count[inverse], first)),
                     pa.array(np.round(run_s[first[1:]] - run_s[first[:-1]], 4))],
                    ["doc_id", "n_words", "n_tokens", "log_prob"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, log_prob) of each row's whole text, without a shuffle.

    Null and empty texts have 0 tokens; null ids and repeated rows are returned as they come; an
    empty table gives no rows; other columns are not read.  The closure carries the vocabulary, whose
    size the file bounds.  Memory follows ``PORTION``, ``INSERT`` and the longest text."""
    names = tuple(pieces(str(Path(tokenizer))))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_count_batches(names), "doc_id long, n_words long, n_tokens long, log_prob double")
