"""Vectorised tokenising of Arrow string columns: word and shingle hashes without Python strings.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 continuation bytes are never
in that set, so byte runs and code-point runs agree.  A word's 64-bit hash is a polynomial
over (optionally A-Z lower-cased) bytes, mixed; it does not depend on the word's position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at once.
SEGMENT = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SHINGLE_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 1)
        for k, b in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, b, U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8)[off[0]:off[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, table: np.ndarray | None = None,
          separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of bytes outside ``separator`` in order, their first byte, and per text
    the index of its first run (``len(texts) + 1`` entries).  A run over a segment's end is carried
    on, so that memory beside the bytes follows the segment."""
    table = table if table is not None else _BYTE_LOWER if lower else _BYTE
    hashes, firsts = [], []
    n = len(data)
    starts_text = np.zeros(n + 1, dtype=bool)
    starts_text[off] = True
    held = 0  # bytes of an unfinished run before this segment
    for at in range(0, n, SEGMENT):
        end = min(at + SEGMENT, n)
        part = data[at:end]
        inside = ~separator[part]
        if held and (not inside[0] or starts_text[at]):
            held = 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | starts_text[at + 1:end]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | starts_text[at + 1:end]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(len(part) + 1)
        run = np.zeros(len(part) + 1, U64)
        np.cumsum(table[part] * up[:len(part)], out=run[1:])
        value = (run[e] - run[s]) * down[s]
        skip = 0
        if held:
            more = int(value[0]) * pow(int(_BASE), held, 1 << 64)
            hashes[-1][-1] = U64((int(hashes[-1][-1]) + more) % (1 << 64))
            held, skip = (held + int(e[0]) if e[0] == len(part) else 0), 1
        if len(s) > skip:
            hashes.append(value[skip:])
            firsts.append(s[skip:] + at)
            held = len(part) - int(s[-1]) if e[-1] == len(part) else 0
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h, f = mix(np.concatenate(hashes)), np.concatenate(firsts)
    return h, f, np.searchsorted(f, off, side="left")


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` (one per byte, or per word with word offsets) by text."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def per_text_float(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by text, each summed on its own."""
    out = np.zeros(len(off) - 1)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, off[some])
    return out


def sequences(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Hash of each run ``h[cut[i]:cut[i + 1]]`` of word hashes, order counting; 0 if empty."""
    up, down = _powers(len(h) + 1)
    run = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[:len(h)], out=run[1:])
    out = mix((run[cut[1:]] - run[cut[:-1]]) * down[cut[:-1]])
    out[cut[1:] == cut[:-1]] = 0
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (those across texts are the caller's to drop)."""
    if len(h) < k:
        return np.zeros(0, U64)
    m = len(h) - k + 1
    out = h[:m] * SHINGLE_MULT[0]
    for j in range(1, k):
        out += h[j:j + m] * SHINGLE_MULT[j]
    return mix(out)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes: runs of ``k`` words; a shorter text is one
    shingle as a whole, a text without words has none."""
    w = windows(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(w[a:b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = np.add.reduce(h[a:b] * SHINGLE_MULT[:b - a], keepdims=True)
            out.append(mix(whole + SHINGLE_MULT[63 - (b - a)]))
        else:
            out.append(np.zeros(0, U64))
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` text bytes, so that memory follows the piece."""
    if batch.num_rows == 0:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
