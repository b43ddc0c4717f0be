"""SimHash, whitening and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canopy.llm import alignment, queries, simhash, whitening
from canopy.llm import text as tx

SF_SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [None, "", " \t\n\x0b\f\r ", "one", "One", "a b", "a b c d", "é😀 漢字 ß É", "x" * 30000, "w " * 40000, "\n\n\na\n\n",
           "Ab aB AB", "nbsp\xa0stays here", "tab\tsep\x0bline", "▁ in the text", "<|endoftext|> </s> <s> <unk> <0x41>",
           "\x00 nul", "   leading   blanks  "]


def docs_of(spark, texts, ids=None):
    rows = [((i if ids is None else ids[i]), t, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, block long")


def least_reachable(n, linked):
    comp = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b) and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    return comp


# ---- 11 SimHash -----------------------------------------------------------------------------

def fingerprint(t, k=3):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
    grams = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_components(rows, prints):
    """rows: (id or None, fingerprint, component) in the order of prints."""
    ids = [r[0] for r in rows]
    comp = least_reachable(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for i, r in enumerate(rows):
        assert r[1] == f"{prints[i]:016x}"
        reach = [ids[j] for j in range(len(ids)) if comp[j] == comp[i] and ids[j] is not None]
        assert r[2] == (min(reach) if reach else None)


def test_simhash_of_awkward_texts(spark):
    ids = [*range(len(AWKWARD) - 2), None, 3]
    got = simhash.simhash_components(docs_of(spark, AWKWARD, ids).repartition(3)).collect()
    want = sorted((str(i), f"{fingerprint(t):016x}") for i, t in zip(ids, AWKWARD))
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == want
    by = {(str(i), f"{fingerprint(t):016x}"): (i, fingerprint(t)) for i, t in zip(ids, AWKWARD)}
    ordered = sorted(got, key=lambda r: (str(r.doc_id), r.fingerprint))
    check_components([tuple(r) for r in ordered], [by[str(r.doc_id), r.fingerprint][1] for r in ordered])


def test_simhash_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_ball_hashing(spark, SF_SMALL).collect()}
    check_components([got[r.doc_id] for r in rows], [fingerprint(r.text) for r in rows])
    assert len(set(r[2] for r in got.values())) < len(rows)


def test_portions_give_the_same_fingerprints(monkeypatch):
    import pyarrow as pa

    data, off = tx.buffers(pa.array([t or "" for t in AWKWARD]))
    whole = simhash.fingerprints(data, off)
    monkeypatch.setattr(simhash, "PORTION", 3)
    assert (simhash.fingerprints(data, off) == whole).all()


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_ball_hashing_links_what_all_pairs_link(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64).tolist()
    some = set(base) | {0, (1 << 64) - 1}
    for b in base:
        for _ in range(12):
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                b ^= 1 << bit
            some.add(b)
    some = sorted(some)
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    table = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    pairs = [(r.u % 2**64, r.v % 2**64) for r in simhash.colliding_pairs(table, radius).collect()]
    assert len(pairs) == len(set(pairs))
    assert all((a ^ b).bit_count() <= radius for a, b in pairs)
    linked = {frozenset((some.index(a), some.index(b))) for a, b in pairs}
    want = least_reachable(len(some), lambda a, b: (some[a] ^ some[b]).bit_count() <= radius)
    got = least_reachable(len(some), lambda a, b: frozenset((a, b)) in linked)
    assert [want.index(c) for c in want] == [got.index(c) for c in got]


def test_ball_hashing_edges():
    assert len(simhash.ball(0)) == 1 and len(simhash.ball(1)) == 65 and len(simhash.ball(2)) == 65 + 64 * 63 // 2
    with pytest.raises(ValueError):
        simhash.colliding_pairs(None, 3)


def test_simhash_of_an_empty_table(spark):
    assert simhash.simhash_components(docs_of(spark, [])).collect() == []


# ---- 12 whitening ---------------------------------------------------------------------------

def vectors_of(spark, vectors, ids=None):
    rows = [((i if ids is None else ids[i]), v, 1, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component string")


def check_whitening(got, vectors, components=32):
    """got: rows of equal order of ids 0..n-1; compares with the covariance's own eigenvectors."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n = len(x)
    S = x.sum(axis=0)
    centred = ((n * x - S) / n).astype(np.float64)
    cov = centred.T @ centred / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == n * k
    W = np.array([[by[i, j + 1].whitened for j in range(k)] for i in range(n)])
    assert np.abs(W.T @ W / n - np.eye(k)).max() < 1e-9
    for i in range(n):
        r = by[i, 1]
        assert r.n == n and r.deviation == int(((n * x[i] - S) ** 2).sum())
        assert r.identity_error < 1e-9
    for j in range(k):
        assert by[0, j + 1].explained == pytest.approx(e[j] / cov.trace(), rel=1e-9)
        gap = min([abs(e[j] - e[m]) for m in range(len(e)) if m != j] or [1]) / e[0]
        if gap > 1e-6:
            want = centred @ vec[:, j] / np.sqrt(e[j])
            assert min(np.abs(W[:, j] - want).max(), np.abs(W[:, j] + want).max()) < 1e-7


def test_whitening_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    kept = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    got = queries.op12_lanczos_whitening(spark, SF_SMALL).collect()
    place = {r.vec_id: i for i, r in enumerate(kept)}
    assert len(place) == len(kept)
    check_whitening([type(r)(**r.asDict() | {"vec_id": place[r.vec_id]}) for r in got], [r.embedding for r in kept])


def test_whitening_drops_rows_and_keeps_repeats(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((60, 5)) * [5, 4, 3, 2, 1]).tolist()
    good += [good[0]] * 5
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0, -math.inf]]
    table = vectors_of(spark, good + bad).repartition(4)
    check_whitening(whitening.whiten(table).collect(), good)
    check_whitening(whitening.whiten(table, components=2).collect(), good, 2)


def test_whitening_with_equal_and_zero_eigenvalues(spark):
    # Four directions of one variance, one of another, three without any.
    rows = [[8.0 * s * (i == j) for j in range(4)] + [16.0 * s * (i == 0), 1.0, 1.0, 1.0] for i in range(4) for s in (1, -1)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    check_whitening(got, rows)
    assert {r.component for r in got} == {1, 2, 3, 4}


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [None, [math.nan]])).collect() == []
    assert whitening.whiten(vectors_of(spark, [[1.0, 2.0]])).collect() == []
    assert whitening.whiten(vectors_of(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whiten(vectors_of(spark, [[], []])).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(vectors_of(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError):
        whitening.whiten(vectors_of(spark, [[1e16], [2e16], [3e16]]))


def test_whitening_over_blocks_and_null_ids(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = (rng.standard_normal((50, 6)) * 3).tolist()
    monkeypatch.setattr(whitening, "BLOCK", 18)
    got = whitening.whiten(vectors_of(spark, rows, [None] * 2 + [*range(48)])).collect()
    assert len(got) == 50 * 6 and sum(r.vec_id is None for r in got) == 12


def test_bidiagonal_form():
    class Local:
        d, n = 7, 90
        x = np.random.default_rng(5).standard_normal((90, 7)) * np.geomspace(1, 1e-4, 7)

        def centred_sums(self, of, size):
            return of(self.x)

    V, B = whitening.bidiagonalise(Local())
    assert np.abs(V.T @ V - np.eye(7)).max() < 1e-13
    assert np.abs(np.tril(B, -1)).max() == np.abs(np.triu(B, 2)).max() == 0
    assert np.allclose(np.linalg.svd(B)[1], np.linalg.svd(Local.x)[1], rtol=1e-10)


# ---- 13 alignment ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sides():
    return alignment.byte_level(), alignment.pieces()


def brute(texts, sides):
    """Result rows by all pairs of tokens."""
    made, count = [], Counter()
    for t in texts:
        a, b = ((s.encode([t])[0] if t else []) for s in sides)
        raw = b" " + (t or "").encode()
        if any(b"".join(s.of_id[i] for i in ids) != raw for s, ids in zip(sides, (a, b))):
            a = b = []
        spans = []
        for s, ids in zip(sides, (a, b)):
            end, out = 0, []
            for i in ids:
                out.append((i, end, end + len(s.of_id[i])))
                end += len(s.of_id[i])
            spans.append(out)
        pairs = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        common = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, at = [], 0
        for e in common:
            groups.append("|".join(",".join(str(x[0]) for x in s if at < x[2] <= e) for s in spans))
            at = e
        made.append((len(a), len(b), groups, pairs))
        count.update(pairs)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(a, b, len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, p in made]


@pytest.mark.parametrize("block_bytes", [200, 1 << 24])
def test_alignment_of_awkward_texts(spark, sides, block_bytes):
    texts = [t if t is None or len(t) < 1000 else t[:1000] for t in AWKWARD] + ["Unbelievably, tokenisation differs: naïve 漢字漢字!"] * 3
    ids = [*range(len(texts) - 2), None, 3]
    got = alignment.align_tokenizers(docs_of(spark, texts, ids).repartition(3), block_bytes=block_bytes).collect()
    want = sorted((str(i), *r) for i, r in zip(ids, brute(texts, sides)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    by = {r[0]: r for r in want}
    assert by["14"][1:] == (0, 0, 0, 0, 0, 0, "") and by["15"][1] > 0


def test_alignment_of_the_whole_table(spark, sides):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text")).collect()
    table = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in alignment.align_tokenizers(table).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows], sides)
    whole = queries.op13_tokenizer_alignment(spark, SF_SMALL).collect()
    assert len(whole) == len(rows) and sum(r.n_links for r in whole) > sum(r.n_a for r in whole)


def test_ids_are_the_tokenizers_librarys(spark, sides):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.TOKENIZER_A)
    t.encode_special_tokens = True
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    texts += [x for x in AWKWARD if x] + ["a" + " " * 150_000 + "b", "\n" * 99_999 + " x", " \u3000\x85\u2028 z"]
    odd = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}1 {c} {c}{c}b'{c}s\n{c}" for c in odd[i:i + 64]) for i in range(0, len(odd), 64)]
    want = [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]
    assert sides[0].encode(texts) == want


def test_links_along_a_staircase():
    # One slice of 3 and 4 tokens without an inner common end, between two plain slices.
    end_a, end_b = np.array([2, 5, 9, 12, 15]), np.array([2, 4, 6, 10, 12, 15])
    last_a, last_b = map(np.array, alignment.groups(end_a.tolist(), end_b.tolist()))
    assert last_a.tolist() == [0, 3, 4] and last_b.tolist() == [0, 4, 5]
    a, b = alignment.links(last_a, last_b, end_a, end_b)
    start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
    want = {(i, j) for i in range(5) for j in range(6) if start_a[i] < end_b[j] and start_b[j] < end_a[i]}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokenizers(docs_of(spark, [])).collect() == []
