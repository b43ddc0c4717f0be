"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import (boosting, chat, gru, lm, mixing, ngram_join, packing, pages, pii, quality, queries, spotsigs,
                        token_counts)
from canopy.llm import text as tx

SF_SMALL = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the quick brown fox jumps over the lazy dog and runs to the river of gold with a friend in the night "
         "while stars that shine on water move slowly towards the east")
AWKWARD = [None, "", " \t\n\x0b\f\r ", "one", "a b c d", "é😀 漢字 ß", "x" * 3000, "w " * 4000, "\n\n\na\n\n", "Ab aB AB",
           "call +1 (386) 555-3733 or a.b@c.d.e 1.2.3.4 4897493547069810 now", PROSE, PROSE, PROSE.upper(),
           PROSE + " extra words", "nbsp stays here", "tab\tsep\x0bline"]


def doc_rows(texts, start=0, source="s0"):
    return [(start + i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = doc_rows(AWKWARD) + [(None, "null id here", None, None, None), (3, "one", "en", "s0", 3)]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def words_of(t):
    return WORD.findall(t or "")


# ---- text -----------------------------------------------------------------------------------

def test_word_hashes_agree_with_words_across_segments(monkeypatch):
    import pyarrow as pa

    texts = [t or "" for t in AWKWARD] * 3
    data, off = tx.buffers(pa.array(texts))
    whole = tx.words(data, off, lower=True)
    for segment in (1, 7, 64):
        monkeypatch.setattr(tx, "SEGMENT", segment)
        part = tx.words(data, off, lower=True)
        assert all((a == b).all() for a, b in zip(whole, part))
    flat = [w.encode().lower() for t in texts for w in words_of(t)]
    assert len(flat) == len(whole[0])
    assert len(set(flat)) == len(np.unique(whole[0]))
    by = {}
    assert all(by.setdefault(w, h) == h for w, h in zip(flat, whole[0].tolist()))


# ---- 1 packing ------------------------------------------------------------------------------

def test_packing_places_every_word_once(spark, awkward):
    lengths = (8, 32, 64)
    rows = packing.best_fit_pack(awkward, lengths, shard_rows=5).collect()
    want = sorted(len(words_of(t)) for t in [*AWKWARD, "null id here", "one"])
    by_doc = Counter()
    for (doc, shard), own in itertools.groupby(sorted(rows, key=lambda r: (str(r.doc_id), r.shard)), lambda r: (r.doc_id, r.shard)):
        by_doc[doc] += sum(r["size"] for r in own)
    assert sum(by_doc.values()) == sum(want)
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: (r.bin_offset, r["size"]))
        at = 0
        for r in own:
            assert r.bin_offset == at
            at += r["size"]
        used, length = own[0].bin_used, own[0].bin_length
        assert at == used <= length and length == min(c for c in lengths if c >= used)
    assert packing.best_fit_pack(awkward.limit(0), lengths).count() == 0


def slow_pack(sizes, lengths, copies):
    """Bin of each item, trying every open bin and every length."""
    left, pushed, holds, out, clock = [], [], [], [], 0
    for i, s in enumerate(sizes):
        fit = [b for b, x in enumerate(left) if x >= s and x > 0 and copies[i] not in holds[b]]
        if fit:
            b = min(fit, key=lambda b: (left[b], -pushed[b]))
        else:
            def cost(c):
                small = [x for x in sizes[i + 1:] if x <= c - s]
                longer = sum(x > c - s for x in sizes[i + 1:])
                fill = s + min(c - s, sum(small) / (longer + 1))
                return (c + packing.OVERHEAD + c * c / packing.ATTENTION) / max(1, fill), c
            left.append(min((c for c in lengths if c >= s), key=cost))
            pushed.append(0)
            holds.append(set())
            b = len(left) - 1
        left[b] -= s
        clock += 1
        pushed[b] = clock
        holds[b].add(copies[i])
        out.append(b)
    return out


def test_best_fit_equals_trying_every_bin_and_length():
    rng = np.random.default_rng(1)
    for k in range(20):
        sizes = np.sort(rng.integers(1, 600, 80))[::-1]
        copies = np.arange(80) if k % 2 else np.cumsum(np.r_[True, (sizes[1:] != sizes[:-1]) | (rng.random(79) < 0.3)])
        b, _, final = packing.pack(sizes, (64, 256, 1024), copies=copies)
        assert b.tolist() == slow_pack(sizes.tolist(), (64, 256, 1024), copies.tolist())
        assert (np.bincount(b, sizes) <= final).all()
        assert len({(x, y) for x, y in zip(b.tolist(), copies.tolist())}) == 80 or k % 2


def test_several_lengths_win_on_a_mixed_table():
    sizes = np.sort(np.minimum(np.random.default_rng(2).lognormal(5.5, 1.4, 4000).astype(int) + 1, 8192))[::-1]
    spent = {}
    for lengths in (packing.LENGTHS, (2048, 4096, 8192)):
        _, _, final = packing.pack(sizes, lengths)
        spent[lengths] = sum(c + packing.OVERHEAD + c * c / packing.ATTENTION for c in final.tolist())
        if lengths == packing.LENGTHS:
            assert len(set(final.tolist())) >= 3
    assert spent[packing.LENGTHS] <= spent[2048, 4096, 8192]
    # Without anything to fill it up, a long sequence isn't opened.
    assert packing.pack(np.array([900]), packing.LENGTHS)[2].tolist() == [1024]


def test_packing_keeps_the_training_order_and_copies_apart(spark, tmp_path):
    rows = doc_rows([f"{PROSE} {i} " * (i % 7 + 1) for i in range(60)])
    order = [rows[i % 60] for i in range(180)]      # three passes
    spark.createDataFrame(order, DOCS).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(order, DOCS).repartition(4).write.parquet(str(tmp_path / "b"))
    for name, shard_rows in (("a", 50), ("b", 60), ("a", 1000)):
        docs = spark.read.parquet(str(tmp_path / name))
        places = {}
        for n, r in enumerate(docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()):
            places.setdefault(r.doc_id, []).append(n // shard_rows)
        got = packing.best_fit_pack(docs, shard_rows=shard_rows, in_order=True).collect()
        found = {}
        for r in got:
            found.setdefault(r.doc_id, []).append(r.shard)
        assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in places.items()}
        assert len({(r.doc_id, r.piece, r.shard, r.bin) for r in got}) == len(got) == 180


# ---- 2 personal data ------------------------------------------------------------------------

def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_and_extra_spans(spark):
    rng = np.random.default_rng(3)
    parts = ["a", "@", ".", "1", "2", "+", " ", "-", "(", ")", "25", "é", "b.c", "\n", "😀", "4897493547069810", "+1 (386) 555-3733"]
    texts = AWKWARD + ["a@b.c_x@y.zz ++12 345 678 901-- 1.2.3.4.5.6.7.8 001.002.003.0004", "5" * 20000 + " " + "a" * 20000,
                       "a@b.co " * 1500] + ["".join(rng.choice(parts, 60)) for _ in range(150)]
    df = spark.createDataFrame(doc_rows(texts), DOCS)
    for r in pii.find_pii(df).select("text", "base", "spans").collect():
        assert [tuple(s) for s in r.base] == base_spans(r.text or "")
        spans = [tuple(s) for s in r.spans]
        assert set(map(tuple, r.base)) <= set(spans)
        extra = [s for s in spans if s not in set(map(tuple, r.base))]
        for a, b in itertools.product(extra, spans):
            assert a == b or a[2] <= b[0] or b[2] <= a[0]


def test_pii_trees_add_what_the_rules_miss_and_leave_prose_alone(spark):
    texts = ["please call (555) 123-4567 now", "write to jane.doe[at]example[dot]com today", "version 1.2.3.4000 and 5@10 each", PROSE]
    rows = pii.find_pii(spark.createDataFrame(doc_rows(texts), DOCS)).orderBy("doc_id").collect()
    assert [(s.kind, r.text[s.start:s.end]) for r in rows for s in r.spans] == [
        (3, "(555) 123-4567"), (0, "jane.doe[at]example[dot]com")]


def planted_personal_data(n, seed):
    """(text, wanted spans): disguised personal data in invented prose, and look-alikes."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9)))

    def card(valid):
        while True:
            d = str(rng.integers(4, 6)) + digits(15)
            if luhn(d) == valid:
                return d

    good = [lambda: ("email", f"{word()}.{word()}[at]{word()}[dot]com"), lambda: ("email", f"{word()} (at) {word()}.org"),
            lambda: ("ip", ",".join(str(rng.integers(1, 255)) for _ in range(4))),
            lambda: ("card", "/".join(re.findall("....", card(True)))), lambda: ("card", ".".join(re.findall("....", card(True)))),
            lambda: ("phone", f"({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"),
            lambda: ("phone", f"{rng.integers(200, 999)}-{rng.integers(200, 999)}-{rng.integers(1000, 9999)}")]
    lead = {"email": ["write to", "e-mail", "contact"], "ip": ["host", "login from", "server"], "card": ["card", "paid by visa", "credit card:"],
            "phone": ["call", "phone:", "mobile"]}
    bad = [lambda: ("version", ".".join(str(rng.integers(0, 2000)) for _ in range(4))), lambda: ("order", digits(12)),
           lambda: ("id", card(False)), lambda: ("date", f"20{digits(2)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}"),
           lambda: ("total", f"{digits(3)}.{digits(3)},{digits(2)}"), lambda: (word(), f"{digits(1)}@{digits(2)}"), lambda: (word(), card(False))]
    out = []
    for k in range(n):
        head, tail = " ".join(word() for _ in range(4)), " ".join(word() for _ in range(3))
        if k % 2:
            what, value = bad[k // 2 % len(bad)]()
            out.append((f"{head} {what} {value} {tail}", []))
        else:
            kind, value = good[k // 2 % len(good)]()
            text = f"{head} {rng.choice(lead[kind])} {value} {tail}"
            out.append((text, [(text.index(value), pii.KINDS.index(kind), text.index(value) + len(value))]))
    return out


def test_added_spans_on_planted_data(spark):
    """Precision and recall of what the trees add (README has the figures)."""
    planted = planted_personal_data(700, 5)
    df = spark.createDataFrame(doc_rows([t for t, _ in planted]), DOCS)
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    right = added = wanted = 0
    for i, (_, want) in enumerate(planted):
        base = set(map(tuple, rows[i].base))
        new = {tuple(s) for s in rows[i].spans} - base
        right += len(new & set(want))
        added += len(new)
        wanted += len(set(want) - base)
    print(f"precision {right / added:.3f} recall {right / wanted:.3f} of {wanted}")
    assert right / added > 0.95 and right / wanted > 0.7


def test_neighbouring_numbers_are_found(spark):
    """Cards and phones side by side, which the base rules drop as one match of too many digits."""
    text = "La 4539578763621486 4716461583322103 et +1 (826) 555-4081 190.137.223.204 fin 9807915762804491"
    r = pii.find_pii(spark.createDataFrame(doc_rows([text]), DOCS)).first()
    assert [text[s.start:s.end] for s in r.base] == ["190.137.223.204"]
    assert [text[s.start:s.end] for s in r.spans] == ["4539578763621486", "4716461583322103", "+1 (826) 555-4081", "190.137.223.204"]


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(0)
    m = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * m - 0.5)))).astype(float)
    slope, shift = pii.calibrated(m, y)
    assert slope == pytest.approx(0.7, abs=0.06) and shift == pytest.approx(-0.5, abs=0.1)


def test_boosted_trees_as_sql_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    trees = boosting.boost(x, (x[:, 0] + x[:, 1] > 5).astype(float), rounds=8)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = [r[0] for r in df.select(boosting.as_column(trees, [F.col(c) for c in "abc"])).collect()]
    assert sorted(got) == pytest.approx(sorted(boosting.margins(trees, x)))


def test_many_spans_in_one_text(spark):
    one = "ip 10.20.30.40 or 10,20,30,40 mail a.b@c.de "
    df = spark.createDataFrame(doc_rows([one * 8000]), DOCS)
    start = time.time()
    r = pii.find_pii(df).select(F.size("base"), F.size("spans")).first()
    out = pii.redact(df).first().text
    assert time.time() - start < 40
    assert r[0] == 16_000 and r[1] >= r[0]
    assert out.count("[EMAIL]") == 8000 and out.count("[IP]") >= 8000 and "10.20.30.40" not in out
    short = pii.redact(spark.createDataFrame(doc_rows([one * 3]), DOCS)).first().text
    assert out == (short[:len(short) // 3]) * 8000


def test_clusters_and_cut_text_against_brute_force(spark):
    from canopy.llm.exprs import PIECE, clusters, cut_text

    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        n = int(rng.integers(1, 3 * PIECE)) if k else 2 * PIECE
        text = "".join(rng.choice(list("ab é漢\n"), n))
        at = sorted(set(rng.integers(0, n, rng.integers(0, 9)).tolist()))
        spans = sorted((a, min(n, a + int(rng.integers(1, 300)))) for a in at)
        rows.append((text, spans))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:bigint,end:bigint>>")
    joined = F.transform(clusters(F.col("spans")), lambda c: F.struct(
        F.get(c, F.lit(0))["start"].alias("start"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end")))
    out = df.withColumn("cuts", joined).select("text", "spans", "cuts", F.when(F.size("cuts") > 0, cut_text(
        F.col("text"), F.col("cuts"), lambda s: F.lit("[X]"))).otherwise(F.col("text")).alias("cut")).collect()
    for r in out:
        want = []
        for a, b in r.spans:
            if want and a < want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert [list(c) for c in r.cuts] == want
        text, last = "", 0
        for a, b in want:
            text, last = text + r.text[last:a] + "[X]", b
        assert r.cut == text + r.text[last:]


def test_redaction_replaces_spans_only(spark):
    df = spark.createDataFrame(doc_rows(["é mail a@b.co, ip 1.2.3.4!", PROSE, None]), DOCS).withColumn("spans", F.lit("mine"))
    rows = pii.redact(df).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["é mail [EMAIL], ip [IP]!", PROSE, None]
    assert rows[0].n_chars == len(rows[0].text) and rows[0].spans == "mine" and rows[1].n_chars == len(PROSE)


# ---- 3 quality ------------------------------------------------------------------------------

def base_measures(t):
    t = t or ""
    w = words_of(t)
    runs = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {p for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(cover)


def test_quality_against_brute_force(spark):
    junk = "Buy now at shop 12\n"
    rows = doc_rows([f"{PROSE} {i}\n{junk}" for i in range(6)]) + doc_rows([f"{junk}tiny {i} a b c d e f g\n{junk * (i % 2)}" for i in range(5)], 100)
    rows += doc_rows([f"{PROSE} other {i}\nBuy  NOW at shop 77" for i in range(2)], 200, "s1") + doc_rows(AWKWARD, 300, None)
    rows += [(None, f"{PROSE}\n{junk}", None, "s0", 1), rows[0], rows[0]]
    floor, percent = 4, 60
    norm = lambda line: re.sub("[0-9]", "0", " ".join(words_of(line)).translate({c: c + 32 for c in range(65, 91)}))
    holders, texts_of = {}, {}
    for i, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if words_of(line):
                holders.setdefault((s, norm(line)), set()).add(t)
                texts_of.setdefault(s, set()).add(t)
    often = {k for k, v in holders.items() if len(v) > floor and 100 * len(v) > percent * len(texts_of[k[0]])}
    want = []
    for i, t, _, s, _ in rows:
        n, c, sym, dup, rep = base_measures(t)
        gone = sum(len(words_of(x)) for x in (t or "").split("\n") if words_of(x) and (s, norm(x)) in often)
        failed = n < 10 or 100 * rep > 20 * n
        want.append((i, n, c, sym, dup, rep, failed, not failed and n - gone >= 10 and 100 * (n - gone) >= quality.MIN_LEFT_PERCENT * n, gone))
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("lines", F.lit("x"))
    got = quality.line_frequency(df, min_documents=floor, max_percent=percent).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(x[-1] for x in want) and any(not x[6] and not x[7] for x in want)
    cleaned = quality.clean_documents(df, min_documents=floor, max_percent=percent)
    assert cleaned.columns == df.columns
    texts = [r.text for r in cleaned.collect()]
    assert not any(junk.strip() in t for t in texts)
    assert any("shop 77" in t for t in texts)
    # The same share of more documents: above the floor, below a higher percentage.
    assert not any(r.words_removed for r in quality.line_frequency(df, min_documents=floor, max_percent=100).collect())
    assert not any(r.words_removed for r in quality.line_frequency(df, min_documents=100, max_percent=1).collect())
    assert quality.line_frequency(df.limit(0)).count() == 0


def test_lines_are_removed_at_the_sizes_of_the_correctness_check(spark):
    rows = queries.op3_line_frequency(spark, "/root/testdata/sf0.01").collect()
    removed = [r for r in rows if r.words_removed]
    assert removed and all(r.words_removed < r.n_words for r in removed if r.kept)
    assert sum(r.kept for r in removed) > 0.9 * sum(not r.base_failed for r in removed)


# ---- 4 language model -----------------------------------------------------------------------

def test_lm_counts_and_held_out_gain(spark):
    df = documents(spark)
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in df.collect()]
    rows += [(None, [None]), (7_000_001, [None])]
    counts = Counter(w for i, ws in rows if zlib.crc32(str(i if i is not None else "").encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    more = spark.createDataFrame([(None, None, "en", "x", 0), (7_000_001, "", "en", "x", 0)], DOCS)
    out = lm.score_documents(df.unionByName(more)).collect()
    by_id = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        ws = by_id[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score_documents(df.limit(0)).count() == 0


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    """Every token of every training row reaches the recurrent model, and no text the driver."""
    df, collected = documents(spark), []
    whole = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: collected.append(self.columns) or whole(self))
    learnt, trained = [], lm._learn

    def counted(*args):
        run, into = trained(*args), spark.sparkContext.accumulator(0)
        learnt.append((args[1:], into))

        def each(batches):
            for out in run(batches):
                into.add(sum(out.column("tokens").to_pylist()))
                yield out
        return each

    monkeypatch.setattr(lm, "_learn", counted)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    out = lm.score_documents(df).first()
    assert [part for (part, _, _), _ in learnt[1:]] == list(range(lm.ROUNDS))
    assert sum(a.value for _, a in learnt[1:]) == out.train_tokens > 3 * lm.SHARD_TOKENS
    assert not collected


def test_lm_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 30_000)
    monkeypatch.setattr(lm, "BLOCK", 100_000)
    df = documents(spark).unionByName(documents(spark).where("doc_id % 17 = 0").withColumn("text", F.lit("a b c")))
    runs = []
    for parts in (1, 4, 16):
        out = lm.score_documents(df.repartition(parts, F.rand(parts))).collect()
        runs.append(sorted((r.doc_id, r.n_tokens, r.score) for r in out))
    for other in runs[1:]:
        assert all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6) for a, b in zip(runs[0], other))


def test_gru_gradient_and_carried_state():
    layout = gru.Layout(np.array([50, 30, 20, 10, 5, 5, 9]), 3, 2)
    p = {k: v.astype(np.float64) for k, v in gru.initial(layout).items()}
    rng = np.random.default_rng(0)
    for k in p:
        p[k] += rng.normal(0, 0.2, p[k].shape)
    symbols = rng.integers(0, 7, 41)
    off = np.array([0, 9, 10, 41])
    whole = gru.score(p, layout, symbols, off)
    old, gru.WINDOW = gru.WINDOW, 4  # the state is carried, so windows don't matter to scores
    try:
        assert gru.score(p, layout, symbols, off, lanes=2) == pytest.approx(whole, rel=1e-4)
    finally:
        gru.WINDOW = old
    # Probabilities of all symbols add up to one.
    h = rng.normal(0, 1, (1, gru.HIDDEN))
    assert np.exp(gru.log_probs(p, layout, np.repeat(h, 7, 0), np.arange(7))).sum() == pytest.approx(1)

    class Keep(gru.Adam):
        def update(self, q, g):
            self.g = {k: v.copy() for k, v in g.items()}

    opt = Keep(p, 0.1)
    gru.train(p, layout, symbols[:20], np.array([0, 12, 20]), 0.1, opt=opt)
    loss = lambda: -gru.score(p, layout, symbols[:20], np.array([0, 12, 20])).astype(float).sum() / 20
    for k in ("u", "wc", "ww", "x", "bw"):
        at = np.unravel_index(np.abs(opt.g[k]).argmax(), opt.g[k].shape)
        keep, e = p[k][at], 1e-2
        p[k][at] = keep + e
        up = loss()
        p[k][at] = keep - e
        down = loss()
        p[k][at] = keep
        assert opt.g[k][at] == pytest.approx((up - down) / (2 * e), rel=0.03)


# ---- 5 token counts -------------------------------------------------------------------------

def test_token_counts_against_all_segmentations():
    vocab = ["▁", "a", "b", "ab", "▁a", "ba", "abab", "é", "bé", "▁ab"]
    score = dict(zip(vocab, token_counts.scores(vocab)))
    v = token_counts.Vocabulary(vocab)

    def best(w):
        out = []

        def go(rest, s, n):
            if not rest:
                out.append((-s, n))
                return
            for k in range(1, v.longest + 1):
                if rest[:k] in score and len(rest) >= k:
                    go(rest[k:], s + score[rest[:k]], n + 1)
            if rest[0] not in score:
                b = len(rest[0].encode())
                go(rest[1:], s + b * v.fallback, n + b)

        go("▁" + w, 0.0, 0)
        return min((round(s, 9), n) for s, n in out)

    words = ["".join(p) for n in range(1, 6) for p in itertools.product("abéx", repeat=n)][:600] + ["漢😀"]
    s, n = token_counts.trie_forward(words, v)
    for w, x, m in zip(words, s, n):
        want = best(w)
        assert (round(-x, 9), m) == pytest.approx(want)


def test_token_counts_rows(spark, awkward):
    out = token_counts.count_tokens(awkward.withColumn("n_words", F.lit("clash"))).collect()
    v = token_counts.Vocabulary(token_counts.pieces())
    assert len(out) == awkward.count()
    by = {(r.doc_id, r.n_words): r for r in out}
    for i, t in enumerate(AWKWARD):
        ws = words_of(t)
        s, n = token_counts.trie_forward(ws, v) if ws else (np.zeros(1), np.zeros(1, int))
        assert by[i, len(ws)].n_tokens == n.sum()
        assert by[i, len(ws)].log_prob == pytest.approx(s.sum(), abs=1e-3)


# ---- 6 mixing -------------------------------------------------------------------------------

def test_mix_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "w " * int(rng.integers(0, 40)), "en", s, 0) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None], 400, p=[.5, .3, .1, .06, .04]))]
    rows += [(None, None, None, "a", None), (9000, "z " * 30, "en", "b", 0), (9000, "z " * 30, "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(3 * sizes[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        free -= over
    target = {s: share[s] if s in free else 3 * sizes[s] for s in order}
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r["size"] and r.copies <= 3
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 40
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    t = spark.range(1).select(*[mixing.position(F.lit(u), F.lit(s)) for s in (-0.5, 0.0, 0.5) for u in (0.0, 0.3, 1.0)]).first()
    for x, (s, u) in zip(t, [(s, u) for s in (-0.5, 0.0, 0.5) for u in (0.0, 0.3, 1.0)]):
        assert (1 - s) * x + s * x * x == pytest.approx(u)


# ---- 7 fingerprints -------------------------------------------------------------------------

def spot_set(f):
    return {f[i:i + 8] for i in range(0, len(f), 8)}


def test_fingerprints_of_edits(spark):
    rows = doc_rows(AWKWARD) + [(None, "null id the one here now", None, None, None), (3, "another three", "en", "s0", 3), (3, "one", "en", "s0", 3)]
    df = spark.createDataFrame(rows, DOCS).withColumn("tie", F.lit(1))
    out = spotsigs.fingerprint_edits(df).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t or "")
    by_text = {}
    for r in out:
        assert r.n_chars in {len(t) for t in texts[r.doc_id]}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    # Ids that occur once, with a next that occurs once, have one right edit.
    ids = sorted((i for i in texts if i is not None), reverse=True)
    for a, b in zip(ids, ids[1:]):
        if a != 3 and b != 3:
            t, nx = next(iter(texts[a])), next(iter(texts[b]))
            cut = len(t) // 3
            edited = t[:len(t) - cut] + nx[:cut]
            r = next(r for r in out if r.doc_id == a)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            x, y = spot_set(r.fingerprint), spot_set(r.edited_fingerprint)
            assert r.near_edited == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
    for r in out:
        if len(texts[r.doc_id]) == 1:
            assert by_text.setdefault(next(iter(texts[r.doc_id])), r.fingerprint) == r.fingerprint
    assert by_text[""] == "" and by_text[" \t\n\x0b\f\r "] == ""
    assert spotsigs.fingerprint_edits(df.limit(0)).count() == 0


def test_near_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    sets = []
    for i in range(60):
        base = list(range(1000 * (i // 4), 1000 * (i // 4) + 40))
        sets.append(sorted({x if rng.random() > 0.06 * (i % 4) else x + 500 for x in base}))
    sets += [sets[0], [], [7], [7]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sigs array<long>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    reps = [i for i, s in enumerate(sets) if s and first[tuple(s)] == i]
    want = {frozenset((a, b)) for a, b in itertools.combinations(reps, 2)
            if len(set(sets[a]) & set(sets[b])) >= 0.75 * len(set(sets[a]) | set(sets[b]))}
    got = {frozenset((r.u, r.v)) for r in spotsigs.near_pairs(df).collect()}
    assert got == want and want


# ---- 8 pages --------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Home</a></li><li><a>More</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site for many reasons
and more words to make it long enough to look like prose of an article in itself.</p></div><aside>Side text</aside>
<article><h1>Head &amp; tail</h1><p><b>First  line<br>goes &lt;on&gt;</b></p><p>Two.<p>Three&nbsp;&eacute;</p><div class="ad">Buy this now</div>
<form><input value="q"><label>Search</label></form><!-- note <p>no</p> --></article>
<section class="comments"><p>A reader says that this is nice and long, really a long comment with many many words in it.</p></section>
<footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    assert pages.main_text(PAGE) == "Head & tail\nFirst line goes <on>\nTwo.\nThree é"
    assert pages.main_text(PAGE[:PAGE.index("Two.") + 3]).endswith("\nTwo")
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>a</nav>") == ""
    long = "word " * 30
    plain = f"<body><div><a href=1>Home</a></div><div><a>Shop</a></div><h2>Title</h2><p>{long}</p><p>{long}</p><p>{long}</p></body>"
    assert pages.main_text(plain).count("word") == 90 and "Shop" not in pages.main_text(plain)
    df = spark.createDataFrame([(1, "u", PAGE, 5), (None, None, None, 5), (2, "v", "", 5), (2, "v", "", 5)],
                               "page_id long, url string, html string, n_chars long")
    out = pages.extract_pages(df).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 0, len(pages.main_text(PAGE))]


def test_page_tree_learns_its_table():
    assert all(pages.classify(pages.trained(), tuple(r[:-1])) == bool(r[-1]) for r in pages.LABELLED)


# ---- 9 chat ---------------------------------------------------------------------------------

def test_layouts_become_turns(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}],"id":3}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}],"system":"s"}', "conversations_system", [("system", "s"), ("user", "q"), ("assistant", "r")]),
        ('{"prompt":"p","completion":"c","meta":{"x":[1]}}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ('{"instruction":"i","input":"n","output":"o"}', "instruction_input", [("user", "i\n\nn"), ("assistant", "o")]),
        ('{"instruction":"i","output":"o"}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"what":1}', None, []), ("broken", None, []), (None, None, [])]
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(records)], "id long, record string, layout string")
    for r, (_, layout, turns) in zip(chat.canonical_turns(df).orderBy("id").collect(), records):
        assert r.layout == layout and [tuple(t) for t in r.turns] == turns


def test_template_round_trip(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<\\\\|im_start|>", "a\\", "<<SYS>>[[INST]<s>", "\n\n",
             "é😀<|x|>", "[\\/INST]"]
    turns = [[("user", a), ("assistant", b), ("odd\nrole\\n<s>", a)] for a in nasty for b in nasty] + [[]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "id long, turns array<struct<role:string,text:string>>")
    out = chat.format_turns(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    for r in out:
        want = turns[r.id]
        assert [(t.role, t.text) for t in r.back] == want
        assert len(re.findall(r"<\|im_start\|>", r.formatted)) == len(want)
        raw = [r.formatted[s.start:s.end] for s in r.loss_spans]
        plain = [re.sub(r"([<\[])\\(\\*)(\|[a-z_]{1,32}\|>|/?s>|</?SYS>>|/?INST\])", r"\1\2\3", x) for x in raw]
        assert plain == [t for role, t in want if role == "assistant"]


def test_chat_query_on_awkward_rows(spark, tmp_path):
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "x", 1), (None, 0, None, "lost", 1), (2, 1, "assistant", "b", 1), (2, 0, "user", "a", 1),
            (2, 1, "assistant", "b", 1), (3, None, "system", "s", 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record long").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in queries.op9_chat_schema(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("user\n\nassistant\nx\n") and out[2].turns_sha256 == sha("user\na\nassistant\nb\nassistant\nb\n")
    assert out[None].turns_sha256 == sha("\nlost\n") and out[3].n_turns == 1 and out[2].loss_sha256 == sha("bb")
    assert out[-1].loss_sha256 == sha("</s>[INST] ok [/INST]") and out[-1].n_turns == 2


def test_chat_texts_above_the_json_string_limit(spark):
    """Texts above 20 million characters stay, in the pair layout and in messages (also as the first)."""
    turns = [(1, 0, "user", True), (1, 1, "assistant", False), (2, 0, "system", False), (2, 1, "user", True),
             (2, 2, "assistant", False), (3, 0, "system", True), (3, 1, "user", False)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, long boolean").selectExpr(
        "conv_id", "turn", "role", "if(long, repeat('ab ', 7000001), 'yes') as text")
    out = chat.canonical_turns(chat.records_of(rows)).select("conv_id", "layout", F.transform(
        "turns", lambda t: F.struct(t["role"], F.length(t["text"]), F.md5(t["text"]))).alias("told"))
    said = {True: "ab " * 7_000_001, False: "yes"}
    for r in out.collect():
        fits = [m for m in chat.MAPPINGS if m.list_of or r.conv_id < 3]
        assert r.layout in {m.name for m in fits if bool(m.system) == (r.conv_id > 1)}
        assert [tuple(t) for t in r.told] == [
            (role, len(said[long]), hashlib.md5(said[long].encode()).hexdigest()) for i, _, role, long in turns if i == r.conv_id]


def test_conversations_stand_in_every_layout(spark):
    """All twenty mappings are met, and each gives the turns back."""
    texts = ["plain", "first part\n\nsecond part", "three\n\nparts\n\nof it"]
    rows, want = [], {}
    for i in range(600):
        own = ([("system", f"be kind {i}")] if i % 2 else []) + [("user", f"{texts[i % 3]} {i}"), ("assistant", f"yes {i}")]
        own += [("user", "again")] if i % 5 == 0 else []
        want[i] = own
        rows += [(i, k, role, text) for k, (role, text) in enumerate(own)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.canonical_turns(chat.records_of(df)).collect()
    assert {r.layout for r in out} == {m.name for m in chat.MAPPINGS}
    assert all([tuple(t) for t in r.turns] == want[r.conv_id] for r in out)


def test_the_loss_mask_of_a_long_conversation(spark):
    turns = F.transform(F.sequence(F.lit(0), F.lit(31_999)), lambda i: F.struct(
        F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), i.cast("string")).alias("text")))
    df = chat.format_turns(spark.range(1).select(turns.alias("turns"))).select("loss_spans", chat.read_back(F.col("formatted")).alias("read"))
    got = df.select(F.array_join(F.transform(chat.masked("read", "loss_spans"), lambda t: t["text"]), ""))
    start = time.time()
    assert got.first()[0] == "".join(f"t{i}" for i in range(1, 32_000, 2))
    assert time.time() - start < 20


# ---- 10 n-gram join -------------------------------------------------------------------------

def shingles(t):
    w = [x.lower() for x in (t or "").encode().split()]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: shingles(t) for i, t in rows}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed, groups=12, per=12):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"w{g}x{k}" if k > 30 or g % 3 else f"shared{k}" for k in range(int(rng.integers(20, 160)))]
        for _ in range(per):
            w = [x if rng.random() > 0.02 else x + "y" for x in base]
            out.append(" ".join(w[: len(w) - int(rng.integers(0, len(w) // 4))]))
    return out


@pytest.mark.parametrize("limit", [2000, 7])
def test_components_against_all_pairs(spark, monkeypatch, limit):
    """With a limit of 7 sets a node, blocks are spread over nodes and joined in two rounds."""
    monkeypatch.setattr(ngram_join, "NODE_SETS", limit)
    rows = list(enumerate(near_copies(limit) + AWKWARD))
    df = spark.createDataFrame(rows + [(None, PROSE)], "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("id", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df).collect()}
    want = components(rows)
    prose = next(i for i, t in rows if t == PROSE)
    assert got == want | {None: want[prose]}        # a null id takes part


def test_rows_that_repeat_an_id_or_have_none(spark):
    a, b, c = PROSE, "another text altogether of more than five words", "a third one that no other row has at all"
    rows = [(1, a), (1, b), (2, a), (None, b), (3, b), (None, c), (None, None), (3, b), (4, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df).collect()), key=str)
    n = {t: len(shingles(t)) for t in (a, b, c)}
    want = [(1, n[a], 1), (1, n[b], 1), (2, n[a], 1), (None, n[b], 1), (3, n[b], 1), (None, n[c], None), (None, 0, None),
            (3, n[b], 1), (4, 0, 4), (4, 0, 4)]
    assert got == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.one_per_component(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (None, None), (4, ""), (4, "")], key=str)


def test_one_document_of_each_component_stays(spark):
    rows = doc_rows([PROSE, PROSE + " more", "alone is this text here", None, None]) + [(None, "x", None, None, None), (0, PROSE, "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS)
    kept = ngram_join.one_per_component(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 2, 3, 4, None]
    assert kept.where("doc_id = 0").count() == 1


def test_tree_join_equals_pairs():
    texts = near_copies(3, 6, 10)
    rows = list(enumerate(texts))
    sets = [np.array(sorted({hash(s) & (2**63 - 1) for s in shingles(t)}), np.uint64) for t in texts]
    ids = np.arange(len(sets))
    u, v = ngram_join.link_sets(ids, sets, np.zeros(len(ids), int), ids, 75)
    root = {int(a): int(b) for a, b in zip(u, v)}
    assert {i: root.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in components(rows).items()}


def test_blocks_without_article_tags(spark):
    """With article tags taken out, word counts and link densities of the neighbours decide (README has the figure)."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    tag = re.compile(r"</?(?:article|main)\b[^>]*>", re.I)
    both = found = wanted = 0
    for r in rows:
        bare = tag.sub(lambda m: "</div>" if m[0][1] == "/" else "<div>", r.html)
        assert not any(b.article for b in pages.blocks_of(bare))
        want, got = (Counter(x for x in pages.main_text(h).split("\n") if x) for h in (r.html, bare))
        both += sum((want & got).values())
        found += sum(got.values())
        wanted += sum(want.values())
    print(f"block F1 {2 * both / (found + wanted):.3f} of {wanted} blocks")
    assert 2 * both / (found + wanted) > 0.94 and both / found > 0.99


# ---- pipeline -------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    mid = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in mid.collect()}
    after = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, mid, SF_SMALL).collect()}
    passing = {i for i, t in before.items() if (m := base_measures(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    changed = [i for i, t in after.items() if t != before[i]]
    assert set(after) <= passing and len(passing) - len(after) < 0.02 * len(passing)
    assert changed and all(set(after[i].split("\n")) < set(before[i].split("\n")) for i in changed)
    quality_ok = corpus_pipeline.quality_rules(spark, docs, SF_SMALL)
    assert {r.doc_id for r in quality_ok.collect()} <= set(texts)
    near = corpus_pipeline.near_duplicates(spark, quality_ok, SF_SMALL)
    groups = components([(r.doc_id, r.text) for r in quality_ok.collect()])
    ids = {r.doc_id for r in near.collect()}
    assert ids == {i for i, (_, c) in groups.items() if i == c}
    clean = corpus_pipeline.personal_data(spark, near, SF_SMALL)
    assert {r.doc_id for r in clean.collect()} == ids
    assert not any(base_spans(r.text) for r in clean.collect())
    mixed = corpus_pipeline.source_mix(spark, clean, SF_SMALL)
    assert mixed.columns == clean.columns == docs.columns
    from canopy.llm.store import stored

    placed = corpus_pipeline.packed(spark, stored(mixed, "mixed"), SF_SMALL)
    words = sum(len(words_of(r.text)) for r in mixed.collect())
    assert placed.agg(F.sum("size")).first()[0] == words
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF_SMALL).count() == 0
    assert corpus_pipeline.packed(spark, stored(empty, "empty"), SF_SMALL).count() == 0
