"""One query per operator over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, chat, lm, mixing, ngram_join, packing, pages, pii, quality, simhash, spotsigs, token_counts,
               whitening)

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_read(spark, sf_dir, "documents"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *n, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


def op4_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("first_position", 6).alias("first_position")).orderBy(
        "first_position", "doc_id")


def op7_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op8_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(_read(spark, sf_dir, "pages"))


def op9_chat_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    formatted = chat.format_turns(chat.canonical_turns(chat.records_of(rows.unionByName(more)))).select(
        "conv_id", "formatted", "loss_spans")
    read = formatted.withColumn("read", chat.read_back(F.col("formatted")))
    read = read.withColumn("learnt", F.array_join(F.transform(chat.masked("read", "loss_spans"), lambda t: t["text"]), ""))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_read(spark, sf_dir, "documents"))


def op11_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_pii_boosting, op3_line_frequency, op4_gated_lm, op5_trie_token_counts, op6_curriculum_mix,
    op7_spot_signatures, op8_text_blocks, op9_chat_schema, op10_signature_tree_join, op11_ball_hashing, op12_lanczos_whitening,
    op13_tokenizer_alignment, pipeline)}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= {quality.WINDOW})),
twice AS (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (
              SELECT win.r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM win JOIN twice USING (r, g)) GROUP BY r),
lines AS (SELECT r, doc_id, source, t, line, regexp_extract_all(line, '{_WORD}') AS ws
          FROM (SELECT r, doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
real AS (SELECT *, regexp_replace(translate(array_to_string(ws, ' '), '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g') AS norm
         FROM lines WHERE len(ws) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM real GROUP BY r),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM real GROUP BY source),
often AS (SELECT real.source, norm FROM real JOIN hosts ON real.source IS NOT DISTINCT FROM hosts.source GROUP BY real.source, norm
          HAVING count(DISTINCT t) > {quality.MIN_DOCUMENTS} AND 100 * count(DISTINCT t) > {quality.MAX_PERCENT} * any_value(texts)),
gone AS (SELECT r, sum(len(ws)) AS n FROM real JOIN often ON real.source IS NOT DISTINCT FROM often.source AND real.norm = often.norm
         GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS words_removed
      FROM d JOIN w USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed::BIGINT AS words_removed,
       NOT base_failed AND n_words - words_removed >= {quality.MIN_WORDS}
       AND 100 * (n_words - words_removed) >= {quality.MIN_LEFT_PERCENT} * n_words AS kept
FROM f"""

_OP6 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
                  md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o, text FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS k FROM d GROUP BY source),
q AS (SELECT *, [5, 2, 1][k % 3 + 1] AS weight, [{', '.join(f'{x}::DOUBLE' for x in mixing.SLOPES)}][k % 3 + 1] AS slope FROM s),
a AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(source_size) OVER b, 0) AS size_before, coalesce(sum(weight) OVER b, 0) AS weight_before
      FROM q WINDOW b AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * (weights - weight_before) <= weight * (total - 3 * size_before) AS capped FROM a),
e AS (SELECT *, sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER () AS capped_size,
             sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS free FROM c),
t AS (SELECT source, source_size, slope, (CASE WHEN capped THEN 3 * source_size ELSE (total - 3 * capped_size) * weight END)::BIGINT AS num,
             (CASE WHEN capped THEN 1 ELSE free END)::BIGINT AS den FROM e),
p AS (SELECT d.doc_id, d.size, t.*, (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, size, d.doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN num // (den * source_size) ELSE 0 END AS whole FROM p),
g AS (SELECT *, whole + CASE WHEN whole < 3 AND (2 * pos + size) * den <= 2 * (num - whole * den * source_size) THEN 1 ELSE 0 END AS copies,
             num::DOUBLE / den AS target FROM f),
h AS (SELECT *, least(pos / greatest(target, 1.0), 1.0) AS u FROM g)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(CASE WHEN abs(slope) < 1e-9 THEN u
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 6) END AS first_position
FROM h"""

_CONTROL = r"([<\[])(\\*)(\|[a-z_]{1,32}\|>|/?s>|</?SYS>>|/?INST\])"
_OP9 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) AS n_text,
             length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{_CONTROL}', '\1\\\2\3', 'g')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum({len(chat.START)} + n_role + 1 + n_text + {len(chat.END)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
      UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY u, v),
l AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.v) AS component_id
FROM d JOIN reach ON reach.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLE_SQL: dict[str, str] = {"op3_line_frequency": _OP3, "op6_curriculum_mix": _OP6, "op9_chat_schema": _OP9,
                              "op10_signature_tree_join": _OP10}
