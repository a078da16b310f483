"""The numbered queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.ann import nearest
from factloom.llm.common import id_remainder
from factloom.llm.exact_dedup import exact_groups
from factloom.llm.fill_middle import fill_in_middle, restored
from factloom.llm.mixing import mix
from factloom.llm.near_dedup import near_groups
from factloom.llm.packing import pack
from factloom.llm.phrases import phrases
from factloom.llm.quality_crf import quality
from factloom.llm.suffix_tree import suffix_tree_scores
from factloom.llm.token_counts import token_counts
from factloom.llm.token_store import read_store, write_store
from factloom.llm.toxicity import toxicity
from factloom.llm.warc import archives_of, read_archives, write_archives


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder("doc_id", 10) == 0).alias("held_out"))
    return suffix_tree_scores(docs, "held_out")


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), byte_bpe()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_store(_read(spark, sf_dir, "documents"), byte_bpe())
    return read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "class_id", "class_size", "kept")


def op7_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, piece_vocabulary()).select("doc_id", "n_tokens", "token_score")


def op8_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(_read(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    path, kind = write_archives(pages), pages.schema["page_id"].dataType
    got = read_archives(archives_of(spark, path), path)
    return got.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast(kind).alias("refers_to"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("output"), F.col("form")
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_tree_scoring, op2_kneser_ney_toxicity, op3_source_mixing, op4_hilbert_packing, op5_token_store, op6_icws_near_dedup, op7_viterbi_token_counts, op8_nn_descent_search, op9_exact_dedup, op10_crf_quality, op11_phrase_collocations, op12_warc_archives, op13_fill_in_middle)}


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
-- sources in the order in which they reach twice their size; the level is that of the first that does not
f AS (
  SELECT *, 2.0 * source_size / weight AS full_at,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, source_size, round(least(2.0 * source_size, weight * coalesce((SELECT level FROM f WHERE level <= full_at ORDER BY full_at, source LIMIT 1), 0)), 6) AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(h, 1, 12) AS BIGINT) / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS kept,
       text_sha256
FROM t
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (
  SELECT lang, unnest(w) AS phrase, 1 AS k FROM p
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), 2 FROM p
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]), 3 FROM p),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY lang, phrase, k),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.w, x.j, x.left_words, x.right_words FROM c,
  LATERAL (SELECT j, array_to_string(c.w[1:j], ' ') AS left_words, array_to_string(c.w[j + 1:], ' ') AS right_words FROM range(1, 3) AS r(j) WHERE j < c.k) AS x),
s AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, cut.j, l.f AS l, r.f AS r, (1000000::HUGEINT * cut.a * cut.a) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = left_words JOIN f AS r ON r.lang = cut.lang AND r.phrase = right_words),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS part FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3) GROUP BY lang, part),
kept AS (
  SELECT low.* FROM low LEFT JOIN around ON around.lang = low.lang AND around.part = low.phrase AND 100 * around.a >= 50 * low.a WHERE around.part IS NULL)
SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP12_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM p
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, n, [CAST('0x' || substr(s, 8 * i + 1, 8) AS BIGINT) FOR i IN range(0, 4)] AS h FROM d),
f AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mixing": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op12_warc_archives": OP12_SQL,
        "op13_fill_in_middle": OP13_SQL}
