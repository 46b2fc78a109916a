"""Columns of the operators' queries that SQL can express, each taken from its
operator's own result, with the SQL to compare them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm, media, mixing, quality, tokenfile
from .common import table, vocabulary

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's counts and base scores."""
    got = lm.score_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of the stored payloads."""
    got = media.digest(media.store_tensors(media.store_audio(table(spark, sf_dir, "documents"))))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix, and that no document is over its cap."""
    got = mixing.plan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within_cap"))


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the classifier holds out, and their lines."""
    got = quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "n_lines", F.col("score").between(0, 1).alias("in_range"))


def token_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the files hold every document once, in the order of ids."""
    got = tokenfile.encode_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    after = got.select("doc_id", F.col("start").alias("next"))
    ends = got.select("doc_id", (F.col("start") + F.col("n_tokens")).alias("next"))
    joined = ends.join(after.withColumnRenamed("doc_id", "following"), "next", "left")
    return joined.select("doc_id", F.coalesce("following", F.lit(-1)).alias("following"))


QUERIES = (lm_base_scores, media_payloads, mixing_targets, quality_folds, token_file_order)


#: CRC-32 of the id as text, in steps: a letter, then its eight bits.
_REMAINDER = """rem AS (WITH RECURSIVE s(doc_id, t, i, c) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
 UNION ALL SELECT doc_id, t, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(t, i // 9 + 1, 1))::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM s WHERE i < 9 * length(t))
 SELECT doc_id, xor(c, 4294967295) AS crc FROM s WHERE i = 9 * length(t))"""

SQL = {
    "lm_base_scores": f"""WITH {_REMAINDER}, d AS (SELECT doc_id, coalesce(crc % 7 = 2, false) AS held_out, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents LEFT JOIN rem USING (doc_id)),
 w AS (SELECT doc_id, held_out, unnest(list_append(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), ' ')) AS w FROM d), c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
 SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))), 6) AS base_score FROM w LEFT JOIN c USING (w), n GROUP BY doc_id, held_out""",
    "media_payloads": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, t, strlen(t) AS n, greatest(1, (strlen(t) + 191) // 192) * 192 AS m FROM d)
 SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', m - n)) AS payload_sha256 FROM p""",
    "mixing_targets": f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
 t AS (SELECT sum(n)::DOUBLE AS total FROM s), r(k, source, n, w, target, capped) AS (SELECT 0, source, n, w, 0.0::DOUBLE, n = 0 FROM s
 UNION ALL SELECT k + 1, source, n, w, CASE WHEN capped THEN 3.0 * n ELSE w * rest / free END, capped OR w * rest / free >= 3.0 * n
 FROM (SELECT *, (SELECT total FROM t) - coalesce(sum(3.0 * n) FILTER (capped) OVER (), 0) AS rest, sum(w) FILTER (NOT capped) OVER () AS free FROM r) WHERE k < 40)
 SELECT doc_id, size, n AS source_size, round(target, 3) AS target, true AS within_cap FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND k = 40""",
    "quality_folds": f"""WITH {_REMAINDER} SELECT doc_id, coalesce(crc % 3 = 1, false) AS held_out, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS n_lines, true AS in_range FROM documents LEFT JOIN rem USING (doc_id)""",
    "token_file_order": "SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY doc_id NULLS FIRST), -1) AS following FROM documents",
}
