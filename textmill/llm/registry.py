"""The queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, digests, licenses, lm, media, mixing, neardup, packing, quality, secrets, sortmeans, tokenfile, toxicity
from .common import table, vocabulary


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_report(table(spark, sf_dir, "documents"), secrets.fit_forest(secrets.labelled_findings(spark)), path="source")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store_tensors(media.store_audio(table(spark, sf_dir, "documents"))))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(table(spark, sf_dir, "embeddings"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_report(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, which SQL can say."""
    return sortmeans.report(spark, table(spark, sf_dir, "embeddings")).drop("scanned")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_scoring, op2_secret_scans, op3_media_columns, op4_mixing, op5_quality, op6_token_files, op7_packing, op8_near_duplicates, op9_toxicity, op10_neighbours, op11_license_scans, op12_tokenizer_alignment, op13_centroid_clusters)
    return {f.__name__: f for f in own} | {f.__name__: f for f in digests.QUERIES}


def oracle_sql() -> dict[str, str]:
    """The license scan and the clustering are SQL statements in whole.  Trained
    models, sketches, file formats and tokenizers aren't: those operators are
    tested against brute-force versions, and the columns that SQL can express
    are queries of their own."""
    return dict(digests.SQL) | {"op11_license_scans": licenses.oracle_sql(), "op13_centroid_clusters": sortmeans.oracle_sql()}
