"""From raw documents to packed sequences in five stages.

Each stage works on all rows that the one before kept; between stages rows are
written as Parquet and read again.  All but the last return the columns of
``documents``, of whatever names there are beside doc_id, text and source.

Null and empty texts are kept by the classifier and the secret scan, are one
class to the near-duplicates (so one row of them stays), have no words for the
mix to take, and so end there.  Rows without an id and repeated ids are rows
like others: what is decided of a row depends on its text.  Of a class the row
of the smallest id stays, rows without an id last; equal rows are one.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import mixing, neardup, packing, secrets, toxicity
from textmill.llm.common import fresh_dir, table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest id."""
    return neardup.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``<secret>``; every document stays."""
    return secrets.redact(docs, secrets.fit_forest(secrets.labelled_findings(spark)), path="source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' target shares; a document is repeated as often as taken."""
    return mixing.mixed_documents(docs, mixing.plan(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their places in sequences.  A document
    that the mix repeats has as many rows for each piece."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, sketches and tokenizers: no SQL statement gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = fresh_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
