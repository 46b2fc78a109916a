"""Overlap of datasets against its SQL on texts that lack keys."""

import duckdb

from textmill.operators import pool
from textmill.plans import catalogue

TEXTS = ["", "!!!", "... ?", "éü", "Abc  def", "abc def", "ABC, def", "abc\tdef", "x1", "x 1", None]


def test_overlap_of_texts_without_letters(spark):
    """Texts without letters or digits are shared exactly but have no
    alphanumeric key, so none of their groups is counted at that level."""
    rows = [(i, TEXTS[(i * 7 + i // 5) % len(TEXTS)], None if i % 13 == 0 else f"src{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pool.pairwise_overlap(pool.keyed(docs).drop("text")).toPandas()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = con.execute(catalogue.oracle_sql()["pairwise_overlap"]).df()
    key = ["dataset_a", "dataset_b"]
    assert list(got.columns) == list(want.columns) and len(got) == 6
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
