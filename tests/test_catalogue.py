"""Every query with SQL against DuckDB on the smallest tables (a sample of
them: the driver compares all)."""

import os

import duckdb
import pytest

from textmill.plans import catalogue, review

SF = "/root/testdata/sf0.001"
NAMES = ("exact_dedup_canonical", "text_keys", "quality_flags", "conflict_summary", "isolate_pool", "near_dup_components", "group_split", "obfuscate_o1", "paired_robustness", "expectations", "greedy_split", "lsh_pairs", "edit_diagnostics", "proportional_sample", "length_batches", "subword_stats", "review_queue", "data_contract", "reverification_sample")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = (catalogue.queries() | review.QUERIES)[name](spark, SF).toPandas()
    want = con.execute((catalogue.oracle_sql() | review.SQL)[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)
