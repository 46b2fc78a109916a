"""Divided buckets, sub-words and edit counts against plain versions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from textmill.operators import obfuscate as O
from textmill.operators import shingles, subwords
from textmill.plans import review, sql


@pytest.mark.parametrize("limit", [3, 12, 200])
def test_divided_buckets_are_those_of_the_sql(spark, limit):
    """260 near copies share their bands; some are equal but for marks."""
    rng = random.Random(limit)
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base) + "!" * (i % 9) for i in range(12)] + [" ".join([*base, f"end{rng.randrange(40)}"]) + " " * (i % 3) + "." * (i % 5) for i in range(260)]
    texts += [" ".join(rng.choice(base) for _ in range(25)) for _ in range(30)] + ["a", "", None]
    rows = list(enumerate(dict.fromkeys(texts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = shingles.minhash(shingles.with_shingles(df.filter("text is not null"))).cache()
    pairs = shingles.lsh_pairs(signed, limit=limit)
    got = {(r.id_a, r.id_b): r.jaccard for r in pairs.join(shingles.similar(pairs, signed), ["id_a", "id_b"], "left").collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r for r in rows if r[1] is not None])
    want = {(a, b): j for a, b, j in con.execute(sql.lsh_pairs_sql(limit)).fetchall()}
    assert got == want and len(got) > 200
    if limit == 3:  # hardly more pairs than texts, and still one cluster of copies
        assert len(got) < 16 * len(rows)


def test_subwords_by_hand(spark):
    words = spark.createDataFrame([("abab", 5), ("abc", 3), ("once", 1), ("", 9), ("b" * 3000, 2)], "w string, n long")
    voc = subwords.vocabulary(words, 100_000)
    assert "once" not in voc and {"a", "ab", "abab", "##b", "##bab", "##c"} <= set(voc)
    assert subwords.vocabulary(words, 2) == ["##b", "##bb"]
    known = {"a", "ab", "##c", "##ba", "##a"}
    assert subwords.cut_word("abcba", known, 4) == ["ab", "##c", "##ba"] and subwords.cut_word("abx", known, 4) is None and subwords.cut_word("", known, 4) == []
    rows = spark.createDataFrame([("x", 1, "abc", 2), ("x", 1, "zz", 3), ("x", 2, "a", 1), ("y", 1, "abcba", 1)], "k string, doc_id long, w string, n long")
    got = {r.k: r.asDict() for r in subwords.statistics(rows, ["k"], known).collect()}
    assert got["x"] == {"k": "x", "documents": 2, "tokens": 8, "unknown": 3, "continuations": 2, "documents_with_unknown": 1, "tokens_a_document": 4.0, "pct_with_unknown": 50.0}
    assert got["y"]["continuations"] == 2 and subwords.statistics(rows.limit(0), ["k"], []).collect() == []


def test_statistics_of_whole_texts(spark, monkeypatch):
    """As of the words' rows, and no word is shuffled: a row a document is."""
    monkeypatch.setattr(subwords, "TEXTS", 3)
    monkeypatch.setattr(subwords, "SEEN", 2)
    texts = ["abc abc zz zz zz", " a\t\nabcba  ", "", None, "   ", "zz", "a abc zz \u00e9\u00a0a"] * 3
    rows = spark.createDataFrame([("xyz"[i % 3], i, t) for i, t in enumerate(texts)], "k string, doc_id long, text string")
    known = {"a", "ab", "##c", "##ba", "##a"}
    words = rows.selectExpr("k", "doc_id", "explode(regexp_extract_all(text, '\\\\S+', 0)) as w").groupBy("k", "doc_id", "w").count().withColumnRenamed("count", "n")
    got = subwords.text_statistics(rows, ["k"], known)
    assert sorted(got.collect()) == sorted(subwords.statistics(words, ["k"], known).collect()) and got.count() == 3
    assert subwords.text_statistics(rows.limit(0), ["k"], known).collect() == []


def test_the_ablation_shuffles_no_words(spark):
    got = review.QUERIES["homoglyph_ablation"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1  # of documents, by variant


def test_edits_are_the_edit_distance(spark):
    rng = random.Random(4)
    words = ["Total", "gebaut", "système", "aaaa", "baobab", "o'clock", "http://x.de", "année", "x9y8z7", "ooo-ooo"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for family in O.FAMILIES:
        got = O.hash_mode(df, family).withColumn("x", O.excessive()).collect()
        assert all(r.modified_char_count == O.edit_distance(r.text, r.text_obfuscated) for r in got)
        assert all(r.x == (r.modified_char_count / max(len(r.text), 1) > (0.20 if r.severity == "MILD" else 0.35)) for r in got)
        assert any(r.changed for r in got)
    assert O.hash_mode(df, family).filter("changed").agg(F.min("modified_char_count")).first()[0] == 1
