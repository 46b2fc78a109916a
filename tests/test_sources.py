import json
import math

import pytest
from pyspark.sql import functions as F

from textmill.operators import evaluate as E
from textmill.operators import ml, pool
from textmill.operators import obfuscate as O
from textmill.plans import review
from textmill.sources import registry as R
from textmill.sources import sinks


def test_csv_readers(spark, tmp_path):
    for k, row in (("a", '1,"two ""quoted"", with\na line",3.5'), ("b", '2,,x')):
        (tmp_path / f"{k}.csv").write_text(f"id,text,n\n{row}\n")
    both = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    got = sorted(map(tuple, R.read_csv_strings(spark, both, ["id", "text", "n"]).collect()))
    assert got == [("1", 'two "quoted", with\na line', "3.5"), ("2", None, "x")]
    typed = R.read_csv(spark, both[0], "id long, text string, n double").first()
    assert (typed.id, typed.n) == (1, 3.5)
    with pytest.raises(Exception):
        R.read_csv(spark, both[1], "id long, text string, n double").collect()
    with pytest.raises(Exception):
        R.read_csv_strings(spark, both, ["id", "other", "n"]).collect()


def test_tables_partitions_and_resuming(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x", "m1"), (2, "y", "m2")], "id long, v string, model string")
    assert sinks.write_missing(df.filter("model = 'm1'"), at, ("model",)) == 1
    assert sinks.write_missing(df.withColumn("v", F.lit("new")), at, ("model",)) == 1
    assert sorted(map(tuple, R.read_checkpoint(spark, at).select("id", "v", "model").collect())) == [(1, "x", "m1"), (2, "new", "m2")]
    assert sinks.write_missing(df, at, ("model",)) == 0
    # a partition whose files a broken run left without a marker is written anew; null is a partition
    torn = str(tmp_path / "torn")
    df.filter("id = 1").withColumn("v", F.lit("half")).write.partitionBy("model").parquet(torn)
    assert sinks.write_missing(df.unionByName(spark.createDataFrame([(3, "z", None)], df.schema)), torn, ("model",)) == 3
    assert sorted((r.id, r.v, r.model) for r in R.read_checkpoint(spark, torn).collect()) == [(1, "x", "m1"), (2, "y", "m2"), (3, "z", None)]
    assert sinks.write_missing(df, torn, ("model",)) == 0
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "id"])
    assert sorted(map(tuple, R.read_csv_strings(spark, str(tmp_path / "c"), ["v", "id"]).collect())) == [("x", "1"), ("y", "2")]
    queue = df.withColumn("reason", F.when(F.col("id") == 2, "why"))
    assert sinks.write_review_queue(queue, str(tmp_path / "q")) == 1 and [r.reason for r in spark.read.parquet(str(tmp_path / "q")).collect()] == ["why"]


def test_reports_manifests_and_identity(spark, tmp_path):
    df = spark.range(5).select("id", F.lit("a|b").alias("t"))
    assert sinks.markdown(df, 2).endswith("\nThe first 2 rows.\n") and "a\\|b" in sinks.markdown(df) and "first" not in sinks.markdown(df)
    (tmp_path / "f").write_bytes(b"abc")
    held = sinks.manifest({"five": df, "none": df.limit(0)}, {"f": str(tmp_path / "f")}, {"b": 1, "a": 2})
    assert held["counts"] == {"five": 5, "none": 0} and held["sha256"]["f"].startswith("ba7816bf") and held["identity"] == sinks.identity({"a": 2, "b": 1})
    path = str(tmp_path / "m.json")
    assert sinks.write_manifest(held, path) == sinks.file_digest(path) and R.read_manifest(path) == held
    assert R.read_json(spark, path).count() == 1 and R.checksums(spark, path).first().sha256 == sinks.file_digest(path)
    sinks.same_identity(held, {"a": 2, "b": 1})
    with pytest.raises(ValueError):
        sinks.same_identity(held, {"a": 3})
    with pytest.raises(ValueError):
        R.require_columns(df, ["id", "text"])


def test_vocabulary(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"stoi": {"a": 2, "b": 3}, "itos": {"2": "a", "3": "b"}, "pad": 0, "unk": 1}))
    held = R.vocabulary(str(path))
    got = R.encode_characters(spark.createDataFrame([("abz",), ("",), ("aaaaaa",)], "text string"), held, 4)
    assert [r.ids for r in got.collect()] == [[2, 3, 1, 0], [0, 0, 0, 0], [2, 2, 2, 2]]
    path.write_text(json.dumps({"stoi": {"a": 2}, "itos": {"2": "b"}, "pad": 0, "unk": 1}))
    with pytest.raises(ValueError):
        R.vocabulary(str(path))


def test_public_names():
    import textmill

    assert all(getattr(textmill, name) is not None for name in textmill.__all__) and textmill.obfuscate is O.obfuscate
    with pytest.raises(AttributeError):
        textmill.nothing_of_this_name  # noqa: B018


def test_smooth_idf(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.sparse(3, {0: 2.0, 1: 1.0}),), (Vectors.sparse(3, {0: 1.0}),), (Vectors.sparse(3, {0: 3.0, 2: 1.0}),)], ["tf"])
    got = [r.x.toArray().tolist() for r in ml.SmoothIDF("tf", "x").fit(df).transform(df).collect()]
    rare = math.log(4 / 2) + 1
    assert got == [[2.0, pytest.approx(rare), 0.0], [1.0, 0.0, 0.0], [3.0, 0.0, pytest.approx(rare)]]


def test_models_are_saved_read_and_compared(spark, tmp_path):
    rows = [(i, "good words here now" if i % 2 else "bad words there then", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    model = ml.svm_pipeline(len(rows), bigrams=True).fit(ml.weighted(df, "y"))
    again = ml.save_and_check(model, str(tmp_path / "m"), df)
    assert all(r.predicted_label == r.y for r in ml.predict(R.read_model(str(tmp_path / "m")), df).collect()) and again is not model
    with pytest.raises(ValueError):
        R.read_model(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        ml.predict(model, df.drop("text"))
    with pytest.raises(Exception, match="null texts"):
        ml.predict(model, df.withColumn("text", F.when(F.col("id") > 3, F.col("text")))).collect()
    best, _ = ml.grid(df, df, "y", [(False, 1.0), (True, 1.0)])
    assert best["f1"] == 1.0 and best["unigram"]


def test_obfuscate_one_text():
    got = O.obfuscate("situs gacor", "REC_O1", O.FAMILIES[0], "MILD")
    assert got.changed and got.status == "SUCCESS" and got.failure_reason is None and got.modified_char_count == 1 and got.modified_token_count == 1
    assert got == O.obfuscate("situs gacor", "REC_O1", O.FAMILIES[0], "MILD")
    for text in ("123 456", "👍 🔥 ❤️", "di ke ya", "https://slot.com"):
        got = O.obfuscate(text, "R", O.FAMILIES[1], "STRONG")
        assert not got.changed and got.status == "NO_CHANGE" and got.failure_reason and got.text_obfuscated == text
    control = O.obfuscate("any text at all", "R", "NORMAL", "NORMAL")
    assert control.status == "SUCCESS" and not control.changed and control.modified_char_count == 0 and control.failure_reason is None
    for family, severity in (("O9", "MILD"), (O.FAMILIES[0], "HARD"), ("NORMAL", "MILD"), (O.FAMILIES[0], "NORMAL")):
        with pytest.raises(ValueError):
            O.obfuscate("some text", "R", family, severity)
    with pytest.raises(TypeError):
        O.obfuscate(None, "R", O.FAMILIES[0], "MILD")


def test_seeded_mode_keeps_to_its_caps(spark):
    text = "daftar di situs slot gacor sekarang dapat bonus melimpah"
    for family in O.FAMILIES:
        for severity, tokens, share in (("MILD", 1, 0.2), ("STRONG", 2, 0.35)):
            for i in range(40):
                got = O.obfuscate(text, f"R{i}", family, severity)
                assert got.modified_token_count <= tokens and got.modified_char_ratio <= share and got.modified_char_count >= 1
    rows = O.conditions(spark.createDataFrame([("R1", text), ("R2", "123 456")], "record_id string, text string"))
    for r in O.edit_figures(O.mt_mode(rows)).collect():
        one = O.obfuscate(r.text, r.record_id, r.family, r.severity)
        assert (r.text_obfuscated, r.status, r.modified_char_count, r.modified_token_count) == (one.text_obfuscated, one.status, one.modified_char_count, one.modified_token_count) and abs(r.modified_char_ratio - one.modified_char_ratio) < 1e-9


def test_look_alikes_alone_are_undone(spark):
    df = spark.createDataFrame([(i, "poker deposit %d hmmm pssst brrrr xyz" % i) for i in range(30)], "doc_id long, text string")
    got = O.homoglyph_only(df).collect()
    assert len(got) == 60 and any(r.changed for r in got)
    back = O.homoglyph_only(df).select((O.normalize_homoglyphs(F.col("text_obfuscated")) == F.col("text")).alias("same"))
    assert all(r.same for r in back.collect())


def test_a_violated_order_of_overlaps_is_found(spark):
    rows = [("a", "b", 3, 3, 4, 5), ("a", "c", 3, 2, 4, 5), ("b", "c", 1, 1, 4, 3)]
    df = spark.createDataFrame(rows, "dataset_a string, dataset_b string, " + ", ".join(f"shared_{k}_groups long" for k in pool.LEVELS))
    assert sorted(map(tuple, pool.overlap_monotonicity(df).collect())) == [("a", "c"), ("b", "c")]


def test_canonical_takes_the_preferred_valid_row(spark):
    rows = [("k", 2, 1, False), ("k", 1, 9, False), ("k", 1, 8, False), ("bad", 1, 3, True), ("bad", 2, 4, False), (None, 1, 5, False)]
    got = pool.canonical(spark.createDataFrame(rows, "key string, rank int, id long, broken boolean"), "key", ["rank", "id"], F.col("broken"))
    assert [(r.key, r.id, r.source_record_count) for r in got.collect()] == [("k", 8, 3)]


def test_bootstrap_against_resampled_rows(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.3).astype(int)
    n = np.where(rng.random(400) < 0.1, 1 - y, y)
    o = np.where(rng.random(400) < 0.25, 1 - y, y)
    df = spark.createDataFrame([("m", int(a), int(b), int(c), True) for a, b, c in zip(y, n, o)], "model string, y int, y_norm int, y_obf int, changed boolean")
    got = E.bootstrap_ci(df, ["model"]).first()
    f1 = lambda t, p: 2 * ((t == 1) & (p == 1)).sum() / max(1, (t == 1).sum() + (p == 1).sum())
    at = [np.flatnonzero(y == k) for k in (0, 1)]
    drops = []
    for _ in range(4000):
        i = np.concatenate([rng.choice(a, len(a)) for a in at])
        drops.append(f1(y[i], n[i]) - f1(y[i], o[i]))
    assert abs(got.drop_mean - np.mean(drops)) < 0.005 and abs(got.drop_std - np.std(drops)) < 0.005
    assert np.allclose([got.ci_95_lower, got.ci_95_upper], np.percentile(drops, [2.5, 97.5]), atol=0.012)


def test_every_query_has_its_sql():
    assert set(review.QUERIES) == set(review.SQL)
