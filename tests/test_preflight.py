import hashlib
import resource

import pytest
from pyspark.sql import functions as F

from textmill.operators import ml
from textmill.operators.expect import require
from textmill.sources import preflight as P


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def test_digests_by_file_and_by_chunk(spark, tmp_path):
    data = {"a b.bin": bytes(range(256)) * 40, "empty": b"", "é": b"x" * 1000}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    names = [str(tmp_path / k) for k in data]
    got = [(r.bytes, r.sha256) for r in P.file_digests(spark, names).collect()]
    assert sorted(got) == sorted((len(v), _sha(v)) for v in data.values())
    assert P.file_digests(spark, str(tmp_path)).count() == 2  # the empty one isn't listed
    chunks = P.chunk_digests(spark, names, 1000)
    rows = sorted((r.start, r.size, r.sha256) for r in chunks.collect())
    assert rows == sorted((s, len(v[s : s + 1000]), _sha(v[s : s + 1000])) for v in data.values() for s in range(0, max(1, len(v)), 1000))
    tree = {r.bytes: (r.chunks, r.tree_sha256) for r in P.tree_digests(chunks).collect()}
    long = data["a b.bin"]
    assert tree[len(long)] == (11, _sha("".join(_sha(long[s : s + 1000]) for s in range(0, len(long), 1000)).encode()))
    # a changed byte is found, and in which chunk
    before = chunks.collect()
    was = spark.createDataFrame(before, chunks.schema)
    (tmp_path / "a b.bin").write_bytes(long[:4321] + b"!" + long[4322:])
    bad = P.compare_digests(P.chunk_digests(spark, names, 1000), was, ("path", "start")).collect()
    assert [(r.start, r.problem) for r in bad] == [(4000, "changed")]
    assert P.file_digests(spark, []).count() == 0


def test_a_file_above_two_gigabytes_in_bounded_memory(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    h = hashlib.sha256()
    for _ in range(2 << 10):
        h.update(bytes(1 << 20))
    h.update(bytes(5))
    got = P.file_digests(spark, str(tmp_path / "large")).first()
    assert (got.bytes, got.sha256) == (size, h.hexdigest())
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 2 << 20  # kilobytes, of any ended worker
    one = list(P._hashed(iter([__import__("pandas").DataFrame([[str(tmp_path / "large"), 0, 64 << 20]], columns=["path", "start", "size"])])))
    assert one[0].sha256[0] == _sha(bytes(64 << 20))


def test_compared_lists(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    got = P.compare_digests(frame([("same", "1"), ("new", "2"), ("other", "3"), ("null", None), ("twice", "1"), ("twice", "2")]), frame([("same", "1"), ("same", "1"), ("gone", "2"), ("other", "4"), ("null", None), ("twice", "1")]))
    assert sorted(map(tuple, got.collect())) == [("gone", "missing"), ("new", "unlisted"), ("null", "changed"), ("other", "changed"), ("twice", "changed")]
    assert P.compare_digests(frame([]), frame([])).count() == 0


def test_preflight(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).write_bytes(k.encode())
    train = spark.createDataFrame([(i, f"{'bonus link sign' if i % 2 else 'great notes thanks'} w{i % 5}", i % 2) for i in range(40)], "id int, text string, y int")
    model = ml.svm_pipeline(40, iterations=5).fit(ml.weighted(train, "y"))
    models = {"svm": lambda df: ml.predict(model, df), "broken": lambda df: df.select("nowhere"), "silent": lambda df: df.limit(1).withColumn("predicted_label", F.lit(1)), "odd": lambda df: df.withColumn("predicted_label", F.lit(7))}
    files = {str(tmp_path / "a"): _sha(b"a"), f"file://{tmp_path}/b": _sha(b"changed"), str(tmp_path / "c"): _sha(b"c")}
    tables = {"train": (train, ["id", "text"]), "none": (train.limit(0), ["id"]), "narrow": (train, ["id", "label"])}
    got = {r.check: r.violations for r in P.preflight(spark, files, models, tables).collect()}
    assert got == {"files_there": 1, "files_unchanged": 1, "model_svm": 0, "model_broken": 1, "model_silent": 1, "model_odd": 2, "table_train": 0, "table_none": 1, "table_narrow": 1}
    with pytest.raises(AssertionError):
        require(P.preflight(spark, files))
    require(P.preflight(spark, {str(tmp_path / "a"): _sha(b"a").upper()}))
