"""Digests of files of any size, and what must hold before an evaluation runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.expect import count_violations

#: Bytes that a task holds of a file at a time.
STEP = 1 << 20


def listed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, bytes) of files, and of the files in folders, whose contents
    aren't read.  Without any path, no rows; a path that isn't there raises.
    Spark leaves empty files out of its lists: those named themselves are
    rows, those in a folder aren't."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    empty = [(p, 0) for p in paths if _empty(spark, p)]
    rest = [p for p in paths if (p, 0) not in empty]
    rows = spark.createDataFrame(empty, "path string, bytes long")
    if not rest:
        return rows
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(rest)
    return found.select("path", F.col("length").alias("bytes")).unionByName(rows)


def _empty(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return False
    at = store.getFileStatus(where)
    return at.isFile() and at.getLen() == 0


def _opened(path: str):
    """A file as Spark names it, for reading at any place."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path) if parts.scheme else path)
    store, at = fs.FileSystem.from_uri("s3" + path[3:] if parts.scheme == "s3a" else path)
    return store.open_input_file(at)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            h, left = hashlib.sha256(), int(row.size)
            with _opened(row.path) as f:
                f.seek(int(row.start))
                while left and (data := f.read(min(STEP, left))):
                    h.update(data)
                    left -= len(data)
            if left:
                raise OSError(f"{row.path} became shorter while it was read")
            yield pd.DataFrame([[row.path, row.start, row.size, h.hexdigest()]], columns=["path", "start", "size", "sha256"])


def _dealt(ranges: DataFrame) -> DataFrame:
    """A row for each task's read, dealt by hash so that a file's ranges are
    read side by side."""
    spread = ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4, "path", "start")
    return spread.mapInPandas(_hashed, "path string, start long, size long, sha256 string")


def file_digests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, bytes, sha256) of whole files, read in steps of a megabyte: a
    file's size is bounded by nothing.  One file is one task's, as SHA-256 goes
    from its beginning to its end; ``chunk_digests`` divides it."""
    whole = listed(spark, paths).select("path", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("size"))
    return _dealt(whole).select("path", F.col("size").alias("bytes"), "sha256")


def chunk_digests(spark: SparkSession, paths: list[str] | str, size: int = 256 << 20) -> DataFrame:
    """(path, start, size, sha256) of each ``size`` bytes, read side by side;
    an empty file is one empty chunk.  Two lists of them tell where files
    differ."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))
    cuts = listed(spark, paths).select("path", "bytes", F.explode(starts).alias("start"))
    return _dealt(cuts.select("path", "start", F.least(F.col("bytes") - F.col("start"), F.lit(size)).cast("long").alias("size")))


def tree_digests(chunks: DataFrame) -> DataFrame:
    """(path, bytes, chunks, tree_sha256): the digest of a file's chunk digests
    in their order, 64 characters for each."""
    rows = F.sort_array(F.collect_list(F.struct("start", "sha256")))
    got = chunks.groupBy("path").agg(F.sum("size").alias("bytes"), F.count("*").alias("chunks"), rows.alias("x"))
    return got.select("path", "bytes", "chunks", F.sha2(F.array_join(F.col("x.sha256"), ""), 256).alias("tree_sha256"))


def compare_digests(found: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Files or chunks that aren't as the list says: (keys, problem), which is
    ``missing`` (listed only), ``unlisted`` (found only) or ``changed``.  Both
    hold keys and sha256; a key that a list holds twice with two digests is
    changed, a null digest agrees with none."""
    have = found.groupBy(*keys).agg(F.min("sha256").alias("a"), F.max("sha256").alias("a2"), F.lit(1).alias("here"))
    want = wanted.groupBy(*keys).agg(F.min("sha256").alias("b"), F.max("sha256").alias("b2"), F.lit(1).alias("there"))
    same = F.coalesce((F.col("a") == F.col("b")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), F.lit(False))
    problem = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "unlisted").when(~same, "changed")
    return have.join(want, list(keys), "full_outer").select(*keys, problem.alias("problem")).filter("problem is not null")


#: Texts for a model's first run (fixed).
SMOKE = ("thank you for the notes, they were of great use", "sign up now through the link in my profile, 100 % bonus")


def smoke(spark: SparkSession, predict: Callable[[DataFrame], DataFrame], texts: tuple[str, ...] = SMOKE) -> DataFrame:
    """What is wrong with a model's first run on a few texts: a row for each
    text without exactly one prediction of 0 or 1, or one row with the error."""
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    schema = "id int, problem string"
    try:
        got = predict(asked).select("id", F.col("predicted_label").cast("int").alias("p")).collect()  # as many rows as texts
    except Exception as e:  # whatever a model fails with is the report's row
        return spark.createDataFrame([(None, f"{type(e).__name__}: {str(e)[:200]}")], schema)
    seen = {i: [r.p for r in got if r.id == i] for i in range(len(texts))}
    bad = [(i, f"predictions {p}") for i, p in seen.items() if len(p) != 1 or p[0] not in (0, 1)]
    return spark.createDataFrame(bad, schema)


def preflight(spark: SparkSession, files: dict[str, str], models: dict[str, Callable[[DataFrame], DataFrame]] = {}, tables: dict[str, tuple[DataFrame, list[str]]] = {}) -> DataFrame:
    """(check, violations) before an evaluation: every file of ``files`` (path
    to SHA-256) is there and unchanged, every model answers a few texts, every
    table holds rows and its columns.  Nothing is evaluated if one fails:
    ``expect.require``."""
    from textmill.sources.sinks import exists

    wanted = spark.createDataFrame([(_plain(p), s.lower()) for p, s in files.items()], "path string, sha256 string")
    there = [p for p in files if exists(spark, p)]
    found = file_digests(spark, there).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    problems = compare_digests(found, wanted)
    checks = {"files_there": problems.filter("problem = 'missing'"), "files_unchanged": problems.filter("problem = 'changed'")}
    for name, model in models.items():
        checks[f"model_{name}"] = smoke(spark, model)
    for name, (df, columns) in tables.items():
        lacking = [(c,) for c in columns if c not in df.columns]
        empty = df.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("rows").alias("lacks"))
        checks[f"table_{name}"] = empty.unionByName(spark.createDataFrame(lacking, "lacks string"))
    return count_violations(checks)


def _plain(path: str) -> str:
    parts = urlparse(path)
    return "/" + unquote(parts.path).lstrip("/") if parts.scheme == "file" else path
