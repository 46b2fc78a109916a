"""Sinks: tables, reports, manifests, resumable partitions."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet; with partitions, only those in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").options(header=True, escape='"', quoteAll=True).csv(path)


def exists(spark, path: str) -> bool:
    """Whether a folder or file is there, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _marker(path: str, values: list) -> str:
    """Where a partition's commit marker lies: beside the data, hidden from
    readers, named by the partition's values."""
    return f"{path}/_committed/{identity([None if v is None else str(v) for v in values])}"


def write_missing(df: DataFrame, path: str, keys: tuple[str, ...]) -> int:
    """Writes the partitions of ``df`` that aren't committed yet; how many.
    A partition counts as there once its marker is, which is made after all of
    its files: what a broken run left of a partition is replaced.  The keys'
    distinct values come to the driver, as their folders do in any listing."""
    spark = df.sparkSession
    parts = [list(r) for r in df.select(*keys).distinct().collect()]
    new = [v for v in parts if not exists(spark, _marker(path, v))]
    if not new:
        return 0
    asked = spark.createDataFrame(new, df.select(*keys).schema)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    held = df.alias("d").join(F.broadcast(asked.alias("n")), reduce(lambda a, b: a & b, same), "left_semi")
    write_table(held, path, keys)
    for values in new:
        where = spark._jvm.org.apache.hadoop.fs.Path(_marker(path, values))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True).close()
    return len(new)


def write_review_queue(df: DataFrame, path: str, reason: str = "reason") -> int:
    """Rows with a reason, by reason; how many there are."""
    held = df.filter(f"{reason} is not null")
    write_table(held, path, (reason,))
    return df.sparkSession.read.parquet(path).count() if exists(df.sparkSession, path) else 0


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A result as a Markdown table; says how many rows are shown if it has
    more than ``most``."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(v) for v in r] for r in df.limit(most + 1).collect()]
    more = f"\nThe first {most} rows.\n" if len(rows) > most else ""
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows[:most]]) + "\n" + more


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def identity(value: object) -> str:
    """SHA-256 of sorted-key JSON: equal configurations, equal identity."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def manifest(counts: dict[str, DataFrame], files: dict[str, str], config: object) -> dict:
    """Rows of each table (one job), digests of files, the configuration's
    identity and the environment."""
    import platform

    import pyspark

    from textmill.sources.registry import inventory

    return {"counts": {r["dataset"]: r["rows"] for r in inventory(counts)}, "sha256": {k: file_digest(p) for k, p in files.items()}, "identity": identity(config), "environment": {"python": platform.python_version(), "pyspark": pyspark.__version__}}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_manifest(value: dict, path: str) -> str:
    """Writes beside, syncs, then moves, and reads the result back; returns
    its SHA-256."""
    data = (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
    digest = hashlib.sha256(data).hexdigest()
    if file_digest(path) != digest:
        raise OSError(f"{path} was not written as given")
    return digest


def same_identity(manifest: dict, config: object) -> None:
    """Refuses to resume if the configuration is another one."""
    if manifest.get("identity") != identity(config):
        raise ValueError("the manifest belongs to another configuration")
