"""Source registry and readers."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


@dataclass(frozen=True)
class SourceSpec:
    """How a source's columns map to canonical ones."""

    dataset: str
    path: str
    row_id: str
    text: str
    label: str | None = None
    lineage: str = ""
    priority: int = 0


DOCUMENTS = SourceSpec("DS1", "documents.parquet", "doc_id", "text", None, "documents", 1)
CONVERSATIONS = SourceSpec("DS2", "conversations.parquet", "row", "text", "turn", "conversations", 2)
BENCHMARK = SourceSpec("DS3", "benchmark.parquet", "item_id", "text", None, "benchmark", 3)


def read_csv(spark: SparkSession, paths: list[str] | str, schema: StructType | str) -> DataFrame:
    """Quoted multi-line CSV by a declared schema; other columns fail."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="FAILFAST", enforceSchema=False).csv(paths)


def read_csv_strings(spark: SparkSession, paths: list[str] | str, columns: list[str]) -> DataFrame:
    """All columns as strings, several files as one table."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, StringType())
    return read_csv(spark, paths, schema)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory(frames: dict[str, DataFrame]) -> list[dict]:
    """Rows, columns and types of each table, counted in one job."""
    if not frames:
        return []
    counts = reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in frames.items()])
    rows = {r.k: r.n for r in counts.collect()}
    return [{"dataset": k, "rows": rows[k], "columns": df.columns, "dtypes": dict(df.dtypes)} for k, df in frames.items()]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def vocabulary(path: str) -> dict:
    """A vocabulary file's characters: ``stoi`` (ids), ``itos`` (by id), ``pad``
    and ``unk``; raises if these don't agree."""
    held = read_manifest(path)
    stoi = {k: int(v) for k, v in held["stoi"].items()}
    itos = {v: k for k, v in stoi.items()} | {int(k): v for k, v in dict(held.get("itos", {})).items()}
    pad, unk = int(held.get("pad", 0)), int(held.get("unk", 1))
    if any(itos[v] != k for k, v in stoi.items()) or pad == unk:
        raise ValueError(f"{path} does not agree with itself")
    return {"stoi": stoi, "itos": itos, "pad": pad, "unk": unk}


def encode_characters(df: DataFrame, held: dict, width: int, text: str = "text") -> DataFrame:
    """Adds ``ids``: the first ``width`` characters' ids, unknown ones as
    ``unk``, padded; the map is a literal of the vocabulary's size."""
    ids = F.create_map(*[F.lit(x) for pair in held["stoi"].items() for x in pair])
    chars = F.filter(F.split(F.substring(text, 1, width), ""), lambda c: c != "")
    known = F.transform(chars, lambda c: F.coalesce(ids[c], F.lit(held["unk"])))
    return df.withColumn("ids", F.concat(known, F.array_repeat(F.lit(held["pad"]), F.lit(width) - F.size(known))))


def read_model(path: str):
    """A saved pipeline; raises with the path if it is none."""
    from pyspark.ml import PipelineModel

    try:
        return PipelineModel.load(path)
    except Exception as e:
        raise ValueError(f"no saved pipeline at {path}") from e
