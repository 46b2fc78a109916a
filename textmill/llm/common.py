"""What the operators share: reading, the shared folder, batches in Python."""

from __future__ import annotations

import ctypes
import glob
import os
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.graph import components  # noqa: F401
from textmill.operators.storage import cut, release, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def remainder(key: str, by: int):
    """crc32 of the id as text, modulo ``by``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % by, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of one column, so that
    what is made of a piece stays small whatever the length of the texts.
    Memory that was used for them goes back to the system at the end, as the
    worker goes on with other tasks."""
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            at = total = 0
            for i, n in enumerate(sizes):
                total += n
                if total >= most:
                    yield batch.slice(at, i + 1 - at)
                    at, total = i + 1, 0
            if at < len(sizes):
                yield batch.slice(at)
    finally:
        batch = None
        trim()


#: What a worker process keeps from task to task, by operator: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def takes_over(owner: str) -> None:
    """A worker that starts on another operator's tasks drops what it kept for
    the one before."""
    for name, drop in KEPT.items():
        if name != owner:
            drop()


def trim() -> None:
    """Gives freed memory of this process back to the system, where the C
    library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


@cache
def one_thread() -> None:
    """Matrix products of this process take one thread.  A worker has one core
    for its task; with a thread for each core, small products wait for one
    another and take three times the processor's time."""
    names = [f"{a}openblas_set_num_threads{b}" for a in ("scipy_", "") for b in ("64_", "")]
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in names:
            if hasattr(lib, name):
                getattr(lib, name)(1)


def by_group(df: DataFrame, keys: list[str], links: Callable[[pa.RecordBatch], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that ``links`` makes of each group of two rows and more; keys are
    whole numbers.  Groups are runs of a sorted partition, so that a small one
    costs no call of its own into Spark; one group at a time is held."""
    def found(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def made() -> list[tuple[int, int]]:
            if sum(h.num_rows for h in held) < 2:
                return []
            return links(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0])

        def rows(got):
            return pa.record_batch({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            turns = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            out: list[tuple[int, int]] = []
            for start, end in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
                here = key[:, start].tolist()
                if here != last:
                    out += made()
                    held, last = [], here
                held.append(batch.slice(start, end - start))
            yield rows(out)
        yield rows(made())

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(found, "a long, b long")
