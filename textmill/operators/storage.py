"""The shared folder, and plans cut there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session, else the checkpoint directory that the program has set.  Where
    both are unset, a folder under /tmp on one machine, an error on a cluster."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at:
        return at
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = "file:///tmp/checkpoints/textmill"
    context.setCheckpointDir(at)
    return context.getCheckpointDir() or at


def cut(df: DataFrame) -> DataFrame:
    """The rows computed once and written to the shared folder, so that lost
    executors cost no more than a read; Spark removes the files later."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Frees the shuffle files and cut tables that nothing refers to any more:
    Spark removes them once the driver has collected what held them, which an
    iteration may outrun."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns that are computed once, however often they are
    used later: the optimizer merges projections, and then computes a shared
    expression at each use (in a lambda, at each element), but it doesn't
    merge them across a generator."""
    held = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    return held.select(*[c for c in df.columns if c not in columns], *[F.col(f"_once.{k}").alias(k) for k in columns])


#: Bytes of a table below which each core gets a share of it, whatever its files.
SMALL_SHARE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that is small for the session's cores, dealt to all of them: a
    file of one row group would be one task's work.  Larger tables have row
    groups enough and are left as they are, so that no text is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SHARE else df
