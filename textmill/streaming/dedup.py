"""Exact de-duplication of a stream of texts (an extension: the batch
operators have no streaming counterpart to match)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textmill.functions.keys import exact_key
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, text: str, time: str, within: str = "1 day") -> DataFrame:
    """The first event of each text within the watermark."""
    return stream.withWatermark(time, within).withColumn("exact_key", exact_key(F.col(text))).dropDuplicatesWithinWatermark(["exact_key"])
