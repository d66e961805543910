"""Running byte statistics over a stream of documents (an extension: the batch operators over unbounded input)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import byte_characters


def windowed_histogram(stream: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``(start, b, cnt)``: byte counts by tumbling window; rows later than ``late`` are left out, and windows past it are final."""
    rows = stream.withWatermark(time, late).select(time, F.encode(text, "UTF-8").alias("content"))
    counts = byte_characters(rows, time).groupBy(F.window(time, window).alias("w"), "c").agg(F.count("*").alias("cnt"))
    return counts.select(F.col("w.start").alias("start"), F.ascii("c").alias("b"), "cnt")
