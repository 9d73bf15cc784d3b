"""Streams of quality events: an accumulated table that is finalised again, and windows in event time (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def accumulate(stream: DataFrame, path: str, checkpoint: str, finalize: Callable[[DataFrame], None]) -> StreamingQuery:
    """Writes each micro-batch as a part of its own number under path, then finalises all of it. A batch that runs again replaces its part."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finalize(batch.sparkSession.read.parquet(path))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean by tumbling window and key; rows later than `late` are left out."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("window.start").alias("window_start"), *keys, "n", "total", "mean")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): events with less than gap between them."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
