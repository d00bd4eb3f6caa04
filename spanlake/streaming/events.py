"""Streaming: event counts by windows with a watermark, sequence numbers per key, and incremental masking of documents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events with a time zone and a watermark; a timestamp without a zone counts as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return _counts(events, F.window("ts", size))


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours") -> DataFrame:
    return _counts(events, F.window("ts", size, step))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def _counts(events: DataFrame, window) -> DataFrame:
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def numbered(events: DataFrame) -> DataFrame:
    """user_id, event_id, seq: a running number per user that goes on over micro-batches (one long of state per user)."""

    def number(key, frames, state):
        n = state.get[0] if state.exists else 0
        for pdf in frames:
            pdf = pdf.sort_values("event_id")
            yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "seq": range(n + 1, n + 1 + len(pdf))})
            n += len(pdf)
        state.update((n,))

    return events.groupBy("user_id").applyInPandasWithState(number, "user_id long, event_id long, seq long", "n long", "append", "NoTimeout")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; progress is in the checkpoint, so a second run goes on from it."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def mask_incrementally(docs: DataFrame, mask: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Masks whole documents, one micro-batch after another; a batch that is run again replaces its own part."""

    def each(batch: DataFrame, batch_id: int) -> None:
        mask(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
