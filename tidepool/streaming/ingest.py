"""Ingest of arriving pages, and windows over events, as streams. An addition to the engine's batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import ingest


def follow_pages(spark: SparkSession, folder: str, schema: str, source_id: str, load: Callable[[], dict[str, DataFrame]], save: Callable[[dict[str, DataFrame], int], None], checkpoint: str, trigger: dict | None = None):
    """A query that ingests every new file of pages in folder. load and save read and write the tables' snapshots.

    A batch that is run again after a failure finds its pages unchanged and skips
    them, so the tables come out the same.
    """

    def batch(pages: DataFrame, number: int) -> None:
        save(ingest.ingest(ingest.from_pages(pages, source_id), load()), number)

    pages = spark.readStream.schema(schema).parquet(folder)
    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding windows; on a stream, windows close when the watermark has passed them."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


