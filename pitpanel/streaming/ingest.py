"""Streaming ingest: files of filings or events as they arrive, with the rules of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import Store


def ingest(stream: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Load a stream into a stored table batch by batch, by the table's own rule.

    A batch reads and rewrites only the partitions that its rows touch. One that runs again finds its rows stored and
    changes nothing, and one that is cut short leaves nothing, so restarts leave no duplicates.
    """

    def add(batch: DataFrame, _: int) -> None:
        store.load(table, batch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Window start, event_type, n, total of events (ts, event_type, value); rows later than the watermark are dropped."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = stream.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
