"""Streaming edge weights: windowed co-activation counts of an event stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_weights(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, src, dst, w): how often user src did event type dst in each window; works on batches too."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("win"), F.col("user_id").alias("src"), F.col("event_type").alias("dst")).agg(F.count("*").alias("w")).select(F.col("win.start").alias("start"), "src", "dst", "w")


def maintain(events: DataFrame, path: str, checkpoint: str, **windows) -> StreamingQuery:
    """Append finished windows to a Parquet table from which graphs are rebuilt in batches."""
    return edge_weights(events, **windows).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
