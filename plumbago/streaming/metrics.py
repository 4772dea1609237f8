"""A Spark-native extra: slice scores kept up to date over a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbago.operators.metrics import slice_metrics


def windowed_scores(stream: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes", slice_col: str = "slice_name") -> DataFrame:
    """Score of each slice and time window; state older than the watermark is dropped."""
    rows = stream.withWatermark(ts, late).withColumn("window", F.window(ts, window))
    return slice_metrics(rows, ["window", slice_col]).select(F.col("window.start").alias("window_start"), slice_col, "brier", "score", "n")


def start_scores(scores: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run the aggregation once over what is there, in update mode, resuming from its checkpoint."""
    return scores.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
