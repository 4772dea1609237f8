"""Small report tables over scores, epochs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A test score and the validation score of the same earlier model.
KNOWN_TEST, KNOWN_VALIDATION = 0.94726, 0.9430


def estimate_test_score(scores: DataFrame, slice_col: str = "slice_name", score: str = "score", anchor: str = "real_scene") -> DataFrame:
    """The anchor slice's score moved by the gap once measured between test and validation."""
    return scores.where(F.col(slice_col) == anchor).select((F.col(score) + (KNOWN_TEST - KNOWN_VALIDATION)).alias("estimate"))


def model_summary(models: DataFrame) -> DataFrame:
    """Mean temperature over slices and the multiply-accumulates of all members (rows member, slice_name, temperature, macs)."""
    per = models.groupBy("member").agg(F.avg("temperature").alias("temperature"), F.first("macs").alias("macs"))
    return per.agg(F.avg("temperature").alias("mean_temperature"), F.sum("macs").alias("total_macs"))


def running_loss(batches: DataFrame, order: str, loss: str = "loss", rows: str = "rows") -> DataFrame:
    """Mean loss up to each batch, weighted by its rows (an epoch's batches are few)."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batches.withColumn("mean_loss", F.sum(F.col(loss) * F.col(rows)).over(so_far) / F.sum(rows).over(so_far))


def best_epoch(history: DataFrame, order: str = "index", score: str = "score") -> DataFrame:
    """The first epoch with the largest score."""
    return history.orderBy(F.col(score).desc(), F.col(order)).limit(1)


def score_table(scores: DataFrame, slices: list[str], bucket: str = "bucket", slice_col: str = "slice_name", score: str = "score") -> DataFrame:
    """Buckets by slice; hidden buckets are NULL."""
    return scores.groupBy(bucket).pivot(slice_col, slices).agg(F.first(score))


def session_row(history: DataFrame, temperature: float) -> DataFrame:
    """The session document: epochs in order with their slice scores, the best score and the temperature."""
    rows = F.array_sort(F.collect_list(F.struct("index", "loss", "seconds", "scores")), lambda a, b: (a["index"] - b["index"]).cast("int"))  # an epoch is a row
    return history.agg(F.max("index").alias("epoch"), F.max("score").alias("best_score"), rows.alias("history")).withColumn("temperature", F.lit(temperature))


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)
