"""Mixing data sets by shares, epochs and windows; ordering, limits and set helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_boundaries(shares: DataFrame, order: str, count: str = "sample_count") -> DataFrame:
    """Adds low and high: the positions of an epoch that belong to each share (a short table)."""
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.sum(count).over(running)
    return shares.withColumn("high", high).withColumn("low", F.col("high") - F.col(count))


def locate(positions: DataFrame, bounds: DataFrame, epoch: int, pos: str = "pos") -> DataFrame:
    """Share and row of each epoch position: the window slides by the share's count each epoch and wraps."""
    # a row per share, and shares are configured by hand
    joined = positions.join(F.broadcast(bounds), (F.col(pos) >= F.col("low")) & (F.col(pos) < F.col("high")))
    return joined.withColumn("local", F.pmod(F.lit(epoch) * F.col("sample_count") + F.col(pos) - F.col("low"), F.col("dataset_rows")))


def dense_number(df: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Numbers from 0 without gaps within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def batch_limit(limit: int, batch: int, pos: Column) -> Column:
    """Rows up to a limit that is rounded up to whole batches."""
    return pos < -(-limit // batch) * batch


def codepoint_ranges(df: DataFrame, key: str, point: str) -> DataFrame:
    """Sorted integers of each key as closed ranges (gaps and islands)."""
    rows = df.select(key, point).distinct()
    island = F.col(point) - F.row_number().over(Window.partitionBy(key).orderBy(point))
    return rows.withColumn("island", island).groupBy(key, "island").agg(F.min(point).alias("lo"), F.max(point).alias("hi")).drop("island")


def covered(point: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: point.between(r["lo"], r["hi"]))


def top_by(df: DataFrame, by: list[Column], k: int | None) -> DataFrame:
    """The first k rows of an order; all of them where k is None."""
    return df.orderBy(*by).limit(k) if k is not None else df


def pick_styles(preferred: Column, available: Column, k: int) -> Column:
    """Preferred styles that exist, in order of preference, else the first available; k of them."""
    found = F.slice(F.array_intersect(preferred, available), 1, k)
    return F.when(F.size(found) > 0, found).otherwise(F.slice(available, 1, 1))


def first_seen_codes(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Integer code of each distinct value in order of first appearance."""
    firsts = df.groupBy(value).agg(F.min(pos).alias("first_pos"))
    return firsts.withColumn("code", F.row_number().over(Window.orderBy("first_pos")) - 1)
