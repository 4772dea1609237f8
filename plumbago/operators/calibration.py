"""Temperature calibration, symmetrised logits and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.functions.numeric import sigmoid
from plumbago.operators.metrics import brier


def symmetric_logit(forward: Column, flipped: Column) -> Column:
    """Logit of the item against its half turn; antisymmetric by construction."""
    return (forward - flipped) / 2


def ensemble(members: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean of the members' probabilities."""
    weights = weights or [1.0] * len(members)
    if not members or len(weights) != len(members) or sum(weights) <= 0:
        raise ValueError("every member needs a weight, and the weights a positive sum")
    return sum((m * w for m, w in zip(members[1:], weights[1:])), members[0] * weights[0]) / F.lit(float(sum(weights)))


def align_members(members: list[DataFrame], key: str) -> DataFrame:
    """Join members' predictions (key, p) on their key; ids that differ between members raise."""
    out = members[0].withColumnRenamed("p", "p_0")
    for i, m in enumerate(members[1:], 1):
        out = out.join(m.withColumnRenamed("p", f"p_{i}"), key)
    n = out.count()
    if any(m.count() != n for m in members):
        raise ValueError("the members predict different ids")
    return out


def half_split(df: DataFrame, slice_col: str, order: str, least_one: bool = True) -> DataFrame:
    """Adds pos within the slice and whether the row belongs to the calibration half (the first)."""
    rows = df.withColumn("pos", F.row_number().over(Window.partitionBy(slice_col).orderBy(order)) - 1)
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy(slice_col)) / 2)
    return rows.withColumn("calibrates", F.col("pos") < (F.greatest(half, F.lit(1)) if least_one else half))


def temperature_grid(df: DataFrame, temperatures: list[float], by: list[str] = (), z: str = "logit", y: str = "label", w: str = "weight") -> DataFrame:
    """Brier score at each temperature: one pass with an aggregate per grid point, then a small stack."""
    scores = [brier(sigmoid(F.col(z), t), F.col(y), F.col(w)) for t in temperatures]
    one = df.groupBy(*by).agg(F.array(*scores).alias("scores"))
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    return one.select(*by, F.explode(F.arrays_zip(grid.alias("temperature"), F.col("scores").alias("brier"))).alias("row")).select(*by, "row.temperature", "row.brier")


def best_temperature(df: DataFrame, temperatures: list[float], by: list[str] = (), **names: str) -> DataFrame:
    """The temperature with the least Brier score of each group; ties go to the lower."""
    grid = temperature_grid(df, temperatures, by, **names)
    least = grid.groupBy(*by).agg(F.min(F.struct("brier", "temperature")).alias("best"))
    return least.select(*by, F.col("best.temperature").alias("temperature"), F.col("best.brier").alias("brier"))


def fit_temperature(df: DataFrame, low: float = 0.05, high: float = 20.0, tolerance: float = 1e-4, points: int = 24, **names: str) -> float:
    """Bounded minimum of the Brier score over temperature: grids that narrow around the best point, one pass each."""
    while high - low > tolerance:
        step = (high - low) / (points - 1)
        best = best_temperature(df, [low + i * step for i in range(points)], **names).first()
        if best is None or best["brier"] is None:
            raise ValueError("nothing to calibrate on")
        low, high = max(low, best["temperature"] - step), min(high, best["temperature"] + step)
    return (low + high) / 2


def calibrated_scores(df: DataFrame, slice_col: str, order: str, temperatures: list[float], z: str = "logit", y: str = "label", w: str = "weight") -> DataFrame:
    """Fit the temperature on each slice's first half, score the second."""
    rows = half_split(df, slice_col, order, least_one=False)
    best = best_temperature(rows.where("calibrates"), temperatures, [slice_col], z=z, y=y, w=w).select(slice_col, "temperature")
    scored = rows.where("not calibrates").join(F.broadcast(best), slice_col)  # a row per slice
    return scored.groupBy(slice_col).agg(F.first("temperature").alias("temperature"), (1 - brier(sigmoid(F.col(z), F.col("temperature")), F.col(y), F.col(w))).alias("score"), F.count(F.lit(1)).alias("n"))
