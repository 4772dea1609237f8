"""Joint log-geometry densities, importance weights, capped probabilities and resampling.

Rows of one grid cell share their ratio and probability, so everything after binning works on at
most bins squared cells: capping runs over that table, never over rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.functions.numeric import ASPECT_FLOOR, HEIGHT_FLOOR, log_floor, uniform

CELL = ["hb", "ab"]


def grid_edges(*populations: DataFrame, height: str = "height", aspect: str = "aspect") -> DataFrame:
    """Least and largest log height and log aspect over the union of the populations: one row."""
    every = populations[0].select(height, aspect)
    for p in populations[1:]:
        every = every.unionByName(p.select(height, aspect))
    h, a = log_floor(F.col(height), HEIGHT_FLOOR), log_floor(F.col(aspect), ASPECT_FLOOR)
    return every.agg(F.min(h).alias("h_low"), F.max(h).alias("h_high"), F.min(a).alias("a_low"), F.max(a).alias("a_high"))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    wide = F.when(high > low, high - low).otherwise(F.lit(1.0))  # a range of nothing is widened
    start = F.when(high > low, low).otherwise(low - 0.5)
    return F.least(F.greatest(F.floor((value - start) / wide * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def with_cells(df: DataFrame, edges: DataFrame, bins: int = 10, height: str = "height", aspect: str = "aspect") -> DataFrame:
    """Adds the cell (hb, ab) of each row."""
    h, a = log_floor(F.col(height), HEIGHT_FLOOR), log_floor(F.col(aspect), ASPECT_FLOOR)
    joined = df.crossJoin(F.broadcast(edges))  # one row of edges
    return joined.withColumns({"hb": _bin(h, F.col("h_low"), F.col("h_high"), bins), "ab": _bin(a, F.col("a_low"), F.col("a_high"), bins)}).drop("h_low", "h_high", "a_low", "a_high")


def cell_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def cell_density(df: DataFrame) -> DataFrame:
    """Share of the rows in each cell that has any."""
    cells = cell_counts(df)
    total = cells.agg(F.sum("n").alias("total"))
    return cells.crossJoin(F.broadcast(total)).select(*CELL, "n", (F.col("n") / F.greatest(F.col("total"), F.lit(1))).alias("density"))  # one row


def density_ratio(candidates: DataFrame, target: DataFrame, strict: bool = False) -> DataFrame:
    """Cells of the candidates with their count and the ratio of target to own density (0 where the target has none)."""
    own, wanted = cell_density(candidates), cell_density(target).select(*CELL, F.col("density").alias("wanted"))
    out = own.join(F.broadcast(wanted), CELL, "left").select(*CELL, "n", (F.coalesce("wanted", F.lit(0.0)) / F.col("density")).alias("ratio"))  # at most bins squared rows
    if strict and not (out.agg(F.sum("ratio")).first()[0] or 0) > 0:
        raise ValueError("the geometries don't overlap")
    return out


def importance_weights(ratios: DataFrame) -> DataFrame:
    """Weight of a row of each cell, scaled to a mean of 1 over rows."""
    total = ratios.agg(F.sum(F.col("ratio") * F.col("n")).alias("mass"), F.sum("n").alias("rows"))
    return ratios.crossJoin(F.broadcast(total)).select(*CELL, "n", "ratio", F.try_divide(F.col("ratio") * F.col("rows"), F.col("mass")).alias("weight"))


def cap_cells(ratio: np.ndarray, rows: np.ndarray, draws: int, max_repeats: int = 10, exclude_zero: bool = False) -> np.ndarray:
    """Probability of a row of each cell, capped so that its expected repeats stay within the limit.

    The mass above the cap moves all open cells the same part of their way to it: with ``part`` the mass above
    over the room below, a row at p goes to p + part * (cap - p), which never passes the cap, so that one step is
    final. The way is longest where the ratio is zero; ``exclude_zero`` keeps such cells where they are.
    """
    plain = ratio / (ratio @ rows)
    if max_repeats <= 0:
        return plain
    cap = max_repeats / draws
    level = np.clip(plain, None, cap)
    room = (cap - level) * (ratio > 0 if exclude_zero else 1)
    above, below = (plain - level) @ rows, room @ rows
    out = level + room * (min(1.0, above / below) if below > 0 else 0.0)
    return out / (out @ rows)


def capped_probabilities(ratios: DataFrame, draws: int, max_repeats: int = 10, exclude_zero: bool = False) -> DataFrame:
    """Cells with their row probability; the table has at most bins squared rows, so it is capped on the driver."""
    cells = ratios.select(*CELL, "n", "ratio").collect()
    ratio, rows = np.array([c["ratio"] for c in cells], dtype=float), np.array([c["n"] for c in cells], dtype=float)
    if not len(cells) or not ratio @ rows > 0:
        raise ValueError("the geometries don't overlap")
    p = cap_cells(ratio, rows, draws, max_repeats, exclude_zero)
    return ratios.sparkSession.createDataFrame([(c["hb"], c["ab"], c["n"], float(c["ratio"]), float(x)) for c, x in zip(cells, p)], "hb int, ab int, n long, ratio double, p double")


def resample(candidates: DataFrame, cells: DataFrame, draws: int, seed: int = 0, key: str = "index") -> DataFrame:
    """Draws with replacement, row by row: each row repeats as often as systematic sampling gives it.

    A row's expected repeats are draws * p; the whole part is certain and the rest is decided by a
    uniform of its key, so no draw table exists and rows never move.
    """
    expected = F.col("p") * draws
    placed = candidates.join(F.broadcast(cells.select(*CELL, "p")), CELL)
    times = (F.floor(expected) + F.when(uniform(seed, 0, "resample", F.col(key)) < expected - F.floor(expected), 1).otherwise(0)).cast("int")
    return placed.withColumn("repeats", times).where("repeats > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1))).drop("p")


def effective_draws(counts: DataFrame, n: str = "repeats") -> DataFrame:
    """Effective number of distinct rows behind the draws."""
    return counts.where(F.col(n) > 0).agg((F.pow(F.sum(n), F.lit(2)) / F.sum(F.col(n) * F.col(n))).alias("effective"))
