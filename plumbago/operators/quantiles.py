"""Exact quantile profiles and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.functions.numeric import inverse_cdf

GRID = [i / 100 for i in range(101)]
#: The report's probes and the gaps up to which a metric is ok or close.
PROBES = (0.05, 0.25, 0.5, 0.75, 0.95)
OK, CLOSE = 0.15, 0.35


def quantiles(value: Column) -> Column:
    """101 exact quantiles with linear interpolation; values are counted map-side before they are sorted."""
    return F.percentile(value, F.array(*[F.lit(g) for g in GRID]))


def profile(df: DataFrame, columns: list[str], flag: str | None = None, by: list[str] = (), strict: bool = False) -> DataFrame:
    """Quantiles of each column, the share of the flag and the sample size."""
    shares = [F.avg(F.col(flag).cast("double")).alias(f"{flag}_share")] if flag else []
    out = df.groupBy(*by).agg(*[quantiles(F.col(c)).alias(c) for c in columns], *shares, F.count(F.lit(1)).alias("sample_size"))
    if strict and not df.limit(1).count():
        raise ValueError("an empty set has no profile")
    return out


def quantile_rows(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """One row for each of the 101 quantiles."""
    one = df.groupBy(*by).agg(quantiles(F.col(column)).alias("q"))
    return one.select(*by, F.posexplode("q").alias("step", "value"))


def compare(candidate: Column, reference: Column) -> tuple[Column, Column]:
    """Relative gap of two medians and its verdict."""
    gap = F.when(F.abs(reference) < 1e-12, F.lit(float("inf"))).otherwise(F.abs(candidate - reference) / F.abs(reference))
    return gap, F.when(gap <= OK, "ok").when(gap <= CLOSE, "close").otherwise("off")


def compare_profiles(candidate: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (metric, probe, candidate, reference, ratio, gap, verdict) of two one-row profiles."""
    both = candidate.select(*[F.col(c).alias(f"c_{c}") for c in columns]).crossJoin(reference.select(*[F.col(c).alias(f"r_{c}") for c in columns]))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"c_{c}").alias("c"), F.col(f"r_{c}").alias("r")) for c in columns])
    one = both.select(F.explode(rows).alias("m")).select("m.metric", "m.c", "m.r", F.explode(F.array(*[F.lit(p) for p in PROBES])).alias("probe"))
    gap, verdict = compare(inverse_cdf(F.lit(0.5), F.col("c")), inverse_cdf(F.lit(0.5), F.col("r")))
    at = lambda q: inverse_cdf(F.col("probe"), F.col(q))
    return one.select("metric", "probe", at("c").alias("candidate"), at("r").alias("reference"), F.try_divide(at("c"), at("r")).alias("ratio"), gap.alias("median_gap"), verdict.alias("verdict"))
