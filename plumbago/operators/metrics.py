"""Weighted proper scores, decompositions and reports, one aggregate per slice.

Every metric is a ratio of plain sums, so Spark combines it map-side; slices are never averaged into
one number. Inputs have a probability or logit, a label, a weight and grouping columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.functions.numeric import LOG_CLIP, bce_with_logits, bin_of, clip


def mean_of(value: Column, weight: Column) -> Column:
    """Weighted mean; NULL where the weights sum to nothing."""
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def brier(p: Column, y: Column, w: Column) -> Column:
    return mean_of(F.pow(clip(p, 0.0, 1.0) - y, F.lit(2)), w)


def accuracy(p: Column, y: Column, w: Column) -> Column:
    return mean_of(F.when((clip(p, 0.0, 1.0) >= 0.5) == (y >= 0.5), 1.0).otherwise(0.0), w)


def log_loss(p: Column, y: Column, w: Column) -> Column:
    q = clip(p, LOG_CLIP, 1 - LOG_CLIP)
    return mean_of(-(y * F.log(q) + (1 - y) * F.log(1 - q)), w)


def effective_size(w: Column, guarded: bool = False) -> Column:
    """(sum w)^2 / sum w^2; guarded with a small floor as the metrics report has it."""
    squares = F.sum(w * w)
    return F.try_divide(F.pow(F.sum(w), F.lit(2)), F.greatest(squares, F.lit(1e-7)) if guarded else squares)


def slice_metrics(df: DataFrame, by: list[str], p: str = "p", y: str = "label", w: str = "weight", strict: bool = False) -> DataFrame:
    """Brier, score, accuracy, log loss, mean probability, count and effective count of each group."""
    p_, y_, w_ = F.col(p), F.col(y), F.col(w)
    out = df.groupBy(*by).agg(
        brier(p_, y_, w_).alias("brier"), (1 - brier(p_, y_, w_)).alias("score"), accuracy(p_, y_, w_).alias("accuracy"), log_loss(p_, y_, w_).alias("log_loss"),
        mean_of(clip(p_, 0.0, 1.0), w_).alias("mean_probability"), F.count(F.lit(1)).alias("n"), effective_size(w_, True).alias("effective_count"),
    )
    if strict and out.where("brier is null").limit(1).count():
        raise ValueError("weights must have a positive sum")
    return out


def bce_loss(df: DataFrame, by: list[str], z: str = "logit", y: str = "label", w: str = "weight") -> DataFrame:
    return df.groupBy(*by).agg(mean_of(bce_with_logits(F.col(z), F.col(y)), F.col(w)).alias("loss"))


def bin_edges(bins: int) -> Column:
    """Inner and outer edges 0..1; i / bins equals the float grid that counts as equal width."""
    if bins < 2:
        raise ValueError("at least two bins are needed")
    step = 1.0 / bins
    return F.array(*[F.lit(i * step) for i in range(bins)])


def murphy_bins(df: DataFrame, by: list[str], bins: int = 20, p: str = "p", y: str = "label", w: str = "weight") -> DataFrame:
    """Weight, mean probability and observed rate of each probability bin; empty bins have no row."""
    p_ = clip(F.col(p), 0.0, 1.0)
    binned = df.withColumn("bin", bin_of(p_, bin_edges(bins), bins))
    out = binned.groupBy(*by, "bin").agg(F.sum(w).alias("bin_weight"), mean_of(p_, F.col(w)).alias("mean_p"), mean_of(F.col(y), F.col(w)).alias("observed"), F.count(F.lit(1)).alias("n"))
    return out.where("bin_weight > 0")


def murphy_decomposition(df: DataFrame, by: list[str], bins: int = 20, **names: str) -> DataFrame:
    """Reliability, resolution, uncertainty, the Brier score they recompose, and the calibration headroom."""
    rows = murphy_bins(df, by, bins, **names)
    # the base rate is a sum over the bins of its group, so the second aggregate needs no window over rows
    parts = rows.groupBy(*by).agg(
        F.sum("bin_weight").alias("total"), F.sum(F.col("bin_weight") * F.col("observed")).alias("hits"),
        F.sum(F.col("bin_weight") * F.pow(F.col("mean_p") - F.col("observed"), F.lit(2))).alias("rel"), F.sum(F.col("bin_weight") * F.col("observed") * F.col("observed")).alias("squares"),
    )
    rate = F.col("hits") / F.col("total")
    rel, res, unc = F.col("rel") / F.col("total"), F.col("squares") / F.col("total") - rate * rate, rate * (1 - rate)
    return parts.select(*by, rel.alias("reliability"), res.alias("resolution"), unc.alias("uncertainty"), (rel - res + unc).alias("brier"), rel.alias("headroom"))


def consistency_report(df: DataFrame, by: list[str], forward: str = "forward", flipped: str = "flipped") -> DataFrame:
    """How far two views of one item contradict each other, and how decided their mean is."""
    f, g = F.col(forward), F.col(flipped)
    gap, middle = F.abs(f + g - 1), (f + 1 - g) / 2
    return df.groupBy(*by).agg(
        F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.avg(middle).alias("mean_p"), F.avg(F.when(F.abs(middle - 0.5) > 0.4, 1.0).otherwise(0.0)).alias("confident_share"),
    )


def bucket_scores(df: DataFrame, slice_col: str, value: str, edges: list[float], least: int = 30, p: str = "p", y: str = "label", w: str = "weight") -> DataFrame:
    """Score by slice and value bucket (low <= v < high); buckets of ``least`` rows or fewer are hidden."""
    label = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        label = F.when((F.col(value) >= low) & (F.col(value) < high), F.lit(f"{low:g}-{high:g}")).otherwise(label)
    rows = df.withColumn("bucket", label).where("bucket is not null")
    out = rows.groupBy(slice_col, "bucket").agg((1 - brier(F.col(p), F.col(y), F.col(w))).alias("score"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") > least)


def score_gap(df: DataFrame, slice_col: str, first: str, second: str, p: str = "p", y: str = "label", w: str = "weight") -> DataFrame:
    """Difference of two slices' scores in one pass."""
    def score(name: str) -> Column:
        own = F.when(F.col(slice_col) == name, F.col(w)).otherwise(0.0)
        return 1 - brier(F.col(p), F.col(y), own)

    return df.where(F.col(slice_col).isin(first, second)).agg(score(first).alias("first_score"), score(second).alias("second_score"), (score(first) - score(second)).alias("gap"))


def best_so_far(df: DataFrame, order: str, score: str) -> DataFrame:
    """Marks rows whose score is above all before (a short history, so one ordered window)."""
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("is_best", F.coalesce(F.col(score) > F.max(score).over(earlier), F.lit(True)))


def submission_rows(df: DataFrame, id_col: str, p: str) -> DataFrame:
    """Identifier and probability with six digits after the point."""
    return df.select(F.col(id_col), F.format_string("%.6f", F.col(p)).alias("p_180"))


def submission_summary(df: DataFrame, p: str) -> DataFrame:
    return df.agg(F.avg(p).alias("mean_p"), F.avg(F.when(F.abs(F.col(p) - 0.5) > 0.4, 1.0).otherwise(0.0)).alias("confident_share"), F.count(F.lit(1)).alias("n"))
