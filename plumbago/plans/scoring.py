"""Score, calibration and ensemble queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions.numeric import sigmoid
from plumbago.operators import calibration, metrics
from plumbago.plans.stand_ins import PAIRED_SQL, PREDICTIONS_SQL, crops, paired_logits, predictions, CROPS_SQL

GRID = [0.25, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 8.0, 12.0]
ASPECTS = [1.0, 2.0, 4.0, 6.0, 8.0, 12.0]


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, with a negative zero made positive: sums depend on their order in the last bits."""
    return df.select(*[(F.round(F.col(f.name), digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def slice_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predictions(spark, sf_dir).groupBy("slice_name").agg(metrics.brier(F.col("p"), F.col("label"), F.col("weight")).alias("brier"))
    return rounded(out.withColumn("score", 1 - F.col("brier")))


def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.slice_metrics(predictions(spark, sf_dir), ["slice_name"]))


def bce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.bce_loss(predictions(spark, sf_dir), ["slice_name"]))


def effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predictions(spark, sf_dir).groupBy("slice_name").agg(metrics.effective_size(F.col("weight")).alias("effective")))


def murphy_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.murphy_bins(predictions(spark, sf_dir), ["slice_name"]))


def murphy_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.murphy_decomposition(predictions(spark, sf_dir), ["slice_name"]))


def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired_logits(spark, sf_dir).select(F.col("label"), sigmoid(F.col("forward")).alias("forward"), sigmoid(F.col("flipped")).alias("flipped"))
    return rounded(metrics.consistency_report(rows, ["label"]))


def bucket_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crops(spark, sf_dir).withColumns({"p": F.pmod(F.col("l_partkey"), F.lit(101)) / F.lit(100.0), "label": (F.col("l_suppkey") % 2).cast("double"), "weight": F.lit(1.0)})
    return rounded(metrics.bucket_scores(rows, "slice_name", "aspect", ASPECTS))


def slice_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.score_gap(predictions(spark, sf_dir), "slice_name", "purchase", "click"))


def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.temperature_grid(predictions(spark, sf_dir), GRID, ["slice_name"]))


def heldout_calibrated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.calibrated_scores(predictions(spark, sf_dir), "slice_name", "event_id", GRID))


def symmetric_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired_logits(spark, sf_dir).select("vec_id", calibration.symmetric_logit(F.col("forward"), F.col("flipped")).alias("logit")), 6)


def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired_logits(spark, sf_dir)
    return rounded(rows.select("vec_id", calibration.ensemble([sigmoid(F.col("forward")), 1 - sigmoid(F.col("flipped"))]).alias("p")), 6)


def ensemble_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired_logits(spark, sf_dir)
    z = calibration.symmetric_logit(F.col("forward"), F.col("flipped"))
    return rounded(rows.select("vec_id", calibration.ensemble([sigmoid(F.col("forward")), sigmoid(z, 2.0)], [1.0, 3.0]).alias("p")), 6)


def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.half_split(predictions(spark, sf_dir), "slice_name", "event_id")
    return rows.groupBy("slice_name", "calibrates").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = predictions(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 500).alias("epoch")).agg(F.round(1 - metrics.brier(F.col("p"), F.col("label"), F.col("weight")), 8).alias("score"))
    return metrics.best_so_far(days, "epoch", "score")


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select(F.format_string("crop_%06d", "event_id").alias("image_id"), F.round("p", 6).alias("p"))
    return metrics.submission_rows(rows, "image_id", "p")


def submission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.submission_summary(predictions(spark, sf_dir), "p"))


_P = f"WITH {PREDICTIONS_SQL}\n"
_EDGES = "[" + ", ".join(f"{i * 0.05!r}::DOUBLE" for i in range(20)) + "]"
_BINNED = f"""bins AS (SELECT *, greatest(len(list_filter({_EDGES}, lambda x: x <= p)) - 1, 0)::INT AS bin FROM pred)"""
_SCORE = "1 - sum(weight * (p - label) ** 2) / sum(weight)"
_BRIERS = ", ".join(f"{{'temperature': {t}::DOUBLE, 'brier': sum(weight * (1 / (1 + exp(-logit / {t}::DOUBLE)) - label) ** 2) / sum(weight)}}" for t in GRID)
_BUCKET = " ".join(f"WHEN aspect >= {a} AND aspect < {b} THEN '{a:g}-{b:g}'" for a, b in zip(ASPECTS[:-1], ASPECTS[1:]))

QUERIES = (
    slice_brier, slice_metrics, bce_loss, effective_size, murphy_bins, murphy_decomposition, consistency_report, bucket_scores, slice_gap, temperature_grid,
    heldout_calibrated_score, symmetric_logit, ensemble_mean, ensemble_weighted, half_split, best_so_far, submission_rows, submission_summary,
)

SQL = {
    "slice_brier": f"{_P}SELECT slice_name, round(1 - ({_SCORE}), 8) + 0.0 AS brier, round({_SCORE}, 8) + 0.0 AS score FROM pred GROUP BY slice_name",
    "slice_metrics": f"""{_P}SELECT slice_name, round(1 - ({_SCORE}), 8) AS brier, round({_SCORE}, 8) AS score, round(sum(weight * CASE WHEN (p >= 0.5) = (label >= 0.5) THEN 1 ELSE 0 END) / sum(weight), 8) AS accuracy,
      round(sum(weight * -(label * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))) / sum(weight), 8) AS log_loss,
      round(sum(weight * p) / sum(weight), 8) AS mean_probability, count(*) AS n, round(sum(weight) ** 2 / sum(weight * weight), 8) AS effective_count FROM pred GROUP BY slice_name""",
    "bce_loss": f"{_P}SELECT slice_name, round(sum(weight * (greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))))) / sum(weight), 8) AS loss FROM pred GROUP BY slice_name",
    "effective_size": f"{_P}SELECT slice_name, round(sum(weight) ** 2 / sum(weight * weight), 8) AS effective FROM pred GROUP BY slice_name",
    "murphy_bins": f"{_P}, {_BINNED} SELECT slice_name, bin, round(sum(weight), 8) AS bin_weight, round(sum(weight * p) / sum(weight), 8) AS mean_p, round(sum(weight * label) / sum(weight), 8) + 0.0 AS observed, count(*) AS n FROM bins GROUP BY slice_name, bin",
    "murphy_decomposition": f"""{_P}, {_BINNED}, b AS (SELECT slice_name, bin, sum(weight) AS w, sum(weight * p) / sum(weight) AS m, sum(weight * label) / sum(weight) AS o FROM bins GROUP BY slice_name, bin),
      s AS (SELECT slice_name, sum(w * (m - o) ** 2) / sum(w) AS rel, sum(w * o) / sum(w) AS r, sum(w * o * o) / sum(w) AS sq FROM b GROUP BY slice_name)
      SELECT slice_name, round(rel, 8) AS reliability, round(sq - r * r, 8) + 0.0 AS resolution, round(r * (1 - r), 8) + 0.0 AS uncertainty, round(rel - (sq - r * r) + r * (1 - r), 8) AS brier, round(rel, 8) AS headroom FROM s""",
    "consistency_report": f"""WITH {PAIRED_SQL}, c AS (SELECT label, 1 / (1 + exp(-forward)) AS f, 1 / (1 + exp(-flipped)) AS g FROM pair)
      SELECT label, round(avg(abs(f + g - 1)), 8) AS mean_gap, round(max(abs(f + g - 1)), 8) AS max_gap, round(avg((f + 1 - g) / 2), 8) AS mean_p, round(avg(CASE WHEN abs((f + 1 - g) / 2 - 0.5) > 0.4 THEN 1.0::DOUBLE ELSE 0 END), 8) + 0.0 AS confident_share FROM c GROUP BY label""",
    "bucket_scores": f"""WITH {CROPS_SQL}, b AS (SELECT slice_name, CASE {_BUCKET} END AS bucket, (l_partkey % 101) / 100.0::DOUBLE AS p, (l_suppkey % 2)::DOUBLE AS label FROM crop)
      SELECT slice_name, bucket, round(1 - avg((p - label) ** 2), 8) AS score, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY slice_name, bucket HAVING count(*) > 30""",
    "slice_gap": f"""{_P}, s AS (SELECT slice_name, {_SCORE} AS score FROM pred GROUP BY slice_name), t AS (SELECT max(score) FILTER (slice_name = 'purchase') AS a, max(score) FILTER (slice_name = 'click') AS b FROM s)
      SELECT round(a, 8) AS first_score, round(b, 8) AS second_score, round(a - b, 8) AS gap FROM t""",
    "temperature_grid": f"{_P}, g AS (SELECT slice_name, unnest([{_BRIERS}]) AS row FROM pred GROUP BY slice_name) SELECT slice_name, row.temperature AS temperature, round(row.brier, 8) AS brier FROM g",
    "heldout_calibrated_score": f"""{_P}, h AS (SELECT *, row_number() OVER (PARTITION BY slice_name ORDER BY event_id) - 1 < count(*) OVER (PARTITION BY slice_name) // 2 AS fit FROM pred),
      g AS (SELECT slice_name, unnest([{_BRIERS}]) AS row FROM h WHERE fit GROUP BY slice_name), t AS (SELECT slice_name, arg_min(row.temperature, row.brier) AS temperature FROM g GROUP BY slice_name)
      SELECT slice_name, any_value(temperature) AS temperature, round(1 - sum(weight * (1 / (1 + exp(-logit / temperature)) - label) ** 2) / sum(weight), 8) AS score, count(*) AS n FROM h JOIN t USING (slice_name) WHERE NOT fit GROUP BY slice_name""",
    "symmetric_logit": f"WITH {PAIRED_SQL} SELECT vec_id, round((forward - flipped) / 2, 6) + 0.0 AS logit FROM pair",
    "ensemble_mean": f"WITH {PAIRED_SQL} SELECT vec_id, round((1 / (1 + exp(-forward)) + 1 - 1 / (1 + exp(-flipped))) / 2, 6) AS p FROM pair",
    "ensemble_weighted": f"WITH {PAIRED_SQL} SELECT vec_id, round((1 / (1 + exp(-forward)) + 3 / (1 + exp(-(forward - flipped) / 2 / 2.0::DOUBLE))) / 4, 6) AS p FROM pair",
    "half_split": f"""{_P}, h AS (SELECT slice_name, event_id, row_number() OVER (PARTITION BY slice_name ORDER BY event_id) - 1 < greatest(count(*) OVER (PARTITION BY slice_name) // 2, 1) AS calibrates FROM pred)
      SELECT slice_name, calibrates, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM h GROUP BY slice_name, calibrates""",
    "best_so_far": f"""{_P}, d AS (SELECT event_id // 500 AS epoch, round({_SCORE}, 8) AS score FROM pred GROUP BY 1)
      SELECT epoch, score, coalesce(score > max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM d""",
    "submission_rows": f"{_P}SELECT printf('crop_%06d', event_id) AS image_id, printf('%.6f', round(p, 6)) AS p_180 FROM pred",
    "submission_summary": f"{_P}SELECT round(avg(p), 8) AS mean_p, round(avg(CASE WHEN abs(p - 0.5) > 0.4 THEN 1.0::DOUBLE ELSE 0 END), 8) AS confident_share, count(*) AS n FROM pred",
}
