"""Geometry, quantile and resampling queries over crop geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions import numeric
from plumbago.operators import geometry, quantiles
from plumbago.plans.scoring import rounded
from plumbago.plans.stand_ins import CROPS_SQL, crops, table

DRAWS = 5000


def roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = crops(spark, sf_dir)
    return rows.where("role = 'candidate'"), rows.where("role = 'target'")


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, target = roles(spark, sf_dir)
    edges = geometry.grid_edges(candidates, target)
    return geometry.density_ratio(geometry.with_cells(candidates, edges), geometry.with_cells(target, edges))


def quantile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantiles.quantile_rows(crops(spark, sf_dir), "aspect", ["slice_name"]), 9).withColumnRenamed("step", "percent")


def profile_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, target = roles(spark, sf_dir)
    profile = lambda d: quantiles.profile(d, ["height", "aspect"])
    return rounded(quantiles.compare_profiles(profile(candidates), profile(target), ["height", "aspect"]), 5)


def inverse_cdf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = crops(spark, sf_dir).agg(quantiles.quantiles(F.col("height")).alias("q"))
    drawn = table(spark, sf_dir, "events").select("event_id", numeric.lcg_uniform(F.col("event_id")).alias("u")).crossJoin(F.broadcast(one))  # one row
    return rounded(drawn.select("event_id", numeric.inverse_cdf(F.col("u"), F.col("q")).alias("height")), 6)


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.grid_edges(*roles(spark, sf_dir)))


def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, target = roles(spark, sf_dir)
    return rounded(geometry.cell_density(geometry.with_cells(target, geometry.grid_edges(candidates, target))))


def density_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ratios(spark, sf_dir), 6)


def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.importance_weights(_ratios(spark, sf_dir)).select("hb", "ab", "n", "weight"), 6)


def weighted_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = geometry.importance_weights(_ratios(spark, sf_dir))
    return rounded(w.agg((F.pow(F.sum(F.col("weight") * F.col("n")), F.lit(2)) / F.sum(F.col("weight") * F.col("weight") * F.col("n"))).alias("effective")), 4)


def capped_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = geometry.capped_probabilities(_ratios(spark, sf_dir), DRAWS, 1)
    return rounded(cells.select("hb", "ab", "n", (F.col("p") * DRAWS).alias("expected")), 6)


def resample_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, target = roles(spark, sf_dir)
    edges = geometry.grid_edges(candidates, target)
    placed = geometry.with_cells(candidates, edges)
    cells = geometry.capped_probabilities(geometry.density_ratio(placed, geometry.with_cells(target, edges)), DRAWS)
    keyed = placed.withColumn("index", F.col("l_orderkey") * 1000 + F.col("l_partkey"))
    return geometry.resample(keyed, cells, DRAWS).select("index", "height", "aspect", "repeat", "repeats")


def tilt_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crops(spark, sf_dir).withColumn("tilt", (F.col("l_partkey") % 37 - 18).cast("double"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return rounded(rows.select(*keys, numeric.tilt_ceiling(F.col("aspect")).alias("ceiling"), numeric.tilt_compensation(F.col("tilt"), F.col("aspect")).alias("compensation")), 6)


def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select("p_partkey", *[(F.col("p_partkey") * k % 256).cast("int").alias(n) for k, n in ((7, "r"), (11, "g"), (13, "b"))])
    own = numeric.relative_luminance(F.col("r"), F.col("g"), F.col("b"))
    return rounded(c.select("p_partkey", own.alias("luminance"), numeric.contrast_ratio(own, F.lit(1.0)).alias("contrast")), 6)


CELLS_SQL = f"""{CROPS_SQL}, both_ AS (SELECT * FROM crop WHERE role IS NOT NULL),
edge AS (SELECT min(ln(greatest(height, 8.0::DOUBLE))) AS h_low, max(ln(greatest(height, 8.0::DOUBLE))) AS h_high, min(ln(greatest(aspect, 1.05::DOUBLE))) AS a_low, max(ln(greatest(aspect, 1.05::DOUBLE))) AS a_high FROM both_),
cell AS (SELECT role, least(greatest(floor((ln(greatest(height, 8.0::DOUBLE)) - h_low) / (h_high - h_low) * 10), 0), 9)::INT AS hb, least(greatest(floor((ln(greatest(aspect, 1.05::DOUBLE)) - a_low) / (a_high - a_low) * 10), 0), 9)::INT AS ab FROM both_, edge),
dens AS (SELECT role, hb, ab, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY role) AS density FROM cell GROUP BY role, hb, ab),
ratio AS (SELECT c.hb, c.ab, c.n, coalesce(t.density, 0) / c.density AS ratio FROM (SELECT * FROM dens WHERE role = 'candidate') c LEFT JOIN (SELECT * FROM dens WHERE role = 'target') t USING (hb, ab)),
wt AS (SELECT hb, ab, n, ratio, ratio * sum(n) OVER () / sum(ratio * n) OVER () AS weight FROM ratio)"""
_Q = "[" + ", ".join(f"{i / 100}" for i in range(101)) + "]"
_LERP = "q[least(floor({u} * 100), 99)::INT + 1] + (q[least(floor({u} * 100), 99)::INT + 2] - q[least(floor({u} * 100), 99)::INT + 1]) * ({u} * 100 - least(floor({u} * 100), 99))"


def _pass(source: str, name: str) -> str:
    """One capping pass over cells (p of a row, n rows) with a cap of 1 / DRAWS."""
    cap = f"{1 / DRAWS!r}::DOUBLE"
    return f"""{name}_s AS (SELECT sum(CASE WHEN p > {cap} THEN (p - {cap}) * n ELSE 0 END) AS released, sum(CASE WHEN p > {cap} THEN 0 ELSE ({cap} - p) * n END) AS room FROM {source}),
{name} AS (SELECT hb, ab, n, CASE WHEN p > {cap} THEN {cap} WHEN released > 0 AND room > 0 THEN p + ({cap} - p) / room * least(released, room) ELSE p END AS p FROM {source}, {name}_s)"""


_LUM = " + ".join(f"{w}::DOUBLE * CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE (({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE END" for w, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b")))

QUERIES = (
    quantile_profile, profile_compare, inverse_cdf_sample, grid_edges, grid_density, density_ratio, importance_weights, weighted_ess, capped_probabilities,
    resample_draws, tilt_ceiling, luminance,
)

SQL = {
    "quantile_profile": f"""WITH {CROPS_SQL}, g AS (SELECT slice_name, quantile_cont(aspect, {_Q}) AS q FROM crop GROUP BY slice_name)
      SELECT slice_name, (i - 1)::INT AS percent, round(q[i], 9) AS value FROM g, range(1, 102) AS r(i)""",
    "profile_compare": f"""WITH {CROPS_SQL}, m AS (SELECT role, 'height' AS metric, height AS v FROM crop UNION ALL SELECT role, 'aspect', aspect FROM crop),
      g AS (SELECT metric, role, quantile_cont(v, {_Q}) AS q FROM m WHERE role IS NOT NULL GROUP BY metric, role),
      l AS (SELECT metric, role, probe, {_LERP.format(u='probe')} AS v, {_LERP.format(u='0.5::DOUBLE')} AS mid FROM g, (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.95)) AS p(probe)),
      j AS (SELECT metric, probe, c.v AS candidate, t.v AS reference, abs(c.mid - t.mid) / abs(t.mid) AS gap FROM l c JOIN l t USING (metric, probe) WHERE c.role = 'candidate' AND t.role = 'target')
      SELECT metric, probe, round(candidate, 5) AS candidate, round(reference, 5) AS reference, round(candidate / reference, 5) AS ratio, round(gap, 5) + 0.0 AS median_gap, CASE WHEN gap <= 0.15 THEN 'ok' WHEN gap <= 0.35 THEN 'close' ELSE 'off' END AS verdict FROM j""",
    "inverse_cdf_sample": f"""WITH {CROPS_SQL}, g AS (SELECT quantile_cont(height, {_Q}) AS q FROM crop), e AS (SELECT event_id, ((event_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS u FROM events)
      SELECT event_id, round({_LERP.format(u='u')}, 6) AS height FROM e, g""",
    "grid_edges": f"WITH {CELLS_SQL} SELECT round(h_low, 8) AS h_low, round(h_high, 8) AS h_high, round(a_low, 8) AS a_low, round(a_high, 8) AS a_high FROM edge",
    "grid_density": f"WITH {CELLS_SQL} SELECT hb, ab, n, round(density, 8) AS density FROM dens WHERE role = 'target'",
    "density_ratio": f"WITH {CELLS_SQL} SELECT hb, ab, n, round(ratio, 6) AS ratio FROM ratio",
    "importance_weights": f"WITH {CELLS_SQL} SELECT hb, ab, n, round(weight, 6) AS weight FROM wt",
    "weighted_ess": f"WITH {CELLS_SQL} SELECT round(sum(weight * n) ** 2 / sum(weight * weight * n), 4) AS effective FROM wt",
    "capped_probabilities": f"""WITH {CELLS_SQL}, p0 AS (SELECT hb, ab, n, ratio / sum(ratio * n) OVER () AS p FROM ratio), {_pass('p0', 'p1')}, {_pass('p1', 'p2')}
      SELECT hb, ab, n, round(p / sum(p * n) OVER () * {DRAWS}, 6) AS expected FROM p2""",
    "tilt_ceiling": f"""WITH {CROPS_SQL}, t AS (SELECT *, radians(abs(l_partkey % 37 - 18)::DOUBLE) AS a, 1.0::DOUBLE / greatest(aspect, 1.0::DOUBLE) AS s FROM crop)
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN s >= 1 THEN 18.0::DOUBLE ELSE least(18.0::DOUBLE, degrees(asin(s))) END, 6) AS ceiling,
      round(CASE WHEN cos(a) - aspect * sin(a) <= 0 THEN 1.5::DOUBLE ELSE least(greatest((aspect * cos(a) - sin(a)) / (cos(a) - aspect * sin(a)) / aspect, 1.0::DOUBLE), 1.5::DOUBLE) END, 6) AS compensation FROM t""",
    "luminance": f"""WITH c AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 11 % 256 AS g, p_partkey * 13 % 256 AS b FROM part), l AS (SELECT p_partkey, {_LUM} AS y FROM c)
      SELECT p_partkey, round(y, 6) AS luminance, round((greatest(y, 1.0::DOUBLE) + 0.05::DOUBLE) / (least(y, 1.0::DOUBLE) + 0.05::DOUBLE), 6) AS contrast FROM l""",
}
