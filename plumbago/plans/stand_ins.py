"""Stand-in columns over the star-schema tables for predictions, geometry, boxes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions.numeric import lcg_uniform, sigmoid

#: A fixed vector for dot products with embeddings.
PROJECTION = [((i * 37 + 11) % 64 - 31.5) / 32.0 for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overconfident predictions: event_id, slice_name, label, logit, p, weight."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("slice_name"))
    label = F.when(F.col("slice_name").isin("purchase", "signup"), 1.0).otherwise(0.0)
    rows = e.withColumn("label", label).withColumn("logit", 6 * ((2 * F.col("label") - 1) * 0.35 + (lcg_uniform(F.col("event_id")) - 0.5) * 2))
    return rows.withColumns({"p": sigmoid(F.col("logit")), "weight": 1 + (F.col("event_id") % 4) / F.lit(2.0)})


PREDICTIONS_SQL = """e AS (SELECT event_id, event_type AS slice_name, CASE WHEN event_type IN ('purchase','signup') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
  ((event_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS u, 1 + (event_id % 4) / 2.0::DOUBLE AS weight FROM events),
z AS (SELECT *, 6 * ((2 * label - 1) * 0.35::DOUBLE + (u - 0.5::DOUBLE) * 2) AS logit FROM e),
pred AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS p FROM z)"""


def paired_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of an item and of its half turn: vec_id, forward, flipped, label, weight."""
    v = table(spark, sf_dir, "embeddings")
    dot = lambda a: F.aggregate(F.zip_with(a, F.array(*[F.lit(x) for x in PROJECTION]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", dot(F.col("embedding")).alias("forward"), dot(F.reverse("embedding")).alias("flipped"), (F.col("label") % 2).cast("double").alias("label"), (1 + (F.col("vec_id") % 5) / F.lit(4.0)).alias("weight"))


PAIRED_SQL = f"""w AS (SELECT {PROJECTION}::DOUBLE[] AS w),
pair AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * w[i])) AS forward, list_sum(list_transform(range(1, 65), lambda i: embedding[65 - i]::DOUBLE * w[i])) AS flipped,
  (label % 2)::DOUBLE AS label, 1 + (vec_id % 5) / 4.0::DOUBLE AS weight FROM embeddings, w)"""


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop geometry: keys, height, aspect, role (candidate or target), slice_name."""
    li = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_linestatus") == "O", "candidate").when(F.col("l_linestatus") == "F", "target")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (8 + 4 * F.col("l_quantity")).alias("height"), (1.05 + F.col("l_extendedprice") / 10000).alias("aspect"),
        role.alias("role"), F.col("l_returnflag").alias("slice_name"),
    )


CROPS_SQL = """crop AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 8 + 4 * l_quantity AS height, 1.05::DOUBLE + l_extendedprice / 10000 AS aspect,
  CASE l_linestatus WHEN 'O' THEN 'candidate' WHEN 'F' THEN 'target' END AS role, l_returnflag AS slice_name FROM lineitem)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of an order as an image: image_id, pos, left, top, width, height, angle, text."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), (F.col("l_partkey") % 800).cast("int").alias("left"), (20 * F.col("l_linenumber")).cast("int").alias("top"),
        (20 + F.col("l_quantity")).cast("int").alias("width"), (12 + F.col("l_suppkey") % 20).cast("int").alias("height"), (F.col("l_partkey") % 360 - 180).cast("double").alias("angle"),
        F.when(F.col("l_partkey") % 17 == 0, ".").otherwise(F.col("l_returnflag")).alias("text"),
    )


WORDS_SQL = """word AS (SELECT l_orderkey AS image_id, l_partkey * 1000 + l_suppkey AS pos, (l_partkey % 800)::INT AS "left", (20 * l_linenumber)::INT AS top,
  (20 + l_quantity)::INT AS width, (12 + l_suppkey % 20)::INT AS height, (l_partkey % 360 - 180)::DOUBLE AS angle, CASE WHEN l_partkey % 17 = 0 THEN '.' ELSE l_returnflag END AS text FROM lineitem)"""
