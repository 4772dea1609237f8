"""Annotation queries: boxes, filters, reports, lines of words, runs, obstacles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.operators import annotations as a
from plumbago.operators import storage
from plumbago.plans.scoring import rounded
from plumbago.plans.stand_ins import WORDS_SQL, table, words

KEY = ["image_id", "pos"]


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as quadrilaterals: the second vertex carries the tilt, one word in 13 has a fifth vertex."""
    w = words(spark, sf_dir)
    x, y, r, b = F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height")
    dy = (F.col("pos") % 61 - 30).cast("int")
    four = [F.array(x, y), F.array(r, y + dy), F.array(r, b), F.array(x, b)]
    return w.withColumn("vertices", F.when(F.col("pos") % 13 == 0, F.array(*four, F.array(x, b))).otherwise(F.array(*four)))


def vertex_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quads(spark, sf_dir).select(*KEY, "top", a.vertex_box(F.col("vertices")).alias("b")).select(*KEY, F.col("top").alias("line_top"), "b.left", "b.top", "b.width", "b.height")


def top_edge_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_quads(spark, sf_dir).select(*KEY, "top", a.top_edge_angle(F.col("vertices")).alias("angle")), 6)


def upright_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(*KEY, "top", "angle", a.upright_verdict(F.col("angle")).alias("upright"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quads(spark, sf_dir).withColumns({"box": a.vertex_box(F.col("vertices")), "upright": a.upright_verdict(F.col("angle"))})
    usable = a.line_usable(F.col("pos") % 11 != 0, F.col("pos") % 7 == 0, F.col("vertices"), F.col("box"), F.col("upright"))
    return q.withColumn("status", a.route(usable, F.col("upright"))).withColumn("slice_name", F.when(F.col("text") == "R", "handwritten").otherwise("scene"))


def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("status = 'accepted'").select(*KEY, "top", "slice_name")


def reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.build_report(_judged(spark, sf_dir), ["slice_name"])


def excluded_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", "lang", "n_chars")


def word_lines_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).withColumn("angle", F.lit(0.0))
    return a.word_lines(w.select("image_id", *a.WORD_COLUMNS), "image_id").select("image_id", "pos", "top", "left", "line", "place")


def word_lines_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.word_islands(words(spark, sf_dir), "image_id").select(*KEY, "top", F.col("line").cast("long").alias("line"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct("left", "pos", "top", "width", "height")
    return words(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("words"))


def run_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.emit_runs(_lines(spark, sf_dir)).groupBy("slice_name", F.col("span.length").alias("length")).agg(F.count(F.lit(1)).alias("runs"))


def run_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = a.emit_runs(_lines(spark, sf_dir)).withColumn("b", a.merge_boxes(F.col("run")))
    return runs.select("image_id", F.col("span.start").alias("start"), F.col("span.length").alias("length"), "b.left", "b.top", "b.width", "b.height")


def obstacle_theta_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    boxes = w.select("image_id", "left", "top", (F.col("left") + F.col("width")).alias("right"), (F.col("top") + F.col("height")).alias("bottom"))
    patches = w.select("image_id", "pos", (F.col("pos") % 700).cast("int").alias("left"), (F.col("pos") % 90).cast("int").alias("top"))
    patches = patches.withColumns({"right": F.col("left") + 96, "bottom": F.col("top") + 30})
    return a.free_patches(patches, boxes, "image_id")


def path_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbago.operators.mixing import first_seen_codes

    return first_seen_codes(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "first_pos", F.col("code").cast("int").alias("code"))


def shard_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("writer"), "doc_id", "n_chars")
    return storage.assign_shards(d, "writer", "doc_id", "n_chars", 20_000)


def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    index = w.select("width", "height", (F.col("pos") % 9000).alias("length"), (F.col("image_id") % 7).cast("int").alias("shard"), F.col("text").alias("slice_name"))
    return rounded(storage.store_summary(index, ["slice_name"]), 6)


_QUADS = f"""WITH {WORDS_SQL}, quad AS (SELECT *, (pos % 61 - 30)::INT AS dy FROM word)"""
_BOX = """box AS (SELECT *, least(top, top + dy) AS b_top, greatest(top + height, top + dy) AS b_bottom FROM quad)"""
_JUDGED = f"""{_QUADS}, {_BOX}, j AS (SELECT *, CASE WHEN abs(angle) <= 35 THEN true WHEN abs(abs(angle) - 180) <= 35 THEN false END AS upright,
  CASE WHEN text = 'R' THEN 'handwritten' ELSE 'scene' END AS slice_name FROM box),
s AS (SELECT *, CASE WHEN NOT (pos % 11 <> 0 AND pos % 7 <> 0 AND pos % 13 <> 0 AND b_bottom - b_top >= 12 AND width / greatest(b_bottom - b_top, 1) >= 1.5 AND upright IS NOT NULL) THEN 'rejected' WHEN NOT upright THEN 'upside_down' ELSE 'accepted' END AS status FROM j)"""
_RUNS = f"""WITH {WORDS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "left", pos, top, width, height) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS m FROM word),
span AS (SELECT DISTINCT image_id, s.start, l.length FROM (SELECT DISTINCT image_id, m FROM n) i, LATERAL (SELECT unnest(range(1, least(m, 3) + 1)) AS length) l, LATERAL (SELECT unnest(range(0, m - l.length + 1)) AS start) s
  UNION ALL SELECT DISTINCT image_id, 0, m FROM n WHERE m > 3)"""

QUERIES = (
    vertex_bbox, top_edge_angle, upright_verdict, line_filter, reject_report, excluded_anti_join, word_lines_exact, word_lines_islands, run_emit, run_boxes,
    obstacle_theta_anti, path_dictionary, shard_addresses, store_summary,
)

SQL = {
    "vertex_bbox": f'{_QUADS}, {_BOX} SELECT image_id, pos, top AS line_top, "left", b_top AS top, width, b_bottom - b_top AS height FROM box',
    "top_edge_angle": f"{_QUADS} SELECT image_id, pos, top, round(degrees(atan2(dy::DOUBLE, width::DOUBLE)), 6) + 0.0 AS angle FROM quad",
    "upright_verdict": f"WITH {WORDS_SQL} SELECT image_id, pos, top, angle, CASE WHEN abs(angle) <= 35 THEN true WHEN abs(abs(angle) - 180) <= 35 THEN false END AS upright FROM word",
    "line_filter": f"{_JUDGED} SELECT image_id, pos, top, slice_name FROM s WHERE status = 'accepted'",
    "reject_report": f"{_JUDGED} SELECT slice_name, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'upside_down') AS upside_down, count(*) FILTER (status = 'rejected') AS rejected FROM s GROUP BY slice_name",
    "excluded_anti_join": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "word_lines_islands": f"""WITH {WORDS_SQL}, o AS (SELECT *, top + height / 2 AS c, lag(top + height / 2) OVER w AS pc, lag(height) OVER w AS ph FROM word WINDOW w AS (PARTITION BY image_id ORDER BY top + height / 2, "left", pos))
      SELECT image_id, pos, top, (sum(CASE WHEN abs(c - pc) <= least(height, ph) / 2 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY c, "left", pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS line FROM o""",
    "run_emit": f"{_RUNS} SELECT CASE WHEN length = 1 THEN 'word' ELSE 'line' END AS slice_name, length::INT AS length, count(*) AS runs FROM span GROUP BY ALL",
    "run_boxes": f"""{_RUNS} SELECT image_id, start::INT AS start, length::INT AS length, min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height
      FROM span JOIN n USING (image_id) WHERE k >= start AND k < start + length GROUP BY ALL""",
    "obstacle_theta_anti": f"""WITH {WORDS_SQL}, p AS (SELECT image_id, pos, (pos % 700)::INT AS "left", (pos % 90)::INT AS top, (pos % 700)::INT + 96 AS "right", (pos % 90)::INT + 30 AS bottom FROM word)
      SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM word w WHERE w.image_id = p.image_id AND p."left" < w."left" + w.width AND w."left" < p."right" AND p.top < w.top + w.height AND w.top < p.bottom)""",
    "path_dictionary": "SELECT event_type, min(event_id) AS first_pos, (row_number() OVER (ORDER BY min(event_id)) - 1)::INT AS code FROM events GROUP BY event_type",
    "shard_addresses": """WITH RECURSIVE d AS (SELECT source AS writer, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
      f AS (SELECT writer, doc_id, n_chars, k, 0 AS shard, 0::BIGINT AS "offset" FROM d WHERE k = 1
        UNION ALL SELECT d.writer, d.doc_id, d.n_chars, d.k, CASE WHEN f."offset" + f.n_chars > 0 AND f."offset" + f.n_chars + d.n_chars > 20000 THEN f.shard + 1 ELSE f.shard END,
          CASE WHEN f."offset" + f.n_chars + d.n_chars > 20000 THEN 0 ELSE f."offset" + f.n_chars END FROM f JOIN d ON d.writer = f.writer AND d.k = f.k + 1)
      SELECT writer, doc_id, n_chars, shard, "offset" FROM f""",
    "store_summary": f"""WITH {WORDS_SQL} SELECT text AS slice_name, count(*) AS n, sum(pos % 9000)::BIGINT AS bytes, count(DISTINCT image_id % 7) AS shards, round(median(height), 6) AS median_height,
      round(median(width / greatest(height, 1)), 6) AS median_aspect FROM word GROUP BY text""",
}
