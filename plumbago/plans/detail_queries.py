"""Queries of single operators: manifests, words, fonts, texts, models, draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions import numeric, text
from plumbago.functions.numeric import lcg_uniform, sigmoid
from plumbago.operators import annotations, calibration, fonts, geometry, mixing, reports, selection
from plumbago.plans.geometry_queries import CELLS_SQL, DRAWS, roles
from plumbago.plans.scoring import rounded
from plumbago.plans.stand_ins import CROPS_SQL, PAIRED_SQL, PREDICTIONS_SQL, WORDS_SQL, crops, paired_logits, predictions, table, words
from plumbago.sources import tables

KEY = ["image_id", "pos"]
_U = "((event_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE"


def manifest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.take_slice(crops(spark, sf_dir), "A", strict=True).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "height")


def replaced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("event_id", "slice_name", "weight")
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), (F.col("quality") + 0.25).alias("weight"))
    return tables.with_weights(rows, new, ["event_id"]).select("event_id", "slice_name", "weight")


def box_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.with_boxes(words(spark, sf_dir)).select(*KEY, "top", "left", "right", "bottom", "aspect"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with flat coordinates at halves; one word in eleven lacks a corner."""
    w = words(spark, sf_dir)
    x, y, r, b = F.col("left") + 0.5, F.col("top") + 0.5, F.col("left") + F.col("width") + 0.5, F.col("top") + F.col("height") + 0.5
    return w.withColumn("points", F.when(F.col("pos") % 11 == 0, F.array(x, y, r, y, r, b)).otherwise(F.array(x, y, r, y, r, b, x, b)))


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = annotations.points_to_vertices(F.col("points"))
    corner = v[2]
    return _points(spark, sf_dir).select(*KEY, "top", F.size(v).alias("corners"), corner[0].alias("x"), corner[1].alias("y"))


def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _points(spark, sf_dir).withColumn("box", F.struct("left", "top", "width", "height"))
    usable = annotations.word_usable(F.col("text"), F.col("points"), F.col("box"), annotations.upright_verdict(F.col("angle")))
    return w.select(*KEY, "top", F.coalesce(usable, F.lit(False)).alias("usable"))


def slice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "").alias("words"))
    return annotations.emit_runs(lines, "words", 2).groupBy("slice_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("run")).alias("words"))


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", selection.image_path("photos/train/", F.col("doc_id")).alias("path"))


def font_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda a, b: F.struct(F.lit(a).alias("lo"), b.cast("int").alias("hi"))
    c = F.col("p_size")
    held = F.array(span(48, 57 - c % 3), span(65, 122 - c % 5), span(0x401, F.lit(0x450) + c % 2))
    made = table(spark, sf_dir, "part").select("p_partkey", held.alias("coverage"))
    return fonts.eligible(made).select("p_partkey", F.array_join("scripts", "+").alias("scripts"))


def jittered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).withColumn("margin", (F.col("pos") % 50) / F.lit(64.0))
    box = annotations.jittered_box(F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.col("margin"), F.lit(700), F.lit(120))
    return w.select(*KEY, F.col("top").alias("word_top"), box.alias("b")).select(*KEY, "word_top", "b.*")


def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ann_id"), F.col("p_brand").alias("word"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_orderkey") % 997, F.lit(-1).cast("long")).alias("ann_ids"))
    return selection.listed(orders, parts).select("o_orderkey", "place", "ann_id", "word")


def members_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired_logits(spark, sf_dir)
    one, two = (rows.select("vec_id", sigmoid(F.col(c)).alias("p")) for c in ("forward", "flipped"))
    both = calibration.align_members([one, two], "vec_id")
    return rounded(both.select("vec_id", calibration.ensemble([F.col("p_0"), F.col("p_1")], [2.0, 1.0]).alias("p")), 6)


def shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.member_logits(paired_logits(spark, sf_dir), {"z_plain": F.col("forward"), "z_symmetric": calibration.symmetric_logit(F.col("forward"), F.col("flipped"))})
    return rounded(rows.select("vec_id", "z_plain", "z_symmetric", calibration.ensemble([sigmoid(F.col("z_plain")), sigmoid(F.col("z_symmetric"))]).alias("p")), 6)


def truth_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("place", F.col("event_id"))
    both = selection.truth_by_place(rows.select("slice_name", "place", "p"), rows.select("slice_name", "place", "label"), "slice_name", "place")
    return rounded(both.groupBy("slice_name").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("p") - F.col("label"))).alias("error")))


def score_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = predictions(spark, sf_dir).groupBy("slice_name").agg(F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2))).alias("score"))
    return rounded(reports.estimate_test_score(scores, anchor="purchase"), 7)


def model_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("member"), F.col("p_type").alias("slice_name")).agg(F.avg("p_size").alias("temperature"))
    return rounded(reports.model_summary(per.withColumn("macs", F.length("member") * 1000)), 6)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("index")).agg(F.avg("value").alias("loss"), F.count(F.lit(1)).alias("rows"))


def loss_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.running_loss(_batches(spark, sf_dir), "index").select("index", "rows", "mean_loss"), 6)


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.best_epoch(_batches(spark, sf_dir).select("index", F.round("loss", 1).alias("score"))))


def supported_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((97, 122), (48, 57))])
    docs = table(spark, sf_dir, "documents")
    kept = docs.select("doc_id", text.supported_only(F.coalesce("text", F.lit("")), ranges).alias("kept"))
    return kept.select("doc_id", F.char_length("kept").cast("long").alias("n"), F.sha2("kept", 256).alias("digest"))


def hsv_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    h, s, v = (F.col("p_partkey") % 97) / F.lit(97.0), (F.col("p_size") % 11) / F.lit(10.0), (F.col("p_partkey") % 13) / F.lit(12.0)
    return p.select("p_partkey", *[c.alias(n) for c, n in zip(numeric.hsv_to_rgb(h, s, v), "rgb")])


def scaled_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(*KEY, "top", numeric.target_width(F.col("width"), F.col("height"), 48).alias("scaled"))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").select("event_id", numeric.learning_rate(F.col("event_id"), 2000, 100, 0.003).alias("rate")))


def integer_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lcg_uniform(F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", numeric.uniform_int(u, -3, 9).alias("whole"), (u < 0.3).alias("happens"), F.round(2.0 + (7.0 - 2.0) * u, 8).alias("between"))


def spec_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat_ws(":", F.col("p_brand"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "x"), F.when(F.col("p_size") % 5 == 0, ""), F.when(F.col("p_size") % 7 == 0, "z"))
    parts = selection.spec_parts(spec, 2, 3)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.coalesce(parts, F.array().cast("array<string>"))).alias("n"), F.get(parts, F.lit(1)).alias("second"))


def css_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = F.concat(F.lit("@font-face{src:url('a/"), F.col("p_brand"), F.lit("') format(x), url( b/"), F.col("p_partkey").cast("string"), F.lit('.woff );} .c{background:url("c.png")}'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(selection.css_addresses(sheet), "|").alias("addresses"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", selection.duration_text(F.col("o_totalprice") / 10).alias("shown"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).groupBy("slice_name").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    share = F.col("hits") / F.col("n")
    return rows.select("slice_name", selection.describe_score(F.round(share, 3), F.round(1 - share, 3), F.col("n")).alias("shown"))


def families_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that the twelve most used leave, in order of name and size."""
    p = table(spark, sf_dir, "part")
    top = mixing.top_by(p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part")), [F.col("n").desc(), F.col("first_part")], 12)
    return selection.without(p.select("p_brand", "p_size").distinct(), top, ["p_brand"]).orderBy("p_brand", "p_size")


def names_without_decorative(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return selection.without(p.select("p_type").distinct(), p.where("p_size > 49").select("p_type"), ["p_type"])


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label table names yet."""
    return selection.without(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])


def extraction_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.quota(table(spark, sf_dir, "pages").select("page_id", F.char_length("html").cast("long").alias("n")), F.col("n") > 500, 100, ["page_id"])


def canvas_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    size = selection.canvas_size(F.col("width"), F.col("height"), F.lit(0.125), F.lit(0.25), F.lit(0.5), F.lit(0.0625))
    ratio = selection.ink_ratio(F.col("height"), F.col("width") - 40)
    return rounded(w.select(*KEY, "top", size["width"].alias("canvas_width"), size["height"].alias("canvas_height"), ratio.alias("ratio"), selection.font_size(F.col("height"), ratio).alias("font")))


def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("c"))
    dense, split = (selection.convolution_macs(F.lit(48), F.lit(192), F.col("c"), 2 * F.col("c"), 3, s) for s in (False, True))
    return rounded(p.select("p_partkey", dense.alias("dense"), split.alias("separable"), selection.model_megabytes(dense).alias("megabytes")))


def fitting_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.transform(F.split("c_name", ""), lambda c: F.when(c.isin("0", "1", "i", "l"), 4.0).otherwise(8.0))
    return table(spark, sf_dir, "customer").select("c_custkey", selection.prefix_that_fits(F.col("c_name"), wide, (F.col("c_custkey") % 120).cast("double")).alias("prefix"))


def repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("p_brand").cast("double")
    out = selection.repeat_until(F.col("p_brand"), n * 8, F.col("p_partkey") % 9000, gap=8.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.char_length(out).alias("n"), F.md5(out).alias("digest"))


def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's word against a fixed one: shared height and gap."""
    w = words(spark, sf_dir)
    fixed = F.struct(F.lit(400).alias("left"), F.lit(50).alias("top"), F.lit(60).alias("width"), F.lit(25).alias("height"))
    own = F.struct("left", "top", "width", "height")
    return rounded(w.select(*KEY, F.col("top").alias("word_top"), annotations.shared_height(fixed, own).alias("shared"), annotations.gap_between(fixed, own).alias("gap")))


def exact_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as asked for, whatever the weights; each finds the least key of its crop's place."""
    candidates, target = roles(spark, sf_dir)
    edges = geometry.grid_edges(candidates, target)
    placed = geometry.with_cells(candidates, edges)
    cells = geometry.capped_probabilities(geometry.density_ratio(placed, geometry.with_cells(target, edges)), DRAWS, 1)
    keyed = placed.select("hb", "ab", (((F.col("l_orderkey") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")).alias("index"))
    draws = table(spark, sf_dir, "events").select(F.col("event_id").alias("draw"), lcg_uniform(F.col("event_id")).alias("u"))
    return selection.exact_draws(keyed, cells, draws, ["hb", "ab"], "index").groupBy("hb", "ab").agg(F.count(F.lit(1)).alias("draws"), F.count_distinct("index").alias("rows"))


QUERIES = (
    manifest_slice, replaced_weights, box_projection, point_pairs, word_filter, slice_names, image_paths, font_eligibility, jittered_boxes, listed_words, members_aligned,
    shared_scan, truth_by_place, score_estimate, model_totals, loss_progress, best_epoch, supported_text, hsv_colours, scaled_width, learning_rates, integer_draws, spec_parts,
    css_addresses, durations, descriptions, families_left, names_without_decorative, missing_files, extraction_quota, canvas_sizes, model_sizes, fitting_prefix, repeated_text,
    word_gaps, exact_draws,
)

_UPRIGHT = "(abs(angle) <= 35 OR abs(abs(angle) - 180) <= 35)"
_BATCHES = "b AS (SELECT (event_id // 500) AS \"index\", avg(value) AS loss, count(*) AS rows FROM events GROUP BY 1)"
_LADDER = lambda *o: "CASE s6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(o)) + " END"
_SIG = "1.0::DOUBLE / (1.0::DOUBLE + exp(-{}))"

SQL = {
    "manifest_slice": f"WITH {CROPS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, height FROM crop WHERE slice_name = 'A'",
    "replaced_weights": f"WITH {PREDICTIONS_SQL} SELECT event_id, slice_name, coalesce(quality + 0.25::DOUBLE, weight) AS weight FROM pred LEFT JOIN labels ON doc_id = event_id",
    "box_projection": f'WITH {WORDS_SQL} SELECT image_id, pos, top, "left", "left" + width AS "right", top + height AS bottom, round(width / height, 8) AS aspect FROM word',
    "point_pairs": f'WITH {WORDS_SQL} SELECT image_id, pos, top, (CASE WHEN pos % 11 = 0 THEN 3 ELSE 4 END)::INT AS corners, round_even("left" + width + 0.5, 0)::INT AS x, round_even(top + height + 0.5, 0)::INT AS y FROM word',
    "word_filter": f"WITH {WORDS_SQL} SELECT image_id, pos, top, text <> '.' AND pos % 11 <> 0 AND height >= 12 AND width / greatest(height, 1) >= 1.0 AND {_UPRIGHT} AS usable FROM word",
    "slice_names": """WITH w AS (SELECT len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM documents)
      SELECT 'word' AS slice_name, sum(n)::BIGINT AS n, sum(n)::BIGINT AS words FROM w UNION ALL SELECT 'line', sum(greatest(n - 1, 0) + (n > 2)::INT)::BIGINT, sum(2 * greatest(n - 1, 0) + CASE WHEN n > 2 THEN n ELSE 0 END)::BIGINT FROM w""",
    "image_paths": "SELECT doc_id, 'photos/train/' || doc_id || '.jpg' AS path FROM documents",
    "font_eligibility": "SELECT p_partkey, CASE WHEN p_size % 5 <= 1 THEN 'cyrillic+latin' ELSE 'cyrillic' END AS scripts FROM part WHERE p_size % 3 = 0",
    "jittered_boxes": f"""WITH {WORDS_SQL}, m AS (SELECT *, (pos % 50) / 64.0::DOUBLE * height AS m FROM word)
      SELECT image_id, pos, top AS word_top, greatest(0, trunc("left" - m)::INT) AS "left", greatest(0, trunc(top - m)::INT) AS top, least(700, trunc("left" + width + m)::INT) AS "right", least(120, trunc(top + height + m)::INT) AS bottom FROM m""",
    "listed_words": "WITH l AS (SELECT o_orderkey, 0 AS place, o_custkey AS ann_id FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey % 997 FROM orders) SELECT o_orderkey, place, ann_id, p_brand AS word FROM l JOIN part ON p_partkey = ann_id",
    "members_aligned": f"WITH {PAIRED_SQL} SELECT vec_id, round((2 * {_SIG.format('forward')} + {_SIG.format('flipped')}) / 3, 6) AS p FROM pair",
    "shared_scan": f"WITH {PAIRED_SQL} SELECT vec_id, round(forward, 6) + 0.0 AS z_plain, round((forward - flipped) / 2, 6) + 0.0 AS z_symmetric, round(({_SIG.format('forward')} + {_SIG.format('(forward - flipped) / 2')}) / 2, 6) AS p FROM pair",
    "truth_by_place": f"WITH {PREDICTIONS_SQL} SELECT slice_name, count(*) AS n, round(avg(abs(p - label)), 8) AS error FROM pred GROUP BY slice_name",
    "score_estimate": f"WITH {PREDICTIONS_SQL} SELECT round(avg((p - label) ** 2) + (0.94726::DOUBLE - 0.9430::DOUBLE), 7) AS estimate FROM pred WHERE slice_name = 'purchase'",
    "model_totals": """WITH p AS (SELECT p_brand, p_type, avg(p_size) AS t FROM part GROUP BY 1, 2), m AS (SELECT p_brand, avg(t) AS t, length(p_brand) * 1000 AS macs FROM p GROUP BY 1)
      SELECT round(avg(t), 6) AS mean_temperature, sum(macs)::BIGINT AS total_macs FROM m""",
    "loss_progress": f'WITH {_BATCHES} SELECT "index", rows, round(sum(loss * rows) OVER (ORDER BY "index") / sum(rows) OVER (ORDER BY "index"), 6) AS mean_loss FROM b',
    "best_epoch": f'WITH {_BATCHES} SELECT "index", round(loss, 1) AS score FROM b ORDER BY score DESC, "index" LIMIT 1',
    "supported_text": """WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS kept FROM documents)
      SELECT doc_id, length(kept)::BIGINT AS n, sha256(kept) AS digest FROM k""",
    "hsv_colours": f"""WITH c AS (SELECT p_partkey, (p_partkey % 97) / 97.0::DOUBLE AS h, (p_size % 11) / 10.0::DOUBLE AS s, (p_partkey % 13) / 12.0::DOUBLE AS v FROM part),
      d AS (SELECT *, floor(h * 6)::INT % 6 AS s6, h * 6 - floor(h * 6) AS f FROM c), x AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t FROM d)
      SELECT p_partkey, {', '.join(f"greatest(0, least(255, round_even(255 * ({_LADDER(*o)}), 0)))::INT AS {n}" for n, o in (('r', 'vqpptv'), ('g', 'tvvqpp'), ('b', 'pptvvq')))} FROM x""",
    "scaled_width": f"WITH {WORDS_SQL} SELECT image_id, pos, top, greatest(1, round_even(width * 48 / height, 0)::INT) AS scaled FROM word",
    "learning_rates": """SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.003::DOUBLE * (event_id + 1) / 100 ELSE 0.003::DOUBLE * 0.5 * (1 + cos(pi() * least((event_id - 100) / 1900.0::DOUBLE, 1.0::DOUBLE))) END, 8) + 0.0 AS rate FROM events""",
    "integer_draws": f"SELECT event_id, (floor({_U} * 13) - 3)::INT AS whole, {_U} < 0.3::DOUBLE AS happens, round(2.0::DOUBLE + 5.0::DOUBLE * {_U}, 8) AS \"between\" FROM events",
    "spec_parts": """WITH s AS (SELECT p_partkey, p_size, 2 + (p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT + (p_size % 7 = 0)::INT AS n FROM part), k AS (SELECT *, n <= 3 AND p_size % 5 <> 0 AS ok FROM s)
      SELECT p_partkey, CASE WHEN ok THEN n ELSE 0 END AS n, CASE WHEN ok THEN p_size::VARCHAR END AS second FROM k""",
    "css_addresses": "SELECT p_partkey, 'a/' || p_brand || '|b/' || p_partkey || '.woff|c.png' AS addresses FROM part",
    "durations": """WITH s AS (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS s FROM orders)
      SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown FROM s""",
    "descriptions": f"""WITH {PREDICTIONS_SQL}, g AS (SELECT slice_name, count(*) AS n, round(sum(label) / count(*), 3) AS a, round(1 - sum(label) / count(*), 3) AS b FROM pred GROUP BY 1)
      SELECT slice_name, printf('score %.4f, accuracy %.2f %%, %d rows', a, b * 100, n) AS shown FROM g""",
    "families_left": """WITH t AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1 ORDER BY n DESC, f LIMIT 12) SELECT DISTINCT p_brand, p_size FROM part WHERE p_brand NOT IN (SELECT p_brand FROM t)""",
    "names_without_decorative": "SELECT DISTINCT p_type FROM part EXCEPT SELECT p_type FROM part WHERE p_size > 49",
    "missing_files": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "extraction_quota": "SELECT page_id, length(html)::BIGINT AS n FROM pages WHERE length(html) > 500 ORDER BY page_id LIMIT 100",
    "canvas_sizes": f"""WITH {WORDS_SQL}, r AS (SELECT *, height / greatest(width - 40, 1)::DOUBLE AS ratio FROM word)
      SELECT image_id, pos, top, ceil(width + 0.625 * height)::INT AS canvas_width, ceil(height * 1.3125)::INT AS canvas_height, round(ratio, 8) AS ratio, greatest(8, least(256, round_even(height * ratio, 0)))::INT AS font FROM r""",
    "model_sizes": """WITH d AS (SELECT p_partkey, 48 * 192 * p_size::BIGINT * 2 * p_size * 9 AS dense, 48 * 192 * (p_size::BIGINT * 9 + 2 * p_size * p_size) AS separable FROM part)
      SELECT p_partkey, dense, separable, round(dense * 4 / 1048576.0::DOUBLE, 8) AS megabytes FROM d""",
    "fitting_prefix": """WITH k AS (SELECT c_custkey, c_name, unnest(range(1, length(c_name) + 1)) AS n FROM customer), w AS (SELECT *, sum(CASE WHEN c_name[n] IN ('0', '1', 'i', 'l') THEN 4 ELSE 8 END) OVER (PARTITION BY c_custkey ORDER BY n) AS used FROM k)
      SELECT c_custkey, c_name[1:count(*) FILTER (used <= c_custkey % 120)] AS prefix FROM w GROUP BY c_custkey, c_name""",
    "repeated_text": """WITH t AS (SELECT p_partkey, greatest(1, least(ceil((p_partkey % 9000 + 8.0::DOUBLE) / (length(p_brand) * 8 + 8)), floor(401 / (length(p_brand) + 1))))::INT AS k, p_brand FROM part), r AS (SELECT p_partkey, rtrim(repeat(p_brand || ' ', k)) AS x FROM t)
      SELECT p_partkey, length(x)::INT AS n, md5(x) AS digest FROM r""",
    "word_gaps": f"""WITH {WORDS_SQL} SELECT image_id, pos, top AS word_top, round(greatest(least(75, top + height) - greatest(50, top), 0) / greatest(least(25, height), 1)::DOUBLE, 8) AS shared,
      greatest(CASE WHEN "left" < 400 THEN 400 - "left" - width ELSE "left" - 460 END, 0) AS gap FROM word""",
    "exact_draws": f"""WITH {CELLS_SQL}, p0 AS (SELECT hb, ab, n, ratio / sum(ratio * n) OVER () AS p FROM ratio), f AS (SELECT sum(greatest(p - {1 / DRAWS!r}::DOUBLE, 0) * n) / sum(greatest({1 / DRAWS!r}::DOUBLE - p, 0) * n) AS f FROM p0),
      p1 AS (SELECT hb, ab, n, least(p, {1 / DRAWS!r}::DOUBLE) + least(f, 1) * greatest({1 / DRAWS!r}::DOUBLE - p, 0) AS p FROM p0, f), p2 AS (SELECT hb, ab, n, p * n / sum(p * n) OVER () AS share FROM p1),
      b AS (SELECT *, sum(share) OVER (ORDER BY hb, ab) AS high FROM p2 WHERE share > 0), e AS (SELECT event_id, {_U} AS u FROM events),
      d AS (SELECT hb, ab, floor((u - (high - share)) / share * n) AS k FROM e JOIN b ON u >= high - share AND u < high) SELECT hb, ab, count(*) AS draws, count(DISTINCT k) AS rows FROM d GROUP BY hb, ab""",
}
