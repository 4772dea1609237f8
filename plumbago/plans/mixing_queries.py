"""Mixing, ordering and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions.numeric import lcg_uniform, weighted_pick
from plumbago.operators import mixing
from plumbago.plans.scoring import rounded
from plumbago.plans.stand_ins import crops, table

EPOCH = 3
WEIGHTS = [5.0, 1.5, 2.5, 0.0, 1.5, 2.0]
#: Rows an epoch takes of each table.
SHARES = (("orders", "orders", 700), ("customer", "customer", 400), ("part", "part", 1100))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [table(spark, sf_dir, t).agg(F.lit(i).alias("share"), F.lit(n).alias("name"), F.count(F.lit(1)).alias("dataset_rows"), F.lit(k).cast("long").alias("sample_count")) for i, (n, t, k) in enumerate(SHARES)]
    return mixing.share_boundaries(sizes[0].unionByName(sizes[1]).unionByName(sizes[2]), "share")


def share_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).select("name", "sample_count", "dataset_rows", "low", "high")


def range_join_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % sum(k for *_, k in SHARES)).alias("pos"))
    return mixing.locate(pos, _shares(spark, sf_dir), EPOCH).select("event_id", "name", "local")


def epoch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each share that the first four epochs show, and how many of them are new."""
    pos = spark.range(sum(k for *_, k in SHARES)).withColumnRenamed("id", "pos")
    shares = _shares(spark, sf_dir)
    seen = None
    for epoch in range(4):
        one = mixing.locate(pos, shares, epoch).select("name", "local", F.lit(epoch).alias("epoch"))
        seen = one if seen is None else seen.unionByName(one)
    return seen.groupBy("name").agg(F.count(F.lit(1)).alias("shown"), F.count_distinct("local").alias("different"))


def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", lcg_uniform(F.col("event_id")).alias("u"))
    return e.select("event_id", weighted_pick(F.col("u"), WEIGHTS).alias("choice"))


def codepoint_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 1000).cast("int").alias("point"))
    return mixing.codepoint_ranges(points, "event_type", "point")


def range_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of part keys covered by each type's ranges."""
    points = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 1000).cast("int").alias("point"))
    ranges = mixing.codepoint_ranges(points, "event_type", "point").groupBy("event_type").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    asked = table(spark, sf_dir, "part").select((F.col("p_partkey") % 1000).cast("int").alias("cp"))
    joined = asked.crossJoin(F.broadcast(ranges))  # at most a thousand code points for each of five types
    return rounded(joined.groupBy("event_type").agg(F.avg(F.when(mixing.covered(F.col("cp"), F.col("ranges")), 1.0).otherwise(0.0)).alias("share")))


def top_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))
    return mixing.top_by(f, [F.col("n").desc(), F.col("first_part")], 12)


def style_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set((F.col("p_size") * 100).cast("int"))).alias("styles"))
    return s.select("p_brand", F.array_join(mixing.pick_styles(F.array(F.lit(400), F.lit(700), F.lit(300)), F.col("styles"), 2), ",").alias("picked"))


def batch_rounded_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.dense_number(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], "pos")
    return rows.where(mixing.batch_limit(1000, 64, F.col("pos"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crops(spark, sf_dir)
    both = rows.where("role = 'candidate'").select("slice_name", "height").unionByName(rows.where("role = 'target'").select("slice_name", "height"))
    return both.groupBy("slice_name").agg(F.count(F.lit(1)).alias("n"), F.sum("height").alias("height"))


def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbago.sources.tables import number_crops

    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = crops(spark, sf_dir).withColumns({"width": F.floor(F.col("height") * (F.col("l_partkey") % 40) / 10)})
    return number_crops(rows, "slice_name", keys).select(*keys, "slice_name", F.col("number").cast("long").alias("number"), "file")


def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops(spark, sf_dir).groupBy("slice_name").agg(F.count(F.lit(1)).alias("n"))


def distinct_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops(spark, sf_dir).select("slice_name").distinct().orderBy("slice_name")


def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbago.operators.storage import address_lookup as lookup

    index = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("n_chars").alias("length"))
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 3).alias("index"))
    return lookup(index, asked, "index", index.count())


_S = "s AS (" + " UNION ALL ".join(f"SELECT {i} AS share, '{n}' AS name, count(*) AS dataset_rows, {k}::BIGINT AS sample_count FROM {t}" for i, (n, t, k) in enumerate(SHARES)) + """),
b AS (SELECT *, (sum(sample_count) OVER (ORDER BY share))::BIGINT AS high, (sum(sample_count) OVER (ORDER BY share))::BIGINT - sample_count AS low FROM s)"""
_TOTAL = sum(k for *_, k in SHARES)
_LOCAL = "({e} * sample_count + pos - low) % dataset_rows"
_POINTS = "p AS (SELECT DISTINCT event_type, (user_id % 1000)::INT AS point FROM events), i AS (SELECT *, point - row_number() OVER (PARTITION BY event_type ORDER BY point) AS island FROM p), r AS (SELECT event_type, min(point) AS lo, max(point) AS hi FROM i GROUP BY event_type, island)"
_CUM = [sum(WEIGHTS[: i + 1]) for i in range(len(WEIGHTS))]

QUERIES = (
    share_boundaries, range_join_share, epoch_window, weighted_choice, codepoint_ranges, range_contains, top_families, style_pick, batch_rounded_limit, union_splits,
    dense_renumber, slice_counts, distinct_slices, address_lookup,
)

SQL = {
    "share_boundaries": f"WITH {_S} SELECT name, sample_count, dataset_rows, low, high FROM b",
    "range_join_share": f"WITH {_S}, p AS (SELECT event_id, event_id % {_TOTAL} AS pos FROM events) SELECT event_id, name, {_LOCAL.format(e=EPOCH)} AS local FROM p JOIN b ON pos >= low AND pos < high",
    "epoch_window": f"WITH {_S}, p AS (SELECT e, pos FROM range(4) a(e), range({_TOTAL}) x(pos)) SELECT name, count(*) AS shown, count(DISTINCT {_LOCAL.format(e='e')}) AS different FROM p JOIN b ON pos >= low AND pos < high GROUP BY name",
    "weighted_choice": f"""WITH u AS (SELECT event_id, ((event_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE * {sum(WEIGHTS)}::DOUBLE AS u FROM events)
      SELECT event_id, (CASE {' '.join(f'WHEN u < {c}::DOUBLE THEN {i}' for i, c in enumerate(_CUM) if WEIGHTS[i])} ELSE {len(WEIGHTS) - 1} END)::INT AS choice FROM u""",
    "codepoint_ranges": f"WITH {_POINTS} SELECT * FROM r",
    "range_contains": f"WITH {_POINTS}, a AS (SELECT (p_partkey % 1000)::INT AS cp FROM part), t AS (SELECT DISTINCT event_type FROM r) SELECT event_type, round(avg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.event_type = t.event_type AND cp BETWEEN lo AND hi) THEN 1.0::DOUBLE ELSE 0 END), 8) + 0.0 AS share FROM a, t GROUP BY event_type",
    "top_families": "SELECT p_brand, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY p_brand ORDER BY n DESC, first_part LIMIT 12",
    "style_pick": """WITH s AS (SELECT p_brand, list_sort(list_distinct(list(p_size * 100))) AS st FROM part GROUP BY p_brand), f AS (SELECT p_brand, st, list_filter([400, 700, 300], lambda x: list_contains(st, x))[1:2] AS got FROM s)
      SELECT p_brand, array_to_string(CASE WHEN len(got) > 0 THEN got ELSE st[1:1] END, ',') AS picked FROM f""",
    "batch_rounded_limit": "WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events) SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM p WHERE pos < ceil(1000 / 64.0) * 64 GROUP BY event_type",
    "union_splits": "SELECT l_returnflag AS slice_name, count(*) AS n, sum(8 + 4 * l_quantity) AS height FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY 1",
    "dense_renumber": """WITH w AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS slice_name, 8 + 4 * l_quantity AS height, floor((8 + 4 * l_quantity) * (l_partkey % 40) / 10) AS width FROM lineitem),
      n AS (SELECT *, row_number() OVER (PARTITION BY slice_name ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS number FROM w WHERE height >= 10 AND width / greatest(height, 1) >= 1.1)
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, slice_name, number, printf('%05d.png', number) AS file FROM n""",
    "slice_counts": "SELECT l_returnflag AS slice_name, count(*) AS n FROM lineitem GROUP BY 1",
    "distinct_slices": "SELECT DISTINCT l_returnflag AS slice_name FROM lineitem",
    "address_lookup": 'WITH c AS (SELECT count(*) AS n FROM documents) SELECT (event_id * 3) % n AS "index", event_id, n_chars AS length FROM events, c JOIN documents ON doc_id = (event_id * 3) % n',
}
