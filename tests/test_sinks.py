"""Sinks and scans of files, and operators without a query."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbago.functions import numeric
from plumbago.operators import annotations, appearance, images, selection, storage
from plumbago.sources import tables


def png(width, height, level):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([level]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_shards_round_trip(spark, tmp_path):
    rows = [(w, i, bytes([w * 40 + i]) * (1 + (w * 7 + i * 5) % 23)) for w in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "writer int, number int, payload binary").withColumn("length", F.length("payload").cast("long")).repartition(5)
    placed = storage.number_shards(df.drop("payload"), "writer", "number", "length", 60).join(df.select("writer", "number", "payload"), ["writer", "number"])
    index = storage.write_payloads(placed, str(tmp_path / "store")).withColumns({"width": F.lit(8), "height": F.lit(4)})
    storage.write_index(index, str(tmp_path / "index"))
    held = spark.read.parquet(str(tmp_path / "index"))
    assert held.columns == list(storage.INDEX_COLUMNS) and held.count() == 120
    assert held.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 60 and held.groupBy("shard", "offset").count().where("count > 1").count() == 0
    got = storage.read_payloads(held, str(tmp_path / "store")).collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted(r[2] for r in rows)
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_files_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(f"a/{k:05d}.png", png(6 + k, 4, 20 * k)) for k in range(5)], "file string, payload binary")
    assert storage.write_files(df, str(tmp_path / "crops")).count() == 5
    read = tables.read_images(spark, str(tmp_path / "crops/a")).collect()
    assert [r["image_id"] for r in read] == [f"{k:05d}" for k in range(5)] and [r["image"]["width"] for r in read] == [6, 7, 8, 9, 10]
    found = tables.read_files(spark, str(tmp_path / "crops"), (".PNG".lower(),)).collect()
    assert {r["sha256"] for r in found} == {hashlib.sha256(png(6 + k, 4, 20 * k)).hexdigest() for k in range(5)}
    tables.write_manifest(spark.createDataFrame([("s", "p", 1, 2, 3, 4, None)], "slice_name string, image_path string, left int, top int, width int, height int, weight double"), str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")).first()["weight"] == 1.0


def test_corpus_digest_is_the_files(spark, tmp_path):
    lines = spark.range(5000).select("id", F.concat(F.lit("line é "), "id").alias("line"))
    tables.write_lines(lines.repartition(4), "line", ["id"], str(tmp_path / "c"))
    whole = "".join(f"line é {i}\n" for i in range(5000)).encode()
    assert tables.parts_digest(str(tmp_path / "c")) == hashlib.sha256(whole).hexdigest()


def test_fonts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.ttf", ["latin"], [(48, 57), (65, 90)])], "path string, scripts array<string>, coverage array<struct<lo:int,hi:int>>")
    tables.write_fonts(df, str(tmp_path / "f"))
    assert [tuple(r) for r in tables.read_fonts(spark, str(tmp_path / "f")).first()["coverage"]] == [(48, 57), (65, 90)]


def test_embedded_crops_and_samples(spark, tmp_path):
    spark.createDataFrame([((bytes([k]), "x"), None if k else "t") for k in range(6)], "image struct<bytes:binary,path:string>, text string").write.parquet(str(tmp_path / "e"))
    got = tables.read_embedded_crops(spark, str(tmp_path / "e"), limit=4)
    assert got.count() == 4 and {r["text"] for r in tables.read_embedded_crops(spark, str(tmp_path / "e")).collect()} == {"", "t"}
    paths = spark.createDataFrame([(f"p{k:03d}",) for k in range(50)], "path string")
    one, two = ([r["path"] for r in tables.sample_paths(paths.repartition(k), "path", 10, seed=3).collect()] for k in (2, 5))
    assert one == two == sorted(set(one)) and len(one) == 10 and tables.sample_paths(paths, "path", None).count() == 50
    near = images.by_photo(paths.withColumn("photo", F.substring("path", 2, 1)), "photo").select("photo", F.spark_partition_id().alias("part")).distinct()
    assert near.count() == near.select("photo").distinct().count()


def test_background_pixels_and_patches():
    rng = np.random.default_rng(1)
    for kind in ("solid", "gradient", "noise"):
        x = appearance.background_pixels(kind, 12, 30, (90, 120, 200), rng)
        assert x.shape == (12, 30, 3) and x.dtype == np.uint8 and (kind != "solid" or (x == (90, 120, 200)).all())
    with pytest.raises(ValueError):
        appearance.background_pixels("photo", 1, 1, (0, 0, 0), rng)
    wall = [(0, 0, 400, 300)]
    assert appearance.find_patch((400, 300), wall, 120, rng) is None and appearance.find_patch((80, 300), [], 120, rng) is None
    for _ in range(20):
        x, y, r, b = appearance.find_patch((600, 300), [(0, 0, 150, 300)], 120, rng)
        assert r - x == b - y == 120 and x >= 150 and r <= 600 and b <= 300


def test_mixed_lines(spark):
    source = lambda name, n: spark.range(n).select(F.col("id").alias("number"), F.concat(F.lit(name), "id").alias("line"))
    got = appearance.mixed_lines(spark.range(3000), "id", [(source("a", 7), "line", 3.0), (source("b", 5), "line", 1.0), (source("c", 5), "line", 0.0)]).collect()
    share = sum(r["line"].startswith("a") for r in got) / 3000
    assert len(got) == 3000 and 0.7 < share < 0.8 and not any(r["line"].startswith("c") for r in got)


def test_exact_draws(spark):
    rows = spark.range(5000).select(F.col("id").alias("index"), (F.col("id") % 3).cast("int").alias("hb"), F.lit(0).alias("ab"))
    n = {r["hb"]: r["count"] for r in rows.groupBy("hb").count().collect()}
    cells = spark.createDataFrame([(h, 0, n[h], w / n[h]) for h, w in ((0, 0.5), (1, 0.5), (2, 0.0))], "hb int, ab int, n long, p double")
    draws = spark.range(8000).select(F.col("id").alias("draw"), ((F.col("id") + 0.5) / 8000).alias("u"))
    got = selection.exact_draws(rows, cells, draws, ["hb", "ab"], "index")
    per = got.groupBy("index").count().collect()
    assert got.count() == 8000 and got.select("draw").distinct().count() == 8000
    assert got.where("hb = 0").count() == 4000 and got.where("hb = 2").count() == 0 and {r["count"] for r in per} <= {2, 3}
    ends = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.9999999999)], "draw long, u double")
    assert selection.exact_draws(rows, cells, ends, ["hb", "ab"], "index").count() == 3


def test_small_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(numeric.target_width(F.lit(5), F.lit(2), 1)) == 2 and value(numeric.target_width(F.lit(1), F.lit(90), 10)) == 1
    assert value(numeric.learning_rate(F.lit(0), 100, 10, 1.0)) == pytest.approx(0.1) and value(numeric.learning_rate(F.lit(100), 100, 10, 1.0)) == pytest.approx(0)
    assert value(numeric.tilt_compensation(F.lit(0.0), F.lit(4.0))) == pytest.approx(1) and value(numeric.tilt_compensation(F.lit(60.0), F.lit(4.0))) == 1.5
    assert value(selection.duration_text(F.lit(3723.9))) == "1:02:03" and value(selection.duration_text(F.lit(59))) == "0:59"
    assert value(selection.spec_parts(F.lit("a:b"), 3, 4)) is None and value(selection.spec_parts(F.lit("a:b:c"), 3, 4)) == ["a", "b", "c"]
    assert value(selection.repeat_until(F.lit("x" * 500), F.lit(1.0), F.lit(9000.0))) == "x" * 500
    assert tuple(value(annotations.jittered_box(F.lit(2), F.lit(3), F.lit(10), F.lit(8), F.lit(0.5), F.lit(14), F.lit(99)))) == (0, 0, 14, 15)
