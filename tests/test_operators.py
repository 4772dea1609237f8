"""Operators against literal values and independent NumPy versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbago.functions import numeric, text
from plumbago.operators import annotations, appearance, calibration, corpus, geometry, images, metrics, mixing, quantiles, storage
from plumbago.sources import tables


def preds(spark, rows):
    return spark.createDataFrame([("s", float(p), float(y), float(w)) for p, y, w in rows], "slice_name string, p double, label double, weight double")


def test_constant_half_scores_three_quarters(spark):
    r = metrics.slice_metrics(preds(spark, [(0.5, 0, 1), (0.5, 1, 1)]), ["slice_name"]).first()
    assert r["score"] == 0.75 and r["n"] == 2 and r["log_loss"] == pytest.approx(math.log(2))


def test_weights_count(spark):
    assert metrics.slice_metrics(preds(spark, [(0, 0, 9), (0, 1, 1)]), ["slice_name"]).first()["brier"] == pytest.approx(0.1)
    assert metrics.slice_metrics(preds(spark, [(0, 0, 1), (0, 1, 1)]), ["slice_name"]).first()["brier"] == 0.5
    with pytest.raises(ValueError):
        metrics.slice_metrics(preds(spark, [(0.5, 1, 0)]), ["slice_name"], strict=True)


def test_murphy_equals_numpy(spark):
    rng = np.random.default_rng(1)
    p = np.r_[rng.random(500), np.arange(21) / 20]
    y, w = (rng.random(len(p)) < p).astype(float), rng.uniform(0.5, 2, len(p))
    r = metrics.murphy_decomposition(preds(spark, zip(p, y, w)), ["slice_name"]).first()
    index = np.digitize(p, np.linspace(0, 1, 21)[1:-1])
    base, rel, res = np.average(y, weights=w), 0.0, 0.0
    for k in range(20):
        m = index == k
        share, o = w[m].sum() / w.sum(), np.average(y[m], weights=w[m])
        rel += share * (np.average(p[m], weights=w[m]) - o) ** 2
        res += share * (o - base) ** 2
    assert r["reliability"] == pytest.approx(rel) and r["resolution"] == pytest.approx(res) and r["uncertainty"] == pytest.approx(base * (1 - base))
    with pytest.raises(ValueError):
        metrics.bin_edges(1)


def test_consistency(spark):
    df = spark.createDataFrame([("s", 0.9, 0.9), ("s", 0.9, 0.1)], "k string, forward double, flipped double")
    r = metrics.consistency_report(df, ["k"]).first()
    assert r["max_gap"] == pytest.approx(0.8) and r["mean_gap"] == pytest.approx(0.4) and r["confident_share"] == 0.0


def test_temperature(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.5).astype(float)
    z = 4 * ((2 * y - 1) * 0.6 + rng.normal(0, 1, 3000))
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(z, y)], "logit double, label double, weight double").cache()
    t = calibration.fit_temperature(df)
    score = lambda t: np.mean((1 / (1 + np.exp(-z / t)) - y) ** 2)
    grid = np.linspace(0.05, 20, 40000)
    assert t == pytest.approx(grid[np.argmin([score(g) for g in grid[::8]]) * 8], abs=0.02)
    with pytest.raises(ValueError):
        calibration.ensemble([F.lit(1)], [1.0, 2.0])


def test_align_members(spark):
    a = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id long, p double")
    assert calibration.align_members([a, a], "id").count() == 2
    with pytest.raises(ValueError):
        calibration.align_members([a, a.where("id = 1")], "id")


def test_grid_weights_and_capping(spark):
    rng = np.random.default_rng(0)
    rows = [(float(h), float(a), i < 3000) for i, (h, a) in enumerate(zip(np.r_[rng.uniform(10, 90, 3000), rng.uniform(20, 60, 2000)], np.r_[rng.uniform(1.1, 12, 3000), rng.uniform(2, 6, 2000)]))]
    df = spark.createDataFrame(rows, "height double, aspect double, own boolean")
    own, target = df.where("own"), df.where("not own")
    edges = geometry.grid_edges(own, target)
    ratios = geometry.density_ratio(geometry.with_cells(own, edges), geometry.with_cells(target, edges), strict=True)
    weights = geometry.importance_weights(ratios).collect()
    assert sum(r["weight"] * r["n"] for r in weights) / sum(r["n"] for r in weights) == pytest.approx(1)
    assert any(r["weight"] == 0 for r in weights)
    lh, la = np.log(np.maximum([r[0] for r in rows], 8)), np.log(np.maximum([r[1] for r in rows], 1.05))
    e = [np.linspace(v.min(), v.max(), 11) for v in (lh, la)]
    hist = [np.histogram2d(lh[m], la[m], e)[0] for m in (np.arange(5000) < 3000, np.arange(5000) >= 3000)]
    got = {(r["hb"], r["ab"]): (r["n"], r["ratio"]) for r in ratios.collect()}
    for (h, a), (n, ratio) in got.items():
        assert n == hist[0][h, a] and ratio == pytest.approx(hist[1][h, a] / 2000 / (n / 3000))
    cells = geometry.capped_probabilities(ratios, 5000, 10).collect()
    per_row = np.repeat([r["ratio"] for r in cells], [r["n"] for r in cells])
    p = per_row / per_row.sum()
    cap = 10 / 5000
    for _ in range(6):
        over = p > cap
        if not over.any():
            break
        released = (p[over] - cap).sum()
        p = np.where(over, cap, p)
        room = (cap - p)[~over]
        p[~over] += room / room.sum() * min(released, room.sum())
    assert np.allclose(np.repeat([r["p"] for r in cells], [r["n"] for r in cells]), p / p.sum())
    with pytest.raises(ValueError):
        far = df.where("own").withColumn("height", F.col("height") + 1e6)
        both = geometry.grid_edges(own, far)
        geometry.density_ratio(geometry.with_cells(own, both), geometry.with_cells(far, both), strict=True)


def test_resample_keeps_expected_repeats(spark):
    own = spark.range(4000).select(F.col("id").alias("index"), F.lit(1).alias("hb"), (F.col("id") % 2).cast("int").alias("ab"))
    cells = spark.createDataFrame([(1, 0, 2000, 1.0, 0.75 / 2000), (1, 1, 2000, 1.0, 0.25 / 2000)], "hb int, ab int, n long, ratio double, p double")
    drawn = geometry.resample(own, cells, 8000, seed=4)
    n = {r["ab"]: r["count"] for r in drawn.groupBy("ab").count().collect()}
    assert n[0] == 6000 and n[1] == 2000
    assert drawn.repartition(3).count() == drawn.count()


def test_quantiles_equal_numpy(spark):
    v = np.random.default_rng(5).normal(size=777)
    r = quantiles.profile(spark.createDataFrame([(float(x),) for x in v], "v double"), ["v"]).first()
    assert np.allclose(r["v"], np.percentile(v, np.arange(101))) and r["sample_size"] == 777
    u = spark.createDataFrame([(0.0,), (0.5,), (0.999999,)], "u double").select(numeric.inverse_cdf(F.col("u"), F.array(*[F.lit(float(i)) for i in range(101)])).alias("x"))
    assert [x["x"] for x in u.collect()] == pytest.approx([0, 50, 99.9999])


def test_annotation_document(spark, tmp_path):
    quad = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    line = lambda v, **k: {"vertices": v, "text": "t", "legible": True, "vertical": False, "handwritten": False} | k
    turned = [[100, 40], [0, 40], [0, 0], [100, 0]]
    doc = {"annotations": [{"image_id": "a", "paragraphs": [{"lines": [line(quad(0, 0, 100, 20)), line(turned), line(quad(0, 0, 100, 20), legible=False), line(quad(0, 0, 20, 20), handwritten=True)]}]}]}
    path = tmp_path / "lines.json"
    path.write_text(json.dumps(doc))
    rows = annotations.flatten_lines(tables.read_line_annotations(spark, str(path)))
    assert annotations.build_report(rows).first().asDict() == {"accepted": 1, "upside_down": 1, "rejected": 2}
    box = rows.where("status = 'accepted'").first()["box"]
    assert tuple(box) == (0, 0, 100, 20)


def test_word_document(spark, tmp_path):
    flat = lambda *p: {"points": [float(x) for x in p], "utf8_string": "w"}
    doc = {"imgs": {"i": {}, "x": {}}, "anns": {"1": flat(0, 0, 40.5, 0, 40.5, 20, 0, 20), "2": flat(0, 0, 40, 0, 40, 20, 0, 20, 1, 1), "3": flat(0, 0, 40, 0, 40, 20, 0, 20)}, "imgToAnns": {"i": ["1", "2"], "x": ["3"]}}
    path = tmp_path / "words.json"
    path.write_text(json.dumps(doc))
    words = annotations.flatten_words(tables.read_word_annotations(spark, str(path)), spark.createDataFrame([("x",)], "image_id string"))
    got = {r["ann_id"]: r["status"] for r in words.collect()}
    assert got == {"1": "accepted", "2": "rejected"}
    assert words.where("ann_id = '1'").first()["box"]["width"] == 40  # half to even


def test_word_grouping_and_runs(spark):
    rows = [("i", p, x, y, 30, 20, 0.0) for p, (x, y) in enumerate([(0, 0), (40, 0), (80, 0), (0, 60), (300, 0)])] + [("j", 0, 0, 0, 30, 20, 0.0)]
    words = spark.createDataFrame(rows, "image_id string, pos int, left int, top int, width int, height int, angle double")
    got = {(r["image_id"], r["pos"]): (r["line"], r["place"]) for r in annotations.word_lines(words, "image_id").collect()}
    assert [got["i", k][0] for k in range(5)] == [0, 0, 0, 2, 1] and [got["i", k][1] for k in range(3)] == [0, 1, 2]
    five = spark.createDataFrame([([1, 2, 3, 4, 5],), ([7],)], "words array<int>")
    runs = annotations.emit_runs(five).collect()
    assert {len(r["run"]) for r in runs if len(r["words"]) == 5} == {1, 2, 3, 5} and len(runs) == 5 + 4 + 3 + 1 + 1
    merged = spark.createDataFrame([([(10, 100, 50, 60), (60, 120, 70, 100)],)], "b array<struct<left:int,top:int,width:int,height:int>>").select(annotations.merge_boxes(F.col("b")).alias("m")).first()["m"]
    assert tuple(merged) == (10, 100, 120, 120)


def test_shares(spark):
    shares = spark.createDataFrame([(0, 10, 4), (1, 100, 40)], "share int, dataset_rows long, sample_count long")
    bounds = mixing.share_boundaries(shares, "share")
    at = lambda e: mixing.locate(spark.range(44).withColumnRenamed("id", "pos"), bounds, e)
    assert [r["local"] for r in at(3).where("share = 0").orderBy("pos").collect()] == [2, 3, 4, 5]
    seen = at(0).union(at(1)).union(at(2)).where("share = 1").select("local").distinct().count()
    assert seen == 100


def test_texts(spark):
    one = lambda c, **k: spark.createDataFrame([tuple(k.values())], list(k)).select(c.alias("x")).first()["x"]
    assert one(text.title_case(F.col("s")), s="o'neil foo-bar") == "O'Neil Foo-Bar"
    assert one(text.clean_line(F.col("s")), s="  a  b~c ") == "a bc" and one(text.clean_line(F.col("s")), s="~~") is None
    assert one(text.dominant_script(F.col("s")), s="abвг") == "cyrillic" and one(text.dominant_script(F.col("s")), s="12") is None
    assert one(text.price(F.col("n"), F.lit(True)), n=1234567) == "1 234 567 ₽"
    assert one(text.file_stem(F.col("s")), s="/a/b.c/img_01.png") == "img_01"


def test_corpus_spans_are_whole(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve. short"), (2, "one two three four five six seven eight nine ten eleven twelve")], "doc_id long, text string")
    rows = corpus.cut_spans(corpus.cleaned_sentences(df, "doc_id", "text"), "doc_id", seed=3).orderBy("doc_id", "pos", "span").collect()
    whole = {}
    for r in rows:
        whole.setdefault((r["doc_id"], r["pos"]), []).append(r["line"])
    assert " ".join(whole[1, 0]) == "one two three four five six seven eight nine ten eleven twelve"
    assert all(1 <= len(x.split()) <= 14 for v in whole.values() for x in v)
    assert corpus.build_corpus(df, "doc_id", "text", fixed=4, target=2).count() == 2


def test_manifest(spark, tmp_path):
    df = tables.manifest_from_records(spark, [("a", "p", 1, 2, 30, 10, 2.5), ("b", "q", 0, 0, 9, 3, 0.5)])
    df.drop("weight").write.parquet(str(tmp_path / "m"))
    back = tables.read_manifest(spark, str(tmp_path / "m"))
    assert {r["weight"] for r in back.collect()} == {1.0}
    assert tables.with_boxes(df).where("slice_name = 'a'").first()["right"] == 31
    with pytest.raises(ValueError):
        tables.conform_manifest(df.drop("left"))
    with pytest.raises(ValueError):
        tables.take_slice(df, "zz", strict=True)
    with pytest.raises(ValueError):
        tables.manifest_from_records(spark, [])
    new = tables.with_weights(df, spark.createDataFrame([("p", 7.0)], "image_path string, weight double"), ["image_path"])
    assert {r["image_path"]: r["weight"] for r in new.collect()} == {"p": 7.0, "q": 0.5}


def test_shards_and_payloads(spark, tmp_path):
    sizes = [5, 5, 5, 20, 3]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "writer int, number int, length long")
    rows = {r["number"]: (r["shard"], r["offset"]) for r in storage.assign_shards(df, "writer", "number", "length", 10).collect()}
    assert rows == {0: (0, 0), 1: (0, 5), 2: (1, 0), 3: (2, 0), 4: (3, 0)}
    for k in range(4):
        (tmp_path / f"shard_{k:05d}.bin").write_bytes(bytes([k]) * 30)
    index = spark.createDataFrame([(k, 2, 4, 8, 8) for k in range(4)], "shard int, offset long, length long, width int, height int")
    assert {r["shard"]: bytes(r["payload"]) for r in storage.read_payloads(index, str(tmp_path)).collect()} == {k: bytes([k]) * 4 for k in range(4)}
    with pytest.raises(ValueError):
        storage.conform_index(index.drop("width"))


def test_lines_and_digest(spark, tmp_path):
    (tmp_path / "c.txt").write_text(" ab \n\nx\nyz\n")
    lines = tables.read_lines(spark, str(tmp_path / "c.txt"))
    assert sorted(r["line"] for r in lines.collect()) == ["ab", "yz"]
    numbered = spark.range(1000).select("id", F.concat(F.lit("l"), "id").alias("line"))
    a, b = (tables.lines_digest(numbered.repartition(k), "line", "id", 64).first()["sha256"] for k in (1, 7))
    assert a == b != tables.lines_digest(numbered.where("id < 999"), "line", "id", 64).first()["sha256"]


def test_image_kernels(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (24, 120, 3)).astype(np.uint8)
    assert (images.half_turn(images.half_turn(x)) == x).all() and (images.resize(x, 24, 120) == x).all()
    flat = np.full((24, 60, 3), 77, np.uint8)
    for y in (images.gaussian_blur(flat, 1.3), images.motion_blur(flat, 7, 33.0), images.arc(flat, 5.0), images.perspective(flat, np.ones((4, 2))), images.resize(flat, 11, 31, "cubic")):
        assert (y == 77).all()
    assert images.measure(flat)[2:] == (0.0, 0.0, True)
    assert images.preprocess(x, 48, 192).shape == (1, 48, 192) and images.preprocess(x, 48, 300, 3).shape == (3, 48, 300)
    assert np.allclose(images.preprocess(np.full((10, 10, 3), 255, np.uint8), 8, 32), 1.0, atol=1e-6)
    with pytest.raises(images.NotSupported):
        images.degrade(x, "real_codec", rng)
    for stage in images.STAGES:
        a = images.degrade(x, stage, images.rng_of(1, 0, 5), skip_jpeg=True)
        assert (a == images.degrade(x, stage, images.rng_of(1, 0, 5), skip_jpeg=True)).all()
    bgr = x[..., ::-1].tobytes()
    df = spark.createDataFrame([(k, (bgr, 24, 120, 3)) for k in range(20)], "id long, image struct<data:binary,height:int,width:int,nChannels:int>")
    m = images.measure_images(df, "id").first()
    assert m["crop_height"] == 24 and m["aspect_ratio"] == 5.0 and m["ink_spread"] == pytest.approx(images.to_gray(x).std() / 255)
    one = {r["id"]: (r["label"], tuple(r["image"][:9])) for r in images.labelled_samples(df, "id", "codec", 2, skip_jpeg=True).collect()}
    two = {r["id"]: (r["label"], tuple(r["image"][:9])) for r in images.labelled_samples(df.repartition(5), "id", "codec", 2, skip_jpeg=True).collect()}
    assert one == two and {v[0] for v in one.values()} == {0, 1}


def test_appearance(spark):
    rows = appearance.colour_scheme(spark.range(3000), "id").collect()
    assert all(0 <= v <= 255 for r in rows for c in (r["background"], r["foreground"]) for v in c)
    shares = np.bincount([r["mode"] for r in rows], minlength=5) / 3000
    assert np.allclose(shares, np.array(appearance.MODE_WEIGHTS) / 12.5, atol=0.04)
    assert 0.07 < np.mean([r["stroke"] is not None for r in rows]) < 0.13
    lay = appearance.layout(spark.range(2000).withColumn("aspect", F.lit(12.0)), "id", "aspect").collect()
    assert max(abs(r["tilt"]) for r in lay) <= math.degrees(math.asin(1 / 12)) + 1e-9
    texts = appearance.pattern_text(spark.range(500), "id").collect()
    assert {r["pattern"] for r in texts} == {0, 1, 2, 3, 4} and all(r["text"] for r in texts)
    with pytest.raises(ValueError):
        numeric.weighted_pick(F.lit(0.5), [0.0, 0.0])


def test_streaming_scores(spark, tmp_path):
    from plumbago.streaming.metrics import start_scores, windowed_scores

    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 's' AS slice_name, 0.5D AS p, 1.0D AS label, 1.0D AS weight").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    start_scores(windowed_scores(stream), "scores", str(tmp_path / "cp")).awaitTermination(60)
    assert spark.table("scores").first()["score"] == 0.75
