"""Reports, fonts and configuration."""

import pytest
from pyspark.sql import functions as F

from plumbago.operators import appearance, fonts, reports
from plumbago.sources import config, tables


def test_reports(spark):
    scores = spark.createDataFrame([("real_scene", "a", 0.94), ("hand", "a", 0.9)], "slice_name string, bucket string, score double")
    assert reports.estimate_test_score(scores).first()["estimate"] == pytest.approx(0.94426)
    assert reports.score_table(scores, ["real_scene", "hand", "none"]).first().asDict() == {"bucket": "a", "real_scene": 0.94, "hand": 0.9, "none": None}
    models = spark.createDataFrame([("t", "a", 1.0, 10), ("t", "b", 2.0, 10), ("u", "a", 3.0, 5)], "member string, slice_name string, temperature double, macs long")
    assert tuple(reports.model_summary(models).first()) == (2.25, 15)
    batches = spark.createDataFrame([(0, 1.0, 10), (1, 4.0, 5)], "i int, loss double, rows long")
    assert [r["mean_loss"] for r in reports.running_loss(batches, "i").orderBy("i").collect()] == [1.0, 2.0]
    history = spark.createDataFrame([(0, 0.5, 1.0, {"a": 0.5}, 0.5), (1, 0.4, 1.0, {"a": 0.7}, 0.7), (2, 0.3, 1.0, {"a": 0.7}, 0.7)], "index int, loss double, seconds double, scores map<string,double>, score double")
    assert reports.best_epoch(history).first()["index"] == 1
    one = reports.session_row(history, 1.5).first()
    assert (one["epoch"], one["best_score"], len(one["history"]), one["temperature"]) == (2, 0.7, 3, 1.5)


def test_fonts(spark, tmp_path):
    (tmp_path / "fonts.json").write_text('[{"path": "a.ttf", "scripts": [], "coverage": [48, 57, 65, 90, 97, 122]}, {"path": "b.ttf", "scripts": [], "coverage": [65, 90, 97, 122]}]')
    got = fonts.eligible(tables.read_fonts(spark, str(tmp_path / "fonts.json"))).collect()
    assert [(r["path"], r["scripts"]) for r in got] == [("a.ttf", ["latin"])]
    style = fonts.line_style(appearance.colour_scheme(spark.range(2000), "id"), "id").collect()
    assert all(r["skew"] == 0 or 3 <= r["skew"] <= 22 for r in style) and all(r["stroke_width"] == 0 or r["stroke"] is not None for r in style)
    assert 0.15 < sum(r["skew"] > 0 for r in style) / 2000 < 0.25


def test_config(tmp_path):
    paths = {k: "x" for k in config.RunConfig.REQUIRED}
    c = config.parse_config({"paths": paths, "weights": {"english": 3}, "train_length": "7"})
    assert c.weights.english == 3.0 and c.weights.russian == 6.0 and c.train_length == 7 and c.preprocess.width == 192
    with pytest.raises(ValueError):
        config.parse_config({"paths": {}})
    with pytest.raises(ValueError):
        config.parse_config({"paths": paths, "preprocess": {"channel_count": 2}})
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("paths: {font_index: a, russian_corpus: b, english_corpus: c, test_profile: d}\nvalidation_seed: 5\n")
    assert config.read_config(str(tmp_path / "c.yaml")).validation_seed == 5


def test_profile_round_trip(spark, tmp_path):
    q = [float(i) for i in range(101)]
    df = spark.createDataFrame([(q, q, q, q, 0.16, 5000)], "crop_height array<double>, aspect_ratio array<double>, sharpness array<double>, ink_spread array<double>, grayscale_share double, sample_size int")
    tables.write_profile(df, str(tmp_path / "p"))
    assert tables.read_profile(spark, str(tmp_path / "p")).first()["sharpness"] == q
    tables.write_profile(df.withColumn("sharpness", F.array(F.lit(1.0))), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        tables.read_profile(spark, str(tmp_path / "bad"))
