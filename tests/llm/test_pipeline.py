"""The pipeline's stages against brute force, each on its own input."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbago.llm import packing
from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def made(tmp_path, spark):
    rng = random.Random(2)
    en = "the of and with house river stone running water and for light under tree".split()
    de = "der die und mit haus fluss stein nicht für wasser licht unter einem baum".split()
    line = lambda v, n: " ".join(rng.choice(v) + rng.choice(["", "a", "en", "ing"]) for _ in range(n)) + "."
    common, item = line(en, 9), line(en, 25) + " " + line(en, 6)
    rows = []
    for i in range(150):
        v, lang = (en, "en") if i % 3 else (de, "de")
        parts = [line(v, rng.randint(6, 60)) for _ in range(rng.randint(1, 4))]
        if i % 6 == 1:
            parts.insert(1, common)
        if i % 40 == 5:
            parts.insert(1, item)
        rows.append((i, "\n".join(parts), lang, "s", 0))
    rows += [(500 + k, rows[60 + k][1], "de", "s", 0) for k in range(6)]
    rows += [(600, "1234 5678 !!!", None, "s", 0), (601, None, None, "s", None), (602, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, line(de, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), item


def test_stages(spark, tmp_path):
    folder, item = made(tmp_path, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    schema = docs.schema
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.columns == schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert before.keys() - after.keys() == {600, 601, 602} and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            kept = {i: s for i, _, _, s in brute.op7(list(before.items()))}
            assert {i: brute.sha(t) for i, t in after.items()} == kept
            assert {r["doc_id"]: r["n_chars"] for r in docs.collect()} == {i: len(t) for i, t in after.items()}
        elif name == "simhash_near_dedup":
            sets = {i: set(zip(*((t or "").lower().split()[k:] for k in range(5)))) for i, t in before.items()}
            like = lambda a, b: len(a & b) / max(1, len(a | b))
            gone = before.keys() - after.keys()
            assert gone >= {j for i in before for j in before if i < j and before[i] == before[j]}
            for i in gone:  # each is much like one with a lesser id, perhaps by way of others
                assert max(like(sets[i], sets[j]) for j in before if j != i) > 0.6
            assert not any(like(sets[i], sets[j]) > 0.95 for i in after for j in after if i < j)
        else:
            assert before.keys() - after.keys() == {i for i, t in before.items() if item in t}
        before = after
    rows = docs.collect()
    ids = dict(zip(before, brute.token_ids("byte_bpe_50k.json", list(before.values()))))
    by, sizes = defaultdict(int), Counter()
    for r in rows:
        assert r["ids_crc32"] == brute.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        by[r["doc_id"]] += r["length"]
        sizes[r["length"]] += 1
    assert dict(by) == {i: len(x) for i, x in ids.items()}
    assert len({r["sequence_id"] for r in rows}) <= packing.lower_bound(sizes, 1024) + 1
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
