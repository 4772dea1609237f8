"""Every operator keeps 64-bit ids exact beside nulls, repeated ids and columns whose names clash with its own."""

import pytest
from pyspark.sql import functions as F

from plumbago.llm import decontamination, html_text, language_id, line_dedup, packing, simhash, simhash_wide, spot_signatures, sstable, substring_dedup, warc
from plumbago.llm.tokens import tokenizer_path

LARGE = (1 << 60) + 1
IDS = [LARGE, None, 7, -(1 << 63), (1 << 63) - 1, 7, 0]
CLASH = "doc_id long, text string, lang string, fp string, node int, key string, mark int, keys string, chunk int, salt int, piece int, score string, cut int, told int, hashes string"


def documents(spark):
    words = "the river runs under a bridge of old stone where boats wait for the morning tide and nobody hurries along its bank today".split()
    rows = [(i, f"{k} " + " ".join(words) + f" number {k}\na line that is held by every document here\n" + ("x" * 25 if k % 2 else ""), "en") for k, i in enumerate(IDS)]
    return spark.createDataFrame([(*r, *("c" if "string" in c else 1 for c in CLASH.split(",")[3:])) for r in rows], CLASH).coalesce(1)


def pages(spark):
    rows = [(i, f"http://h{k}.org/", f"<p>text of page {k}, long enough to be kept by the extraction</p>" * 30, "c", 1) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n_chars int").coalesce(1)


def archives(spark):
    folder, captures = warc.write_archives(pages(spark))
    return warc.read_archives(folder, warc.build_index(folder, captures))


def shards(spark):
    folder, manifest = sstable.write_shards(documents(spark), tokenizer_path("word_bpe_49k.json"))
    return sstable.read_shards(spark, folder, manifest)


def leaks(spark):
    item = documents(spark).where("doc_id = 0").select(F.lit(LARGE + 2).alias("item_id"), F.expr("split(text, '\\n')[1]").alias("text"))
    out = decontamination.find_leaks(documents(spark), item)
    assert {r["item_id"] for r in out.collect()} == {LARGE + 2}
    return out


CASES = {
    "op1": lambda s: spot_signatures.fingerprint_edits(documents(s)),
    "op2": lambda s: simhash.near_duplicates(documents(s)),
    "op3": lambda s: language_id.identify(documents(s), None),
    "op4": lambda s: packing.pack_documents(documents(s), tokenizer_path("byte_bpe_50k.json")),
    "op5": archives,
    "op6": shards,
    "op7": lambda s: line_dedup.dedup_lines(documents(s), columns=("lang",)),
    "op8": leaks,
    "op9": lambda s: html_text.extract_text(pages(s)),
    "op10": lambda s: substring_dedup.dedup_substrings(documents(s)),
    "stage": lambda s: simhash_wide.near_copies(documents(s)),
}


@pytest.mark.parametrize("name", CASES)
def test_ids_stay_exact(spark, name):
    rows = CASES[name](spark).collect()
    key = "page_id" if name in ("op5", "op9") else "doc_id"
    assert sorted((r[key] is None, r[key] or 0) for r in rows) == sorted((i is None, i or 0) for i in IDS)


def test_components_are_named_exactly(spark):
    df = documents(spark)
    same = df.withColumn("text", F.lit("one and the same text for all of them"))
    for out in (simhash.near_duplicates(same), simhash_wide.near_copies(same)):
        assert {r["component_id"] for r in out.collect()} == {-(1 << 63)}
    assert {r["component_id"] for r in simhash_wide.near_copies(same.where("doc_id is null or doc_id > 7")).collect()} == {LARGE}


def test_one_id_on_two_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (5, text), (5, "another text of the same id"), (None, text), (None, "no id and alone"), (6, None), (9, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["stays"]) for r in simhash_wide.near_copies(df).collect()}
    assert got == {(1, True), (5, False), (5, True), (None, False), (None, True), (6, True), (9, False)}
