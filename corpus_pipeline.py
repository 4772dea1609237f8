"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm import language_id
from plumbago.llm.common import materialise
from plumbago.llm.decontamination import find_leaks
from plumbago.llm.line_dedup import dedup_lines
from plumbago.llm.packing import pack_documents
from plumbago.llm.simhash_wide import near_copies, text_mark
from plumbago.llm.tokens import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents go whose words are, to less than this expected share, in one language.
LEAST_SHARE = 0.5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents without those rows whose id and text are listed: another text of the same id stays."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    listed = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (text_mark(F.col("text")) == F.col("gone_mark"))
    return docs.join(gone, listed, "left_anti").select(*COLUMNS)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or a prevailing language go.

    A null, empty or letterless text goes; a row without an id or a label is judged by its text; repeated rows
    and ties (to the language first in alphabetical order) are judged alike; other columns are left out.
    """
    told = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: frequent lines stay in the document with the largest id only; n_chars follows the text.

    A null text becomes an empty one; repeated rows count once and are cut alike; rows without an id are one
    document, which never keeps a frequent line where one with an id holds it; other columns are left out.
    """
    kept = dedup_lines(docs, columns=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over five-word shingles at a similarity of 0.8: the least doc_id of each group stays.

    Null, empty and blank texts are copies of each other; one id on two texts is two documents; repeated rows of
    the one that stays all stay; a row without an id stays only where its whole group has none; other columns
    are left out.
    """
    return _without(docs, near_copies(docs, shingle=5).where(~F.col("stays")))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go.

    A null or blank text holds none and stays; rows go by id and text, so repeated rows go together and another
    text of the same id stays; an empty benchmark changes nothing; other columns are left out.
    """
    marked = docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
    return _without(docs, find_leaks(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=("mark",)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left into sequences of at most 1024 tokens.

    A null or empty text is the end id alone; repeated rows and rows without an id are packed each.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("pack", pack_sequences),
]

#: A trained model, components and a packing search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
