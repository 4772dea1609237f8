"""Line corpora from articles: sentences, cleaning, spans, filters, first-seen dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.functions.numeric import uniform, uniform_int
from plumbago.functions.text import clean_line, has_markup, line_usable, sentences

#: Words in a line.
SPAN = (2, 14)


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, pos, sentence) of every piece."""
    return df.select(F.col(key), F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def cleaned_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences without markup, cleaned; empty ones go."""
    rows = sentence_rows(df, key, text).where(~has_markup(F.col("sentence")))
    return rows.withColumn("line", clean_line(F.col("sentence"))).where("line is not null").select(key, "pos", "line")


def cut_spans(rows: DataFrame, key: str, fixed: int | None = None, seed: int = 0) -> DataFrame:
    """Cut lines into spans of words: of a fixed size, or of 2 to 14 drawn for each span of each sentence.

    A span's end is a running sum of draws keyed by sentence and number, so rows are independent.
    """
    words = F.split("line", " ")
    if fixed:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / fixed).cast("int")), lambda i: F.struct((i * fixed).alias("at"), F.lit(fixed).alias("n")))
    else:
        draw = lambda i: uniform_int(uniform(seed, 0, "span", F.col(key), F.col("pos"), i), *SPAN)
        sizes = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / SPAN[0]).cast("int")), draw)
        empty = F.array().cast("array<struct<at:int,n:int>>")
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["at"] + F.try_element_at(acc, F.lit(-1))["n"], F.lit(0))
        starts = F.aggregate(sizes, empty, lambda acc, n: F.when(last(acc) < F.size("w"), F.concat(acc, F.array(F.struct(last(acc).alias("at"), n.alias("n"))))).otherwise(acc))
    spans = rows.withColumn("w", words).withColumn("span", F.explode(starts))
    return spans.select(key, "pos", F.col("span.at").alias("span"), F.array_join(F.slice("w", F.col("span.at") + 1, F.col("span.n")), " ").alias("line"))


def first_seen(df: DataFrame, line: str, order: list[str]) -> DataFrame:
    """Each distinct line at its first place; a grouped minimum, combined map-side."""
    return df.groupBy(line).agg(F.min(F.struct(*order)).alias("first")).select(line, "first.*")


def build_corpus(df: DataFrame, key: str, text: str, script: str = "latin", target: int | None = None, fixed: int | None = None, seed: int = 0) -> DataFrame:
    """Usable distinct lines in order of first appearance; at most ``target`` of them if given."""
    lines = cut_spans(cleaned_sentences(df, key, text), key, fixed, seed).where(line_usable(F.col("line"), script))
    out = first_seen(lines, "line", [key, "pos", "span"])
    return out.orderBy(key, "pos", "span").limit(target) if target else out
