"""Text-corpus, pattern and script queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions import text as t
from plumbago.operators import corpus
from plumbago.plans.scoring import rounded
from plumbago.plans.stand_ins import table

SPAN = 8


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", "sentence")


def markup_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.sentence_rows(table(spark, sf_dir, "pages"), "page_id", "html")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(~t.has_markup(F.col("sentence"))).alias("plain"))


def line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.clean_line(F.col("text")).alias("line")).where("line is not null")


def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return rounded(d.select("doc_id", t.script_share(F.col("text"), "latin").alias("latin"), t.script_share(F.col("text"), "cyrillic").alias("cyrillic"), t.letters(F.col("text")).cast("long").alias("letters")))


def dominant_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text in Cyrillic stand-in letters, every fifth half and half, some without a letter."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("s"))
    cyr = F.translate("s", "abcdefghijklmnopqrstuvwxyz", "абсдефгийклмнопярстувшхузы")
    mixed = F.when(F.col("doc_id") % 7 == 0, F.lit("12 34")).when(F.col("doc_id") % 5 == 0, F.lit("Приветhellois")).when(F.col("doc_id") % 3 == 0, cyr).otherwise(F.col("s"))
    return d.select("doc_id", t.dominant_script(mixed).alias("script"))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.build_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", fixed=SPAN)
    return lines.select("line", "doc_id", "pos", "span")


def corpus_drawn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.build_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", seed=7)


def first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return corpus.first_seen(rows, "line", ["conv_id", "turn"])


def price_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", t.price(F.floor("o_totalprice"), F.col("o_orderkey") % 2 == 0).alias("price"))


def text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions, phone number, date and article code from an order's numbers."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    part = lambda m, a: (F.col("k") * m % 398 + a).cast("int")
    sizes = F.when(F.col("k") % 2 == 0, F.array(part(7, 3), part(11, 3))).otherwise(F.array(part(7, 3), part(11, 3), part(13, 3)))
    separator = F.get(F.array(F.lit("x"), F.lit("*"), F.lit(" x ")), (F.col("k") % 3).cast("int"))
    digits = F.lpad((F.col("k") * 7919 % 10_000_000_000).cast("string"), 10, "0")
    groups = F.array(*[F.array(*[(F.col("k") * m % 97 + j).cast("int") for j in range(3)]) for m in (3, 5)])
    return o.select(
        "o_orderkey", t.dimensions(separator, sizes).alias("dimensions"), t.phone(digits).alias("phone"),
        t.date_text((1990 + F.col("k") % 37).cast("int"), (1 + F.col("k") % 12).cast("int"), (1 + F.col("k") % 28).cast("int")).alias("date"),
        t.article_code(groups, F.array(F.col("k") % 2 == 0, F.lit(False))).alias("code"),
    )


def case_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbago.functions.numeric import lcg_uniform

    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", t.case_roll(F.lower("p_name"), lcg_uniform(F.col("p_partkey"))).alias("name"))


_SENT = "s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n]+')) AS sentence, generate_subscripts(string_split_regex(text, '[.!?\\n]+'), 1) - 1 AS pos FROM documents)"
_MARK = "NOT (" + " OR ".join(f"contains({{0}}, '{m}')" for m in t.MARKUP) + ")"
_CLEAN = "nullif(trim(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}} .,:;!?()\"''/%#&+*=@«»—–№₽-]', '', 'g'), '[ \\t\\n\\x0B\\f\\r\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{85}}\\x{{1680}}]+', ' ', 'g')), '')"
_LETTERS = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"
_LATIN, _CYR = (f"length(regexp_replace({{0}}, '{p}', '', 'g'))" for p in ("[^A-Za-z]", "[^А-яЁё]"))

QUERIES = (sentence_split, markup_drop, line_clean, script_share, dominant_script, corpus_lines, corpus_drawn_spans, first_seen_dedupe, price_pattern, text_patterns, case_roll)

SQL = {
    "sentence_split": f"WITH {_SENT} SELECT doc_id, pos::INT AS pos, sentence FROM s",
    "markup_drop": f"""WITH s AS (SELECT page_id, unnest(string_split_regex(html, '[.!?\\n]+')) AS sentence FROM pages)
      SELECT page_id, count(*) AS sentences, count(*) FILTER ({_MARK.format('sentence')}) AS plain FROM s GROUP BY page_id""",
    "line_clean": f"WITH c AS (SELECT conv_id, turn, {_CLEAN.format('text')} AS line FROM conversations) SELECT * FROM c WHERE line IS NOT NULL",
    "script_share": f"""SELECT doc_id, round(coalesce({_LATIN.format('text')} / nullif({_LETTERS.format('text')}, 0), 0), 8) + 0.0 AS latin, round(coalesce({_CYR.format('text')} / nullif({_LETTERS.format('text')}, 0), 0), 8) + 0.0 AS cyrillic,
      {_LETTERS.format('text')} AS letters FROM documents""",
    "dominant_script": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '12 34' WHEN doc_id % 5 = 0 THEN 'Приветhellois' WHEN doc_id % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абсдефгийклмнопярстувшхузы') ELSE text END AS s FROM documents)
      SELECT doc_id, CASE WHEN {_CYR.format('s')} >= {_LATIN.format('s')} AND {_CYR.format('s')} > 0 THEN 'cyrillic' WHEN {_LATIN.format('s')} > 0 THEN 'latin' END AS script FROM d""",
    "corpus_lines": f"""WITH {_SENT}, c AS (SELECT doc_id, pos, {_CLEAN.format('sentence')} AS line FROM s WHERE {_MARK.format('sentence')}), w AS (SELECT doc_id, pos, string_split(line, ' ') AS w FROM c WHERE line IS NOT NULL),
      p AS (SELECT doc_id, pos, unnest(range(0, len(w), {SPAN})) AS span, w FROM w), l AS (SELECT doc_id, pos, span, array_to_string(w[span + 1:span + {SPAN}], ' ') AS line FROM p),
      u AS (SELECT * FROM l WHERE length(line) BETWEEN 4 AND 120 AND {_LETTERS.format('line')} >= 3 AND {_LATIN.format('line')} / {_LETTERS.format('line')} >= 0.6)
      SELECT line, doc_id, pos::INT AS pos, span::INT AS span FROM u QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos, span) = 1""",
    "first_seen_dedupe": "SELECT text AS line, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) = 1",
    "price_pattern": "SELECT o_orderkey, replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', ' ') || CASE WHEN o_orderkey % 2 = 0 THEN ' ₽' ELSE '' END AS price FROM orders",
    "text_patterns": """WITH k AS (SELECT o_orderkey, o_orderkey AS k, lpad((o_orderkey * 7919 % 10000000000)::VARCHAR, 10, '0') AS d, ['x', '*', ' x '][o_orderkey % 3 + 1] AS s FROM orders)
      SELECT o_orderkey, (k * 7 % 398 + 3) || s || (k * 11 % 398 + 3) || CASE WHEN k % 2 = 0 THEN '' ELSE s || (k * 13 % 398 + 3) END AS dimensions,
      '+7 ' || d[1:3] || ' ' || d[4:6] || '-' || d[7:8] || '-' || d[9:10] AS phone, strftime(make_date(1990 + k % 37, 1 + k % 12, 1 + k % 28), '%d.%m.%Y') AS date,
      array_to_string(list_transform([0, 1, 2], lambda j: CASE WHEN k % 2 = 0 THEN chr((65 + (k * 3 % 97 + j) % 26)::INT) ELSE ((k * 3 % 97 + j) % 10)::VARCHAR END), '') || ' ' || array_to_string(list_transform([0, 1, 2], lambda j: ((k * 5 % 97 + j) % 10)::VARCHAR), '') AS code FROM k""",
    "case_roll": """WITH p AS (SELECT p_partkey, lower(p_name) AS n, ((p_partkey * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS u FROM part)
      SELECT p_partkey, CASE WHEN u < 0.32 THEN upper(n) WHEN u < 0.47 THEN array_to_string(list_transform(regexp_extract_all(n, '\\p{L}+|[^\\p{L}]+'), lambda x: upper(x[1]) || x[2:]), '') ELSE n END AS name FROM p""",
}
