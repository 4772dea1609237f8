"""The registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm import language_id
from plumbago.llm.decontamination import find_leaks
from plumbago.llm.html_text import extract_text
from plumbago.llm.line_dedup import dedup_lines
from plumbago.llm.packing import pack_documents
from plumbago.llm.simhash import near_duplicates
from plumbago.llm.spot_signatures import fingerprint_edits
from plumbago.llm.sstable import read_shards, write_shards
from plumbago.llm.substring_dedup import dedup_substrings
from plumbago.llm.tokens import tokenizer_path
from plumbago.llm.warc import build_index, read_archives, write_archives


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, captures = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = read_archives(folder, build_index(folder, captures))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_shards(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return read_shards(spark, folder, manifest)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir), texts=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_documents(spark, sf_dir), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict:
    return {f.__name__: f for f in (op1_spotsigs, op2_simhash, op3_language_id, op4_packing, op5_warc, op6_sstable, op7_line_dedup, op8_decontaminate, op9_html_text, op10_substring_dedup)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), k AS (SELECT html, max(page_id) AS kept FROM p WHERE strlen(html) >= 1000 GROUP BY html HAVING count(*) > 1)
      SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN kept IS NOT NULL AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN kept <> page_id THEN kept END AS refers_to FROM p LEFT JOIN k USING (html)""",
    "op7_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
      e AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
      h AS (SELECT key, max(doc_id) AS keeper FROM e WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256 FROM e LEFT JOIN h USING (key) GROUP BY doc_id""",
    "op10_substring_dedup": """WITH s AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
      w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM s),
      h AS (SELECT doc_id, word, k, CASE WHEN k <= n - 34 THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM w),
      t AS (SELECT h FROM h WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
      d AS (SELECT doc_id, word, k, t.h IS NOT NULL AS again FROM h LEFT JOIN t USING (h)),
      c AS (SELECT doc_id, word, k, bool_or(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM d)
      SELECT s.doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
      FROM s LEFT JOIN c USING (doc_id) GROUP BY s.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
