"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.llm import infill, language, quality, toxicity
from kinefold.llm.alignment import align
from kinefold.llm.common import crc_fold, scratch_path
from kinefold.llm.decontaminate import contamination
from kinefold.llm.html_text import extract_text
from kinefold.llm.lempel_ziv import compare_edited
from kinefold.llm.packing import pack
from kinefold.llm.pii import find_pii
from kinefold.llm.retrieval_packing import pack_related
from kinefold.llm.simhash import near_duplicates
from kinefold.llm.tokens import token_digests, write_tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contamination.*")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(_documents(spark, sf_dir), path)
    return token_digests(spark, path)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def _scored(scored: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(quality.score_quality(docs, model), 4, 2, quality.THRESHOLD)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "language.*")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(toxicity.score_toxicity(docs, model), 3, 1, toxicity.THRESHOLD)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_documents(spark, sf_dir))


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_related(_documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_documents(spark, sf_dir))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_output": op2_token_output,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_lempel_ziv_fingerprint": op7_lempel_ziv_fingerprint,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_retrieval_packing": op12_retrieval_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL of the operators that it can express: no tokenizer, no XXH64, no classifier.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT item, least(13, len(w)) AS n, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS j FROM b WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[j + 1 : j + n], ' ') AS k FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n),
hits AS (SELECT doc_id, item, p, n FROM (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS k FROM places) JOIN wanted USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
