"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.llm import oracles
from ordertide.llm.common import table
from ordertide.llm.decontaminate import decontaminate
from ordertide.llm.hard_negatives import hard_negatives, whole_vectors
from ordertide.llm.html_text import extract_text
from ordertide.llm.hpylm import score_texts
from ordertide.llm.licenses import PHRASES, TEMPLATES, scan_licenses
from ordertide.llm.mixing import mixture
from ordertide.llm.pii import find_personal_data
from ordertide.llm.quality_model import score_quality
from ordertide.llm.quality_rules import quality_rules
from ordertide.llm.simhash import near_duplicates
from ordertide.llm.spelling import spelling_variants
from ordertide.llm.token_counts import count_tokens
from ordertide.llm.url_filter import filter_urls

# Fixed: the rules of the url query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, items).drop("text_hash")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "entry string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_removed",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform(F.filter("places", lambda p: p.kind == "phrase"), lambda p: p.start)
    named = F.transform(F.filter("places", lambda p: p.kind == "phrase"), lambda p: p.label)
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives(vectors, is_anchor=F.col("id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_source_mixing": op5_source_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_personal_data": op8_personal_data,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_license_scan": op12_license_scan,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": oracles.DECONTAMINATE,
    "op4_url_filter": oracles.URL_FILTER,
    "op10_quality_rules": oracles.QUALITY_RULES,
    "op11_spelling_variants": oracles.SPELLING,
    "op12_license_scan": oracles.licenses(PHRASES, TEMPLATES),
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
