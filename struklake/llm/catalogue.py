"""Registry of the corpus queries: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from struklake.llm import (
    decontaminate,
    fingerprints,
    html,
    lexical,
    linededup,
    mixing,
    negatives,
    personal,
    quality,
    repeats,
    sharding,
    simhash,
    urls,
)
from struklake.llm.common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdict_digest(read_table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(read_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digest(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_digest(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_url_filter": op2_url_filter,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_fingerprints": op5_fingerprints,
    "op6_html": op6_html,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op2_url_filter": urls.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op4_simhash": simhash.ORACLE,
    "op6_html": html.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
    "op9_suffix_dedup": repeats.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
