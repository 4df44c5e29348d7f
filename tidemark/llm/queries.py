"""The registered queries of the corpus operators.  Each reads its whole tables and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import brown_lm, decontam, fingerprint_log, hilbert_ann, langid, near_dups, packing, quality, suffix_dedup, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public byte-level BPE that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_log.dedup(_table(spark, sf_dir, "documents"), texts=False)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(_table(spark, sf_dir, "embeddings"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), keep_bytes=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_nearest_neighbours, op3_suffix_array_dedup, op4_language_id, op5_quality_classifier, op6_packing, op7_decontamination, op8_url_filters, op9_lm_scoring, op10_near_dedup)
}
SQL: dict[str, str] = {"op7_decontamination": decontam.SQL, "op8_url_filters": url_rules.SQL}
