"""From raw documents to packed sequences, in five stages.

Each stage reads what the one before it kept, as Parquet, whole.  run() writes
the results between stages to the shared folder of the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, near_dups, packed, packing, suffix_dedup
from tidemark.llm.queries import vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found (op 4)."""
    return langid.in_known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, at shingles of five words and a similarity of 0.8 (op 10)."""
    return near_dups.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that start in an earlier one (op 3)."""
    return suffix_dedup.without_repeats(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window stands (op 7)."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 2048 tokens (op 6)."""
    return packing.pack(docs, vocabulary())


STAGES = [("language ID", identified), ("MinHash near-dedup", one_of_each), ("suffix-array dedup", without_repeats), ("benchmark decontamination", clean), ("packing", packed_pieces)]

#: Language ID, near-dedup and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), packed.made()
    for name, stage in STAGES:
        docs = packed.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        # what the stage has read and kept for itself isn't needed any more
        packed.sweep(spark, [*before, docs.tidemark_path])
    return docs
