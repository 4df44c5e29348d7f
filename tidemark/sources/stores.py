"""Lenient sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chat_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Seconds of viewer messages of a chat replay, one JSON object a line; other lines are skipped."""
    schema = "videoOffsetTimeMsec STRING, actions ARRAY<STRUCT<addChatItemAction: STRUCT<item: STRUCT<liveChatTextMessageRenderer: STRING>>>>"
    line = spark.read.text(path).select(F.from_json(F.get_json_object("value", "$.replayChatItemAction"), schema).alias("r"))
    said = F.exists("r.actions", lambda a: a["addChatItemAction"]["item"]["liveChatTextMessageRenderer"].isNotNull())
    return line.where(said).select((F.col("r.videoOffsetTimeMsec").try_cast("double") / 1000).alias("t")).where("t IS NOT NULL").orderBy("t")


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON store; an empty one if it is missing, and without the rows that can't be read."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a list, lower-cased; blank and # lines are skipped."""
    w = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return w.where("word <> '' AND NOT startswith(word, '#')").distinct()


def byte_windows(index: DataFrame, start: float, end: float, by: str = "stream") -> DataFrame:
    """From an index (by, idx, byte_len, dur) in seconds: first and last segment, byte range and times of each stream that cover [start, end].

    A start at the very end takes the last segment; a stream that ends before
    the start has no row."""
    order = f"PARTITION BY {by} ORDER BY idx"
    before = lambda c, zero: F.expr(f"coalesce(sum({c}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {zero})")
    t = index.withColumn("t0", before("dur", "0.0D")).withColumn("b0", before("byte_len", "0")).withColumn("t1", F.col("t0") + F.col("dur")).withColumn("_total", F.expr(f"sum(dur) OVER (PARTITION BY {by})"))
    last = F.expr(f"idx = max(idx) OVER (PARTITION BY {by})")
    t = t.withColumn("_last", last).where(F.col("_total") >= start)
    # from the first segment that ends after the start to the first one that reaches the end
    hit = t.where(((F.col("t1") > start) | F.col("_last")) & ((F.col("t0") < end) | (F.col("t0") <= start) | F.col("_last") & (F.col("t1") <= start)))
    return hit.groupBy(by).agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("b0").alias("byte_from"), F.max(F.col("b0") + F.col("byte_len")).alias("byte_to"), F.min("t0").alias("t0_s"), F.max("t1").alias("t1_s"))
