"""Segmentation of timed text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def split(units: DataFrame, by: str, gap: float = 1.25, japanese: bool = False) -> DataFrame:
    """Units (by, idx, text, start_s, end_s) as sentences: closed by final punctuation or a pause of more than `gap`; the last one only by punctuation."""
    order = f"PARTITION BY {by} ORDER BY idx"
    ends = units.withColumn("_end", T.ends_sentence(F.col("text"), japanese)).withColumn("_next", F.expr(f"lead(start_s) OVER ({order})"))
    shut = ends.withColumn("_shut", F.col("_end") | F.coalesce(F.col("_next") - F.col("end_s") > gap, F.lit(False)))
    run = shut.withColumn("sentence", F.expr(f"coalesce(sum(cast(_shut AS int)) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    return run.groupBy(by, "sentence").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("units"), words.alias("text"), F.max("_shut").alias("closed"))


# Seconds of a pause that a run-on may be cut at, how far before
# the cap it is looked for, and the longest gap that growth bridges.
CUT_PAUSE, CUT_BAND, GROW_GAP = 0.40, 10.0, 4.0


def _run_on(units: list[tuple[float, float]], cap: float) -> float:
    """Where to cut before `cap`: the last unit's end before a pause, else the last end, else the last start."""
    ends = [e for _, e in units if e <= cap]
    following = [s for s, _ in units[1:]] + [float("inf")]
    pauses = [e for (_, e), n in zip(units, following, strict=True) if cap - CUT_BAND <= e <= cap and n - e >= CUT_PAUSE]
    starts = [s for s, _ in units if s <= cap]
    return max(pauses or ends or starts or [cap])


def bounded(seed: tuple[float, float], sents: list[tuple[float, float, bool]], units: list[tuple[float, float]], least: float, most: float) -> tuple[float, float]:
    """A range on sentence bounds: snapped outward, grown by neighbouring sentences to `least`, cut to `most`; the seed where no sentence fits."""
    over = lambda t: next((i for i, (s, e, _) in enumerate(sents) if s <= t < e), None)
    lo, hi = over(seed[0]), over(seed[1])
    start, end = seed
    if lo is not None:
        start = min(sents[lo][0], start)
    else:
        lo = next((i for i, x in enumerate(sents) if x[0] >= seed[0]), None)
    if hi is not None:
        end = max(sents[hi][1], end)
    else:
        hi = max((i for i, x in enumerate(sents) if x[1] <= seed[1]), default=None)
        end = end if hi is None else sents[hi][1]
    if lo is None or hi is None or lo > hi or end <= start:
        return seed
    while end - start < least:
        sides = []
        if lo > 0 and end - sents[lo - 1][0] <= most and start - sents[lo - 1][1] <= GROW_GAP:
            sides.append((start - sents[lo - 1][1], 1))
        # an unclosed last run isn't taken in; the later one on a tie
        if hi + 1 < len(sents) and sents[hi + 1][2] and sents[hi + 1][1] - start <= most and sents[hi + 1][0] - end <= GROW_GAP:
            sides.append((sents[hi + 1][0] - end, 0))
        if not sides:
            break
        if min(sides)[1]:
            lo -= 1
            start = sents[lo][0]
        else:
            hi += 1
            end = sents[hi][1]
    if end - start > most:
        cap = start + most
        floor = min(seed[1], cap)
        while hi > lo and end - start > most and sents[hi - 1][1] >= floor:
            hi -= 1
            end = sents[hi][1]
        if end - start > most:
            end = _run_on(units, cap)
    return (start, end) if end > start else seed


def moment_bounds(seeds: DataFrame, units: DataFrame, by: str, least: float, most: float, gap: float = 1.25, japanese: bool = False) -> DataFrame:
    """Seeds (by, id, start_s, end_s) on the sentence bounds of the units (by, idx, text, start_s, end_s) of their recording.

    Sentences are made by split(); only the search for bounds is sequential.  A
    recording without units keeps its seeds."""
    timed = units.select(by, "idx", F.col("start_s").alias("u0"), F.col("end_s").alias("u1"), F.lit(False).alias("closed"), F.lit(0).alias("kind"))
    sents = split(units, by, gap, japanese).select(by, F.col("sentence").alias("idx"), F.col("start_s").alias("u0"), F.col("end_s").alias("u1"), "closed", F.lit(1).alias("kind"))

    def run(own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        said = said.sort_values(["kind", "idx"])
        words = said[said["kind"] == 0]
        runs = said[said["kind"] == 1].sort_values("u0")
        words, runs = list(zip(words["u0"], words["u1"])), list(zip(runs["u0"], runs["u1"], runs["closed"]))
        found = [bounded((a, b), runs, words, least, most) for a, b in zip(own["start_s"], own["end_s"])]
        return own[[by, "id"]].assign(start_s=[f[0] for f in found], end_s=[f[1] for f in found])

    kind = dict(seeds.dtypes)
    return seeds.groupBy(by).cogroup(timed.unionByName(sents).groupBy(by)).applyInPandas(run, f"{by} {kind[by]}, id {kind['id']}, start_s double, end_s double")


def within(units: DataFrame, moments: DataFrame, by: str, slack: float = 0.05) -> DataFrame:
    """Units (by, idx, start_s, end_s) of each moment (by, id, from_s, to_s): those inside its bounds, give or take `slack`."""
    return units.join(moments.select(by, "id", "from_s", "to_s"), by).where((F.col("start_s") >= F.col("from_s") - slack) & (F.col("end_s") <= F.col("to_s") + slack)).drop("from_s", "to_s")
