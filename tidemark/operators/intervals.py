"""Interval joins.  Overlap joins go over equal cells of time, so that they shuffle by key and never compare all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def celled(df: DataFrame, start: str, end: str, cell: float) -> DataFrame:
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))


def overlaps(left: DataFrame, right: DataFrame, by: str, cell: float, least: float = 0.0) -> DataFrame:
    """Pairs whose spans [start_s, end_s) and [from_s, to_s) share more than `least`; with lo and hi of what they share."""
    both = celled(left, "start_s", "end_s", cell).join(celled(right, "from_s", "to_s", cell), [by, "_cell"])
    lo, hi = F.greatest("start_s", "from_s"), F.least("end_s", "to_s")
    # a pair meets in several cells: it counts in the one where its common part begins
    return both.withColumn("lo", lo).withColumn("hi", hi).where((F.col("hi") - F.col("lo") > least) & (F.floor(F.col("lo") / cell) == F.col("_cell"))).drop("_cell")


def cut_to(plan: DataFrame, kept: DataFrame, by: str, cell: float, least: float = 0.05) -> DataFrame:
    """Pieces of a plan inside kept spans."""
    return overlaps(plan, kept, by, cell).where(F.col("hi") - F.col("lo") >= least)


def best_overlap(units: DataFrame, kept: DataFrame, by: str, unit: str, cell: float) -> DataFrame:
    """Each unit with its largest overlap (the later span on a tie), on the clock without the gaps."""
    base = F.expr(f"coalesce(sum(to_s - from_s) OVER (PARTITION BY {by} ORDER BY from_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)")
    pairs = overlaps(units, kept.withColumn("base", base), by, cell, 1e-6)
    rank = F.expr(f"row_number() OVER (PARTITION BY {by}, {unit} ORDER BY hi - lo DESC, from_s DESC)")
    best = pairs.withColumn("_k", rank).where("_k = 1").drop("_k")
    return best.withColumn("new_start", F.col("base") + F.col("lo") - F.col("from_s")).withColumn("new_end", F.col("base") + F.col("hi") - F.col("from_s"))


def covering(points: DataFrame, windows: DataFrame, by: str, point: str, cell: float) -> DataFrame:
    """Each point t with the window that covers it and has the nearest centre (the first on a tie)."""
    cells = points.withColumn("_cell", F.floor(F.col("t") / cell))
    both = cells.join(celled(windows, "from_s", "to_s", cell), [by, "_cell"]).where("from_s <= t AND t < to_s")
    rank = F.expr(f"row_number() OVER (PARTITION BY {by}, {point} ORDER BY abs(t - (from_s + to_s) / 2), from_s)")
    return both.withColumn("_k", rank).where("_k = 1").drop("_k", "_cell")


def snapped(points: DataFrame, candidates: DataFrame, by: str, point: str, back: float, ahead: float) -> DataFrame:
    """Each t moved to the candidate `at` of the best score in [t - back, t + ahead] (the later on a tie); t without one."""
    cell = back + ahead
    left = points.withColumn("_cell", F.explode(F.array(F.floor((F.col("t") - back) / cell), F.floor((F.col("t") - back) / cell) + 1)))
    near = left.join(candidates.withColumn("_cell", F.floor(F.col("at") / cell)), [by, "_cell"]).where(f"at >= t - {back} AND at <= t + {ahead}")
    best = near.groupBy(by, point).agg(F.max(F.struct("score", "at")).alias("b"))
    return points.join(best, [by, point], "left").withColumn("snapped", F.coalesce("b.at", "t")).drop("b")


def complement(cuts: DataFrame, by: str, total: float, groups: DataFrame | None = None) -> DataFrame:
    """What is left of [0, total) after cuts (from_s, to_s); cuts that touch are one.

    A group of `groups` (its column `by`) without cuts keeps all of [0, total)."""
    reach = F.expr(f"max(to_s) OVER (PARTITION BY {by} ORDER BY from_s, to_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    gaps = cuts.withColumn("_to", F.coalesce(reach, F.lit(0.0))).where("from_s > _to").select(by, F.col("_to").alias("from_s"), F.col("from_s").alias("to_s"))
    tail = cuts.groupBy(by).agg(F.max("to_s").alias("from_s")).where(f"from_s < {total}").withColumn("to_s", F.lit(total))
    left = gaps.unionByName(tail)
    if groups is None:
        return left
    whole = groups.select(by).distinct().join(cuts.select(by), by, "left_anti")
    return left.unionByName(whole.select(by, F.lit(0.0).alias("from_s"), F.lit(total).alias("to_s")))


def without(kept: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """Kept spans (by, from_s, to_s) without one removed span (lo, hi) a group: what lies before and after it; pieces of nothing go."""
    both = kept.join(gone.select(by, "lo", "hi"), by, "left")
    pieces = F.array(F.struct("from_s", F.least("to_s", F.coalesce("lo", "to_s")).alias("to_s")), F.struct(F.greatest("from_s", F.coalesce("hi", "to_s")).alias("from_s"), "to_s"))
    return both.select(by, F.explode(pieces).alias("x")).select(by, "x.from_s", "x.to_s").where("from_s < to_s")


def touching(spans: DataFrame, by: str, slack: float = 1e-6) -> DataFrame:
    """Spans (by, idx, start_s, end_s) in the order of idx, those that begin where the one before ends put together."""
    order = f"PARTITION BY {by} ORDER BY idx"
    begins = spans.withColumn("_new", F.expr(f"coalesce(abs(start_s - lag(end_s) OVER ({order})) >= {slack}, true)"))
    run = begins.withColumn("run", F.expr(f"sum(int(_new)) OVER ({order} ROWS UNBOUNDED PRECEDING)"))
    return run.groupBy(by, "run").agg(F.min_by("start_s", "idx").alias("from_s"), F.max_by("end_s", "idx").alias("to_s")).drop("run")


def first_within(points: DataFrame, spans: DataFrame, by: str, point: str, span: str, slack: float, cell: float) -> DataFrame:
    """Each point t with the first span that holds it, give or take `slack` (the smaller `span` on a tie); points without one aren't listed."""
    wide = celled(spans.withColumn("_a", F.col("from_s") - slack).withColumn("_b", F.col("to_s") + slack), "_a", "_b", cell)
    near = points.withColumn("_cell", F.floor(F.col("t") / cell)).join(wide, [by, "_cell"]).where("_a <= t AND t <= _b")
    return near.groupBy(by, point).agg(F.min(F.struct("from_s", span)).alias("x")).select(by, point, F.col(f"x.{span}").alias(span))
