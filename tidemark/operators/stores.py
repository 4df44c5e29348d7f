"""Keyed stores and their joins: layered merge, harvesting, voting, clustering by sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

def layered(rows: DataFrame) -> DataFrame:
    """Corrections (layer, pos, wrong, right, at_s): one row per (lower wrong, at_s), the upper layer wins but a blank right never hides a filled one; the first position stays."""
    own = rows.withColumn("_key", F.lower("wrong"))
    filled = F.struct((F.col("right") != "").alias("f"), "layer", "pos", "wrong", "right")
    merged = own.groupBy("_key", "at_s").agg(F.max(filled).alias("w"), F.min(F.struct("layer", "pos")).alias("p"))
    return merged.select("w.wrong", "w.right", "at_s", F.col("p.layer").alias("layer"), F.col("p.pos").alias("pos"))


def harvested(words: DataFrame, known: DataFrame, least: float, chars: int, top: int) -> DataFrame:
    """Words (clip, idx, word, confidence) that are unsure, long enough without marks at their ends, and not known: the first of each, the least confident `top` of a clip."""
    own = words.withColumn("core", F.lower(T.core(F.col("word")))).where((F.col("confidence") < least) & (F.length("core") >= chars) & F.col("core").rlike(r"\p{L}"))
    first = own.withColumn("_k", F.expr("row_number() OVER (PARTITION BY clip, core ORDER BY idx)")).where("_k = 1")
    new = first.join(known.select(F.lower("word").alias("core")).distinct(), "core", "left_anti")
    rank = F.expr("row_number() OVER (PARTITION BY clip ORDER BY confidence, idx)")
    return new.withColumn("rank", rank).where(F.col("rank") <= top).select("clip", "core", "confidence", F.col("rank").cast("long").alias("rank"))


def voted(votes: DataFrame) -> DataFrame:
    """Votes (pos, variant, token): the token with most votes; the backbone (variant 0) wins a tie, else the smallest token."""
    n = votes.groupBy("pos", "token").agg(F.count("*").alias("n"), F.max((F.col("variant") == 0).cast("int")).alias("backbone"))
    rank = F.expr("row_number() OVER (PARTITION BY pos ORDER BY n DESC, backbone DESC, token)")
    return n.withColumn("_k", rank).where("_k = 1").select("pos", "token", "n")


def seats(pairs: DataFrame, least: int, share: float) -> DataFrame:
    """Pairs (cluster, seat), one per bin: the seat of each cluster that is seen often and mostly there."""
    n = pairs.groupBy("cluster", "seat").agg(F.count("*").alias("n"))
    total = n.withColumn("total", F.expr("sum(n) OVER (PARTITION BY cluster)")).withColumn("_k", F.expr("row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seat)"))
    return total.where((F.col("_k") == 1) & (F.col("total") >= least) & (F.col("n") / F.col("total") >= share)).select("cluster", "seat", "n", "total")


def gap_cut(heights: DataFrame) -> DataFrame:
    """The middle of the largest gap between neighbouring merge heights of each group (the first on a tie); 0.5 for fewer than two."""
    gap = heights.withColumn("_next", F.expr("lead(d) OVER (PARTITION BY grp ORDER BY d)"))
    best = gap.where("_next IS NOT NULL").groupBy("grp").agg(F.max(F.struct((F.col("_next") - F.col("d")).alias("g"), (-F.col("d")).alias("first"), ((F.col("_next") + F.col("d")) / 2).alias("cut"))).alias("b"))
    return heights.select("grp").distinct().join(best, "grp", "left").select("grp", F.coalesce("b.cut", F.lit(0.5)).alias("cut"))


def average_linkage(items: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Clusters of unit vectors (item, emb) by average cosine distance; 0 is the largest cluster.

    Each step joins the pair of the least mean, the first in order on a tie.  Only
    the upper triangle counts: a row knows its nearest later column, or just a
    bound below it once that column is gone, and is searched anew when the bound
    comes up.  So a step costs a row, not the whole table."""
    x = np.stack(items["emb"]).astype(float)
    n = len(x)
    sums = x @ x.T
    np.subtract(1, sums, out=sums)
    size, alive = np.ones(n), np.ones(n, bool)
    best, near, exact = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    groups: list[list[int] | None] = [[i] for i in range(n)]

    def search(a: int) -> None:
        mean = np.where(alive[a + 1:], sums[a, a + 1:] / (size[a] * size[a + 1:]), np.inf)
        k = int(mean.argmin()) if len(mean) else -1
        best[a], near[a], exact[a] = (mean[k], a + 1 + k, True) if k >= 0 else (np.inf, -1, True)

    for a in range(n):
        search(a)
    for _ in range(n - 1):
        while not exact[a := int(best.argmin())]:
            search(a)
        if best[a] >= threshold:
            break
        b = int(near[a])
        sums[a] += sums[b]
        sums[:, a] = sums[a]
        size[a] += size[b]
        alive[b], best[b], exact[b] = False, np.inf, True
        groups[a] += groups[b]
        groups[b] = None
        # what earlier rows now have in column a; rounding may bring it below their bound
        mean = np.where(alive[:a], sums[a, :a] / (size[a] * size[:a]), np.inf)
        had, lost = best[:a], (near[:a] == a) | (near[:a] == b)
        less = (mean < had) | ((mean == had) & exact[:a] & (lost | (near[:a] > a))) & (mean < np.inf)
        exact[:a] &= ~(lost & ~less)
        had[less], near[:a][less], exact[:a][less] = mean[less], a, True
        exact[a + 1:b] &= near[a + 1:b] != b
        search(a)
    left = [g for g in groups if g]
    label = np.empty(n, np.int64)
    for k, g in enumerate(sorted(left, key=len, reverse=True)):
        label[g] = k
    return pd.DataFrame({"item": items["item"], "cluster": label})


def clustered(items: DataFrame, by: str, threshold: float) -> DataFrame:
    """Groups are one clip's windows; a group takes the square of its items times 8 bytes."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        return average_linkage(p.sort_values("item").reset_index(drop=True), threshold).assign(**{by: p[by].iloc[0]})[[by, "item", "cluster"]]

    return items.groupBy(by).applyInPandas(run, f"{by} long, item long, cluster long")


def edits(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Levenshtein operations that turn a into b: diagonal before deletion before insertion."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int64)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            out.append(("ok" if a[i - 1] == b[j - 1] else "sub", i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            out.append(("del", i - 1, None))
            i -= 1
        else:
            out.append(("ins", None, j - 1))
            j -= 1
    return out[::-1]


def attributed(activity: pd.DataFrame, hold: int, ratio: float = 1.35, floor: float = 0.004) -> pd.DataFrame:
    """Speaker of each bin by hysteresis: rows (bin, voiced, track, v); a challenger must lead by `ratio` for `hold` bins in a row."""
    current = rival = None
    run = 0
    rows = []
    for b, g in activity.sort_values(["bin", "track"]).groupby("bin", sort=True):
        acts = dict(zip(g["track"], g["v"], strict=True))
        total = sum(acts.values())
        if not g["voiced"].iloc[0]:
            rival, run = None, 0
            rows.append((b, None, 0.0))
            continue
        lead = max(acts, key=lambda t: (acts[t], t))
        if acts[lead] < floor:
            rows.append((b, current, 0.34 if current is not None else 0.0))
            continue
        if current is None:
            current = lead
        elif lead != current and acts[lead] > ratio * max(acts.get(current, 0.0), floor):
            run = run + 1 if rival == lead else 1
            rival = lead
            if run >= hold:
                current, rival, run = lead, None, 0
        else:
            rival, run = None, 0
        rows.append((b, current, acts.get(current, 0.0) / total if total else 0.0))
    return pd.DataFrame(rows, columns=["bin", "speaker", "confidence"])


def with_clip_todos(store: DataFrame, clips: DataFrame) -> DataFrame:
    """A store (pos, wrong, right) and the open to-dos of clip stores (clip, pos, wrong, right) whose word it doesn't know: the first of each word; pos goes on after the store's."""
    todo = clips.where("wrong <> '' AND right = ''").withColumn("_k", F.lower("wrong"))
    new = todo.join(store.select(F.lower("wrong").alias("_k")).distinct(), "_k", "left_anti").groupBy("_k").agg(F.min(F.struct("clip", "pos", "wrong")).alias("x"))
    return store.select("wrong", "right", F.lit(None).cast("long").alias("clip")).unionByName(new.select("x.wrong", F.lit("").alias("right"), F.col("x.clip").cast("long").alias("clip")))


def promoted(store: DataFrame, clip: DataFrame) -> DataFrame:
    """A store (wrong, right) after the confirmed corrections of a clip (pos, wrong, right, clip_only) are taken in: a blank right side is filled, a word that is filled stays, a new one is added; the clip's first entry of a word counts."""
    given = clip.where("wrong <> '' AND right <> '' AND NOT clip_only").groupBy(F.lower("wrong").alias("_k")).agg(F.min(F.struct("pos", "wrong", "right")).alias("x"))
    own = store.select("wrong", "right", F.lower("wrong").alias("_k"))
    both = own.join(given, "_k", "full")
    return both.select(F.coalesce("wrong", "x.wrong").alias("wrong"), F.when(F.coalesce("right", F.lit("")) != "", F.col("right")).otherwise(F.coalesce("x.right", F.lit(""))).alias("right"))


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with those of `new` (same columns, one for each key) in place of rows with their key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def languages(videos: DataFrame, creators: DataFrame, default: str = "id") -> DataFrame:
    """Videos (id, creator, explicit) with their language: the one asked for, else the creator's (creator, language), else the default."""
    return videos.join(creators.select("creator", "language"), "creator", "left").select("id", F.coalesce("explicit", "language", F.lit(default)).alias("language"))


def dash_pairs(formats: DataFrame, by: str) -> DataFrame:
    """Of the formats (by, protocol, url, vcodec, acodec, height, container, tbr) of a video: the best plain-HTTP H.264 track up to 1080 lines, the best AAC one, and whether a muxed playlist is there."""
    plain = F.col("protocol").isin("http", "https") & F.col("url").isNotNull()
    mp4 = F.col("container").isNull() | F.col("container").contains("mp4")
    video = plain & F.col("vcodec").startswith("avc1") & (F.col("acodec") == "none") & (F.col("height") <= 1080) & mp4
    audio = plain & F.col("acodec").startswith("mp4a") & (F.col("vcodec") == "none")
    muxed = F.col("protocol").startswith("m3u8") & (F.col("vcodec") != "none") & (F.col("acodec") != "none") & (F.col("height") <= 1080)
    rate = F.floor(F.coalesce("tbr", F.lit(0.0)))
    best = formats.groupBy(by).agg(F.max(F.when(video, F.struct("height", rate.alias("r"), "url"))).alias("v"), F.max(F.when(audio, F.struct(rate.alias("r"), "url"))).alias("a"), F.coalesce(F.max(muxed.cast("int")), F.lit(0)).alias("m"))
    whole = F.col("v").isNotNull() & F.col("a").isNotNull()
    return best.select(by, F.when(whole, F.col("v.url")).alias("video"), F.when(whole, F.col("a.url")).alias("audio"), (F.col("m") == 1).alias("muxed"))


def numbered_names(clips: DataFrame, by: str) -> DataFrame:
    """Clips (by, id, stem) with names that don't collide in a folder: the first of a stem as it is, others with (2), (3) in the order of id."""
    n = F.expr(f"row_number() OVER (PARTITION BY {by}, stem ORDER BY id)")
    return clips.withColumn("_n", n).select(by, "id", F.when(F.col("_n") == 1, F.col("stem")).otherwise(F.format_string("%s (%d)", "stem", "_n")).alias("name"))

