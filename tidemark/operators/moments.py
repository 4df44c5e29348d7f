"""Discovery of moments: peaks, suppression, ranges that grow around them, ranking."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import series as S


def greedy_peaks(peaks: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Strongest first (the earlier on a tie); dropped if nearer than `gap` bins to one that is kept."""
    kept: list[int] = []
    rows = []
    for k in peaks.sort_values(["v", "bin"], ascending=[False, True], kind="stable").index:
        b = int(peaks.at[k, "bin"])
        if all(abs(b - o) >= gap for o in kept):
            kept.append(b)
            rows.append(k)
    return peaks.loc[rows]


def non_maximum(peaks: DataFrame, gap: int) -> DataFrame:
    """Peaks of a series are few; the greedy rule needs them in order."""
    return peaks.groupBy("series_id").applyInPandas(lambda p: greedy_peaks(p, gap)[["series_id", "bin", "v"]], "series_id string, bin long, v double")


def grown(values, peak: int, width: float, lead: float, least: float, most: float) -> tuple[float, float]:
    """The range around a peak in which the series holds 0.45 of it (0.5 at least)."""
    bar, limit = max(0.45 * values[peak], 0.5), math.ceil(most / width)
    left = right = peak
    while left > 0 and peak - left < limit and values[left - 1] >= bar:
        left -= 1
    while right + 1 < len(values) and values[right + 1] >= bar and right - peak < limit:
        right += 1
    at, total = peak * width + width / 2, len(values) * width
    start = max(min(at - lead, left * width - 1.0), at - max(0.35 * most, lead), 0.0)
    end = min(max((right + 1) * width + 2.0, start + least), start + most, total)
    if end - start < least:
        start = max(0.0, end - least)
    return start, end


def suppressed(ranges: list[tuple[float, float, float, float]], least: float) -> list[tuple[float, float, float, float]]:
    """(start, end, peak, score) by falling score, trimmed against those kept; one that loses its peak or its length goes."""
    out: list[tuple[float, float, float, float]] = []
    for start, end, at, score in ranges:
        lost = False
        for a, b, *_ in out:
            if a < end and start < b:
                if a <= at < b:
                    lost = True
                    break
                start, end = (start, min(end, a)) if at < a else (max(start, b), end)
        if not lost and end - start >= least and start <= at < end:
            out.append((start, end, at, score))
    return out


def discover(combined: DataFrame, width: float, bar: float, lead: float, least: float, most: float, top: int) -> DataFrame:
    """series_id, id, start_s, end_s, peak_s, score of the best moments of each series."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = p.sort_values("bin")["v"].to_numpy()
        found = [b for b in range(len(v)) if v[b] >= bar and (b == 0 or v[b] > v[b - 1]) and (b + 1 == len(v) or v[b] >= v[b + 1])]
        kept = greedy_peaks(pd.DataFrame({"bin": found, "v": [v[b] for b in found]}), max(1, math.floor(least / width + 0.5)))
        ranges = [(*grown(v, int(b), width, lead, least, most), b * width + width / 2, float(s)) for b, s in zip(kept["bin"], kept["v"], strict=True)]
        rows = suppressed(ranges, least)[:top]
        return pd.DataFrame([(p["series_id"].iloc[0], k + 1, *r) for k, r in enumerate(rows)], columns=["series_id", "id", "start_s", "end_s", "peak_s", "score"])

    return combined.select("series_id", "bin", "v").groupBy("series_id").applyInPandas(run, "series_id string, id long, start_s double, end_s double, peak_s double, score double")


def combined_score(weights: dict[str, float]) -> Column:
    """Weighted mean of the signals that are there; 0 without any."""
    total = sum((F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def reranked(moments: DataFrame, by: str) -> DataFrame:
    """id is the rank by falling score; the former id breaks ties."""
    return moments.withColumn("id", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id)").cast("long"))


def detect(loud: DataFrame, chat: DataFrame, width: float, window: int, bar: float, least: float, most: float, top: int) -> DataFrame:
    """From two gridded signals to ranked moments: robust z, smoothing, weighted sum, peaks, ranges, suppression."""
    both = S.combine([(S.smooth_max(S.robust_z(loud), window), 0.5), (S.smooth(S.robust_z(chat), window), 0.5)])
    return discover(both, width, bar, 3 * width, least, most, top)
