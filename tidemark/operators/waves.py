"""Sound as numbers: filter banks, envelopes and the place of a take in a recording.

Kernels are numpy over one window or clip at a time; a row holds one, so that
memory is bounded by the longest clip.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The filter bank's rate, frame, shift, transform, pre-emphasis, bands and their range in Hz.
RATE, FRAME, SHIFT, FFT, EMPHASIS, MELS, LOW, HIGH = 16_000, 400, 160, 512, 0.97, 80, 20.0, 7600.0
# Samples of an envelope bin, least correlation, most seconds by which two windows may differ.
HOP, LEAST_CORRELATION, AGREE_S = 64, 0.55, 0.08


@lru_cache(1)
def _bank() -> tuple[np.ndarray, np.ndarray]:
    """The window over a frame, and the triangles [MELS, FFT / 2] on the mel scale."""
    window = np.hanning(FRAME) ** 0.85
    mel = lambda hz: 1127.0 * np.log1p(np.asarray(hz) / 700.0)
    edges = np.linspace(mel(LOW), mel(HIGH), MELS + 2)
    at = mel(np.arange(FFT // 2) * RATE / FFT)[None, :]
    left, mid, right = (edges[k:k + MELS, None] for k in range(3))
    return window, np.clip(np.minimum((at - left) / (mid - left), (right - at) / (right - mid)), 0, None)


def log_mels(x: np.ndarray, centred: bool = True) -> np.ndarray:
    """[frames, MELS] log energies; frames stand on the shift grid and reflect at the ends.  centred: less the mean of each band."""
    frames = (len(x) + SHIFT // 2) // SHIFT
    if not len(x) or not frames:
        return np.zeros((0, MELS))
    at = np.arange(frames)[:, None] * SHIFT + (SHIFT - FRAME) // 2 + np.arange(FRAME)
    at = np.where(at < 0, -at - 1, at)
    at = np.clip(np.where(at >= len(x), 2 * len(x) - 1 - at, at), 0, len(x) - 1)
    f = x[at].astype(float)
    f -= f.mean(1, keepdims=True)
    f -= EMPHASIS * np.hstack([f[:, :1], f[:, :-1]])
    window, bank = _bank()
    power = np.abs(np.fft.rfft(f * window, FFT)[:, :FFT // 2]) ** 2
    out = np.log(np.maximum(power @ bank.T, np.finfo(np.float32).eps))
    return out - out.mean(0) if centred else out


def envelope(x: np.ndarray) -> np.ndarray:
    """ln(1 + 10000 E) of bins of HOP samples, E their mean square."""
    if not len(x):
        return np.zeros(0)
    begins = np.arange(0, len(x), HOP)
    return np.log1p(1e4 * np.add.reduceat(np.square(x, dtype=float), begins) / np.minimum(HOP, len(x) - begins))


def best_lag(a: np.ndarray, b: np.ndarray) -> tuple[float, float] | None:
    """Bins after which a stands in b, refined between bins, and the correlation there; the last of equals.  None if a doesn't fit."""
    n = len(a)
    if not n or len(b) < n:
        return None
    own = a - a.mean()
    total, squares = (np.r_[0.0, np.cumsum(y)] for y in (b, b * b))
    spread = squares[n:] - squares[:-n] - (total[n:] - total[:-n]) ** 2 / n
    score = np.correlate(b, own, "valid") / (max(np.sqrt((own * own).sum()), 1e-9) * np.maximum(np.sqrt(np.maximum(spread, 0)), 1e-9))
    k = len(score) - 1 - int(score[::-1].argmax())
    before, top, after = score[max(k - 1, 0)], score[k], score[min(k + 1, len(score) - 1)]
    bend = before - 2 * top + after
    return k + (0.5 * (before - after) / bend if abs(bend) > 1e-9 else 0.0), float(top)


def offset(take: np.ndarray, whole: np.ndarray, rate: int = RATE) -> tuple[float, float] | None:
    """Second of the whole at which the take begins, and the lesser correlation of its windows; None without two that agree."""
    bins, long = rate / HOP, len(take) / rate
    if long >= 26:
        spans = [(2.0, 12.0), (long - 12, long - 2)]
    elif long >= 8:
        spans = [(1.0, min(long - 1, 11.0)), (max(long - 8, 1.0), long - 1)]
    else:
        spans = [(0.2, long - 0.2)]
    part, rest, found = envelope(take), envelope(whole), []
    for a, b in spans:
        i, j = int(max(a, 0) * bins), min(int(max(b, 0) * bins), len(part))
        hit = best_lag(part[i:j], rest) if j > i + int(bins) else None
        if hit is None or hit[1] < LEAST_CORRELATION:
            return None
        found.append((hit[0] / bins - a, hit[1]))
    at = [x for x, _ in found]
    return None if abs(at[0] - at[-1]) > AGREE_S else (sum(at) / len(at), min(c for _, c in found))


def filter_banks(windows: DataFrame, by: str, centred: bool = True) -> DataFrame:
    """(by, samples array) to (by, frame, mels array); a null or empty window has no rows."""
    def run(frames):
        for p in frames:
            for k, x in zip(p[by], p["samples"], strict=True):
                if x is not None and len(x):
                    m = log_mels(np.asarray(x, float), centred)
                    yield pd.DataFrame({by: k, "frame": np.arange(len(m)), "mels": list(m)})

    return windows.select(by, "samples").mapInPandas(run, f"{by} {windows.schema[by].dataType.simpleString()}, frame long, mels array<double>")


def offsets(pairs: DataFrame, by: str, rate: int = RATE) -> DataFrame:
    """(by, take, whole), arrays of samples, to (by, offset_s, correlation), null where nothing agrees."""
    def run(frames):
        for p in frames:
            hits = [(None if a is None or b is None else offset(np.asarray(a, float), np.asarray(b, float), rate)) or (None, None) for a, b in zip(p["take"], p["whole"], strict=True)]
            yield pd.DataFrame({by: p[by], "offset_s": [h[0] for h in hits], "correlation": [h[1] for h in hits]}).astype({"offset_s": float, "correlation": float})

    out = pairs.select(by, "take", "whole").mapInPandas(run, f"{by} {pairs.schema[by].dataType.simpleString()}, offset_s double, correlation double")
    return out.selectExpr(by, "nullif(offset_s, double('NaN')) AS offset_s", "nullif(correlation, double('NaN')) AS correlation")
