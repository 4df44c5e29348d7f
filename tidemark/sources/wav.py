"""Mono 16-bit WAV files as rows of samples."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def parsed(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples in [-1, 1) of a file.  Anything but mono 16-bit PCM is a ValueError; a cut data chunk gives what is there."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (channels, bits) != (1, 16):
                raise ValueError(f"expected mono 16-bit samples, found {channels} channels of {bits} bits")
        elif name == b"data" and rate:
            body = data[at + 8:at + 8 + size]
            return rate, np.frombuffer(body, "<i2", len(body) // 2) / np.float32(32768)
        at += 8 + size + size % 2
    raise ValueError("no samples in the WAV file")


def bounds(start_s: float, end_s: float, rate: int, total: int) -> tuple[int, int]:
    """Half-open range of samples, within the file."""
    start = min(int(max(start_s, 0.0) * rate), total)
    return start, min(max(int(min(max(end_s, 0.0) * rate, total)), start), total)


def wav_samples(spark: SparkSession, path: str, start_s: float = 0.0, end_s: float = float("inf"), piece_s: float = 30.0) -> DataFrame:
    """(path, rate, first, samples) of a range of each file, in pieces of at most piece_s seconds.

    Files are read by Spark, one in a task; a file is at most 2 GB."""
    def run(frames):
        for p in frames:
            for name, data in zip(p["path"], p["content"], strict=True):
                rate, x = parsed(data)
                a, b = bounds(start_s, end_s, rate, len(x))
                step = max(1, int(piece_s * rate))
                for k in range(a, b, step):
                    yield pd.DataFrame({"path": [name], "rate": [rate], "first": [k], "samples": [x[k:min(k + step, b)]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, first long, samples array<float>")
