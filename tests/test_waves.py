"""Sound kernels against plain sums and planted offsets; WAV files by round trip."""

import cmath
import math
import struct
import wave

import numpy as np
import pytest

from tidemark.operators import waves
from tidemark.sources import wav


def plain_mels(x, f):
    """Band energies of one frame by a sum over frequencies, as the definition has it."""
    frame = []
    for i in range(400):
        s = f * 160 + 80 - 200 + i
        s = -s - 1 if s < 0 else s
        s = 2 * len(x) - 1 - s if s >= len(x) else s
        frame.append(x[min(max(s, 0), len(x) - 1)])
    mean = sum(frame) / 400
    frame = [v - mean for v in frame]
    frame = [v - 0.97 * frame[max(i - 1, 0)] for i, v in enumerate(frame)]
    frame = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / 399)) ** 0.85 for i, v in enumerate(frame)]
    power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / 512) for i, v in enumerate(frame))) ** 2 for k in range(256)]
    mel = lambda hz: 1127 * math.log(1 + hz / 700)
    lo, step = mel(20), (mel(7600) - mel(20)) / 81
    out = []
    for m in range(80):
        a, c, b = (lo + (m + j) * step for j in range(3))
        e = sum(p * ((q - a) / (c - a) if q <= c else (b - q) / (b - c)) for k, p in enumerate(power) if a < (q := mel(k * 31.25)) < b)
        out.append(math.log(max(e, 2.0 ** -23)))
    return out


def test_filter_bank():
    x = np.random.default_rng(1).normal(size=900)
    got = waves.log_mels(x, centred=False)
    assert got.shape == (6, 80) and len(waves.log_mels(x[:0])) == 0 and waves.log_mels(x[:90]).shape == (1, 80)
    for f in (0, 3, 5):
        assert np.allclose(got[f], plain_mels(x.tolist(), f), atol=1e-6)
    assert np.allclose(waves.log_mels(x).mean(0), 0)


@pytest.mark.parametrize("seconds", [4, 12, 30])
def test_planted_offset(seconds):
    r = np.random.default_rng(seconds)
    whole = r.normal(size=16_000 * 40) * np.repeat(r.random(400), 1_600)
    take = whole[16_000 * 5:16_000 * (5 + seconds)] * 0.7
    at, corr = waves.offset(take, whole)
    assert abs(at - 5) < 0.02 and corr > 0.9
    assert waves.offset(r.normal(size=16_000 * seconds) * np.repeat(r.random(10 * seconds), 1_600), whole) is None
    assert waves.offset(take[:100], whole) is None and waves.best_lag(whole[:9], whole[:8]) is None


def test_columns(spark):
    rows = [(1, [0.5] * 400, [0.1] * 9), (2, None, None), (3, [], [])]
    df = spark.createDataFrame(rows, "id long, take array<double>, whole array<double>")
    assert [tuple(r) for r in waves.offsets(df, "id").orderBy("id").collect()] == [(1, None, None), (2, None, None), (3, None, None)]
    assert [(r.id, r.frame, len(r.mels)) for r in waves.filter_banks(df.withColumnRenamed("take", "samples"), "id").orderBy("frame").collect()] == [(1, k, 80) for k in range(3)]


def test_wav_round_trip(spark, tmp_path):
    x = np.random.default_rng(2).integers(-32768, 32768, 4_000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(1_000)
        f.writeframes(x.tobytes())
    rows = wav.wav_samples(spark, str(tmp_path), 0.5, 3.25, 1.0).orderBy("first").collect()
    assert [(r.rate, r.first, len(r.samples)) for r in rows] == [(1_000, 500, 1_000), (1_000, 1_500, 1_000), (1_000, 2_500, 750)]
    assert (np.concatenate([r.samples for r in rows]) * 32768 == x[500:3250]).all()
    assert wav.bounds(-1, 99, 10, 50) == (0, 50) and wav.bounds(9, 2, 10, 50) == (50, 50) and wav.bounds(3, 1, 10, 50) == (30, 30)
    data = (tmp_path / "a.wav").read_bytes()
    with pytest.raises(ValueError):
        wav.parsed(data[:22] + struct.pack("<H", 2) + data[24:])
    with pytest.raises(ValueError):
        wav.parsed(b"RIFX")
