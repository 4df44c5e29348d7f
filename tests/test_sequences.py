"""Ordered rules against brute force."""

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemark.operators import sequences as Q


def collapsed(path, blank=0):
    out, last = [], None
    for p in path:
        if p != last and p != blank:
            out.append(p)
        last = p
    return out


def test_alignment_has_the_best_score():
    rng = np.random.default_rng(5)
    for targets in ([1], [1, 1], [1, 2], [2, 2, 1]):
        logp = np.log(rng.dirichlet(np.ones(3), 6))
        best = max((sum(logp[t, p] for t, p in enumerate(path)), path) for path in product(range(3), repeat=6) if collapsed(path) == targets)
        got = np.zeros(6, int)
        for (a, b), t in zip(Q.aligned(logp, targets), targets, strict=True):
            got[a:b + 1] = t
        assert got.tolist() == list(best[1])
    assert Q.aligned(np.zeros((2, 3)), [1, 1]) is None and Q.aligned(np.zeros((0, 3)), [1]) is None and Q.aligned(np.zeros((2, 3)), []) == []


def test_boxes_lines_and_onsets():
    b = pd.DataFrame({"det": [0, 1, 2], "x": [0.0, 1, 50], "y": [0.0, 0, 0], "w": [10.0, 10, 10], "h": [10.0, 10, 10], "score": [0.5, 0.9, 0.5]})
    assert Q.kept_boxes(b, 0.5)["det"].tolist() == [1, 2]
    assert Q.line_numbers(["x" * 10, "y" * 11, "z", "late"], [0, 1, 2, 9], [1, 2, 3, 10]) == [0, 0, 1, 2]
    assert Q.accepted([0.0, 0.1, 0.14, 0.2, 0.5], 0.15) == [0.0, 0.2, 0.5]


def test_boxes_of_uneven_frames_as_a_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(None if g == 50 else f"f{g}", n, *(float(v) for v in rng.integers(0, 12, 2)), *(float(v) for v in rng.integers(0, 9, 2)), float(rng.integers(0, 4))) for g in range(60) for n in range(200 if g == 3 else rng.integers(1, 9))]
    df = spark.createDataFrame(rows, "frame string, det int, x double, y double, w double, h double, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        got = sorted((tuple(x) for x in Q.box_suppression(df, "frame", 0.3).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[6], r[1])):
            def over(k, x=r[2], y=r[3], w=r[4], h=r[5]):
                both = max(min(x + w, k[2] + k[4]) - max(x, k[2]), 0) * max(min(y + h, k[3] + k[5]) - max(y, k[3]), 0)
                union = w * h + k[4] * k[5] - both
                return union > 0 and both / union > 0.3
            if not any(over(k) for k in kept):
                kept.append(r)
        want += kept
    assert got == sorted(want, key=str)


def test_groups_stay_whole_over_batches():
    keys = [1, 1, 2, 2, 2, 3, None, None, 4, 5, 5, 5, 5, 5]
    for size in range(1, 15):
        batches = [pa.record_batch({"k": pa.array(keys[i:i + size], pa.int64())}) for i in range(0, len(keys), size)]
        found = [t["k"].to_pylist()[a:b] for t, first in Q.whole_groups(iter(batches)) for a, b in zip(first[:-1], first[1:])]
        assert found == [[1, 1], [2, 2, 2], [3], [None, None], [4], [5] * 5]


def test_caption_end_is_held_before_the_next_line(spark):
    rows = [(1, 0, "a", 0.0, 1.0), (1, 1, "b", 2.2, 3.0), (1, 2, "c" * 22, 3.1, 4.0)]
    got = Q.caption_lines(spark.createDataFrame(rows, "c long, idx long, text string, start_s double, end_s double"), "c").orderBy("line").collect()
    assert [(r["text"][:1], r["start_s"], r["end_s"]) for r in got] == [("a", 0.0, 1.5), ("b", 2.2, 3.1), ("c", 3.1, 4.5)]
