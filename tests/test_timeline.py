"""Rules of the timeline, note and sentence operators on cases, and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import notes as N
from tidemark.functions import text as X
from tidemark.operators import intervals, moments, sentences, series, stores
from tidemark.operators import timeline as T


def test_notes_come_back_as_written(spark):
    titles = ["Ther, lyhe sh ered from ", "at from  at ", "now - operator verify", "conf 1) at 0:01", "a\nb", ""]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = df.select("t", N.parse_note(N.harvest_note(F.lit(0.29), F.col("t"), F.lit(3908.0))).alias("p")).collect()
    assert {r.t: (r.p.title, r.p.at_s, round(r.p.confidence, 2)) for r in got} == {t: (t or None, 3908.0, 0.29) for t in titles}


def _halves(text):
    t = text.strip(" ")
    mid, blanks = len(t) // 2, [k for k, x in enumerate(t) if x == " "]
    at = min(blanks, key=lambda k: (abs(k - mid), k), default=None)
    first, second = (t[:mid], t[mid:]) if at is None else (t[:at].strip(" "), t[at + 1:].strip(" "))
    return (first, second) if len(t) >= 2 and first and second else None


def test_halves_as_a_loop_and_of_long_texts(spark):
    r = random.Random(3)
    texts = ["", " ", "a", "ab", "a b", "  ab cd ", "é ö ü", "a  b", "𝒳 b", "abc d", "a bcd"] + ["".join(r.choice("aé𝒳  ") for _ in range(r.randint(0, 12))) for _ in range(400)]
    texts += ["x" * 200_000 + " " + "y" * 300_000, "word " * 100_000, "z" * 100_001]  # by the square of the length these take hours
    got = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string").select("t", N.halves(F.col("t"), F.lit(0.0), F.lit(2.0)).alias("h")).collect()
    assert {x.t: x.h and (x.h.first, x.h.second) for x in got} == {t: _halves(t) for t in texts}


def test_answers_of_a_judge(spark):
    cases = {
        '{"score": 8, "reason": "big", "title": "Boss — down"}': (8.0, "big", "Boss - down"),
        'noise {"score": "7"} noise': (7.0, "", ""),
        "after the 3rd try, I'd say 8": (8.0, "after the 3rd try, I'd say 8", ""),
        "9/10": (9.0, "9/10", ""),
        "out of 10 I give 6": (6.0, "out of 10 I give 6", ""),
        "4 fights, score: 9": (9.0, "4 fights, score: 9", ""),
        "no number": (0.0, "no number", ""),
        "100 times": (0.0, "100 times", ""),
        '{"score": 99, "reason": ""}': (10.0, "", ""),
    }
    got = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", N.parse_judgment(F.col("raw")).alias("j")).collect()
    assert {r.raw: tuple(r.j) for r in got} == cases


def test_notes(spark):
    cases = {
        'auto-harvested (conf 0.42) from "He LOST it on the boss" at 1:23:45 - operator verify': (0.42, "He LOST it on the boss", 5025.0),
        "auto-harvested (conf 0.30) at 1:23 - operator verify": (0.3, None, 83.0),
        'x from "meet at noon" at 0:07 - operator verify': (None, "meet at noon", 7.0),
        "by hand": (None, None, None),
    }
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", N.parse_note(F.col("n")).alias("p")).collect()
    assert {r.n: (r.p.confidence and round(r.p.confidence, 2), r.p.title, r.p.at_s) for r in got} == cases


def test_boundaries_as_a_loop(spark):
    r = random.Random(1)
    cuts = [(k % 3, r.choice([0.0, 0.01, 5.0, 99.99, r.uniform(0, 100)])) for k in range(90)]
    clips = spark.createDataFrame([(k, 100.0) for k in range(4)], "clip long, duration double")
    got = T.boundaries(spark.createDataFrame(cuts, "clip long, t double"), clips, "clip", 0.9).collect()
    for clip in range(4):
        want = []
        for t in sorted([0.0, 100.0] + [t for c, t in cuts if c == clip and 0.03 < t < 99.97]):
            if not want or t - want[-1] >= 0.9:
                want.append(t)
        assert sorted(x.t for x in got if x.clip == clip) == want


def test_range_around_a_peak():
    # the centre of the bin is where the peak is
    v = [0.0] * 60
    v[20] = 5.0
    assert moments.grown(v, 20, 1.0, 3.0, 5.0, 20.0) == (17.5, 23.0)


def slow_nms(peaks, gap):
    kept = []
    for v, b in sorted(((v, b) for b, v in peaks), key=lambda x: (-x[0], x[1])):
        if all(abs(b - k) >= gap for k in kept):
            kept.append(b)
    return kept


def test_suppression_as_a_loop(spark):
    r = random.Random(2)
    peaks = [(b, float(r.randint(0, 5))) for b in r.sample(range(300), 90)]
    df = spark.createDataFrame([("a", b, v) for b, v in peaks], "series_id string, bin long, v double")
    assert sorted(x.bin for x in moments.non_maximum(df, 7).collect()) == sorted(slow_nms(peaks, 7))


def test_moments_as_a_loop(spark):
    r = random.Random(3)
    v = [max(0.0, r.gauss(0, 1)) + (6.0 * math.exp(-((b % 50) - 25) ** 2 / 8) if b // 50 % 2 else 0) for b in range(400)]
    df = spark.createDataFrame([("a", b, x) for b, x in enumerate(v)], "series_id string, bin long, v double")
    got = [(x.start_s, x.end_s, x.peak_s) for x in moments.discover(df, 2.0, 2.0, 6.0, 10.0, 60.0, 5).orderBy("id").collect()]
    peaks = [(b, v[b]) for b in range(400) if v[b] >= 2 and (not b or v[b] > v[b - 1]) and (b == 399 or v[b] >= v[b + 1])]
    kept = []
    for b in slow_nms(peaks, 5):
        bar, lo, hi = max(0.45 * v[b], 0.5), b, b
        while lo > 0 and b - lo < 30 and v[lo - 1] >= bar:
            lo -= 1
        while hi < 399 and hi - b < 30 and v[hi + 1] >= bar:
            hi += 1
        at = 2 * b + 1.0
        start = max(min(at - 6, 2 * lo - 1), at - 21, 0.0)
        end = min(min(max(2 * hi + 4, start + 10), start + 60), 800.0)
        if end - start < 10:
            start = max(0.0, end - 10)
        inside = False
        for a, z, _ in kept:
            if a < end and start < z:
                if a <= at < z:
                    inside = True
                    break
                start, end = (start, min(end, a)) if at < a else (max(start, z), end)
        if not inside and end - start >= 10 and start <= at < end:
            kept.append((start, end, at))
    assert got == kept[:5]


def test_clusters_as_a_loop(spark):
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(4)
    x = r.normal(size=(3, 8))[r.integers(0, 3, 24)] * 3 + r.normal(size=(24, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = stores.average_linkage(pd.DataFrame({"item": range(24), "emb": list(x)}), 0.5)
    groups = [[i] for i in range(24)]
    while len(groups) > 1:
        far, a, b = min((np.mean([1 - x[i] @ x[j] for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if far >= 0.5:
            break
        groups[a] += groups.pop(b)
    want = sorted(sorted(g) for g in groups)
    assert sorted(sorted(g["item"]) for _, g in got.groupby("cluster")) == want


def _linkage(x, threshold):
    """The whole table searched for each pair."""
    import numpy as np

    groups, sums = [[i] for i in range(len(x))], 1 - x @ x.T
    while len(groups) > 1:
        size = np.array([len(g) for g in groups])
        mean = sums / np.outer(size, size)
        mean[np.tril_indices(len(groups))] = np.inf
        a, b = divmod(int(mean.argmin()), len(groups))
        if mean[a, b] >= threshold:
            break
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sums = np.delete(np.delete(sums, b, 0), b, 1)
        groups[a] += groups.pop(b)
    return sorted(groups, key=lambda g: -len(g))


def test_clusters_of_many_copies_and_ties_as_a_search_of_all():
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(8)
    for trial in range(60):
        n, d = int(r.integers(1, 60)), int(r.integers(2, 6))
        x = np.sign(r.normal(size=(n, d))) if trial % 3 == 0 else r.normal(size=(n, d))
        x = x[r.integers(0, max(1, n // 3), n)] if trial % 3 == 1 else x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for threshold in (0.3, 0.6, 3.0):
            got = stores.average_linkage(pd.DataFrame({"item": range(n), "emb": list(x)}), threshold)
            want = _linkage(x, threshold)
            assert got["cluster"].tolist() == [next(k for k, g in enumerate(want) if i in g) for i in range(n)], (trial, threshold)


def test_clusters_of_a_large_group_in_time():
    import time

    import numpy as np
    import pandas as pd

    r = np.random.default_rng(9)
    x = r.normal(size=(300, 16))[r.integers(0, 300, 3000)] + 0.3 * r.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    began = time.process_time()
    got = stores.average_linkage(pd.DataFrame({"item": range(3000), "emb": list(x)}), 0.9)
    assert got["cluster"].nunique() < 300 and time.process_time() - began < 40  # searched as a whole it is minutes


@pytest.mark.parametrize("text, japanese, ends", [("ok.", False, True), ('word."', False, True), ("so‼ ", False, True), ("he said ”", False, False), ("そう。だ", False, False), ("そう。だ", True, True), ("a! b", True, False), ("end.»", False, True)])
def test_sentence_ends(spark, text, japanese, ends):
    assert spark.createDataFrame([(text,)], "t string").select(X.ends_sentence(F.col("t"), japanese).alias("e")).first().e is ends


def test_sentences_close_by_mark_or_pause(spark):
    units = [(1, k, t, s, s + 0.4) for k, (t, s) in enumerate([("one", 0.0), ("two.", 0.5), ("three", 1.0), ("four", 4.0)])]
    got = sentences.split(spark.createDataFrame(units, "c long, idx long, text string, start_s double, end_s double"), "c").orderBy("start_s").collect()
    assert [(x.text, x.closed) for x in got] == [("one two.", True), ("three", True), ("four", False)]


def test_short_series_are_padded(spark):
    df = lambda n, v: spark.createDataFrame([("a", b, v) for b in range(n)], "series_id string, bin long, v double")
    got = {x.bin: x.v for x in series.combine([(df(3, 1.0), 0.5), (df(2, 2.0), 0.25)]).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.5}


def test_mass_of_spans(spark):
    bins = spark.createDataFrame([("a", k, float(k)) for k in range(4)], "series_id string, bin long, v double")
    spans = spark.createDataFrame([("a", 1, 0.0, 40.0), ("a", 2, 36.0, 60.0), ("a", 3, 12.0, 14.0), ("a", 4, 0.0, 10.0), ("b", 5, 0.0, 40.0), ("a", None, 5.0, 15.1), ("a", 6, 0.0, 10.0), ("a", 6, 20.0, 30.0)], "series_id string, span long, start_s double, end_s double")
    got = {x.span: (x.hits, x.total) for x in series.mass(bins, spans, 10.0, 1.0).collect()}
    assert got == {1: (3, 4), 2: (None, 0), 3: (None, 0), 4: (0, 1), 5: (None, 0), None: (1, 2), 6: (1, 2)}


def test_a_group_without_cuts_keeps_its_timeline(spark):
    cuts = spark.createDataFrame([(1, 2.0, 4.0)], "c long, from_s double, to_s double")
    groups = spark.createDataFrame([(1,), (2,)], "c long")
    got = sorted(tuple(x) for x in intervals.complement(cuts, "c", 10.0, groups).collect())
    assert got == [(1, 0.0, 2.0), (1, 4.0, 10.0), (2, 0.0, 10.0)]


def test_empty_tables(spark):
    points, at = spark.createDataFrame([], "by long, id long, t double"), spark.createDataFrame([], "by long, at double")
    bins = spark.createDataFrame([], "by long, bin long, speaker string, confidence double")
    assert T.nearest(points, at, "by", 1.0).count() == T.value_at(points, bins, "by", 1.0).count() == 0
    assert T.boundaries(points, spark.createDataFrame([], "by long, duration double"), "by", 1.0).count() == 0
