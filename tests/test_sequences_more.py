"""Sequential rules on cases and against plain loops; lenient sources on small files."""

import json
import random
import time

import pytest

from tidemark.operators import captions, sentences, sequences
from tidemark.sources import stores


def runs_of(values, least):
    runs = []
    for k, v in enumerate(values):
        if runs and runs[-1][2] == v:
            runs[-1][1] += 1
        else:
            runs.append([k, 1, v])
    out = []
    for first, n, v in runs:
        if out and (out[-1][2] == v or n < least):
            out[-1][1] += n
        else:
            out.append([first, n, v])
    if len(out) > 1 and out[0][1] < least:
        first, n, _ = out.pop(0)
        out[0] = [first, out[0][1] + n, out[0][2]]
    return [tuple(x) for x in out]


def test_stable_runs_as_a_loop(spark):
    r = random.Random(1)
    clips = {c: [r.choice("abc") for _ in range(r.choice([1, 2, 40]))] for c in range(6)}
    clips[7] = list("a" * 5 + "b" * 2 + "a" * 4)
    df = spark.createDataFrame([(c, k, v) for c, own in clips.items() for k, v in enumerate(own)], "clip long, bin long, subject string")
    got = sequences.stable_runs(df, "clip", 3).collect()
    for c, own in clips.items():
        assert sorted((x["first"], x.bins, x.subject) for x in got if x.clip == c) == runs_of(own, 3)


def test_chunks(spark):
    tokens = ["今日", "は", "暑い", "ですね。", "はい", "", "長い長い言葉", "!"]
    df = spark.createDataFrame([(1, k, t, float(k), k + 0.5, 0.9 - k / 10) for k, t in enumerate(tokens)], "clip long, idx long, raw string, t0 double, t1 double, p double")
    got = sequences.character_chunks(df, "clip").orderBy("chunk").collect()
    assert [x.text for x in got] == ["今日は", "暑い", "ですね。", "はい", "長い長い言葉", "!"]
    assert (got[0].start_s, got[0].end_s, round(got[0].confidence, 3)) == (0.0, 1.5, 0.8)


def test_tracks_as_a_loop(spark):
    r = random.Random(2)
    boxes = [(c, f, n, r.choice([10, 50, 200]) + r.uniform(-8, 8), r.uniform(0, 8), 10.0, 10.0) for c in range(3) for f in range(12) for n in range(r.randint(0, 4))]
    got = {(x.clip, x.frame, x.det): x.track for x in sequences.tracked(spark.createDataFrame(boxes, "clip long, frame long, det long, x double, y double, w double, h double"), "clip", 12.0).collect()}
    for c in range(3):
        tracks = []
        for f in range(12):
            claimed = []
            for b in (x for x in boxes if x[0] == c and x[1] == f):
                cx, cy = b[3] + 5, b[4] + 5
                best = None
                for k, (u, v) in enumerate(tracks):
                    d = ((cx - u) ** 2 + (cy - v) ** 2) ** 0.5
                    if k not in claimed and d <= 12 and (best is None or d < best[0]):
                        best = (d, k)
                k = best[1] if best else len(tracks)
                tracks[k:k + 1] = [(cx, cy)]
                claimed.append(k)
                assert got[(c, f, b[2])] == k


def test_tracks_of_uneven_clips(spark):
    """Clips of one box to hundreds, as a plain loop sees them; more rows than a batch."""
    r = random.Random(12)
    boxes = [(c, f, n, r.choice([10.0, 30.0, 50.0]) + r.uniform(-9, 9), r.uniform(0, 8), 10.0, 10.0) for c in range(60) for f in range(1 if c % 3 else 40) for n in range(r.randint(1, 6))] + [(99, f, 0, 5.0 * f, 0.0, 1.0, 1.0) for f in range(400)]
    df = spark.createDataFrame(boxes, "clip long, frame long, det long, x double, y double, w double, h double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(x.clip, x.frame, x.det): x.track for x in sequences.tracked(df, "clip", 12.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, want = {}, {}
    for c, f, n, x, y, w, h in sorted(boxes):
        tracks = last.setdefault(c, [])
        a, b = x + w / 2, y + h / 2
        free = [((a - u) ** 2 + (b - v) ** 2, k) for k, (u, v, seen) in enumerate(tracks) if seen != f]
        d, k = min(free, default=(float("inf"), -1))
        k = k if d <= 144.0 else len(tracks)
        tracks[k:k + 1] = [(a, b, f)]
        want[c, f, n] = k
    assert got == want


def test_many_small_clips_at_once(spark):
    """A call for each clip takes minutes for these."""
    boxes = spark.range(800_000).selectExpr("id div 4 AS clip", "id % 2 AS frame", "id % 4 AS det", "cast(id % 2 AS double) AS x", "0D AS y", "1D AS w", "1D AS h", "rand(1) AS score")
    began = time.time()
    assert sequences.tracked(boxes, "clip", 0.5).count() == 800_000
    assert time.time() - began < 60
    began = time.time()
    assert sequences.box_suppression(boxes, "clip", 0.3).count() == 400_000
    assert time.time() - began < 60


SAID = [(0.0, 5.0, True), (6.0, 10.0, True), (11.0, 20.0, True), (30.0, 33.0, False)]
WORDS = [(float(k), k + 0.9) for k in (0, 1, 2, 3, 4, 6, 7, 8, 9, 11, 13, 15, 17, 19, 30, 32)]


@pytest.mark.parametrize("seed, least, most, want", [
    ((7.0, 9.0), 1.0, 60.0, (6.0, 10.0)),       # out to the sentence
    ((5.5, 10.5), 1.0, 60.0, (5.5, 10.0)),      # a start in a gap stays, an end in a gap goes back
    ((7.0, 9.0), 8.0, 60.0, (6.0, 20.0)),       # equal gaps: grown forward
    ((7.0, 9.0), 18.0, 60.0, (0.0, 20.0)),      # then back
    ((7.0, 9.0), 60.0, 60.0, (0.0, 20.0)),      # an unclosed run isn't taken
    ((1.0, 19.5), 1.0, 12.0, (0.0, 11.9)),      # a run-on is cut at a word's end
    ((40.0, 50.0), 1.0, 60.0, (40.0, 50.0)),    # all speech lies before
    ((5.2, 5.8), 1.0, 60.0, (5.2, 5.8)),        # no whole sentence inside
])
def test_bounds(seed, least, most, want):
    assert sentences.bounded(seed, SAID, WORDS, least, most) == want


def test_moment_bounds(spark):
    units = [(1, 0, "one", 0.0, 0.4), (1, 1, "two.", 0.5, 0.9), (1, 2, "three", 1.0, 1.4), (1, 3, "four.", 1.5, 1.9)]
    seeds = [(1, 7, 1.2, 1.6), (2, 8, 1.0, 2.0)]
    got = sentences.moment_bounds(spark.createDataFrame(seeds, "clip long, id long, start_s double, end_s double"), spark.createDataFrame(units, "clip long, idx long, text string, start_s double, end_s double"), "clip", 0.1, 9.0)
    assert sorted(tuple(x) for x in got.collect()) == [(1, 7, 1.0, 1.9), (2, 8, 1.0, 2.0)]


def test_captions_begin_with_their_sound(spark):
    loud = [0.0] * 5 + [0.5] * 45 + [0.0] * 100
    env = spark.createDataFrame([(1, k, v) for k, v in enumerate(loud)], "clip long, k long, v double")
    units = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.8), (1, 2, 1.6)], "clip long, idx long, start_s double")
    got = {x.idx: (round(x.start_s, 6), round(x.end_s, 6)) for x in captions.refined(units, env, "clip", 0.02).collect()}
    assert got == {0: (0.1, 0.8), 1: (0.8, 1.6)}  # the last one is silent
    assert captions.refined(units, env, "clip", 0.02, keep_silent=True).count() == 3


def test_laughs_cut_as_a_loop(spark):
    r = random.Random(6)
    units = [(c, k, float(a), float(a + r.randint(0, 6))) for c in range(4) for k, a in enumerate(r.choices(range(60), k=30))] + [(9, 0, 1.0, 5.0), (None, 0, 1.0, 5.0), (0, 99, None, 5.0), (0, 98, 4.0, None)]
    laughs = [(c, float(a), float(a + r.randint(0, 3))) for c in range(4) for a in r.choices(range(60), k=3 + 6 * c)] + [(None, 2.0, 3.0), (0, None, 9.0), (1, 30.0, None)]
    got = captions.laugh_trimmed(spark.createDataFrame(units, "clip long, idx long, start_s double, end_s double"), spark.createDataFrame(laughs, "clip long, from_s double, to_s double"), "clip").collect()
    want = {}
    for c, k, a, z in units:
        own = [x for x in laughs if c is not None and x[0] == c and x[1] is not None and a is not None]
        cuts = [f for _, f, _ in own if z is not None and a < f < z]
        inside = any(t is not None and f <= a < t for _, f, t in own)
        want[c, k] = z if inside or not cuts else min(max(a + 0.4, min(cuts)), z)
    assert {(x.clip, x.idx): x.end_s for x in got} == want and len(got) == len(units)


def test_laughs_never_meet_all_units(spark):
    # of these each unit has a laugh of its own: their pairs are 2.5 billion
    n = 50_000
    units = spark.range(n).selectExpr("1L AS clip", "id AS idx", "cast(id AS double) AS start_s", "id + 0.9D AS end_s")
    laughs = spark.range(n).selectExpr("1L AS clip", "id + 0.5D AS from_s", "id + 0.75D AS to_s")
    got = captions.laugh_trimmed(units, laughs, "clip")
    assert got.where("end_s = start_s + 0.5D").count() == n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_lenient_sources(spark, tmp_path):
    said = lambda ms: json.dumps({"replayChatItemAction": {"videoOffsetTimeMsec": ms, "actions": [{"addChatItemAction": {"item": {"liveChatTextMessageRenderer": {"id": "x"}}}}]}})
    banner = json.dumps({"replayChatItemAction": {"videoOffsetTimeMsec": "5", "actions": [{"addBanner": {}}]}})
    (tmp_path / "chat.json").write_text("\n".join([said("2500"), "", "junk", banner, said(1000), said("x")]))
    assert [x.t for x in stores.chat_offsets(spark, f"file://{tmp_path}/chat.json").collect()] == [1.0, 2.5]
    (tmp_path / "list.txt").write_text("Word\n# note\n\n word \nOther\n")
    assert sorted(x.word for x in stores.word_list(spark, f"file://{tmp_path}/list.txt").collect()) == ["other", "word"]
    (tmp_path / "store.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(x.a for x in stores.json_store(spark, f"file://{tmp_path}/store.json", "a long").collect()) == [1, 2]
    assert stores.json_store(spark, f"file://{tmp_path}/missing.json", "a long").count() == 0


def test_byte_windows(spark):
    index = spark.createDataFrame([(1, k, 100, 2.0) for k in range(5)], "stream long, idx long, byte_len long, dur double")
    one = lambda a, b: [tuple(x)[1:5] for x in stores.byte_windows(index, a, b).collect()]
    assert one(2.5, 5.0) == [(1, 2, 100, 300)] and one(0.0, 2.0) == [(0, 0, 0, 100)]
    assert one(10.0, 12.0) == [(4, 4, 400, 500)] and one(9.0, 99.0) == [(4, 4, 400, 500)] and one(10.5, 12.0) == []
