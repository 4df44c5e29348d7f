"""Queries that read every word of a text, against brute force on a small fixture."""

import re

import pytest

from tidemark.queries import QUERIES

TURNS = [(1, 0, "the quick (brown) fox"), (1, 1, "quikc  jumps over the quack"), (1, 2, None), (2, 0, "brwn foxes, jump"), (2, 1, ""), (2, 2, "unseen words at the end are unseen")]
ITEMS = [(5, "first the quick third brown"), (6, "jumps higher foxes")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(*x, "user") for x in TURNS], "conv_id long, turn int, text string, role string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def every():
    return [(c, t, k, w) for c, t, text in TURNS for k, w in enumerate((text or "").split())]


STORE = [(i * 100_000 + k, w) for i, text in ITEMS for k, w in enumerate(text.split())]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_harvest(spark, folder):
    best = {}
    for c, t, k, w in every():
        conf = (c * 7 + t * 13 + k * 29) % 100 / 100
        w = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        if conf < 0.5 and len(w) >= 4 and w.lower() not in {w for _, w in STORE}:
            best.setdefault((c, w.lower()), (conf, t * 100_000 + k))
    want = set()
    for clip in {c for c, _ in best}:
        own = sorted((conf, idx, w) for (c, w), (conf, idx) in best.items() if c == clip)
        want |= {(clip, w, conf, r) for r, (conf, _, w) in enumerate(own[:8], 1)}
    got = {tuple(x) for x in QUERIES["harvest_candidates"](spark, folder).collect()}
    assert got == want and len({w for _, w, *_ in got}) > 3


def test_fuzzy(spark, folder):
    known, want = {w for _, w in STORE}, set()
    for c, t, k, w in every():
        token = w.lower()
        fits = [(token != x, pos) for pos, x in STORE if token == x or (len(x) >= 4 and token not in known and one_edit(token, x))]
        if fits:
            want.add(((c * 1000 + t) * 100_000 + k, token, min(fits)[1], f"r{min(fits)[1]}"))
    got = [tuple(x) for x in QUERIES["fuzzy_store_join"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {"brwn", "quack", "foxes,"} <= {x[1] for x in got}


def test_cores(spark, folder):
    want = sorted((t, c, k, re.sub(r"^[^\w]+|[^\w]+$", "", w), re.sub(r"\W", "", w).lower()) for c, t, k, w in every())
    assert sorted(tuple(x) for x in QUERIES["text_cores"](spark, folder).collect()) == want


def test_captions_hold_every_word(spark, folder):
    lines = QUERIES["caption_line_groups"](spark, folder).orderBy("conv_id", "line").collect()
    for conv in (1, 2):
        assert " ".join(x["text"] for x in lines if x["conv_id"] == conv).split() == [w for c, _, _, w in every() if c == conv]
    assert all(x["start_s"] < x["end_s"] for x in lines)
