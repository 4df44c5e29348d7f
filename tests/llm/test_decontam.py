import hashlib
import random
import re

import pytest

from tidemark.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(D._UPPER, D._LOWER)


def split(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for s in {len(x) for x in windows}:
            for k in range(len(w) - s + 1):
                if (x := tuple(w[k:k + s])) in windows:
                    hit.update(range(k, k + s))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(15)] + ["É", "Aé", "x1", "the", "The"]
    text = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, "!!"), (0, "again the same item id"), (60, "the the the the the the the the the the the")]
    docs = [(i, text(r.randint(0, 60)) + " " + " ".join(split(r.choice(items)[1])[:r.choice([8, 10, 40])])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "the " * 30), (5, docs[5][1]), (6, "another text")]
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, items string, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(x) for x in D.digest(D.decontaminate(d, b)).collect()) == brute(docs, items)


def test_nulls_and_empty(spark):
    d = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "item_id long, text string")
    assert [tuple(x) for x in D.digest(D.decontaminate(d, b)).select("doc_id", "n_hit", "n_items").collect()] == [(1, 3, 1)]
    assert D.decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    assert D.decontaminate(d.limit(0), b).count() == 0
    assert [x.doc_id for x in D.clean(d, b).collect()] == [None]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha x x x x x beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = D.keyed(d)
    lookup = D.rare_terms(D.windows(b), docs)
    near = D.near_matches(D.index(docs, lookup.select("term").distinct()), lookup, 2)
    got = {x.doc_id for x in near.join(docs, "doc_key").collect()}
    assert got == {1, 2}


def test_clean_by_row_with_clashing_columns(spark):
    rows = [(1, "a b c"), (1, "quite another text"), (2, "x"), (2, "x"), (3, None), (4, "say a b c now")]
    d = spark.createDataFrame([(*r, k, k, k, k) for k, r in enumerate(rows)], "doc_id long, text string, _bad int, own int, at int, of int")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = D.clean(d, b)
    assert got.columns == d.columns and sorted(x._bad for x in got.collect()) == [1, 2, 3, 4]
