import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import near_dups as N
from tidemark.llm import packed as P
from tidemark.llm.components import roots

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size=4, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").translate(LOW).encode().split()
        sets.append((i, {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(s), least[top(k)], i == least[top(k)]) for k, (i, s) in enumerate(sets))


def made(seed, n=25, copies=14):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 300))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([3, 12, 80, 250]))]
        for _ in range(r.randint(1, copies)):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                own[r.randrange(len(own))] = word()
            rows.append((0, " ".join(own).upper() if r.random() < 0.1 else " ".join(own)))
            if r.random() < 0.2:
                base = own  # a chain of edits
    r.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "a b"), (3, rows[7][1]), (1006, "w " * 3000), (1007, "w w w w")]


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, root int")
    assert sorted(tuple(x) for x in N.classes(docs).collect()) == brute(rows)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, None)], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in N.classes(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted(str(x.doc_id) for x in N.one_of_each(docs).collect()) == ["1", "3", "None"]
    assert N.classes(docs.limit(0)).count() == 0


def thue_morse(n=1024):
    """Two different words that have one polynomial hash modulo 2**64, whatever the odd base."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_polynomial_hash_are_different(spark):
    x, y = thue_morse()
    rows = [(1, f"{x} {x} {x} {x} {x}"), (2, f"{y} {y} {y} {y} {y}"), (3, " ".join([x] * 9 + list("abcdefghijkl"))), (4, " ".join([y] * 9 + list("abcdefghijkl")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in N.classes(docs).collect()) == brute(rows)


def test_one_of_each_by_row_with_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near, other = text + " more", " ".join(f"v{k}" for k in range(30))
    rows = [(5, text), (5, other), (7, near), (7, other + " x y"), (9, near), (9, near), (11, "alone in its class today"), (11, "alone in its class today"), (12, ""), (12, ""), (None, text)]
    docs = spark.createDataFrame([(*r, k, k, k, k) for k, r in enumerate(rows)], "doc_id long, text string, _gone int, doc int, key int, gone int")
    got = N.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((str(x.doc_id), x.text) for x in got.collect()) == sorted([("5", text), ("5", other), ("11", "alone in its class today"), ("12", ""), ("12", ""), ("None", text)])


@pytest.mark.parametrize("n", [60, 240])
def test_a_group_that_grows(spark, n, monkeypatch):
    """Copies that share a bucket with texts just below the threshold."""
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(n)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in r.sample(range(60), r.choice([1, 2, 3, 4])):
            own[at] = f"x{r.randrange(5)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in N.classes(docs).collect()) == brute(rows)


def test_pruning_keeps_what_may_be_similar():
    least = N.keep_table(80, 1e-6)
    r = np.random.default_rng(1)
    left = r.integers(0, 1 << 32, (4000, N.HASHES), dtype=np.uint32)
    right = np.where(r.random(left.shape) < 0.8, left, left + 1)
    assert N.sequential(left, right, least)[0].mean() > 0.999
    far = np.where(r.random(left.shape) < 0.3, left, left + 1)
    assert N.sequential(left, far, least)[0].mean() < 0.001


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1050)]
    up = {}
    top = lambda k: k if up.get(k, k) == k else top(up[k])
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {x.node: x.root for x in roots(spark.createDataFrame(pd.DataFrame(edges, columns=["u", "v"])), P.Scratch(spark)).collect()}
    nodes = {n for a, b in edges for n in (a, b)}
    assert {n: got.get(n, n) for n in nodes} == {n: top(n) for n in nodes}
