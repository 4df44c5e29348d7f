import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_near_dups import thue_morse
from tidemark.llm import brown_lm as B
from tidemark.llm import packed as P

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return [*(t or "").translate(LOW).encode().split(), None]


def brute(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = split(t)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out


def test_base_as_brute_force_and_a_better_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()])
    got = B.score(docs).collect()
    assert len(got) == len(want)
    ours = base = 0
    for x in got:
        held, n, known, total, score = want[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, total)
        assert x.base_score == pytest.approx(score, rel=1e-9) and x.score < 0
        if held:
            ours, base = ours + x.score, base + x.base_score
    assert ours > base


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "A b a", 0), (3, "A b a", 0), (None, "x", 0)], "doc_id long, text string, n int")
    got = sorted((x.doc_id, x.n_tokens, x.n_known) for x in B.score(docs).collect())
    assert [g[:2] for g in got] == [(1, 1), (2, 1), (3, 4), (3, 4)]
    assert B.score(docs.limit(0)).count() == 0


def likelihood(m, label):
    k = label.max() + 1
    one = np.eye(k)[label]
    cells = one.T @ m @ one
    return B._xlogx(cells).sum() - B._xlogx(cells.sum(0)).sum() - B._xlogx(cells.sum(1)).sum()


def test_exchange_reaches_a_local_best():
    r = np.random.default_rng(1)
    kind = r.integers(0, 3, 20)
    p = np.array([[1, 8, 1], [1, 1, 8], [8, 1, 1]])
    m = r.poisson(p[kind][:, kind]).astype(float)
    label = B.exchange(m, 20, 3, np.empty(0, int))
    best = likelihood(m, label)
    for w in range(20):
        for c in range(3):
            other = label.copy()
            other[w] = c
            if len(set(other)) == 3:
                assert likelihood(m, other) <= best + 1e-6


def test_words_of_a_context_sum_to_one():
    r = np.random.default_rng(2)
    classes, size = 5, 5 + B.SHAPES + 1
    counts = [r.integers(2, 50, 6) for _ in range(classes)]
    cells = r.poisson(1, (size, size)).astype(float)
    # as many tokens of a class as its words have
    cells[0, :classes] += [c.sum() for c in counts] - cells.sum(0)[:classes]
    sums = np.array([r.integers(50, 100, B.SHAPES + 1), np.full(B.SHAPES + 1, 10), np.full(B.SHAPES + 1, 5), np.full(B.SHAPES + 1, 3)])
    model, (once, unseen) = B.Model(cells, classes), B.rare_words(sums)
    inside = np.array([(c / 10 ** model.size[k]).sum() for k, c in enumerate(counts)] + [5 * 10**a + 10**b for a, b in zip(once, unseen)] + [1])
    for c in range(size):
        assert (10**model.step[c] * inside).sum() == pytest.approx(1)


def test_other_words_go_where_the_likelihood_is_greatest():
    r = np.random.default_rng(6)
    classes, size = 4, 9
    cells = r.poisson(20, (size, size)).astype(float)
    before, after = (r.poisson(0.8, (30, size)) * r.choice([1, 1, 30], (30, 1)) for _ in range(2))
    after[:, 0] += np.maximum(0, before.sum(1) - after.sum(1))
    before[:, 0] += np.maximum(0, after.sum(1) - before.sum(1))
    word, column = np.nonzero(np.column_stack([before, after]))
    got = B._gained(cells, classes, word, column, np.column_stack([before, after])[word, column], 30)

    def value(m):
        return B._xlogx(m).sum() - B._xlogx(m.sum(0)).sum() - B._xlogx(m.sum(1)).sum()

    for w in range(30):
        all_ = []
        for c in range(classes):
            m = cells.copy()
            m[:, c] += before[w]
            m[c] += after[w]
            all_.append(value(m))
        assert all_[got[w]] == pytest.approx(max(all_), abs=1e-6)


def test_exchange_goes_on_until_no_word_moves():
    r = np.random.default_rng(5)
    kind = r.integers(0, 8, 100)
    p = r.gamma(0.3, 1, (8, 8))
    m = r.poisson(p[kind][:, kind] * 0.3).astype(float)
    label = B.exchange(m, 100, 8, np.empty(0, int))
    best = likelihood(m, label)
    for w in range(100):
        for c in range(8):
            other = label.copy()
            other[w] = c
            if len(set(other)) == 8:
                assert likelihood(m, other) <= best + 1e-6


def test_words_of_equal_polynomial_hash_are_different(spark):
    x, y = thue_morse()
    rows = [(k, f"{x} a {y if k % 3 else x}") for k in range(1, 25)]
    want = brute(rows)
    for r in B.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        held, n, known, total, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(score, rel=1e-9)


def test_pairs_that_share_a_half():
    low, high = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 9, 2, 1, 9], np.uint64)
    a, b, first, number = P.distinct(low, high)
    assert a.tolist() == [3, 5, 5] and b.tolist() == [9, 1, 2] and number.tolist() == [1, 0, 2, 1, 0] and first.tolist() == [1, 0, 2]
