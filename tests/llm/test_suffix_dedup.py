import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import packed as P
from tidemark.llm import suffix_dedup as S


def brute(rows, length=50):
    """The contract, string by string."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    shared = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(5)]
    rows = [(100, None), (101, ""), (102, "x" * 400), (103, "ab" * 300), (104, "x" * 49), (105, "x" * 50)]
    for i in range(n):
        text = " ".join(word() for _ in range(r.randint(1, 80)))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(text))
            text = text[:at] + r.choice(shared) + text[at:]
        rows.append((i, text))
    rows += [(200 + i, rows[6 + i][1]) for i in range(8)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, block string, kept string")
    got = sorted(tuple(x) for x in S.dedup(docs, keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute(rows)


def test_repeated_ids_nulls_and_empty(spark):
    text = "the same sentence in every row, long enough to be found by its bytes"
    rows = [(1, text), (1, text), (2, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed) for x in S.dedup(docs).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    assert S.dedup(docs.limit(0)).count() == 0


def test_loser_tree_merges_and_counts_shared_prefixes():
    r = random.Random(3)
    rows = [bytes(r.choice(b"ab") for _ in range(8)) for _ in range(200)]
    runs = []
    for k in range(5):
        own = sorted(rows[k::5])
        lcp, rest = S.front_code(np.frombuffer(b"".join(own), np.uint8).reshape(-1, 8))
        runs.append((lcp.tobytes(), rest, own))
    at, last, out = [0] * 5, b"", []
    for run, shared in S.loser_tree([r[:2] for r in runs], 8):
        s = runs[run][2][at[run]]
        at[run] += 1
        same = next((i for i, (a, b) in enumerate(zip(last, s)) if a != b), 8 if last else 0)
        assert shared == same
        last = s
        out.append(s)
    assert out == sorted(rows)


def test_packed_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (P.unpack_sorted(P.pack_sorted(keys)) == keys).all()
    assert P.unpack_sorted(P.pack_sorted(keys[:1])).tolist() == keys[:1].tolist()
    assert (P.sliding_min(keys[::-1], 7) == [keys[::-1][i:i + 7].min() for i in range(994)]).all()


def test_equal_strings_mark_equal_places_in_slices_of_any_size():
    r = np.random.default_rng(5)
    string = r.integers(97, 123, 400).astype(np.uint8)
    near = S.marks(string, np.array([0, 400]))
    long = np.concatenate([r.integers(97, 123, 600_000).astype(np.uint8), string])
    far = S.marks(long, np.array([0, 600_000, 600_400]))
    assert (far[0][far[2] == 1] - 600_000).tolist() == near[0].tolist()


def test_extreme_and_outlying_ids(spark):
    text = "the same sentence in every row, long enough to be found by its bytes"
    rows = [(k, f"{k} {text}") for k in (-9 * 10**18, -5, 0, 7, 10**15, 9 * 10**18)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_blocks_hold_about_the_same_bytes(spark):
    r = random.Random(2)
    rows = [(k, "x" * r.randint(1, 200)) for k in range(4000)] + [(10**15, "one"), (-10**17, "two")]
    docs, n = P.with_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 20)
    sizes = {}
    for x in docs.collect():
        sizes[x.block] = sizes.get(x.block, 0) + int(np.frombuffer(x.sizes, "<u4").sum())
    assert 15 <= len(sizes) <= n and max(sizes.values()) <= 2 * sum(sizes.values()) / len(sizes)


def test_without_repeats_by_row_with_clashing_columns(spark):
    repeat = "a passage that stands in several documents, and is long enough"
    rows = [(1, f"{repeat} first"), (5, f"XX {repeat} tail of the first"), (5, "quite another text"), (5, "quite another text"), (6, None), (None, f"{repeat} again")]
    docs = spark.createDataFrame([(*r, k, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, _kept int, kept string, of int")
    got = S.without_repeats(docs)
    assert got.columns == docs.columns
    texts = [(1, f"{repeat} first"), (5, "XX tail of the first"), (5, "quite another text"), (5, "quite another text"), (6, None), (None, f"{repeat} again")]
    want = sorted(str((i, t, k)) for k, (i, t) in enumerate(texts))
    # the repeat goes with the blank after it, which both texts have
    assert sorted(str((x.doc_id, x.text, x._kept)) for x in got.collect()) == want
