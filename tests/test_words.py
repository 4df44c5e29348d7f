"""Word error counts against a plain recursion."""

from functools import lru_cache

from tidemark.operators import words


def least_edits(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j - 1) + (a[i - 1] != b[j - 1]), d(i - 1, j) + 1, d(i, j - 1) + 1)

    return d(len(a), len(b))


def test_error_counts(spark):
    rows = [(1, "a b c", "a x c d"), (2, "", "q"), (3, None, None), (4, "a a b", ""), (5, "b a n a", "a n a s")]
    got = {r.id: r for r in words.error_counts(spark.createDataFrame(rows, "id long, want string, got string")).collect()}
    for k, want, heard in rows:
        a, b = (want or "").split(), (heard or "").split()
        r = got[k]
        assert r["sub"] + r["del"] + r["ins"] == least_edits(tuple(a), tuple(b))
        assert r["ok"] + r["sub"] + r["del"] == len(a) and r["ok"] + r["sub"] + r["ins"] == len(b)
    assert got[1]["wer"] == 2 / 3 and got[2]["wer"] == 1.0 and got[3]["wer"] == 0.0
