import numpy as np
import pytest

from tidemark.llm import hilbert_ann as H


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = H.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(ids, x, k=5):
    out = {}
    for i, q in zip(ids, x):
        if i % 50 == 0:
            s = H.cosine(q, x)
            out[i] = [(v, c) for c, v in sorted((-c, v) for c, v in zip(s, ids) if v != i)[:k]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    table = df.toPandas()
    want = brute(table["vec_id"].tolist(), np.stack(table["embedding"]).astype(float))
    got = {}
    for q, rank, v, s in H.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(q, []).append((v, -s))
        assert len(got[q]) == rank
    assert got.keys() == want.keys()
    found = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (None, [1.0, 0.0]), (100, []), (9, [1e200, 1e200])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, rank int")
    got = [(x.query_id, x["rank"], x.vec_id) for x in H.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (0, 4, 50), (50, 1, 9), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert H.search(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id long, embedding array<double>")
    assert [x.vec_id for x in H.search(same).where("query_id = 50").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_an_odd_dimension_with_the_smallest_id(spark):
    rows = [(-7, [1.0, 2.0, 3.0])] + [(k, [float(k + 1), 1.0]) for k in range(60)]
    got = {x.query_id for x in H.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0, 50}


def test_buckets_follow_the_vectors():
    sizes = [n / H.bucket_count(n) for n in (10**5, 10**6, 10**7, 10**9)]
    assert max(sizes) <= H.PER_BUCKET and H.bucket_count(10**9) == 50_000
