import numpy as np
import pyarrow as pa

from tidemark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = Q.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(found["score"].to_numpy(), found["quality"].to_numpy()) > 0.9
    assert ((found["score"] >= 0.3).astype(int) == found["predicted"]).all()


def test_walk_is_that_of_nodes():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = Q.fit_trees(x, y, trees=20, depth=3)
    assert ((t.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        m = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            m += v[node - len(f)]
        assert abs(m - t.margin(row[None])[0]) < 1e-9


def test_statistics_alone_and_among_others():
    texts = ["One two two.\nOne two two.", None, "", "ABC!! x|y 12%", "é" * 30]
    whole = Q.batch_statistics(pa.array(texts))
    for t, row in zip(texts, whole):
        assert np.allclose(Q.batch_statistics(pa.array([t], pa.string()))[0], row)
    assert not whole[1].any() and not whole[2].any()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    none = spark.createDataFrame([(7, None, "x")], "doc_id long, quality int, text string")
    got = Q.score(docs, none).collect()
    assert len(got) == 4 and {x.score for x in got} == {0.5}
    assert Q.score(docs.limit(0), none).count() == 0


def test_the_bound_holds_at_the_driver(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit_trees", lambda x, y: seen.append(len(x)) or Q.Trees(0.0, np.zeros((0, 15), np.int64), np.zeros((0, 15), np.float32), np.zeros((0, 16)), 4))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(k, "other") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(k, k % 2) for k in range(2, 60)], "doc_id long, quality int")
    Q.fit(docs, labels, bound=10)
    Q.fit(docs.where("doc_id = 1"), labels, bound=1000)
    assert seen[0] <= 10 and seen[1] == 300


def slow_boost(x, y, trees, depth, rate, bins, ridge, least):
    """The same trees, grown node by node and split by split."""
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows, level):
            best = (1e-6, None)
            if level < depth:
                for j, own in enumerate(cuts):
                    for c in own:
                        left = x[rows, j] <= c
                        if left.sum() >= least and (~left).sum() >= least:
                            a, b = rows[left], rows[~left]
                            gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + ridge) for s, r in ((1, a), (1, b), (-1, rows)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (a, b))
            if best[1] is None:
                step[rows] = -rate * g[rows].sum() / (h[rows].sum() + ridge)
            else:
                for r in best[1]:
                    grow(r, level + 1)

        grow(np.arange(len(y)), 0)
        margin += step
    return margin


def test_boosting_as_brute_force():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 3)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=300) * 0.3 > 0).astype(float)
    fast = Q.fit_trees(x, y, trees=6, depth=3, bins=8)
    assert np.allclose(fast.margin(x), slow_boost(x, y, 6, 3, 0.1, 8, 1.0, 10))
