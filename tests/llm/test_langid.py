import numpy as np

from tidemark.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_features_of_a_text_alone_and_among_others():
    texts = ["Él corre\n".encode(), b"", "123 abc!! Déf".encode(), "ñ".encode()]
    grams, begins, letters = L.features(texts)
    ends = [*begins[1:], len(grams)]
    for t, a, b, n in zip(texts, begins, ends, letters):
        own, _, m = L.features([t])
        assert m[0] == n and len(own) == b - a
        assert (own == grams[a:b]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = L.accuracy(docs)
    assert len(found) == 4 and (found["accuracy"] * found["n"]).sum() / found["n"].sum() > 0.97


def test_naive_bayes_as_by_hand():
    texts = [b"aba", b"bcb b"]
    counts = {}
    for lang, t in zip("xy", texts):
        n = np.full(L.BUCKETS, L.ALPHA)
        np.add.at(n, L.features([t])[0].ravel(), 1)
        counts[lang] = np.log(n / n.sum())
    prior = np.log([0.25, 0.75])
    model = L.Model(["x", "y"], prior, np.array([counts["x"], counts["y"]], np.float32))
    names, scores = model.predict([b"aba", b"bcb b", b"!!", b""])
    assert names == ["x", "y", "und", "und"] and scores[2:].tolist() == [0, 0]
    for t, s in zip(texts, scores):
        sums = [p + counts[k][L.features([t])[0].ravel()].sum() for p, k in zip(prior, "xy")]
        assert abs(s - 1 / np.exp(np.array(sums) - max(sums)).sum()) < 1e-5


def test_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 1), (3, "the house", "en", 1), (None, "la casa", "es", 1), (4, "la casa", "es", 1), (5, "!!1", "en", 1)], "doc_id long, text string, lang string, score int")
    got = {x.doc_id: x.lang_pred for x in L.identify(docs).collect()}
    assert got[1] == got[2] == got[5] == "und" and len(got) == 6
    assert L.identify(docs.limit(0)).count() == 0
    docs = docs.withColumns({c: docs.score for c in ("_found", "_sure", "found", "sure")})
    kept = L.in_known_language(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} <= {3, 4, None}
