"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a batch of documents are made in numpy from their bytes.  Trees
grow level by level from histograms of gradients over quantile bins and are
flattened into arrays (feature, threshold and value of each node of a complete
binary tree), so that scoring is a vectorised walk: a step per level, not a
call per node.

The model is fitted on at most `bound` labelled rows, however often a doc_id
repeats in either table, chosen by a hash of doc_id; scoring covers every row and the whole of each text.  The flattened
model has a fixed size and is broadcast.

Null and empty texts have all statistics 0 and get a score like others.  Rows
with null quality teach nothing.  Without labels of both kinds the score is the
share of label 1 (0.5 without any).  Rows that repeat a doc_id each get a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P
from tidemark.llm.langid import held_out

#: Labelled rows that a fit takes at most.
BOUND = 20_000
_KINDS = 11
_CLASS = np.full(256, 10, np.uint8)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 13), (10,), range(128, 256), b"!?", b".,;:", b"|", b"#$%&*@~^=+<>{}[]\\/_`")):
    _CLASS[list(_set)] = _k
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document."""
    both = np.unique(P.mix(keys) ^ P.mix(doc.astype(np.uint64)), return_index=True)[1]
    return np.bincount(doc[both], minlength=n)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[documents, statistics] as float32."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * _KINDS + _CLASS[buf], minlength=n * _KINDS).reshape(n, _KINDS)
    bytes_ = np.maximum(1, size)
    starts, ends, words, _, begins = P.words_of(buf, offsets)
    w = np.diff(begins)
    word_doc, some = np.repeat(np.arange(n), w), np.maximum(1, w)
    lengths = (ends - starts).astype(float)
    mean = _per_doc(lengths, word_doc, n) / some
    spread = np.sqrt(np.maximum(0, _per_doc(lengths**2, word_doc, n) / some - mean**2))
    capital = _per_doc((_CLASS[buf[starts]] == 1).astype(float), word_doc, n) / some
    last = _CLASS[buf[ends - 1]] if len(ends) else np.empty(0, np.uint8)
    tails = [_per_doc((last == k).astype(float), word_doc, n) / some for k in (6, 7, 9)]
    same = _distinct(words, word_doc, n) / some
    trigram = P.word_grams(words, 3)
    inside = word_doc[:len(trigram)] == word_doc[2:] if len(trigram) else np.empty(0, bool)
    tri_doc = word_doc[:len(trigram)][inside]
    tri = _distinct(trigram[inside], tri_doc, n) / np.maximum(1, np.bincount(tri_doc, minlength=n))
    line_start, line_end, lines, _, line_begins = P.words_of(buf, offsets, _LINE)
    l_n = np.diff(line_begins)
    line_doc = np.repeat(np.arange(n), l_n)
    line_same = _distinct(lines, line_doc, n) / np.maximum(1, l_n)
    line_mean = _per_doc((line_end - line_start).astype(float), line_doc, n) / np.maximum(1, l_n)
    columns = [np.log1p(size), np.log1p(w), np.log1p(l_n), mean, spread, capital, *tails, same, tri, line_same, np.log1p(line_mean), _per_doc((lengths <= 3).astype(float), word_doc, n) / some, _per_doc((lengths >= 20).astype(float), word_doc, n) / some]
    return np.column_stack([*columns, *(kinds / bytes_[:, None]).T, kinds[:, 1] / np.maximum(1, kinds[:, 0] + kinds[:, 1])]).astype(np.float32)


def batch_statistics(column: pa.Array) -> np.ndarray:
    buf, offsets = P.utf8(column)
    out = [statistics(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in P.slices(offsets)]
    return np.concatenate(out) if out else np.empty((0, 27), np.float32)


class Trees:
    """Flattened trees: row t of each array is a tree, node i has the children 2i+1 and 2i+2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, depth: int) -> None:
        self.base, self.feature, self.threshold, self.value, self.depth = base, feature, threshold, value, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(f))]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosting with the logistic loss."""
    share = y.mean() if len(y) else 0.5
    inner = (1 << depth) - 1
    share = min(max(share, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    n, m = binned.shape
    margin = np.full(n, base)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = node - first
            gains = np.zeros((wide, m, bins))
            for j in range(m):
                where = at * bins + binned[:, j]
                gl, hl, cl = (np.cumsum(np.bincount(where, v, wide * bins).reshape(wide, bins), 1) for v in (g, h, None))
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gains[:, j] = np.where((cl >= least) & (ct - cl >= least), gain, 0)
            best = gains.reshape(wide, -1).argmax(1)
            for k in range(wide):
                j, b = divmod(int(best[k]), bins)
                if gains[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        all_f.append(feature)
        all_t.append(cut)
        all_v.append(value)
    return Trees(base, np.array(all_f), np.array(all_t), np.array(all_v), depth)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Trees:
    """docs: doc_id, text; labels: doc_id, quality.  At most `bound` labels are broadcast, and at most `bound` rows of statistics reach the driver."""
    # a doc_id has two different labels at most; the rows of the least hashes are the sample
    named = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            x = batch_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(run, "doc_id long, quality int, x array<float>").orderBy(F.xxhash64("doc_id", "x"), "doc_id", "quality", "x").limit(bound).toPandas()
    x = np.array(found["x"].tolist(), np.float32) if len(found) else np.zeros((0, 27), np.float32)
    return fit_trees(x, found["quality"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, bound: int = BOUND, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of rows held out aren't learned."""
    model = fit(docs, labels.where(~held_out(0, 5)), bound)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(batch_statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
