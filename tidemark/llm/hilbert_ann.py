"""Approximate nearest neighbours on shifted space-filling curves.

Unit vectors are projected on random orthogonal axes, shifted, and put in the
order of a Hilbert curve through DIMS axes of 2**BITS cells (cells are
quantiles of a bounded sample).  There are several such curves; on each, Spark
range-partitions all vectors into buckets of neighbouring keys.  A query looks
at the buckets around its own on each curve, and what it finds there is merged
and ranked again by the exact cosine in double precision.

How many buckets it looks at is fitted: a bounded sample of queries is compared
with all rows in blocks, and the width is the least one that holds `recall` of
their true neighbours.  Vectors without structure need wide windows; then the
search comes near a scan of all rows.  A vector that fills several buckets is
dealt over all of them.

The number of buckets follows the number of vectors, so that a bucket stays as
large as it is.

Vectors that are null, zero, of another dimension than most (of equally
frequent ones the least counts), or hold null or non-finite components take no part, nor do rows without vec_id.  Of rows
that repeat a vec_id the ones with the least components count once.  Ties go to
the smaller vec_id.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P
from tidemark.llm import ranges as R

DIMS, BITS, CURVES = 8, 8, 4
#: Vectors that the cells are fitted on, and queries that the width is fitted on, at most.
SAMPLE, TRIALS = 10_000, 256
#: Buckets of a curve at least, vectors in a bucket beyond that, and vectors of the sample to a bucket.
BUCKETS, PER_BUCKET, PER_CUT = 64, 20_000, 8


def bucket_count(vectors: int) -> int:
    """Buckets of each curve for so many vectors."""
    return min(max(BUCKETS, -(-vectors // PER_BUCKET)), max(1, vectors // 8))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of integer points [n, dims] on the Hilbert curve (Skilling's transform), as uint64."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    m = one << np.uint64(bits - 1)
    q = m
    while q > 1:
        p = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = m
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in reversed(range(bits)):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Curves:
    """Axes, cell bounds and bucket bounds of each curve."""

    def __init__(self, sample: np.ndarray, buckets: int, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        d = sample.shape[1]
        self.dims = min(DIMS, d)
        self.axes, self.cells, self.cuts = [], [], []
        for _ in range(CURVES):
            axes = np.linalg.qr(r.normal(size=(d, self.dims)))[0]
            steps = np.linspace(0, 1, (1 << BITS) + 1)[1:-1]
            shift = r.uniform(-0.5, 0.5) / (1 << BITS)
            cells = np.quantile(sample @ axes, np.clip(steps + shift, 0, 1), axis=0)
            self.axes.append(axes)
            self.cells.append(cells)
            self.cuts.append([])
            keys = self.keys(sample, len(self.axes) - 1)
            self.cuts[-1] = R.bounds(keys.tolist(), buckets)

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        y = unit @ self.axes[curve]
        cells = np.column_stack([np.searchsorted(self.cells[curve][:, j], y[:, j], "right") for j in range(self.dims)])
        return hilbert(cells)

    def reach(self, unit: np.ndarray, curve: int) -> np.ndarray:
        """First and last bucket of each vector."""
        cuts, keys = np.array(self.cuts[curve], np.uint64), self.keys(unit, curve)
        low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
        return np.column_stack([np.where(high - low <= 1, high, low + 1), high])


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first: squares of very large or small components would overflow or vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, each from its own components alone, so that equal rows have equal scores."""
    a = q / np.abs(q).max()
    b = v / np.abs(v).max(1, keepdims=True)
    return (b * a).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of doubles) of the vectors that take part."""
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(x, c -> c <> 0)")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("x") == (sizes[0].d if sizes else 0))


def _best(qx, vx, vid, unit_q, unit_v, qid, k):
    """(query, vec_id, score) of the k nearest of each query among rows v."""
    near = unit_q @ unit_v.T
    for i in range(len(qid)):
        s = near[i]
        own = np.flatnonzero(vid != qid[i])
        if not len(own):
            continue
        s = s[own]
        least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -2
        take = own[s >= least - 1e-9]
        exact = cosine(qx[i], vx[take])
        order = np.lexsort((vid[take], -exact))[:k]
        for j in order:
            yield qid[i], int(vid[take[j]]), float(exact[j])


def _pairs(found) -> pa.Table:
    cols = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def exact(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """The k nearest rows of a few given queries, by a scan in blocks."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches):
        qid, qx = shared.value
        for b in batches:
            if b.num_rows and len(qid):
                v = _matrix(b.column("x"))
                yield from _pairs(_best(qx, v, b.column("vec_id").to_numpy(), _unit(qx), _unit(v), qid.tolist(), k)).to_batches()

    return _rank(rows.mapInArrow(run, "query_id long, vec_id long, score double"), k)


def search(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, recall: float = 0.97, buckets: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each query row."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = valid(vectors)
    rows = P.stored(rows.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = lambda most, total, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most * 0.9 / max(1, total)))
    buckets = buckets or bucket_count(n)
    most = max(SAMPLE, PER_CUT * buckets)
    sample = rows.where(some(most, n, 1)).orderBy("vec_id").limit(most).toArrow()
    if not sample.num_rows:
        sample = rows.orderBy("vec_id").limit(most).toArrow()
    curves = Curves(_unit(_matrix(sample.column("x"))), buckets)
    last = len(curves.cuts[0])
    queries = rows.where(is_query)
    # the width: how far on the nearest curve the true neighbours of some queries are
    trial = queries.where(some(TRIALS, queries.count(), 2)).orderBy("vec_id").limit(TRIALS).toArrow()
    if not trial.num_rows:
        trial = queries.orderBy("vec_id").limit(TRIALS).toArrow()
    if not trial.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids, x = trial.column("vec_id").to_numpy(), _matrix(trial.column("x"))
    true = exact(rows, ids, x, k).join(rows, "vec_id").select("query_id", "x").toArrow()
    width = 0
    if true.num_rows:
        at = np.searchsorted(ids, true.column("query_id").to_numpy())
        u, v = _unit(x)[at], _unit(_matrix(true.column("x")))
        away = np.full(len(at), last)
        for c in range(CURVES):
            a, b = curves.reach(u, c), curves.reach(v, c)
            away = np.minimum(away, np.maximum(0, np.maximum(a[:, 0] - b[:, 1], b[:, 0] - a[:, 1])))
        width = int(np.quantile(away, min(1.0, recall + 0.01), method="higher"))
    shared = spark.sparkContext.broadcast((curves, width))

    def deal(query: bool):
        def run(batches):
            own, w = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                unit, ids = _unit(_matrix(b.column("x"))), b.column("vec_id").to_numpy()
                for c in range(CURVES):
                    reach = own.reach(unit, c)
                    if query:
                        low, high = np.maximum(0, reach[:, 0] - w), np.minimum(last, reach[:, 1] + w)
                        row = np.repeat(np.arange(len(ids)), high - low + 1)
                        to = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
                    else:
                        row = np.arange(len(ids))
                        to = reach[:, 0] + (P.mix(ids.astype(np.uint64)) % (reach[:, 1] - reach[:, 0] + 1).astype(np.uint64)).astype(np.int64)
                    taken = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), c), pa.int32()), pa.array(to, pa.int64()), b.column("vec_id").take(taken), b.column("x").take(taken)], names=["curve", "bucket", "vec_id", "x"])

        return run

    dealt = "curve int, bucket long, vec_id long, x array<double>"
    left, right = queries.mapInArrow(deal(True), dealt), rows.mapInArrow(deal(False), dealt)

    def rerank(key, q, v):
        if not q.num_rows or not v.num_rows:
            return _pairs([])
        qx, vx = _matrix(q.column("x")), _matrix(v.column("x"))
        unit_v, vid, qid = _unit(vx), v.column("vec_id").to_numpy(), q.column("vec_id").to_pylist()
        found = []
        for a in range(0, len(qid), 256):
            found += _best(qx[a:a + 256], vx, vid, _unit(qx[a:a + 256]), unit_v, qid[a:a + 256], k)
        return _pairs(found)

    found = left.groupBy("curve", "bucket").cogroup(right.groupBy("curve", "bucket")).applyInArrow(rerank, schema)
    return _rank(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
