"""Language ID: multinomial naive Bayes over hashed character n-grams.

Prediction is the language of the greatest posterior: the share of a language
among the training documents times the probabilities of the text's n-grams; the
score is that posterior.

Training counts the 1-, 2- and 3-grams of lower-cased letters (any other run of
characters is one blank) in hash buckets.  The matrix of log-probabilities has
BUCKETS rows and a column for each language; it is broadcast, and its size is
bounded by BUCKETS * languages * 4 bytes.  A batch of texts is scored in numpy:
each document is the sparse row of its n-grams, summed over the matrix.

The model is fitted on at most `bound` labelled rows, chosen by a hash of
doc_id; prediction covers every row and the whole of each text.

MOST_LANGS languages can be told apart at most: a table with more is an error.

Null text and text without a letter give `und` with score 0.  Rows with null
lang teach nothing.  Rows without doc_id get a prediction like others and don't
teach.  An empty table, or one with no labelled row, gives `und` throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Rows that a fit takes, about, and languages that it can have, at most.
BOUND, MOST_LANGS = 20_000, 1000

_TABLE: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: 0 if it isn't a letter, else that of its lower case."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low[0])
        _TABLE = t
    return _TABLE


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram of some texts, the first n-gram of each text, and its number of letters."""
    joined = b"\n".join(texts) + b"\n"
    # every text ends with a blank; n-grams that begin near it go on with blanks, not with the next text
    code = _letters()[np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)]
    chars = np.fromiter((len(x.decode("utf-8")) + 1 for x in texts), np.int64, len(texts))
    ends = np.cumsum(chars)
    letters = np.diff(np.r_[0, np.cumsum(code > 0)[ends - 1]])
    keep = np.r_[code[:1] > 0, (code[1:] > 0) | (code[:-1] > 0)]
    keep[ends - 1] = True
    where = np.cumsum(keep)
    code = code[keep].astype(np.uint64)
    ends = where[ends - 1]
    begins = np.r_[0, ends[:-1]]
    out = np.zeros((len(code), len(ORDERS)), np.uint32)
    h = np.zeros(len(code), np.uint64)
    for k in range(max(ORDERS)):
        shifted = np.zeros(len(code), np.uint64)
        shifted[:len(code) - k] = code[k:]
        for back in range(1, k + 1):
            shifted[np.maximum(ends - back, 0)] = 0
        h = h * P.U64(0x9E3779B97F4A7C15) + shifted + P.U64(k + 1)
        if k + 1 in ORDERS:
            out[:, ORDERS.index(k + 1)] = (P.mix(h) >> P.U64(48)).astype(np.uint32) & np.uint32(BUCKETS - 1)
    return out, begins, letters


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pa.array(batch.column("text")).cast(pa.binary()).fill_null(b"").to_pylist()


def _chunks(texts: list[bytes]):
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size > P.SLICE_BYTES:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _count(batches):
    """Partial counts of a partition: lang, bucket, n."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = _texts(batch)
        for a, b in _chunks(texts):
            grams, begins, _ = features(texts[a:b])
            sizes = np.diff(np.r_[begins, len(grams)])
            names, codes = np.unique(np.array(langs[a:b], object), return_inverse=True)
            code = np.repeat(codes, sizes)
            both = np.bincount((code[:, None] * BUCKETS + grams).ravel(), minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for k, name in enumerate(names):
                counts[name] = counts.get(name, 0) + both[k]
    for name, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


class Model:
    """Languages, their log-priors, and float32 log-probabilities [languages, BUCKETS]."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray) -> None:
        self.langs, self.prior, self.logp = langs, prior, logp

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for a, b in _chunks(texts):
            grams, begins, letters = features(texts[a:b])
            if not self.langs:
                names += ["und"] * (b - a)
                continue
            total = np.tile(self.prior, (b - a, 1))
            for k in range(len(ORDERS)):
                for j in range(len(self.langs)):
                    total[:, j] += np.add.reduceat(self.logp[j][grams[:, k]], begins, dtype=np.float64)
            best = total.argmax(1)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            names += [self.langs[i] if n else "und" for i, n in zip(best, letters, strict=True)]
            scores[a:b] = np.where(letters > 0, p, 0)
        return names, scores


def sampled(rows: DataFrame, bound: int) -> DataFrame:
    """About 0.95 * `bound` rows if there are more, chosen by a hash of the row: the same ones at any partitioning.

    Only rows that are equal in all columns are chosen or left together; what
    is gathered from the rows has to be bounded by itself."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < int((1 << 30) * bound * 0.95 / n))


def fit(labelled: DataFrame, bound: int = BOUND) -> Model:
    """labelled: doc_id, text, lang.  Counts are summed in Spark; BUCKETS counts a language reach the driver."""
    rows = sampled(labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang"), bound)
    share = {x.lang: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(share) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(share)
    prior = np.log([share[x] / sum(share.values()) for x in langs])
    logp = np.empty((len(langs), BUCKETS), np.float32)
    for k, name in enumerate(langs):
        own = sums[sums["lang"] == name]
        n = np.full(BUCKETS, ALPHA)
        n[own["bucket"].to_numpy()] += own["n"].to_numpy()
        logp[k] = np.log(n / n.sum())
    return Model(langs, prior, logp)


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, and the language and its score under `names`."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.logp))
    kept = list(keep)

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            found, scores = own.predict(_texts(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def held_out(remainder: int, mod: int) -> Column:
    """Whether crc32 of doc_id as text leaves that remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == remainder, F.lit(False))


def identify(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows held out teach nothing."""
    model = fit(docs.where(~held_out(2, 4)), bound)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(ids, model, ["doc_id"]).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, least: float = 0.5, bound: int = BOUND) -> DataFrame:
    """The documents whose language is found: not `und`, and a score of at least `least`.  Columns may have any name."""
    model = fit(docs.where(~held_out(2, 4)), bound)
    found, sure = P.fresh(docs, "found", "sure")
    kept = predict(docs.withColumn("text", F.col("text").cast("string")), model, docs.columns, (found, sure))
    return kept.where(F.col(found) != "und").where(F.col(sure) >= least).select(*docs.columns)


def accuracy(docs: DataFrame) -> pd.DataFrame:
    """Held-out accuracy of each language."""
    both = identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    return both.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n")).toPandas()
