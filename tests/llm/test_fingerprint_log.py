import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_near_dups import thue_morse
from tests.llm.test_suffix_dedup import made
from tidemark.llm import fingerprint_log as L
from tidemark.llm import packed as P


def brute(rows, n=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        words = (t or "").encode().split()
        gone = set()
        for p in range(len(words) - n + 1):
            w = tuple(words[p:p + n])
            if w in seen:
                gone.update(range(p, p + n))
            seen.add(w)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_as_brute_force(spark, batches):
    rows = [*made(batches), (300, "w " * 70), (301, "w " * 30), (302, "\t lone\r\nwords \x0b here\x0c "), (303, "w w " * 40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    got = sorted(tuple(x) for x in L.dedup(docs, batches, texts=False).collect())
    assert got == brute(rows)


def test_texts_nulls_repeats_empty(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(2, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed, x.kept_text) for x in L.dedup(docs).collect())
    assert got == [(1, 0, text), (2, 25, ""), (2, 25, ""), (3, 0, "")]
    assert L.dedup(docs.limit(0)).count() == 0


def test_words_of_equal_polynomial_hash_are_different(spark):
    x, y = thue_morse()
    common = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{x} {common}"), (2, f"{y} {common}"), (3, f"{y} {common} more"), (-9 * 10**18, "a b c"), (9 * 10**18, f"{x} {common}")]
    got = sorted(tuple(r) for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), texts=False).collect())
    assert got == brute(rows)


def test_a_later_job_goes_on_with_the_index(spark, tmp_path):
    rows = made(7)
    rows.sort()
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    old, n = P.with_blocks(docs(rows[:40]))
    new = P.with_blocks(docs(rows[40:]))[0].withColumn("block", F.col("block") + n)
    at = f"file://{tmp_path}/log"
    first = L.FingerprintLog(spark, at).append(old, old.limit(0), 0, texts=False).collect()
    log = L.FingerprintLog(spark, at)
    assert log.version == 1 and len(log.runs) == 1
    second = log.append(new, old, n, texts=False).collect()
    assert sorted(tuple(r) for r in first + second) == brute(rows)
    assert L.FingerprintLog(spark, at).version == 2
