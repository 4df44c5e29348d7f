"""Substring dedup over a log-structured fingerprint index.

A word is removed if a window of 20 words over it also starts earlier: in a
document with a smaller doc_id, or further ahead in the same one.

Documents arrive in batches, in the order of doc_id.  The index holds what
earlier batches had, as immutable runs sorted by fingerprint: the least 8-gram
(by hash) of every 20-word window, and the block it is in.  Equal windows have
equal least 8-grams, so a window whose fingerprint stands nowhere else has no
copy.  For each batch

1. its fingerprints are written as a new run;
2. a merge join of all runs gives the fingerprints that the batch shares with
   other blocks, of this batch or of history;
3. windows under these are verified: new blocks, and of history only those
   blocks that hold a shared fingerprint, send a 128-bit identity of the whole
   window, made from the words themselves (a word of up to 15 bytes counts as
   it is, a longer one by a cryptographic digest), and a part marks those that
   an earlier block has too.  Repeats inside one block are found there;
4. once `fanout` runs of one level are there, they are compacted into one.

The runs are named in a manifest in the index's folder, so a later job can open
the index and go on with the next batch.

Documents: null text has no words; rows without doc_id are left out; of rows
that repeat a doc_id the one with the smaller text comes first; further columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packed as P
from tidemark.llm.suffix_dedup import _rows

WINDOW, GRAM = 20, 8
_RUN = "part int, block long, kind int, blob binary"


def windows_of(buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Windows of a block: place among its words, fingerprint, key and check (two halves of the identity); and the first word of each document."""
    at, key, check, sign, first, n = [], [], [], [], [np.zeros(1, np.int64)], 0
    for a, b in P.slices(offsets):
        own = offsets[a:b + 1] - offsets[a]
        _, _, words, second, begins = P.words_of(buf[offsets[a]:offsets[b]], own)
        if len(words) >= window:
            doc = np.repeat(np.arange(len(own) - 1), np.diff(begins))
            whole = np.flatnonzero(doc[:len(words) - window + 1] == doc[window - 1:])
            at.append(whole + n)
            key.append(P.word_grams(words, window)[whole])
            check.append(P.word_grams(second, window)[whole])
            # least hashes are small ones: mixed again, or most would fall to the first parts
            sign.append(P.mix(P.sliding_min(P.word_grams(words, gram), window - gram + 1)[whole]))
        first.append(begins[1:] + n)
        n += len(words)
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return {"at": cat(at, np.int64), "key": cat(key, P.U64), "check": cat(check, P.U64), "sign": cat(sign, P.U64), "first": np.concatenate(first)}


def _signs_of_block(parts: int):
    def run(key, table):
        signs = np.unique(windows_of(*P.ordered(table)[1:])["sign"])
        return _rows([(p, key[0].as_py(), 0, P.pack_sorted(signs[s])) for p, s in P.by_part(signs, parts)])

    return run


def _read_signs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of runs and the block of each; a compacted row (kind 1) names its blocks after the keys."""
    keys, blocks = [np.empty(0, P.U64)], [np.empty(0, np.int64)]
    for block, kind, blob in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "blob")), strict=True):
        if kind:
            n = int.from_bytes(blob[:8], "little")
            blocks.append(np.frombuffer(blob, np.int64, n, 8))
            keys.append(P.unpack_sorted(blob[8 + 8 * n:]))
        else:
            keys.append(P.unpack_sorted(blob))
            blocks.append(np.full(len(keys[-1]), block))
    keys, blocks = np.concatenate(keys), np.concatenate(blocks)
    order = np.argsort(keys, kind="stable")  # a merge: every run is sorted already
    return keys[order], blocks[order]


def _merge_join(first_new: int):
    def run(table):
        part = table.column("part")[0].as_py()
        keys, blocks = _read_signs(table)
        if not len(keys):
            return _rows([])
        group = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
        size = np.bincount(group)
        fresh = np.bincount(group, blocks >= first_new) > 0
        hit = ((size > 1) & fresh)[group]
        keys, blocks = keys[hit], blocks[hit]
        order = np.argsort(blocks, kind="stable")
        keys, blocks = keys[order], blocks[order]
        if not len(keys):
            return _rows([])
        begins = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        return _rows([(part, int(blocks[a]), 1, P.pack_sorted(keys[a:z])) for a, z in zip(begins, [*begins[1:], len(keys)], strict=True)])

    return run


def _compact(table):
    part = table.column("part")[0].as_py()
    keys, blocks = _read_signs(table)
    return _rows([(part, -1, 1, len(keys).to_bytes(8, "little") + blocks.tobytes() + P.pack_sorted(keys))] if len(keys) else [])


def _live_windows(found: dict, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and checks of the windows under shared fingerprints."""
    live = np.sort(np.concatenate([np.empty(0, P.U64), *map(P.unpack_sorted, blobs)]))
    keep = P.found_in(found["sign"], live)
    keys, index = np.unique(found["key"][keep], return_index=True)
    return keys, found["check"][keep][index]


def _keys_of_block(parts: int):
    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _rows([])
        keys, checks = _live_windows(windows_of(*P.ordered(left)[1:]), right.column("blob").to_pylist())
        return _rows([(p, key[0].as_py(), 2, len(keys[s]).to_bytes(8, "little") + checks[s].tobytes() + P.pack_sorted(keys[s])) for p, s in P.by_part(keys, parts)])

    return run


def _verify(first_new: int):
    def run(table):
        table = table.sort_by("block")
        part = table.column("part")[0].as_py()
        blocks, keys, checks = table.column("block").to_pylist(), [], []
        for blob in table.column("blob").to_pylist():
            n = int.from_bytes(blob[:8], "little")
            checks.append(np.frombuffer(blob, P.U64, n, 8))
            keys.append(P.unpack_sorted(blob[8 + 8 * n:]))
        edges = np.cumsum([0, *map(len, keys)])
        key, check = np.concatenate(keys), np.concatenate(checks)
        order = np.argsort(key, kind="stable")
        k, c = key[order], check[order]
        if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # one key, two windows
            order = np.lexsort((check, key))
            k, c = key[order], check[order]
        earlier = np.zeros(len(key), bool)
        earlier[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        return _rows([(part, b, 3, np.packbits(earlier[a:z]).tobytes()) for b, a, z in zip(blocks, edges, edges[1:], strict=False) if b >= first_new])

    return run


def _cut_block(parts: int, texts: bool):
    def run(key, left, right):
        ids, buf, offsets = P.ordered(left)
        found = windows_of(buf, offsets)
        kinds, blobs = right.column("kind").to_pylist(), right.column("blob").to_pylist()
        _, index, inverse = np.unique(found["key"], return_index=True, return_inverse=True)
        first = index[inverse]
        dup = (first != np.arange(len(first))) & (found["check"] == found["check"][first])
        marks = {p: b for p, k, b in zip(right.column("part").to_pylist(), kinds, blobs, strict=True) if k == 3}
        if marks:
            keys, checks = _live_windows(found, [b for k, b in zip(kinds, blobs, strict=True) if k == 1])
            seen = [keys[:0]]
            for p, s in P.by_part(keys, parts):
                if p in marks:
                    own = keys[s]
                    seen.append(own[np.unpackbits(np.frombuffer(marks[p], np.uint8), count=len(own)).astype(bool)])
            dup |= P.found_in(found["key"], np.concatenate(seen))
        gone = np.zeros(int(found["first"][-1]) + 1, np.int32)
        np.add.at(gone, found["at"][dup], 1)
        np.add.at(gone, found["at"][dup] + WINDOW, -1)
        keep = np.cumsum(gone)[:-1] == 0
        kept = np.r_[0, np.cumsum(keep)][found["first"]]
        n_words, n_removed = np.diff(found["first"]), np.diff(found["first"]) - np.diff(kept)
        out = []
        raw = buf.tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            words = raw[a:b].split()
            if n_removed[i]:
                words = compress(words, keep[found["first"][i]:found["first"][i + 1]])
            out.append(b" ".join(words))
        columns = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(out, pa.binary()).cast(pa.string())} if texts else {}))

    return run


class FingerprintLog:
    """The index: immutable runs of fingerprints in a shared folder, newest last, named by a manifest.

    With `path` of an index that is there already, its runs are history."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2) -> None:
        self.spark, self.fanout, self.path = spark, fanout, path or P.workspace(spark, "fingerprint-log")
        self.parts, self.runs, self.version = P.shuffle_parts(spark), [], 0
        for x in self._manifests():
            if x["version"] >= self.version:
                self.version, self.parts, self.runs = x["version"], x["parts"], [tuple(r) for r in x["runs"]]

    def _manifests(self) -> list[dict]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/manifest/*").collect()]

    def _commit(self) -> None:
        """A new manifest; readers take the greatest version that is whole."""
        self.version += 1
        row = json.dumps({"version": self.version, "parts": self.parts, "runs": self.runs})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version:09d}")
        if self.version > 1:
            P.remove(self.spark, f"{self.path}/manifest/{self.version - 1:09d}")

    def _read(self) -> DataFrame | None:
        out = None
        for _, name in self.runs:
            run = self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}")
            out = run if out is None else out.unionAll(run)
        return out

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"run-{self.version:09d}-{level}-{uuid.uuid4().hex}"
        rows.repartition(P.shuffle_parts(self.spark), "part").sortWithinPartitions("part", "block").write.parquet(f"{self.path}/{name}")
        self.runs.append((level, name))

    def append(self, batch: DataFrame, history: DataFrame, first: int, texts: bool = True) -> DataFrame:
        """What is left of the documents of a batch.  Its blocks are numbered from `first` on; history holds the blocks before, which are in the index already."""
        self._write(batch.groupBy("block").applyInArrow(_signs_of_block(self.parts), _RUN), 0)
        live = P.stored(self._read().groupBy("part").applyInArrow(_merge_join(first), _RUN), "shared")
        # no more rows than there are blocks
        needed = live.where(F.col("block") < first).select("block").distinct()
        known = history.join(F.broadcast(needed), "block", "left_semi").unionAll(batch)
        keys = known.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(_keys_of_block(self.parts), _RUN)
        marks = keys.groupBy("part").applyInArrow(_verify(first), _RUN)
        self.compact()
        self._commit()
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
        return batch.groupBy("block").cogroup(live.where(F.col("block") >= first).unionAll(marks).groupBy("block")).applyInArrow(_cut_block(self.parts, texts), schema)

    def compact(self) -> None:
        level = 0
        while len(old := [x for x in self.runs if x[0] == level]) >= self.fanout:
            rows = None
            for _, name in old:
                run = self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}")
                rows = run if rows is None else rows.unionAll(run)
            self._write(rows.groupBy("part").applyInArrow(_compact, _RUN), level + 1)
            self.runs = [x for x in self.runs if x not in old]
            for _, name in old:
                P.remove(self.spark, f"{self.path}/{name}")
            level += 1


def dedup(docs: DataFrame, batches: int = 2, texts: bool = True, path: str | None = None) -> DataFrame:
    """All documents, as `batches` successive batches of one index.

    Each batch has about the same bytes of text; batches = 1 is a single load.
    The index stays at `path` if that is given."""
    blocked, n = P.with_blocks(docs)
    log = FingerprintLog(docs.sparkSession, path)
    out = None
    for b in range(batches):
        first, end = b * n // batches, (b + 1) * n // batches
        # the last batch has no upper end, so that no block is left out by rounding
        batch = blocked.where(f"block >= {first}" + (f" AND block < {end}" if b + 1 < batches else ""))
        part = log.append(batch, blocked.where(f"block < {first}"), first, texts)
        out = part if out is None else out.unionAll(part)
    return out
