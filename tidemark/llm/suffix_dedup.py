"""Suffix-array dedup: a distributed merge sort of front-coded suffix runs.

A byte is removed if a 50-byte string over it also starts in a document with a
smaller doc_id.  Sorting every suffix would blow the text up forty-fold, so the
array is sparse: of each 50-byte string the leftmost least 20-gram (by hash)
marks the suffix that stands for it, and equal strings mark equal places.

1. Each block lists the distinct 20-grams it marked, by 48 bits of their hashes;
   a part answers with a bit for each, whether another block has it too.
   Others can't be in a repeat, and a needless bit costs only work.
2. Each block takes its marked suffixes that remain (and those that two of its
   own documents share) with what lies left of them, each distinct one once
   with the least document it is in, and sends them as a sorted front-coded
   run: the length of the prefix shared with the suffix before, then the rest.
   However often a block holds a line, it sends it once.
3. A part merges its runs with a loser tree that keeps, for every run, the
   prefix its head shares with the last suffix put out.  Heads with different
   lengths are ordered by these alone; others are compared from there on.  Runs
   are decoded one suffix at a time, so that a part holds them front-coded.
4. Strings that begin up to 30 bytes before the mark are equal when the merged
   order puts their right sides under one prefix and the order of the reversed
   left sides puts these under one too.  Both tests are exact.  The answer to a
   block is two bytes for each suffix it sent.

Documents: null text is empty; rows without doc_id are left out; rows that
repeat a doc_id are one document each, none smaller than the other; further
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
_RUN = "part int, block long, kind int, blob binary"


#: Low bits of a hash that give way to the place, the same for every text: equal strings mark equal places.
_LOW = P.U64((1 << 24) - 1)


def _least_places(grams: np.ndarray) -> np.ndarray:
    """For each run of SPAN hashes the place of the least one, by its high 40 bits, the leftmost of equal ones."""
    n, step = len(grams) - SPAN + 1, 1 << 23
    out = np.empty(max(0, n), np.int64)
    for a in range(0, n, step):
        own = grams[a:a + step + SPAN - 1]
        least = P.sliding_min((own & ~_LOW) | np.arange(len(own), dtype=P.U64), SPAN)
        out[a:a + step] = (least & _LOW).astype(np.int64) + a
    return out


def marks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked places of documents in buf: place, hash of its 20-gram, document, and least and greatest distance of the strings it stands for."""
    none = (np.empty(0, np.int64), np.empty(0, P.U64), *(np.empty(0, np.int64) for _ in range(3)))
    starts = np.arange(max(0, len(buf) - LENGTH + 1))
    if not len(starts):
        return none
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:len(starts)] == doc[LENGTH - 1:]
    grams = P.byte_grams(buf, GRAM)
    at = _least_places(grams)[inside]
    starts = starts[inside]
    if not len(at):
        return none
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    place = at[first]
    # least hashes are small ones: mixed again, or most would fall to the first parts
    return place, P.mix(grams[place]), doc[place], place - starts[last], place - starts[first]


def _sliced(ids, buf, offsets) -> Iterator[tuple]:
    for a, b in P.slices(offsets):
        own = offsets[a:b + 1] - offsets[a]
        yield a, buf[offsets[a]:offsets[b]], own, marks(buf[offsets[a]:offsets[b]], own)


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table({"part": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int64()), "kind": pa.array(cols[2], pa.int32()), "blob": pa.array(cols[3], pa.binary())})


#: Bits of a hash that the lists of 20-grams leave out.
_CUT = P.U64(16)


def _listed(grams: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The distinct keys of some 20-grams, sorted, and the range of each part."""
    keys = np.unique(grams >> _CUT)
    return keys, list(P.by_part(keys << _CUT, parts))


def _grams_of_block(parts: int):
    def run(key, table):
        ids, buf, offsets = P.ordered(table)
        found = [np.unique(m[1]) for *_, m in _sliced(ids, buf, offsets)]
        keys, ranges = _listed(np.concatenate(found) if found else np.empty(0, P.U64), parts)
        return _rows([(p, key[0].as_py(), 0, P.pack_sorted(keys[s])) for p, s in ranges])

    return run


def _shared(table):
    """A bit for each key of each block: whether another block has it."""
    part = table.column("part")[0].as_py()
    blocks = table.column("block").to_pylist()
    runs = [P.unpack_sorted(x) for x in table.column("blob").to_pylist()]
    keys = np.concatenate(runs) if runs else np.empty(0, P.U64)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    edges = np.cumsum([0, *map(len, runs)])
    return _rows([(part, b, 1, np.packbits(shared[a:z]).tobytes()) for b, a, z in zip(blocks, edges, edges[1:], strict=False) if shared[a:z].any()])


def front_code(suffixes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix with the row before, and the rests, of sorted rows of bytes."""
    n, width = suffixes.shape
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        differ = suffixes[1:] != suffixes[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return lcp, suffixes[np.arange(width)[None, :] >= lcp[:, None]].tobytes()


def _windows(buf: np.ndarray, start: np.ndarray, width: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """buf[start : start + width] of each row, zero outside [low, high)."""
    at = start[:, None] + np.arange(width)[None, :]
    ok = (at >= low[:, None]) & (at < high[:, None])
    return np.where(ok, buf[np.clip(at, 0, len(buf) - 1)], np.uint8(0))


def _ranks(ids: np.ndarray) -> np.ndarray:
    """The rank of each document of a block; rows of one doc_id share it."""
    return np.cumsum(np.r_[False, ids[1:] != ids[:-1]])


class _Block:
    """The marked suffixes of a block that may be in repeats.

    part, right, left, near, far, least: of each distinct one, sorted by part
    and right side; entry, rank, doc, start: of each place, the number of its
    suffix, the rank and row of its document, and the place in it."""

    def __init__(self, table: pa.Table, replies: pa.Table, parts: int) -> None:
        self.ids, self.buf, self.offsets = P.ordered(table)
        rank = _ranks(self.ids)
        pieces = [(a, text, own, m) for a, text, own, m in _sliced(self.ids, self.buf, self.offsets)]
        grams = np.concatenate([m[1] for *_, m in pieces] or [np.empty(0, P.U64)])
        keys, ranges = _listed(grams, parts)
        live = np.zeros(len(keys), bool)
        said = {p: b for p, k, b in zip(*(replies.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True) if k == 1}
        for p, s in ranges:
            if p in said:
                live[s] = np.unpackbits(np.frombuffer(said[p], np.uint8), count=s.stop - s.start)
        live = keys[live]
        # 20-grams that documents of this very block share; two rows of one doc_id count as one
        ranks = np.concatenate([rank[m[2] + a] for a, _, _, m in pieces] or [np.empty(0, np.int64)])
        order = np.lexsort((ranks, grams))
        g, d = grams[order], ranks[order]
        live = np.union1d(live, np.unique(g[1:][(g[1:] == g[:-1]) & (d[1:] != d[:-1])] >> _CUT))
        del g, d, order, ranks, grams
        found = []
        for a, text, own, (place, gram, doc, near, far) in pieces:
            keep = P.found_in(gram >> _CUT, live)
            place, gram, doc, near, far = (x[keep] for x in (place, gram, doc, near, far))
            if len(place):
                right = _windows(text, place, LENGTH, place, np.minimum(own[doc + 1], place + LENGTH - near))
                left = _windows(text, place - (SPAN - 1), SPAN - 1, place - far, place)[:, ::-1]
                part = (gram // P.U64((1 << 64) // parts)).astype(np.int64)
                # the widths come last and aren't zero, so that rows are compared in whole
                found.append((part, np.column_stack([right, left, (near + 1).astype(np.uint8), (far + 1).astype(np.uint8)]), doc + a, place - own[doc]))
        none = (np.empty(0, np.int64), np.empty((0, LENGTH + SPAN + 1), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
        part, rows, self.doc, self.start = (np.concatenate(x) for x in (zip(*found, strict=True) if found else ((x,) for x in none)))
        self.rank = rank[self.doc]
        order = np.lexsort((self.rank, rows.view(f"S{rows.shape[1]}")[:, 0], part)) if len(rows) else np.empty(0, np.int64)
        sorted_rows, sorted_part = rows[order], part[order]
        new = np.r_[True, (sorted_part[1:] != sorted_part[:-1]) | (sorted_rows[1:] != sorted_rows[:-1]).any(1)][:len(rows)]
        first = np.flatnonzero(new)
        self.entry = np.empty(len(rows), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.part, rows = sorted_part[first], sorted_rows[first]
        self.right, self.left = rows[:, :LENGTH], rows[:, LENGTH:LENGTH + SPAN - 1]
        self.near, self.far = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
        self.least = self.rank[order][first]

    def ranges(self):
        for p in np.unique(self.part).tolist():
            yield p, slice(int(np.searchsorted(self.part, p)), int(np.searchsorted(self.part, p, "right")))


def _runs_of_block(parts: int):
    def run(key, left, right):
        if not left.num_rows:
            return _rows([])
        block, out = _Block(left, right, parts), []
        for p, s in block.ranges():
            lcp, rest = front_code(block.right[s])
            far = block.far[s]
            sides = block.left[s][np.arange(SPAN - 1)[None, :] < far[:, None]].tobytes()
            columns = [np.array([len(far), len(rest)], np.int64), block.least[s].astype(np.int32), lcp, block.near[s].astype(np.uint8), far.astype(np.uint8)]
            out.append((p, key[0].as_py(), 2, P.squeeze(b"".join(x.tobytes() for x in columns) + rest + sides)))
        return _rows(out)

    return run


def _read_run(blob: bytes, block: int) -> dict:
    raw = P.unsqueeze(blob)
    n, rest = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, {}
    for name, kind in (("least", np.int32), ("lcp", np.uint8), ("near", np.uint8), ("far", np.uint8)):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    left = np.zeros((n, SPAN - 1), np.uint8)
    left[np.arange(SPAN - 1)[None, :] < out["far"][:, None].astype(np.int64)] = np.frombuffer(raw, np.uint8, -1, at + rest)
    # blocks are ranges of doc_id, so this orders documents of all blocks
    return out | {"order": (np.int64(block) << 32) + out["least"], "rest": raw[at:at + rest], "left": left}


def loser_tree(runs: list[tuple[bytes, bytes]], width: int = LENGTH) -> Iterator[tuple[int, int]]:
    """Merge sorted front-coded runs of (shared prefix with the row before, a byte each; the rests).

    Yields (run, shared prefix with the suffix put out before).  Of two heads
    the one that shares more with the last suffix is smaller; only heads that
    share equally much are compared, from that place on.  Of each run only the
    head is decoded."""
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    at = [0] * k
    sizes = [len(lcp) for lcp, _ in runs] + [0] * (k - len(runs))
    head: list[bytes | None] = [r[1][:width] if r[0] else None for r in runs] + [None] * (k - len(runs))
    read = [width] * k
    shares = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's share becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        h, g = shares[a], shares[b]
        if h != g:
            return (a, b) if h > g else (b, a)
        n = len(x)
        if x[h:] == y[h:]:
            h = n
        else:
            while x[h] == y[h]:
                h += 1
        if h == n:
            won, lost = (a, b) if a < b else (b, a)
        else:
            won, lost = (a, b) if x[h] < y[h] else (b, a)
        shares[lost] = h
        return won, lost

    tree = [0] * k
    top = list(range(k))
    level = top
    base = k
    while len(level) > 1:
        base //= 2
        nxt = []
        for i in range(base):
            won, lost = play(level[2 * i], level[2 * i + 1])
            tree[base + i] = lost
            nxt.append(won)
        level = nxt
    won = level[0]
    while head[won] is not None:
        yield won, shares[won]
        at[won] += 1
        if at[won] < sizes[won]:
            lcp, rest = runs[won]
            shares[won] = same = lcp[at[won]]
            head[won] = head[won][:same] + rest[read[won]:read[won] + width - same]
            read[won] += width - same
        else:
            head[won] = None
        node = (won + k) // 2
        while node:
            won, tree[node] = play(won, tree[node])
            node //= 2


def _classes(order: np.ndarray, shared: np.ndarray) -> "callable":
    """The class of each row among rows that share at least n bytes, for any n."""
    def of(n: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(shared < n)
        return out

    return of


def _merged(table):
    """For each suffix of each block the least and greatest distance at which its string starts in an earlier document too; (255, 0) if none does."""
    part = table.column("part")[0].as_py()
    blocks = table.column("block").to_pylist()
    runs = [_read_run(x, b) for x, b in zip(table.column("blob").to_pylist(), blocks, strict=True)]
    size = np.cumsum([0] + [len(r["near"]) for r in runs])
    order_of, near, far, left = (np.concatenate([r.pop(c) for r in runs]) for c in ("order", "near", "far", "left"))
    steps = np.fromiter((r << 8 | s for r, s in loser_tree([(r["lcp"].tobytes(), r["rest"]) for r in runs])), np.int64, size[-1])
    del runs
    run, shared = steps >> 8, steps & 255
    seen = np.empty(len(run), np.int64)
    seen[np.argsort(run, kind="stable")] = np.arange(len(run))
    right_class = _classes(seen, shared)
    left_order = np.argsort(np.ascontiguousarray(left).view(f"S{SPAN - 1}")[:, 0], kind="stable")
    sorted_left = left[left_order]
    differ = sorted_left[1:] != sorted_left[:-1]
    left_class = _classes(left_order, np.r_[0, np.where(differ.any(1), differ.argmax(1), SPAN)])
    del left, sorted_left, differ, steps, run
    low, high = np.full(len(order_of), 255, np.uint8), np.zeros(len(order_of), np.uint8)
    for o in range(SPAN):
        rows = np.flatnonzero((near <= o) & (far >= o))
        if not len(rows):
            continue
        key = right_class(LENGTH - o)[rows] << 32 | left_class(o)[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(np.minimum.reduceat(order_of[rows], first), np.diff(np.r_[first, len(rows)]))
        hit = rows[order_of[rows] > least]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
    return _rows([(part, b, 3, P.squeeze(low[a:z].tobytes() + high[a:z].tobytes())) for b, a, z in zip(blocks, size, size[1:], strict=False) if (low[a:z] < 255).any()])


def _cut_block(parts: int, texts: bool):
    def run(key, left, right):
        block = _Block(left, right, parts)
        ids, buf, offsets = block.ids, block.buf, block.offsets
        low, high = np.full(len(block.near), 255, np.int64), np.zeros(len(block.near), np.int64)
        said = {p: b for p, k, b in zip(*(right.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True) if k == 3}
        for p, s in block.ranges():
            if p in said:
                low[s], high[s] = np.frombuffer(P.unsqueeze(said[p]), np.uint8).reshape(2, -1)
        low, high = low[block.entry], high[block.entry]
        # an earlier document of this very block has all strings of the suffix
        again = block.rank > block.least[block.entry]
        low[again], high[again] = block.near[block.entry[again]], block.far[block.entry[again]]
        hit = low < 255
        begin = offsets[block.doc[hit]] + block.start[hit]
        gone = np.zeros(len(buf) + 1, np.int32)
        np.add.at(gone, begin - high[hit], 1)
        np.add.at(gone, begin - low[hit] + LENGTH, -1)
        del block, low, high, again, hit, begin
        gone = np.cumsum(gone[:-1]) > 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        opens = gone & (edge[:-1] | ~np.r_[False, gone[:-1]])
        removed = np.r_[0, np.cumsum(gone)][offsets]
        spans = np.r_[0, np.cumsum(opens)][offsets]
        kept = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        columns = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "n_spans": pa.array(np.diff(spans), pa.int64())}
        if texts:
            columns["kept_bytes"] = pa.array(kept, pa.binary())
            same = np.r_[False, (ids[1:] == ids[:-1]) & np.array([buf[a:b].tobytes() == buf[b:c].tobytes() for a, b, c in zip(offsets, offsets[1:], offsets[2:], strict=False)], bool)][:len(ids)]
            columns["again"] = pa.array(same, pa.bool_())
            columns["text_md5"] = pa.array([hashlib.md5(buf[a:b].tobytes(), usedforsecurity=False).digest() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
        return pa.table(columns | {"kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())})

    return run


def dedup(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; if asked for, also kept_bytes, text_md5 (a digest of the whole text) and again (whether a row with this doc_id and text came before)."""
    blocked, _ = P.with_blocks(docs)
    parts = P.shuffle_parts(docs.sparkSession)
    grams = blocked.groupBy("block").applyInArrow(_grams_of_block(parts), _RUN)
    # a bit for each key, used twice
    live = P.stored(grams.groupBy("part").applyInArrow(_shared, _RUN), "live")
    runs = blocked.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(_runs_of_block(parts), _RUN)
    gone = runs.groupBy("part").applyInArrow(_merged, _RUN)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long" + ", kept_bytes binary, again boolean, text_md5 binary" * keep_bytes + ", kept_sha256 string"
    return blocked.groupBy("block").cogroup(live.unionAll(gone).groupBy("block")).applyInArrow(_cut_block(parts, keep_bytes), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the bytes left by dedup() as their text.

    Where a span began or ended inside a character, its bytes become U+FFFD.
    A null text stays null, and so do other columns stay as they are, whatever
    their names.  Rows that repeat a doc_id are told apart by their texts."""
    of, key, kept, own, at = P.fresh(docs, "of", "key", "kept", "own", "at")
    rest = dedup(docs).where("NOT again").select(F.col("doc_id").alias(of), F.col("text_md5").alias(key), F.expr("make_valid_utf8(cast(kept_bytes as string))").alias(kept))
    # only what is left of the texts is moved, not the texts
    others = [c for c in docs.columns if c != "text"]
    rows = docs.where("doc_id IS NOT NULL").select(*others, F.col("doc_id").cast("long").alias(own), P.text_key().alias(at))
    out = rows.join(rest, (F.col(own) == F.col(of)) & (F.col(at) == F.col(key)), "left").withColumnRenamed(kept, "text")
    return out.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
