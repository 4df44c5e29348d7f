"""LM scoring by a Brown class-based bigram model.

P(word | word before) = P(class | class before) * P(word | class).

Counts of all words over all training documents are made in packed form: a
block of documents sends each distinct word once, a part sums, and the block
gets back the counts of its own words.  Every word that occurs LEAST times or
more in training is in a learned class:

1. the FREQUENT most frequent ones are assigned to CLASSES classes by exchange
   clustering on the driver: each word in turn moves to the class that gives the
   greatest likelihood of the class bigrams, until none moves;
2. all others are then exchanged at once, in parts: blocks send with which
   classes each of their words stands, a part adds these up, moves each word to
   the class that gains most, and tells the blocks.  Their number grows with
   the corpus, and so does what is gathered; it is one exchange step for each
   of them, not repeated.

Words that occur once, and unseen ones, are in a class by their shape; the end
of a document is a class of its own and also stands before the first word.

Smoothing: transitions are mixed with the class frequencies (weight TAU); the
words of a shape class share the Good-Turing mass of words seen once, and
unseen ones have the rest.

Documents: null text is empty (one end token); rows without doc_id are left
out; rows that repeat a doc_id are scored and learned each; further columns are
ignored.  Without training documents all counts are 0 and transitions uniform.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P
from tidemark.llm.suffix_dedup import _rows

#: Words that are clustered in turn, their classes, and how often any other word has to occur to be in one.
FREQUENT, CLASSES, LEAST = 1000, 48, 2
SHAPES = 18
TAU = 5.0
#: The end token's key.
_END = P.U64(0x0E0D0E0D0E0D0E0D)
_RUN = "part int, block long, kind int, blob binary"
_POINT = np.zeros(256, np.int8)
_POINT[list(b".,;:!?")] = 1
_POINT[[c for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in ".,;:!?"]] = 2


def learned(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 10 != 0 for i in ids.tolist()], bool)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """128 bits (two hashes) and shape of each token, and the first token of each document; the last token of each is the end (shape SHAPES)."""
    hashes, seconds, shapes, first, n = [], [], [], [np.zeros(1, np.int64)], 0
    for a, b in P.slices(offsets):
        own = offsets[a:b + 1] - offsets[a]
        low = P.lower_ascii(buf[offsets[a]:offsets[b]])
        starts, ends, words, second, begins = P.words_of(low, own)
        length = ends - starts
        wide = np.r_[0, np.cumsum(low >= 128)]
        shape = (_POINT[low[ends - 1]] if len(ends) else np.empty(0, np.int8)).astype(np.int64) * 6 + (wide[ends] > wide[starts]) * 3 + (length > 5) + (length > 9)
        # one end after the words of each document
        hashes.append(np.insert(words, begins[1:], _END))
        seconds.append(np.insert(second, begins[1:], _END))
        shapes.append(np.insert(shape, begins[1:], SHAPES).astype(np.uint8))
        first.append(begins[1:] + np.arange(1, len(begins)) + n)
        n = int(first[-1][-1])
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return cat(hashes, P.U64), cat(seconds, P.U64), cat(shapes, np.uint8), np.concatenate(first)


def _number(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    size = next(s for s in (1, 2, 4, 8) if not len(n) or int(n.max()) < 1 << (8 * s))
    return bytes([size]) + n.astype(f"<u{size}").tobytes()


def _numbers(blob: bytes, n: int) -> tuple[np.ndarray, int]:
    size = blob[0]
    return np.frombuffer(blob, f"<u{size}", n, 1).astype(np.int64), 1 + size * n


def _count_block(parts: int):
    def run(key, table):
        ids, buf, offsets = P.ordered(table)
        hashes, seconds, shapes, first = tokens(buf, offsets)
        keys, checks, index, inverse = P.distinct(hashes, seconds)
        counts = np.bincount(inverse, np.repeat(learned(ids), np.diff(first)), len(keys)).astype(np.int64)
        out = []
        for p, s in P.by_part(keys, parts):
            n = len(keys[s])
            out.append((p, key[0].as_py(), 0, n.to_bytes(8, "little") + _number(counts[s]) + shapes[index[s]].tobytes() + checks[s].tobytes() + P.pack_sorted(keys[s])))
        return _rows(out)

    return run


def _read_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    counts, at = _numbers(blob[8:], n)
    return P.unpack_sorted(blob[8 + at + 9 * n:]), counts, np.frombuffer(blob, np.uint8, n, 8 + at), np.frombuffer(blob, P.U64, n, 8 + at + n)


def _sum_part(frequent: int):
    """Sums of a part: for each block the counts of its words (kind 1), and, as block -1, sums by shape and the most frequent words (kind 2)."""
    def run(table):
        part = table.column("part")[0].as_py()
        blocks = table.column("block").to_pylist()
        runs = [_read_counts(x) for x in table.column("blob").to_pylist()]
        keys, checks, index, inverse = P.distinct(*(np.concatenate([r[k] for r in runs]) for k in (0, 3)))
        total = np.bincount(inverse, np.concatenate([r[1] for r in runs]), len(keys)).astype(np.int64)
        shape = np.concatenate([r[2] for r in runs])[index]
        edges = np.cumsum([0] + [len(r[0]) for r in runs])
        # the count of each word of a block, and its place among the words of the part
        out = [(part, b, 1, _number(total[inverse[a:z]]) + P.pack_sorted(inverse[a:z].astype(P.U64))) for b, a, z in zip(blocks, edges, edges[1:], strict=False)]
        sums = np.array([np.bincount(shape, w, SHAPES + 1) for w in (total, total > 0, total == 1, total == 2)]).astype(np.int64)
        words = np.flatnonzero((shape < SHAPES) & (total > 0))
        top = words[np.lexsort((keys[words].view(np.int64), -total[words]))[:frequent]]
        return _rows([*out, (part, -1, 2, sums.tobytes() + len(top).to_bytes(8, "little") + keys[top].tobytes() + checks[top].tobytes() + total[top].tobytes() + shape[top].tobytes())])

    return run


def _top_rows(frequent: int):
    """The most frequent words of all parts in a partition."""
    def run(batches):
        key, check, count, shape = np.empty(0, P.U64), np.empty(0, P.U64), np.empty(0, np.int64), np.empty(0, np.int32)
        for b in batches:
            for blob in b.column("blob").to_pylist():
                at = 8 * 4 * (SHAPES + 1)
                n = int.from_bytes(blob[at:at + 8], "little")
                own = [np.frombuffer(blob, kind, n, at + 8 + 8 * n * k) for k, kind in enumerate((P.U64, P.U64, np.int64, np.uint8))]
                key, check, count, shape = (np.r_[x, y] for x, y in zip((key, check, count, shape), own, strict=True))
                best = np.lexsort((key.view(np.int64), -count))[:frequent]
                key, check, count, shape = key[best], check[best], count[best], shape[best]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(count), pa.array(shape.astype(np.int32))], names=["key", "check", "n", "shape"])

    return run


def _sum_rows(batches):
    total = np.zeros((4, SHAPES + 1), np.int64)
    for b in batches:
        for blob in b.column("blob").to_pylist():
            total += np.frombuffer(blob, np.int64, 4 * (SHAPES + 1)).reshape(4, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(range(4), SHAPES + 1), pa.int32()), pa.array(np.tile(range(SHAPES + 1), 4), pa.int32()), pa.array(total.ravel())], names=["kind", "shape", "n"])


class _Words:
    """The tokens of a block, and what is known of its distinct words.

    entry: the number of each token's word; count, place (in its part) and
    part range of each word; label: of the frequent ones, the end and the
    shapes, by `labels` (frequent words, then shapes, then the end)."""

    def __init__(self, table: pa.Table, replies: pa.Table, parts: int, top: tuple[np.ndarray, np.ndarray], labels: np.ndarray) -> None:
        self.ids, buf, offsets = P.ordered(table)
        hashes, seconds, shapes, self.first = tokens(buf, offsets)
        keys, checks, index, self.entry = P.distinct(hashes, seconds)
        self.ranges = list(P.by_part(keys, parts))
        said = {p: b for p, k, b in zip(*(replies.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True) if k == 1}
        count, place = [np.empty(0, np.int64)], [np.empty(0, P.U64)]
        for p, s in self.ranges:
            n, at = _numbers(said[p], s.stop - s.start)
            count.append(n)
            place.append(P.unpack_sorted(said[p][at:]))
        self.count, self.place = np.concatenate(count), np.concatenate(place)
        self.shape = shapes[index].astype(np.int64)
        end = self.shape == SHAPES
        frequent = np.zeros(len(keys), bool)
        self.label = labels[len(top[0]) + self.shape]
        if len(top[0]):
            order = np.argsort(top[0], kind="stable")
            at = order[np.minimum(np.searchsorted(top[0][order], keys), len(order) - 1)]
            frequent = (top[0][at] == keys) & (top[1][at] == checks)
            self.label = np.where(frequent, labels[at], self.label)
        self.middle = ~frequent & ~end & (self.count >= LEAST)
        self.trained = np.repeat(learned(self.ids), np.diff(self.first)) if len(self.ids) else np.empty(0, bool)

    def sequence(self) -> np.ndarray:
        return self.label[self.entry]

    def pairs(self, size: int) -> bytes:
        """The numbers of label pairs in training documents."""
        label = self.sequence()
        # the token before a first word is an end, and the last token of all documents is one
        before = np.r_[label[-1:], label[:-1]].astype(np.int64)
        pair, n = np.unique((before * size + label)[self.trained], return_counts=True)
        return len(pair).to_bytes(8, "little") + pair.astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes()


def _pairs_block(parts: int, shared):
    """Pairs of frequent words, shapes and ends."""
    def run(key, left, right):
        top, labels = shared.value
        if not left.num_rows:
            return pa.table({"ids": pa.array([], pa.binary())})
        return pa.table({"ids": pa.array([_Words(left, right, parts, top, labels).pairs(int(labels.max()) + 1)], pa.binary())})

    return run


def _profile_block(parts: int, shared):
    """For each part the places of the block's other words, and how often they stand after and before each class in training."""
    def run(key, left, right):
        if not left.num_rows:
            return _rows([])
        top, labels, size = shared.value[:3]
        w = _Words(left, right, parts, top, labels)
        label = w.sequence()
        mine = w.middle[w.entry] & w.trained
        at = np.flatnonzero(mine)
        before, after = np.r_[label[-1:], label[:-1]], np.r_[label[1:], label[:1]]
        both = np.concatenate([w.entry[at] * (2 * size) + before[at], w.entry[at] * (2 * size) + size + after[at]])
        cells, n = np.unique(both, return_counts=True)
        number = np.cumsum(w.middle) - 1
        out = []
        for p, s in w.ranges:
            own = w.middle[s]
            if own.any():
                first = int(number[s][own][0])
                a, z = np.searchsorted(cells, [s.start * 2 * size, s.stop * 2 * size])
                rebased = ((number[cells[a:z] // (2 * size)] - first) * (2 * size) + cells[a:z] % (2 * size)).astype(P.U64)
                places, profile = P.pack_sorted(w.place[s][own]), P.pack_sorted(rebased) if len(rebased) else b""
                out.append((p, key[0].as_py(), 4, P.squeeze(len(places).to_bytes(8, "little") + len(profile).to_bytes(8, "little") + places + profile + _number(n[a:z]))))
        return _rows(out)

    return run


def _gained(cells: np.ndarray, classes: int, word: np.ndarray, column: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """The class of the greatest likelihood for each word, from its sparse counts: column c < size is class c before it, size + c after it."""
    size = len(cells)
    # what a class pair gains by n more, for each class of the word and each class beside it: [side, beside, class]
    base = np.stack([cells[:, :classes], cells[:classes].T])
    logs = _xlogx(base)
    gain, beside = np.zeros((words, classes)), np.zeros((2, words, classes))
    small = np.stack([_xlogx(base + k) - logs for k in range(17)])
    total = np.zeros(words)
    for a in range(0, len(word), 50_000):
        w, c, k = word[a:a + 50_000], column[a:a + 50_000], n[a:a + 50_000]
        side, lab = c // size, c % size
        part = small[np.minimum(k, 16), side, lab]
        big = np.flatnonzero(k > 16)
        part[big] = _xlogx(base[side[big], lab[big]] + k[big, None]) - logs[side[big], lab[big]]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[first]] += np.add.reduceat(part, first, axis=0)
        own = np.flatnonzero(lab < classes)
        beside[side[own], w[own], lab[own]] += k[own]
        np.add.at(total, w[side == 1], k[side == 1])
    # a class that stands on both sides of the word gets both in one cell
    d = np.diag(cells)[:classes]
    gain += _xlogx(d + beside[0] + beside[1]) - _xlogx(d + beside[0]) - _xlogx(d + beside[1]) + _xlogx(d)
    # what stands before the word is in the rows of other classes, and what stands after it in their columns
    for edge, side in ((cells.sum(1)[:classes], 0), (cells.sum(0)[:classes], 1)):
        gain -= _xlogx(edge + beside[side] + total[:, None]) - _xlogx(edge + beside[side])
    return gain.argmax(1)


def _assign(shared):
    """A part's words in the classes that gain most; the labels of its words for each block."""
    def run(table):
        _, _, size, classes, cells = shared.value
        part = table.column("part")[0].as_py()
        blocks, places, keys, counts = table.column("block").to_pylist(), [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for blob in table.column("blob").to_pylist():
            raw = P.unsqueeze(blob)
            n, m = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
            places.append(P.unpack_sorted(raw[16:16 + n]).astype(np.int64))
            if m:
                own = P.unpack_sorted(raw[16 + n:16 + n + m]).astype(np.int64)
                keys.append(places[-1][own // (2 * size)] * (2 * size) + own % (2 * size))
                counts.append(_numbers(raw[16 + n + m:], len(own))[0])
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)
        names, word = np.unique(key // (2 * size), return_inverse=True)
        label = _gained(cells, classes, word, key % (2 * size), n, len(names)).astype(np.uint8)
        # a word that occurs LEAST times in training has a profile
        return _rows([(part, b, 5, P.squeeze(label[np.searchsorted(names, own)].tobytes())) for b, own in zip(blocks, places, strict=True)])

    return run


def _encode_block(parts: int, shared):
    """Documents as labels, with what their words have but for the sizes of learned classes (kind 0); the numbers of label pairs in training documents (kind 1)."""
    names = ("kind", "doc_id", "n_tokens", "n_known", "base_score", "seen", "ids")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())

    def run(key, left, right):
        top, labels, size, n_all, v_all, once, unseen = shared.value
        if not left.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds, strict=True)})
        w = _Words(left, right, parts, top, labels)
        said = {p: b for p, k, b in zip(*(right.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True) if k == 5}
        for p, s in w.ranges:
            if p in said:
                own = np.flatnonzero(w.middle[s]) + s.start
                w.label[own] = np.frombuffer(P.unsqueeze(said[p]), np.uint8)
        end = w.shape == SHAPES
        rare = np.where(w.count > 0, once[np.minimum(w.shape, SHAPES - 1)], unseen[np.minimum(w.shape, SHAPES - 1)])
        # words of learned classes by their counts, whose sum over the class comes later
        known = (w.label < size - SHAPES - 1) & ~end
        own = np.where(end, 0.0, np.where(known, np.log10(np.maximum(w.count, 1)), rare))
        base = np.log10((w.count + 0.1) / (n_all + 0.1 * (v_all + 1)))
        begins, label, per = w.first[:-1], w.sequence().astype(np.uint8), lambda x: np.add.reduceat(x[w.entry], w.first[:-1])
        columns = (np.zeros(len(begins), np.int32), w.ids, np.diff(w.first), per((w.count > 0).astype(np.int64)), per(base), per(own), [label[a:b].tobytes() for a, b in zip(w.first, w.first[1:], strict=False)])
        docs = pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})
        one = pa.table({c: pa.array([1], k) if c == "kind" else pa.array([w.pairs(size)], k) if c == "ids" else pa.nulls(1, k) for c, k in zip(names, kinds, strict=True)})
        return pa.concat_tables([docs, one])

    return run


def _sum_pairs(size: int):
    """Sums the pair counts of a partition: a fixed number of cells, whatever it holds."""
    def run(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for blob in b.column("ids").to_pylist():
                n = int.from_bytes(blob[:8], "little")
                total[np.frombuffer(blob, np.uint32, n, 8)] += np.frombuffer(blob, np.uint32, n, 8 + 4 * n)
        some = np.flatnonzero(total)
        cut = np.searchsorted(some // size, range(size + 1))
        rows = [(int(r), some[a:z].astype(np.uint32).tobytes(), total[some[a:z]].tobytes()) for r, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["row", "pairs", "n"])

    return run


def _merge_row(size: int):
    def run(table):
        total = np.zeros(size, np.int64)
        row = table.column("row")[0].as_py()
        for pairs, n in zip(table.column("pairs").to_pylist(), table.column("n").to_pylist(), strict=True):
            total[np.frombuffer(pairs, np.uint32).astype(np.int64) - row * size] += np.frombuffer(n, np.int64)
        some = np.flatnonzero(total)
        return pa.table({"row": pa.array([row], pa.int32()), "pairs": pa.array([(some + row * size).astype(np.uint32).tobytes()], pa.binary()), "n": pa.array([total[some].tobytes()], pa.binary())})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(bigrams: np.ndarray, words: int, classes: int, fixed: np.ndarray) -> np.ndarray:
    """Class of each id.  Ids below `words` (most frequent first) move among the classes [0, classes) until none moves; the class of others is fixed."""
    n = len(bigrams)
    label = np.r_[np.arange(words) % max(1, classes), fixed].astype(np.int64)
    k = int(max(label.max(initial=0) + 1, classes))
    onehot = np.zeros((n, k))
    onehot[np.arange(n), label] = 1
    m = bigrams.astype(float)
    right, left = m @ onehot, m.T @ onehot  # of each id with each class after and before it
    cells = onehot.T @ right
    # a move has to gain more than rounding can feign, or words could move in circles
    least = 1e-9 + 1e-12 * float(_xlogx(m.sum()))
    moved = 1
    while moved:
        moved = 0
        for w in range(words):
            a, s = label[w], m[w, w]
            r, l = right[w].copy(), left[w].copy()
            cells[a] -= r
            cells[:, a] -= l
            cells[a, a] += s
            r[a] -= s
            l[a] -= s
            # what comes before w is in the rows of other classes, wherever w goes, and what comes after it in their columns
            rows, cols = cells.sum(1) + l, cells.sum(0) + r
            logs = _xlogx(cells)
            new_r, new_l = _xlogx(cells + r[None, :]) - logs, _xlogx(cells + l[:, None]) - logs
            d = np.arange(k)
            diagonal = _xlogx(cells[d, d] + r + l + s) - logs[d, d]
            gain = new_r.sum(1) - new_r[d, d] + new_l.sum(0) - new_l[d, d] + diagonal
            gain -= _xlogx(rows + r.sum() + s) - _xlogx(rows) + _xlogx(cols + l.sum() + s) - _xlogx(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + least:
                b = a
            cells[b] += r
            cells[:, b] += l
            cells[b, b] += s
            if b != a:
                moved += 1
                label[w] = b
                right[:, a] -= m[:, w]
                right[:, b] += m[:, w]
                left[:, a] -= m[w]
                left[:, b] += m[w]
    return label


def rare_words(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability, within a shape class, of a word seen once and of an unseen one.

    Good-Turing: the unseen have the mass of words seen once, and these that of words seen twice."""
    once, twice = sums[2, :SHAPES].astype(float), sums[3, :SHAPES].astype(float)
    unseen = (once + 0.5) / (once + 2 * twice + 1)
    return np.log10((1 - unseen) / np.maximum(once, 1)), np.log10(unseen)


class Model:
    """log10 transitions [class, class], and log10 of the number of training tokens of each learned class (0 for others)."""

    def __init__(self, cells: np.ndarray, classes: int) -> None:
        k = len(cells)
        share = (cells.sum(0) + 0.5) / (cells.sum() + 0.5 * k)
        self.step = np.log10((cells + TAU * share[None, :]) / (cells.sum(1, keepdims=True) + TAU))
        self.size = np.zeros(k)
        self.size[:classes] = np.log10(np.maximum(cells.sum(0)[:classes], 1))

    def score(self, ids: bytes, seen: float) -> float:
        label = np.frombuffer(ids, np.uint8)
        before = np.r_[len(self.step) - 1, label[:-1]]
        return float(self.step[before, label].sum() - self.size[label].sum() + seen)


def _bigrams(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of pair counts: size * size cells at most reach the driver."""
    out = np.zeros(size * size)
    for x in rows.mapInArrow(_sum_pairs(size), "row int, pairs binary, n binary").groupBy("row").applyInArrow(_merge_row(size), "row int, pairs binary, n binary").collect():
        out[np.frombuffer(x.pairs, np.uint32)] = np.frombuffer(x.n, np.int64)
    return out.reshape(size, size)


def score(docs: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    scratch, share = P.Scratch(spark), spark.sparkContext.broadcast
    blocked, _ = P.with_blocks(docs)
    parts = P.shuffle_parts(spark)
    counts = blocked.groupBy("block").applyInArrow(_count_block(parts), _RUN)
    summed = scratch.stored(counts.groupBy("part").applyInArrow(_sum_part(frequent), _RUN), "counts")
    stats = summed.where("kind = 2").select("blob")
    top = stats.coalesce(max(1, int(parts**0.5))).mapInArrow(_top_rows(frequent), "key long, check long, n long, shape int").orderBy(F.desc("n"), "key").limit(frequent).toPandas()
    by_shape = stats.mapInArrow(_sum_rows, "kind int, shape int, n long").groupBy("kind", "shape").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((4, SHAPES + 1), np.int64)
    sums[by_shape["kind"], by_shape["shape"]] = by_shape["n"]
    n_all, v_all = int(sums[0].sum()), int(sums[1].sum())
    keys = tuple(top[c].to_numpy(np.int64).view(np.uint64) for c in ("key", "check"))
    words = len(top)
    replies = summed.where("kind = 1")
    each = lambda f, schema, said: blocked.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(f, schema)
    # the frequent words: each is a label of its own until they are clustered
    alone = np.arange(words + SHAPES + 1)
    bigrams = _bigrams(each(_pairs_block(parts, share((keys, alone))), "ids binary", replies), len(alone))
    classes = min(classes, words)
    labels = exchange(bigrams, words, classes, classes + np.arange(SHAPES + 1))
    size = classes + SHAPES + 1
    onehot = np.zeros((len(alone), size))
    onehot[alone, labels] = 1
    said = replies
    if classes:
        known = share((keys, labels, size, classes, onehot.T @ bigrams @ onehot))
        profiles = each(_profile_block(parts, known), _RUN, replies)
        said = replies.unionAll(scratch.stored(profiles.groupBy("part").applyInArrow(_assign(known), _RUN), "classes"))
    coded = "kind int, doc_id long, n_tokens long, n_known long, base_score double, seen double, ids binary"
    encoded = P.stored(each(_encode_block(parts, share((keys, labels, size, n_all, v_all, *rare_words(sums)))), coded, said), "encoded")
    model = share(Model(_bigrams(encoded.where("kind = 1").select("ids"), size), classes))
    for path in list(scratch.paths):
        P.remove(spark, path)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = [model.value.score(x, s) for x, s in zip(b.column("ids").to_pylist(), b.column("seen").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(~learned(np.array(ids, np.int64)), pa.bool_()), b.column("n_tokens"), b.column("n_known"), pa.array([n_all] * len(ids), pa.int64()), b.column("base_score"), pa.array(found, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.where("kind = 0").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
