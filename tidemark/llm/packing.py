"""Packing by minimum bin slack.

Every document becomes token ids (by a public vocabulary) and an end id.  It is
cut into whole windows of `size` ids and a remainder.  What is left to pack are
the remainders, and of these only how many there are of each length: a multiset
of at most size - 1 numbers, however many documents there are.

Each window is filled by the multiset of remaining lengths whose sum is closest
to its capacity.  A bitset holds all sums that can be reached (bit s: sum s);
lengths enter it longest first, a length with count c by shifts of 1, 2, 4 ...
copies, so that counts are respected.  The highest bit is the best fill, and
walking the saved bitsets backwards gives the counts of each length.  A filling
is used as often as its counts last, so the plan has few distinct fillings.

A window whose best fill has slack is closed by a cut: as many ids are cut from
the front of a longer remainder, and what is left of it is a remainder again.
The last 64 windows that can't be filled are laid end to end and cut again: whole
windows first, then pieces whose lengths are powers of two, which need no
padding.  The ids of remainders are stored, so no document is tokenised twice.

Documents: null text is empty (only the end id); rows without doc_id are packed
like others; rows that repeat a doc_id are documents of their own; further
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P

SIZE, END = 2048, 1
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_ENCODERS: dict = {}


def _encoder(vocabulary: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken.

    Both give the same ids (tests compare them); this one is six times as fast
    on words that it hasn't seen.  The ranks are read from the file itself."""
    if vocabulary not in _ENCODERS:
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        # the printable stand-ins of bytes in byte-level BPE files
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(stand[c] for c in token): i for token, i in vocab.items() if all(c in stand for c in token)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in special.values()}
        _ENCODERS[vocabulary] = tiktoken.Encoding(base64.b32encode(vocabulary.encode()).decode(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[vocabulary]


def encode(texts: list[str | None], vocabulary: str, end: int = END, special: bool = False) -> list[np.ndarray]:
    """Ids of each text and the end id.  With `special`, the file's added tokens in a text have their own ids, as in the library's default; else they are ordinary text."""
    encoder = _encoder(vocabulary)
    ids = (lambda t: encoder.encode(t, allowed_special="all")) if special else encoder.encode_ordinary
    return [np.append(np.array(ids(t or ""), "<u4"), np.array([end], "<u4")) for t in texts]


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that the sum is the greatest one of at most `capacity`.

    The longest length left is always in it, so that none remains for the end."""
    lengths = sorted((n for n, c in counts.items() if c > 0 and n <= capacity), reverse=True)
    if not lengths:
        return {}
    limit = (1 << (capacity + 1)) - 1
    reach, saved = 1 << lengths[0], []
    for i, n in enumerate(lengths):
        left = counts[n] - (i == 0)
        left = min(left, capacity // n)
        step = 1
        while left > 0:
            take = min(step, left)
            saved.append((n, take, reach))
            reach |= (reach << (n * take)) & limit
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    out = {lengths[0]: 1}
    for n, take, before in reversed(saved):
        if not before >> at & 1:
            at -= n * take
            out[n] = out.get(n, 0) + take
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Fillings and how often each is used; and the lengths of what is laid end to end.

    A filling may hold a length n as (n, s): s ids are cut from the front of one
    piece of n, and n - s are left as a piece of their own."""
    left = {n: c for n, c in counts.items() if c > 0}
    total = sum(n * c for n, c in left.items())
    fills = []
    while left:
        fill: dict = best_fill(left, size)
        slack = size - sum(n * c for n, c in fill.items())
        need = fill
        if slack:
            # a window with slack: from here on the rest is too small to be worth a search
            if total <= 64 * size:
                break
            # all lengths outside the filling are longer than the slack, or it would be a better one; of these the most frequent closes the window
            donor = max((n for n, c in left.items() if c > fill.get(n, 0)), key=lambda n: (left[n] // (fill.get(n, 0) + 1), n))
            need = fill | {donor: fill.get(donor, 0) + 1}
            fill = fill | {(donor, slack): 1}
        times = min(left[n] // c for n, c in need.items())
        fills.append((fill, times))
        total -= size * times
        for n, c in need.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        if slack:
            left[donor - slack] = left.get(donor - slack, 0) + times
    return fills, left


class _Pool:
    """The pieces of each length: ranks [low, high) of an original length, from their id `at` on."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.runs = {n: deque([(n, 0, c, 0)]) for n, c in counts.items() if c > 0}

    def put(self, length: int, runs: list[tuple[int, int, int, int]]) -> None:
        self.runs.setdefault(length, deque()).extend(runs)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out, own = [], self.runs[length]
        while n:
            origin, low, high, at = own.popleft()
            if high - low > n:
                own.appendleft((origin, low + n, high, at))
                high = low + n
            out.append((origin, low, high, at))
            n -= high - low
        return out


def plan_rows(counts: dict[int, int], size: int) -> tuple[list[tuple[int, ...]], int, int]:
    """Where pieces go; the number of sequences; and how many ids are left to be laid end to end.

    A row: of ranks [low, high) of a length, `cut` ids from `at` on go to sequences
    from `first` on, `each` to a sequence, the first at `offset`; `skip` others of
    the same place come before.  Rows with `first` -1 are laid end to end from `offset` on."""
    counts = dict(counts)
    whole = counts.pop(size, 0)
    fills, left = plan(counts, size)
    rows, pool, sequence = [(size, 0, whole, 0, size, 0, 1, 0, 0)] if whole else [], _Pool(counts), whole

    def place(runs, cut, first, each, offset):
        skip = 0
        for origin, low, high, at in runs:
            rows.append((origin, low, high, at, cut, first, each, offset, skip))
            skip += high - low

    for fill, times in fills:
        offset, rests = 0, []
        for n, c in fill.items():
            length, cut = n if isinstance(n, tuple) else (n, n)
            runs = pool.take(length, c * times)
            place(runs, cut, sequence, c, offset)
            if cut < length:
                rests.append((length - cut, [(origin, low, high, at + cut) for origin, low, high, at in runs]))
            offset += cut * c
        for length, runs in rests:
            pool.put(length, runs)
        sequence += times
    offset = 0
    for n, c in sorted(left.items()):
        place(pool.take(n, c), n, -1, 1, offset)
        offset += n * c
    return rows, sequence, offset


def _first_pass(vocabulary: str, size: int, end: int):
    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode([text], vocabulary, end, special=True)[0]
                for a in range(0, len(ids), size):
                    piece = ids[a:a + size]
                    for column, v in zip(rows, (doc, a, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.tobytes() if len(piece) < size else None), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (*(pa.int64(),) * 5, pa.binary()), strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def _cut(edges: list[int], sequence: int):
    """Pieces of which only some ids go to a place, or that lie across the edges of the last sequences."""
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            names = ("doc_id", "start", "doc_tokens", "ids", "at", "cut", "sequence_id", "offset")
            for doc, start, tokens, ids, at, cut, to, offset in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                own = np.frombuffer(ids, "<u4")[at:at + cut]
                lo = 0
                while lo < cut:
                    hi, k, begin = cut, to, offset
                    if to < 0:
                        k = int(np.searchsorted(edges, offset + lo, "right")) - 1
                        hi, begin, k = min(edges[k + 1] - offset, cut), offset + lo - edges[k], sequence + k
                    for column, v in zip(out, (doc, start + at + lo, hi - lo, zlib.crc32(own[lo:hi].tobytes()), tokens, k, begin), strict=True):
                        column.append(v)
                    lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, salts: int = 64) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = source.mapInArrow(_first_pass(vocabulary, size, end), _PIECES)
    # a length may be that of many documents: its ranks are counted in salted groups, and a row that repeats has the same rank whichever of its copies bears it
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = P.stored(pieces.withColumn("salt", salt), "pieces")
    sums = {(x.length, x.salt): x["n"] for x in pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()}
    counts: dict[int, int] = {}
    base: list[tuple[int, int, int]] = []
    for (length, s), n in sorted(sums.items()):
        base.append((length, s, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    rows, sequence, tail = plan_rows(counts, size)
    # a few rows for each length; and salts * size of the bases
    places = F.broadcast(spark.createDataFrame(rows or [(0, 0, 0, 0, 0, 0, 1, 0, 0)], "p_length long, low long, high long, at long, cut long, first long, each long, p_offset long, skip long"))
    bases = F.broadcast(spark.createDataFrame(base or [(0, 0, 0)], "b_length long, b_salt int, base long"))
    # the ids go along only for lengths of which some pieces are cut
    opened = sorted({r[0] for r in rows if r[4] < r[0] or r[5] < 0})
    ids = F.when(F.col("length").isin(opened), F.col("ids")) if opened else F.lit(None).cast("binary")
    rank = F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, start, ids_crc32) - 1")
    ranked = pieces.withColumn("ids", ids).withColumn("rank", rank).join(bases, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt"))).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(places, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).withColumn("nth", F.expr("rank - low + skip"))
    kept = (F.col("cut") == F.col("length")) & (F.col("first") >= 0)
    done = placed.where(kept).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.expr("nth div each")).alias("sequence_id"), (F.col("p_offset") + F.expr("(nth % each) * length")).alias("offset"))
    if not opened:
        return done
    edges = [0]
    for n in tail_cuts(tail, size):
        edges.append(edges[-1] + n)
    to = F.when(F.col("first") < 0, -1).otherwise(F.col("first") + F.expr("nth div each")).alias("sequence_id")
    offset = F.when(F.col("first") < 0, F.col("p_offset") + F.expr("nth * cut")).otherwise(F.col("p_offset") + F.expr("(nth % each) * cut")).alias("offset")
    loose = placed.where(~kept).select("doc_id", "start", "doc_tokens", "ids", "at", "cut", to, offset)
    again = loose.mapInArrow(_cut(edges, sequence), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return done.unionByName(again)


def tail_cuts(total: int, size: int) -> list[int]:
    """Lengths of the last sequences: whole windows, then powers of two."""
    out = [size] * (total // size)
    rest = total % size
    return out + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def padding(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """Sequences, ids and padded ids in all: a sequence is padded to `size` unless its length is a power of two."""
    one = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.expr(f"(n & (n - 1)) = 0 OR n = {size}")
    return one.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(power, 0).otherwise(size - F.col("n"))).alias("padded"))
