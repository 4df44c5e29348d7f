"""Shared numpy kernels and block layout for the corpus operators.

Documents are cut into *blocks* by ranges of doc_id with about as many bytes of
text each, so that block order is document order.  A block talks to a *part* (a hash bucket of fingerprints) in
one packed binary row, never in a row per fingerprint; a key that is in every
document therefore costs a block one entry however often it occurs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Odd multipliers of the rolling hashes, and their inverses modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BYTE_INV, WORD_INV = pow(BYTE_BASE, -1, 1 << 64), pow(WORD_BASE, -1, 1 << 64)

#: Bytes of text that a kernel handles at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64))


class _Powers:
    """Growing tables of powers."""

    def __init__(self, base: int) -> None:
        self.base, self.table = U64(base), np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            t = np.full(max(n, 2 * len(self.table)), self.base, U64)
            t[0] = 1
            self.table = np.cumprod(t)
        return self.table[:n]


_BP, _BI, _WP, _WI = (_Powers(x) for x in (BYTE_BASE, BYTE_INV, WORD_BASE, WORD_INV))


def rolling(values: np.ndarray, width: int, powers: _Powers, inverse: _Powers) -> np.ndarray:
    """Hashes of all runs of `width` values; one per start that has a whole run."""
    n = len(values)
    if n < width:
        return np.empty(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * powers.upto(n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse.upto(n - width + 1))


def byte_grams(buf: np.ndarray, width: int) -> np.ndarray:
    return rolling(_BYTE_VALUE[buf], width, _BP, _BI)


def word_grams(words: np.ndarray, width: int) -> np.ndarray:
    return rolling(words, width, _WP, _WI)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


#: The separators [\x20\x09-\x0D] of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_places(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of documents that lie one after another in buf, and the first word of each document (with the number of words at the end)."""
    ink = ~space[buf]
    if not ink.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of at most so many bytes are their own identity.
SHORT = 15


def identities(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word, as two arrays of 64: the word itself and its length up to SHORT bytes, else its BLAKE2b digest.

    The last byte is the length or 255, so no short word is taken for a long one."""
    if not len(starts):
        return np.empty(0, U64), np.empty(0, U64)
    size = ends - starts
    wide = np.lib.stride_tricks.sliding_window_view(np.r_[buf, np.zeros(16, np.uint8)], 16)[starts]
    wide = np.where(np.arange(16) < size[:, None], wide, np.uint8(0))
    wide[:, 15] = np.minimum(size, 255)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = buf.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=15).digest() + b"\xff" for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        wide[long] = np.frombuffer(digests, np.uint8).reshape(-1, 16)
    both = wide.view(U64)
    return both[:, 0].copy(), both[:, 1].copy()


def words_of(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents that lie one after another in buf.

    Returns start and end of each word, two 64-bit hashes of its identity that
    have nothing in common, and the first word of each document (with the
    number of words at the end).  Words differ in the pair of hashes unless 128
    bits agree by chance."""
    starts, ends, begins = word_places(buf, offsets, space)
    a, b = identities(buf, starts, ends)
    return starts, ends, mix(mix(a) + b * U64(0xC2B2AE3D27D4EB4F)), mix(mix(b ^ U64(0x165667B19E3779F9)) + a * U64(0x9FB21C651E98DF25)), begins


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences; high planes are mostly zero."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    size = max(1, (int(d[1:].max() if len(d) > 1 else 0).bit_length() + 7) // 8)
    planes = d[1:].view(np.uint8).reshape(-1, 8)[:, :size]
    return bytes([size]) + keys[:1].tobytes() + np.ascontiguousarray(planes.T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if len(blob) <= 1:
        return np.empty(0, U64)
    size, n = blob[0], (len(blob) - 9) // blob[0]
    d = np.zeros((n + 1, 8), np.uint8)
    d[0] = np.frombuffer(blob, np.uint8, 8, 1)
    d[1:, :size] = np.frombuffer(blob, np.uint8, n * size, 9).reshape(size, n).T
    return np.cumsum(d.view(U64)[:, 0], dtype=U64)


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(raw: bytes) -> bytes:
    """Compressed bytes, with their length before."""
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unsqueeze(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return _ZSTD.decompress(blob[8:], n, asbytes=True) if n else b""


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The ranges of sorted 64-bit keys that belong to each part; parts split the key space evenly."""
    width = (1 << 64) // parts
    cuts = np.searchsorted(keys, np.array([i * width for i in range(1, parts)], U64))
    edges = [0, *cuts.tolist(), len(keys)]
    for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            yield p, slice(a, b)


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted: both halves, where each first stands, and the number of each pair given."""
    keys, index, inverse = np.unique(low, return_index=True, return_inverse=True)
    if (high[index][inverse] == high).all():
        return keys, high[index], index, inverse
    order = np.lexsort((high, low))
    a, b = low[order], high[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    inverse = np.empty(len(low), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[new], b[new], order[new], inverse


def found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


#: Folders made by this process and not removed yet.
_MADE: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster (spark.checkpoint.dir).

    Only on a local master may that setting be absent, as in tests: elsewhere
    a local folder would be another one on each machine, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file:///tmp/tidemark-checkpoints"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and no executor holds a copy of its own."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a workspace folder, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def made() -> list[str]:
    """The workspace folders of this process that are there now."""
    return list(_MADE)


def sweep(spark: SparkSession, keep: list[str]) -> None:
    """Delete all workspace folders of this process but `keep`: for a job whose results so far are elsewhere."""
    for path in [p for p in _MADE if p not in keep]:
        remove(spark, path)


class Scratch:
    """Stored tables of one operator.  drop() deletes those that nothing reads any more, finish() all but the result."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        self.paths.append(out.tidemark_path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.paths.remove(t.tidemark_path)
            remove(self.spark, t.tidemark_path)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
        return out


#: Rows of a few numbers each that are sent to all executors; a table of more is joined by a shuffle.
LOOKUP = 1_000_000


def lookup(df: DataFrame, most: int = LOOKUP) -> DataFrame:
    """A stored table of narrow rows with a hint to broadcast it, if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Those names, or longer ones if df has columns with them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: str = "text") -> Column:
    """A 128-bit digest of a text, which tells rows of one doc_id apart; null for null."""
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Documents that the bounds of blocks are made from, a block, and bytes of text that a task deals out at once.
PER_BLOCK, DEAL_BYTES = 64, 32 << 20
_PACKED = "block long, ids binary, sizes binary, texts binary"


def block_cuts(docs: DataFrame, blocks: int) -> np.ndarray:
    """Least doc_id of each block but the first, so that blocks have about the same bytes of text.

    The bounds come from a sample of about PER_BLOCK documents a block, each
    chosen with a chance that is proportional to its bytes; they only decide
    where documents lie.  Rows of one doc_id are never split."""
    size = F.octet_length("text").cast("long") + 16
    total = docs.agg(F.sum(F.coalesce(size, F.lit(16)))).first()[0] or 0
    if not total:
        return np.empty(0, np.int64)
    step = max(1, total // (PER_BLOCK * blocks))
    row = docs.select("doc_id", F.coalesce(size, F.lit(16)).alias("size"))
    some = row.where(F.pmod(F.xxhash64("doc_id", "size"), F.lit(step)) < F.col("size")).select("doc_id", F.greatest("size", F.lit(step)).alias("size")).toArrow()
    ids, size = (some.column(c).to_numpy() for c in ("doc_id", "size"))
    if not len(ids):
        return np.empty(0, np.int64)
    order = np.argsort(ids, kind="stable")
    ids, reach = ids[order], np.cumsum(size[order])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, blocks) // blocks)
    cuts = np.unique(ids[np.minimum(at, len(ids) - 1)])
    return cuts


def _deal(cuts: np.ndarray):
    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        block = np.searchsorted(cuts, table.column("doc_id").to_numpy(), "right")
        if (np.diff(block) < 0).any():
            order = np.argsort(block, kind="stable")
            table, block = table.take(pa.array(order)), block[order]
        ids = table.column("doc_id").to_numpy()
        buf, offsets = utf8(table.column("text"))
        names, first = np.unique(block, return_index=True)
        rows = [(ids[a:z].tobytes(), np.diff(offsets[a:z + 1]).astype("<u4").tobytes(), squeeze(buf[offsets[a]:offsets[z]].tobytes())) for a, z in zip(first, [*first[1:], len(ids)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["block", "ids", "sizes", "texts"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > DEAL_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def with_blocks(docs: DataFrame, blocks: int | None = None) -> tuple[DataFrame, int]:
    """Documents as packed rows of blocks, and the number of blocks at most.

    A row holds some documents of one block, their texts compressed, so that
    an exchange of blocks takes half of what the texts take.  The number of
    blocks follows the shuffle partitions, so that it grows with the cluster's
    setting for the input.  Rows without a doc_id can't be addressed in a
    result and are left out."""
    n = blocks or 5 * shuffle_parts(docs.sparkSession) // 2
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return d.mapInArrow(_deal(block_cuts(d, n)), _PACKED), n


def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes and offsets of a block in the order of doc_id, rows with one doc_id in that of their text."""
    rows = []
    for ids, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "texts")), strict=True):
        own = np.frombuffer(sizes, "<u4").astype(np.int64)
        rows.append((np.frombuffer(ids, np.int64), own, unsqueeze(texts)))
    rows.sort(key=lambda r: int(r[0][0]))
    ids = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int64)
    offsets = np.r_[0, np.cumsum(np.concatenate([r[1] for r in rows]))] if rows else np.zeros(1, np.int64)
    buf = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    if len(ids) > 1 and not (ids[1:] > ids[:-1]).all():
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf)])
        both = pa.table({"doc_id": ids, "text": texts}).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids, (buf, offsets) = both.column("doc_id").to_numpy(), utf8(both.column("text"))
    return ids, buf, offsets
