"""MinHash near-dedup with sequential Bayesian verification.

Documents are linked if their sets of word shingles have a Jaccard similarity
of at least `percent` / 100; a class is what links connect.

1. Equal sets are one node at once, whatever their number.  Two 64-bit hashes
   of each shingle, made from 128-bit identities of its words, go into a
   128-bit digest of the set.
2. Signatures of HASHES minima; bands of ROWS put nodes that are likely to be
   similar in one bucket.
3. In every bucket all members are compared with its least node.  No pairs
   within the bucket are formed.
4. A pair's signatures are compared a batch at a time.  After each, the
   posterior (uniform prior) that the similarity reaches the threshold is
   looked up; below `miss` the pair is dropped.
5. The best survivor of each node is verified on the full sets, made again from
   the texts; a star of thousands is verified in salted parts.
6. Members of buckets that then still hold several classes are compared by
   signature within the bucket, in blocks of members; a pair is looked at in
   the first band that it shares.  Those that survive with a member of another
   class are verified where they meet, and only a link for each joining of
   classes leaves a block.  Nothing is capped.

Null text and text without words are an empty set, linked with nothing.  Rows
without doc_id are left out.  Rows that repeat a doc_id each have a set and a
row in the result.  Further columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P
from tidemark.llm.components import roots

HASHES, ROWS, BATCH = 128, 4, 16
#: Chance with which a pair at the threshold may be dropped by its signatures.
MISS = 1e-6
#: Members of a bucket whose signatures are compared in one block, members of a star that are verified in one part, and their shingles in all.
BLOCK, STAR, STAR_SHINGLES = 1024, 256, 1 << 18
_A = P.mix(np.arange(1, HASHES + 1, dtype=P.U64)) | P.U64(1)
_B = P.mix(np.arange(1001, HASHES + 1001, dtype=P.U64))


def _shingles(buf: np.ndarray, offsets: np.ndarray, size: int):
    """The two hashes of every shingle of each document, in the order of the text."""
    _, _, low, high, begins = P.words_of(P.lower_ascii(buf), offsets)
    grams = [P.word_grams(w, size) for w in (low, high)]
    for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False):
        if b - a >= size:
            yield grams[0][a:b - size + 1], grams[1][a:b - size + 1]
        elif b > a:  # fewer words: the whole sequence; its length keeps it from others
            yield tuple(P.word_grams(w[a:b], b - a) ^ P.U64(b - a) for w in (low, high))
        else:
            yield low[:0], high[:0]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sorted distinct shingle hashes of each document, one after another, their numbers, and a 128-bit digest of each set."""
    sets, digests = [], []
    for low, high in _shingles(buf, offsets, size):
        sets.append(np.unique(low))
        digests.append(hashlib.blake2b(sets[-1].tobytes() + np.unique(high).tobytes(), digest_size=16).digest())
    return np.concatenate(sets) if sets else np.empty(0, P.U64), np.array([len(s) for s in sets], np.int64), digests


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[documents, HASHES] the low halves of 32-bit minima; all ones for an empty set."""
    out = np.full((len(sizes), HASHES), 0xFFFF, np.uint16)
    some = np.flatnonzero(sizes)
    if len(some):
        begins = (np.cumsum(sizes) - sizes)[some]
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(((sets * _A[k] + _B[k]) >> P.U64(32)).astype(np.uint32), begins).astype(np.uint16)
    return out


def _sketch(size: int):
    def run(batches):
        for batch in batches:
            buf, offsets = P.utf8(batch.column("text"))
            for a, b in P.slices(offsets):
                sets, sizes, digests = shingle_sets(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                sign = signatures(sets, sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in sign], pa.binary())], names=["doc_id", "text_key", "n_shingles", "digest", "sign"])

    return run


def keep_table(percent: int, miss: float) -> np.ndarray:
    """For each batch the least number of equal hashes with which a pair stays."""
    x = np.linspace(0, 1, 20_001)[1:-1]
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        least = 0
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= percent / 100 - 1e-12].sum() / p.sum() >= miss:
                least = m
                break
        else:
            least = n + 1
        out.append(least)
    return np.array(out)


def sequential(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signatures stay, and how many hashes they share."""
    alive, same = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, need in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        same[alive] += (left[alive, cut] == right[alive, cut]).sum(1)
        alive = alive[same[alive] >= need]
        if not len(alive):
            break
    keep = np.zeros(len(left), bool)
    keep[alive] = True
    return keep, same


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def band_keys(sign: np.ndarray) -> np.ndarray:
    rows = sign.reshape(len(sign), -1, ROWS).astype(P.U64)
    key = np.arange(rows.shape[1], dtype=P.U64)[None, :].repeat(len(sign), 0)
    for r in range(ROWS):
        key = P.mix(key * P.U64(P.WORD_BASE) + rows[:, :, r])
    return key.view(np.int64)


def _bands(batches):
    for b in batches:
        if b.num_rows:
            keys = band_keys(_matrix(b.column("sign")))
            node = np.repeat(b.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(node, pa.int64())], names=["bucket", "node"])


def _near_in_size(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _prune(least: np.ndarray, percent: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                keep, same = sequential(_matrix(b.column("a_sign")), _matrix(b.column("b_sign")), least)
                keep &= _near_in_size(b.column("a_size").to_numpy(), b.column("b_size").to_numpy(), percent)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask), pa.array(same[keep], pa.int64())], names=["a", "b", "same"])

    return run


def _across(left: pa.Table, right: pa.Table, least: np.ndarray, percent: int):
    """For each member on the left: the members on the right that are of another class and may be similar, and how many hashes they share.

    A pair that also shares an earlier band is left to that bucket."""
    a, b = _matrix(left.column("sign")), _matrix(right.column("sign2"))
    a_root, b_root, a_size, b_size = (t.column(c).to_numpy() for t, c in ((left, "root"), (right, "root2"), (left, "size"), (right, "size2")))
    a_band, b_band = band_keys(a), band_keys(b)
    own = int(np.flatnonzero(a_band[0] == left.column("bucket")[0].as_py())[0])
    for i in range(len(a)):
        other = np.flatnonzero((b_root != a_root[i]) & _near_in_size(b_size, a_size[i], percent))
        if own:
            other = other[~(b_band[other, :own] == a_band[i, :own]).any(1)]
        if len(other):
            keep, same = sequential(np.broadcast_to(a[i], (len(other), HASHES)), b[other], least)
            yield i, other[keep], same[keep]


def _flag(least: np.ndarray, percent: int):
    """The members of a bucket that may be similar to one of another class."""
    def run(key, left, right):
        found: set[int] = set()
        bucket = 0
        if left.num_rows and right.num_rows:
            bucket = left.column("bucket")[0].as_py()
            a_node, b_node = left.column("node").to_pylist(), right.column("node2").to_numpy()
            for i, other, _ in _across(left, right, least, percent):
                if len(other):
                    found.add(a_node[i])
                    found.update(b_node[other].tolist())
        return pa.table({"bucket": pa.array([bucket] * len(found), pa.int64()), "node": pa.array(sorted(found), pa.int64())})

    return run


def _link_across(least: np.ndarray, percent: int, size: int):
    """Links between the classes of some nodes and of one block of their bucket, as (u, v) of their roots.

    Pairs that their signatures can't exclude are verified on the full sets,
    likeliest first; a pair whose classes are joined already is skipped, so
    that a block gives one link for each joining of classes, not all its pairs."""
    def run(key, left, right):
        found = []
        if left.num_rows and right.num_rows:
            a_root, b_root = left.column("root").to_pylist(), right.column("root2").to_pylist()
            _, label = np.unique(np.r_[a_root, b_root], return_inverse=True)
            a_class, b_class = label[:len(a_root)].copy(), label[len(a_root):].copy()
            sets: dict[int, tuple] = {}
            texts, others = left.column("text"), right.column("text2")
            for i, other, same in _across(left, right, least, percent):
                own = None
                for j in other[np.argsort(-same, kind="stable")].tolist():
                    if b_class[j] == a_class[i]:
                        continue
                    own = own or full_set(texts[i].as_py(), size)
                    if j not in sets:
                        sets[j] = full_set(others[j].as_py(), size)
                    if similar(own, sets[j], percent):
                        found.append((a_root[i], b_root[j]))
                        was, now = b_class[j], a_class[i]
                        a_class[a_class == was] = now
                        b_class[b_class == was] = now
        return _links(found)

    return run


def _links(found: list[tuple[int, int]]) -> pa.Table:
    cols = list(zip(*found, strict=True)) or [(), ()]
    return pa.table({"u": pa.array(cols[0], pa.int64()), "v": pa.array(cols[1], pa.int64())})


def full_set(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text by their two hashes, sorted by the first."""
    raw = np.frombuffer(text.encode(), np.uint8)
    low, high = next(_shingles(raw, np.array([0, len(raw)]), size))
    low, index = np.unique(low, return_index=True)
    return low, high[index]


def similar(a: tuple, b: tuple, percent: int) -> bool:
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]) or 100 * len(a[0]) < percent * len(b[0]):
        return False
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum())
    return 100 * both >= percent * (len(a[0]) + len(b[0]) - both)


def _verify(percent: int, size: int):
    def run(key, left, right):
        """left: the texts of a star's members, right: the centre's."""
        found = []
        if left.num_rows and right.num_rows:
            centre = full_set(right.column("centre")[0].as_py(), size)
            for node, text in zip(left.column("a").to_pylist(), left.column("text"), strict=True):
                if similar(full_set(text.as_py(), size), centre, percent):
                    found.append((node, key[0].as_py()))
        return _links(found)

    return run


def _texts(scratch: P.Scratch, wanted: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Stored texts (node, text) of some nodes, by the row that stands for each."""
    wanted = scratch.stored(wanted.join(nodes.select("node", "doc_id", "text_key"), "node"), "wanted")
    out = scratch.stored(source.join(P.lookup(wanted), ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"]), "texts")
    scratch.drop(wanted)
    return out


def verified(scratch: P.Scratch, pairs: DataFrame, nodes: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough, as (u, v)."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / STAR), F.ceil(F.col("shingles") / STAR_SHINGLES))
    sized = pairs.join(nodes.select(F.col("node").alias("a"), "size"), "a")
    stars = sized.groupBy("b").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    dealt = scratch.stored(pairs.join(stars, "b").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part")), "pairs")
    texts = _texts(scratch, dealt.select(F.col("a").alias("node")).union(dealt.select("b")).distinct(), nodes, source)
    members = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text")
    # other names than on the left, or Spark takes them for the same columns
    centres = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("node", "b"), "b").select(F.col("b").alias("c"), F.col("part").alias("c_part"), F.col("text").alias("centre"))
    out = scratch.stored(members.groupBy("b", "part").cogroup(centres.groupBy("c", "c_part")).applyInArrow(_verify(percent, size), "u long, v long"), "links")
    scratch.drop(dealt, texts)
    return out


def _rooted(members: DataFrame, root: DataFrame) -> DataFrame:
    """members with the root of their node; a node without links is its own root."""
    of = root.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return members.join(of, F.col("node") == F.col("_n"), "left").select(*members.columns, F.coalesce("_r", "node").alias("root"))


def _mixed(scratch: P.Scratch, members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (bucket, node, root) of buckets with several classes, as two sides for a comparison in blocks.

    Every member is on the right once; those outside the largest class of the bucket are on the left of every block."""
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("of_root"))
    major = sizes.groupBy("bucket").agg(F.sum("of_root").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("of_root", "root")).alias("major")).where("roots > 1")
    own = members.join(major, "bucket").select("bucket", "node", "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), (F.col("root") != F.col("major")).alias("minor"))
    own = scratch.stored(own.join(nodes.select("node", "size", "sign"), "node"), "mixed")
    right = own.select(*(F.col(c).alias(f"{c}2") for c in ("bucket", "node", "root", "size", "sign")), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("i2"))
    left = own.where("minor").select("bucket", "node", "root", "size", "sign", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    return left, right


def _class_of_rows(scratch: P.Scratch, docs: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """doc_id, text_key, n_shingles, and the least (doc_id, text_key) of the class as `first`, of every row with a doc_id; null for an empty set."""
    least = keep_table(percent, miss)
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", P.text_key())
    sketches = scratch.stored(source.mapInArrow(_sketch(size), "doc_id long, text_key binary, n_shingles long, digest binary, sign binary"), "sketches")
    equal = sketches.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.max("n_shingles").alias("size"), F.min("sign").alias("sign"))
    # the numbers are fixed once they are written
    nodes = scratch.stored(equal.select(F.monotonically_increasing_id().alias("node"), "digest", "row.doc_id", "row.text_key", "size", "sign"), "nodes")
    buckets = nodes.select("node", "sign").mapInArrow(_bands, "bucket long, node long")
    star = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1").drop("n")
    shared = scratch.stored(buckets.join(star, "bucket"), "buckets")
    pairs = shared.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    survivors = _signed(pairs, nodes).mapInArrow(_prune(least, percent), "a long, b long, same long")
    best = scratch.stored(survivors.groupBy("a").agg(F.max(F.struct("same", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "best")
    links = verified(scratch, best, nodes, source, size, percent)
    root = roots(links, scratch)
    scratch.drop(best, links)
    left, right = _mixed(scratch, _rooted(shared.select("bucket", "node"), root), nodes)
    near = scratch.stored(left.groupBy("bucket", "i").cogroup(right.groupBy("bucket2", "i2")).applyInArrow(_flag(least, percent), "bucket long, node long").distinct(), "near")
    scratch.drop(shared)
    if near.limit(1).count():
        left, right = _mixed(scratch, _rooted(near, root), nodes)
        texts = _texts(scratch, near.select("node").distinct(), nodes, source)
        left, right = left.join(texts, "node"), right.join(texts.select(F.col("node").alias("node2"), F.col("text").alias("text2")), "node2")
        extra = scratch.stored(left.groupBy("bucket", "i").cogroup(right.groupBy("bucket2", "i2")).applyInArrow(_link_across(least, percent, size), "u long, v long"), "extra")
        # only the roots of classes that are joined get another one, and with them their members
        new = roots(extra, scratch)
        moved = new.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        root = root.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")).unionByName(new)
    # a root isn't listed as a node of its class, nor is a node without links
    whole = _rooted(nodes.select("node", "digest", F.struct("doc_id", "text_key").alias("row")), root)
    linked = whole.where("node <> root").select("root").distinct()
    alone = whole.join(linked, "root", "left_anti").select("digest", F.col("row").alias("first"))
    joined = scratch.stored(whole.join(linked, "root", "left_semi"), "joined")
    named = joined.groupBy("root").agg(F.min("row").alias("first"))
    class_of = alone.unionByName(joined.join(named, "root").select("digest", "first"))
    return sketches.select("doc_id", "text_key", "n_shingles", "digest").join(class_of.withColumnRenamed("digest", "_d"), (F.col("n_shingles") > 0) & (F.col("digest") == F.col("_d")), "left").select("doc_id", "text_key", "n_shingles", "first")


def classes(docs: DataFrame, size: int = 4, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document with a doc_id."""
    scratch = P.Scratch(docs.sparkSession)
    rows = _class_of_rows(scratch, docs, size, percent, miss)
    # an empty set is linked with nothing
    own = F.coalesce(F.col("first.doc_id"), "doc_id")
    return scratch.finish(rows.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept")), "classes")


def _signed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sign").alias(f"{c}_sign")) for c in "ab")
    return pairs.join(a, "a").join(b, "b")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """The documents but for the near copies: of each class the row with the least doc_id stays, and of those the one with the least digest of its text.

    Rows that agree in doc_id and text are copies too, and any one of them
    stays.  Rows without doc_id, and those without words, stay.  Columns may
    have any name."""
    scratch = P.Scratch(docs.sparkSession)
    rows = scratch.stored(_class_of_rows(scratch, docs, size, percent, miss).where("n_shingles > 0"), "rows")
    # one row for each (doc_id, text): whether it goes, and whether there are several of it
    said = rows.groupBy("doc_id", "text_key", "first").agg(F.count("*").alias("n")).withColumn("gone", F.struct("doc_id", "text_key") != F.col("first"))
    said = scratch.finish(said.where("gone OR n > 1").select("doc_id", "text_key", "gone"), "gone")
    doc, key, of, at = P.fresh(docs, "doc", "key", "of", "at")
    wide = docs.select("*", F.col("doc_id").cast("long").alias(doc), P.text_key().alias(key))
    gone, twice = (said.where(c).select(F.col("doc_id").alias(of), F.col("text_key").alias(at)) for c in ("gone", "NOT gone"))
    same = (F.col(doc) == F.col(of)) & (F.col(key) == F.col(at))
    out = wide.join(P.lookup(gone), same, "left_anti")
    if twice.limit(1).count():
        some = P.lookup(twice)
        out = out.join(some, same, "left_anti").unionByName(out.join(some, same, "left_semi").dropDuplicates([doc, key]))
    return out.select(*docs.columns)
