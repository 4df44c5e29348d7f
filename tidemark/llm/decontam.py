"""Benchmark decontamination by a distributed positional inverted index.

Only DataFrame and SQL functions are used.

1. Every distinct window of the benchmark (n consecutive words; an item of fewer
   words is one window) is looked up by its rarest words.  How often a
   benchmark word stands in the corpus is counted over all documents.
2. The index holds the postings (term, document, position) of all words that
   are among the `rare` rarest of some window, over all documents, and is
   stored in the shared folder.
3. The list of the rarest term is moved back by its offset in the window, which
   gives the starts that a match could have, and intersected with the likewise
   moved lists of the other rare terms: a phrase match of those terms.
4. The starts that remain are compared, word by word, with the text.

A proximity match (all rare terms of a window within `slop` words of where they
should be) is made from the same lists; see near_matches().

Words: A-Z lower-cased, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].  Null text
has no words, null items no windows; rows without doc_id or item_id are left
out.  Rows that repeat a doc_id are told apart by their text, and equal rows
each get their result; items that repeat are one.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P

WINDOW = 10
RARE = 2
#: Rows (window, term, offset) that are sent to all executors; more are joined by a shuffle.
WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows: `window` (its words), window_id (a number; store the table before its use) and the sorted item_ids that hold it."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    # numbers are fixed once the table is written
    each = items.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(0, size(w) - {n})), i -> slice(w, i + 1, {n}))")).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("window_id", F.monotonically_increasing_id())


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_key", F.posexplode("w").alias("pos", "term"))


def _with_key(docs: DataFrame) -> DataFrame:
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key and the words of each document.  The key tells rows of one doc_id apart; equal rows share it."""
    return _with_key(docs).select("doc_id", "doc_key", words(F.col("text")).alias("w"))


def rare_terms(found: DataFrame, docs: DataFrame, rare: int = RARE) -> DataFrame:
    """For each window the `rare` rarest of its distinct terms in the corpus: window_id, order (0: rarest), term, offset."""
    terms = found.select("window_id", F.posexplode("window").alias("offset", "term")).groupBy("window_id", "term").agg(F.min("offset").alias("offset"))
    vocabulary = P.lookup(P.stored(terms.select("term").distinct(), "vocabulary"), WINDOWS)
    counts = _tokens(docs).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rank = F.expr("row_number() OVER (PARTITION BY window_id ORDER BY coalesce(n, 0), term) - 1").alias("nth")
    return terms.join(counts, "term", "left").select("window_id", rank, "term", "offset", F.coalesce("n", F.lit(0)).alias("n")).where(f"nth < {rare}")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_key, pos) of the given distinct terms."""
    return _tokens(docs).join(terms, "term", "left_semi")


def phrase_starts(postings: DataFrame, lookup: DataFrame, rare: int = RARE) -> DataFrame:
    """window_id, doc_key and start at which all looked-up terms stand at their offsets: the lists are intersected from the rarest on."""
    # a term may be that of many postings: they stay where they are, and the few rows of the lookup go to them
    small = P.lookup(lookup, WINDOWS)
    out = postings.join(small.where("nth = 0"), "term").select("window_id", "doc_key", (F.col("pos") - F.col("offset")).alias("start"))
    for k in range(1, rare):
        some = small.where(f"nth = {k}").select(F.col("window_id").alias("_w"), F.col("term").alias("_t"), F.col("offset").alias("_o"))
        probe = out.join(some, F.col("window_id") == F.col("_w"), "left")
        there = postings.select(F.col("term").alias("_term"), F.col("doc_key").alias("_doc"), F.col("pos").alias("_pos"))
        hit = (F.col("_t") == F.col("_term")) & (F.col("doc_key") == F.col("_doc")) & (F.col("start") + F.col("_o") == F.col("_pos"))
        # a window of fewer distinct terms than `rare` has nothing more to intersect
        out = probe.where("_t IS NOT NULL").join(there, hit, "left_semi").unionByName(probe.where("_t IS NULL")).select("window_id", "doc_key", "start")
    return out


def near_matches(postings: DataFrame, lookup: DataFrame, slop: int) -> DataFrame:
    """window_id, doc_key and start near which every looked-up term stands within `slop` words of its offset."""
    moved = postings.join(lookup, "term").select("window_id", "nth", "doc_key", (F.col("pos") - F.col("offset")).alias("at"))
    wanted = lookup.groupBy("window_id").agg(F.count("*").alias("wanted"))
    first = moved.where("nth = 0").select("window_id", "doc_key", F.col("at").alias("start"))
    # both sides are put in cells of slop + 1 words, so that the join is one of equal keys
    cell = slop + 1
    left = first.withColumn("cell", F.explode(F.expr(f"array(floor(start / {cell}) - 1, floor(start / {cell}), floor(start / {cell}) + 1)")))
    both = left.join(moved.withColumn("cell", F.floor(F.col("at") / cell)), ["window_id", "doc_key", "cell"]).where(F.abs(F.col("at") - F.col("start")) <= slop)
    return both.groupBy("window_id", "doc_key", "start").agg(F.countDistinct("nth").alias("met")).join(wanted, "window_id").where("met = wanted").select("window_id", "doc_key", "start")


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, rare: int = RARE) -> DataFrame:
    """Candidate starts of whole windows (doc_key, start, window, items), stored."""
    scratch = P.Scratch(docs.sparkSession)
    source = keyed(docs)
    found = scratch.stored(windows(benchmark, n), "windows")
    lookup = scratch.stored(rare_terms(found, source, rare), "lookup")
    # windows with a term that no document has can't match
    possible = scratch.stored(lookup.join(lookup.where("n = 0").select("window_id").distinct(), "window_id", "left_anti"), "possible")
    terms = P.lookup(possible.select("term").distinct(), WINDOWS)
    postings = scratch.stored(index(source, terms), "postings")
    starts = phrase_starts(postings, possible, rare).where("start >= 0")
    # equal documents share a key: their starts count once
    return scratch.finish(starts.distinct().join(P.lookup(found, WINDOWS), "window_id").select("doc_key", "start", "window", "items"), "starts")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, rare: int = RARE) -> DataFrame:
    """doc_id, n_words, n_hit, items (array), spans (array of start and end word), contaminated of each document."""
    return _judged(docs, benchmark, n, rare).drop("doc_key")


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, rare: int) -> DataFrame:
    candidates = matches(docs, benchmark, n, rare)
    # the candidates are a stored table, so its size is known: Spark sends it to the documents if small, and else sorts both
    starts = candidates.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("start", "window", "items"))).alias("found"))
    real = "filter(found, c -> slice(w, c.start + 1, size(c.window)) = c.window)"
    # texts are smaller than arrays of words: they are split after the join
    joined = _with_key(docs).join(starts, "doc_key", "left").select("doc_id", "doc_key", words(F.col("text")).alias("w"), "found")
    both = joined.select("doc_id", "doc_key", F.size("w").alias("n_words"), F.expr(f"coalesce({real}, array())").alias("found"))
    spans = "transform(found, c -> named_struct('start', cast(c.start as long), 'end', cast(c.start + size(c.window) as long)))"
    # sorted by start: each adds what reaches beyond the greatest end so far
    hit = "aggregate(spans, named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.end - greatest(a.to, s.start)), 'to', greatest(a.to, s.end)), a -> a.n)"
    items = "array_sort(array_distinct(flatten(transform(found, c -> c.items))))"
    out = both.select("doc_id", "doc_key", F.col("n_words").cast("long").alias("n_words"), F.expr(spans).alias("spans"), F.expr(items).alias("items"))
    return out.select("doc_id", "doc_key", "n_words", F.expr(hit).alias("n_hit"), "items", "spans").withColumn("contaminated", F.col("n_hit") > 0)


def digest(found: DataFrame) -> DataFrame:
    """The result with the items as a number and a digest of their ids, sorted as strings."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without a hit; rows without doc_id can't be judged and stay.

    Rows that repeat a doc_id are judged each by its own text; columns may have any name."""
    own, at, of, key = P.fresh(docs, "own", "at", "of", "key")
    bad = P.stored(_judged(docs, benchmark, n, RARE).where("contaminated").select(F.col("doc_id").alias(of), F.col("doc_key").alias(key)).distinct(), "contaminated")
    rows = docs.select("*", F.col("doc_id").cast("long").alias(own), F.col("text").cast("string").alias(at))
    rows = rows.withColumn(at, F.xxhash64(own, at))
    return rows.join(P.lookup(bad), (F.col(own) == F.col(of)) & (F.col(at) == F.col(key)), "left_anti").select(*docs.columns)


#: DuckDB SQL of digest().
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS s FROM (SELECT item_id, w, unnest(range(0, greatest(0, len(w) - 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
