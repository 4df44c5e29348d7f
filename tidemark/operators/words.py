"""Corrections of recognised words, word error rates, and vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stores import edits


def _deletions(word: Column) -> Column:
    """A word and what is left of it without one of its letters: words within one edit share one of these."""
    n = F.length(word)
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), less))


def fuzzy(tokens: DataFrame, store: DataFrame, dictionary: DataFrame, chars: int = 4) -> DataFrame:
    """Tokens (id, token) with the entry (pos, wrong, right) that corrects them.

    An exact entry first; else one within one edit, if it has `chars` letters
    and the token isn't in the dictionary (word); the first in the store on a
    tie.  Joined on shared deletions, never all against all.  Tokens without an
    entry aren't listed."""
    words = tokens.select("token").distinct().join(dictionary.select(F.col("word").alias("token")).distinct().withColumn("known", F.lit(True)), "token", "left")
    left = words.withColumn("part", F.explode(_deletions(F.col("token"))))
    right = store.withColumn("part", F.explode(_deletions(F.col("wrong"))))
    near = left.join(right, "part").where((F.col("token") == F.col("wrong")) | (F.col("known").isNull() & (F.length("wrong") >= chars) & (F.levenshtein("token", "wrong", 1) >= 0)))
    best = near.groupBy("token").agg(F.min(F.struct((F.col("token") != F.col("wrong")).alias("inexact"), "pos", "right")).alias("b"))
    return tokens.join(best, "token").select("id", "token", F.col("b.pos").alias("pos"), F.col("b.right").alias("right"))


def allowed(edits_: DataFrame, curated: DataFrame) -> DataFrame:
    """Proposed edits (wrong, right) that a curated pair allows; deletions and changes of case only are refused."""
    own = edits_.where((F.col("right") != "") & (F.lower("wrong") != F.lower("right"))).withColumn("_w", F.lower("wrong")).withColumn("_r", F.lower("right"))
    return own.join(curated.select(F.lower("wrong").alias("_w"), F.lower("right").alias("_r")).distinct(), ["_w", "_r"], "left_semi").drop("_w", "_r")


def vocabulary(layers: DataFrame) -> DataFrame:
    """Words (layer, pos, word) once each without regard to case: the first spelling, in order, joined by commas."""
    first = layers.where("trim(word) <> ''").groupBy(F.lower("word").alias("_k")).agg(F.min(F.struct("layer", "pos", "word")).alias("x"))
    return first.agg(F.count("*").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["word"]), ", ").alias("prompt"))


def error_counts(pairs: DataFrame) -> DataFrame:
    """(id, want, got) with words joined by blanks: id, ok, sub, del, ins and wer = (sub + del + ins) / words wanted."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            rows = []
            for k, want, got in zip(p["id"], p["want"], p["got"], strict=True):
                a, b = (want or "").split(), (got or "").split()
                n = pd.Series([o for o, *_ in edits(a, b)], dtype=object).value_counts()
                c = [int(n.get(o, 0)) for o in ("ok", "sub", "del", "ins")]
                rows.append((k, *c, sum(c[1:]) / len(a) if a else float(c[3] > 0)))
            yield pd.DataFrame(rows, columns=["id", "ok", "sub", "del", "ins", "wer"])

    return pairs.select("id", "want", "got").mapInPandas(run, "id long, ok long, sub long, del long, ins long, wer double")


#: Entries that a store of phrases may have; it is a list kept by hand, sent to every task.
MOST_PHRASES = 100_000
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_TAIL = regex.compile(r"[^\p{L}\p{N}]*$")


def collapse(units: list[tuple[str, float, float, float]], phrases: list[tuple[list[str], str]]) -> list[tuple[str, float, float, float]]:
    """Units (text, start, end, confidence) in which each phrase, in the order given and from the left, becomes one unit."""
    units = list(units)
    cores = [_EDGE.sub("", u[0]).lower() for u in units]
    for words, right in phrases:
        n, k = len(words), 0
        while words[0] in cores[k:] and (k := cores.index(words[0], k)) + n <= len(units):
            if cores[k:k + n] == words:
                run = units[k:k + n]
                text = right + _TAIL.search(run[-1][0]).group()
                units[k:k + n] = [(text, run[0][1], run[-1][2], min(u[3] for u in run))]
                cores[k:k + n] = [_EDGE.sub("", text).lower()]
            k += 1
    return units


def phrase_collapse(units: DataFrame, by: str, store: DataFrame) -> DataFrame:
    """Units (by, idx, text, start_s, end_s, confidence) with the phrases of a store (pos, wrong, right) collapsed; idx is counted anew from 0.

    Entries of one word and empty ones are passed over.  Null text is empty.  A
    store of more than MOST_PHRASES entries is an error."""
    rows = store.where("coalesce(wrong, '') <> '' AND coalesce(right, '') <> ''").select("pos", "wrong", "right").limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"the store has more than {MOST_PHRASES} entries")
    phrases = [(w, r.right) for r in sorted(rows) if len(w := r.wrong.lower().split()) > 1]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        out = collapse(list(zip(p["text"].fillna(""), p["start_s"], p["end_s"], p["confidence"], strict=True)), phrases)
        return pd.DataFrame([(p[by].iloc[0], k, *u) for k, u in enumerate(out)], columns=[by, "idx", "text", "start_s", "end_s", "confidence"])

    own = units.select(by, F.col("idx").cast("long").alias("idx"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("double").alias(c) for c in ("start_s", "end_s", "confidence")))
    return own.groupBy(by).applyInPandas(run, own.schema)
