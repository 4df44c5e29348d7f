"""Scalar text and clock functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence, closers that may follow them, and marks that end one inside a Japanese unit (fixed values).
TERMINAL, CLOSERS, JAPANESE = ".?!…。？！｡‼⁇⁈⁉", "\"')]}」』）»", "。？！｡"


def normalised(text: Column) -> Column:
    """Words of a text after its ASR mark: lower case, anything but letters and digits is a blank."""
    body = F.regexp_replace(text, r"(?s)^.*<asr_text>", "")
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(body), r"[^\p{IsAlphabetic}\p{N}]+", " ")), " "), "")


def core(word: Column) -> Column:
    """A word without what isn't a letter or digit at its ends; empty if nothing is."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def alnum_lower(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def similar(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a) | (F.levenshtein(a, b, 2) >= 0)


def ends_sentence(text: Column, japanese: bool = False) -> Column:
    """Whether a unit ends with a mark and closers after it; a Japanese unit ends a sentence by a mark anywhere in it."""
    last = text.rlike(rf"[{TERMINAL}][{CLOSERS.replace(']', chr(92) + ']')}]*\p{{IsWhite_Space}}*$")
    return last | text.rlike(f"[{JAPANESE}]") if japanese else last


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.round(F.greatest(seconds, F.lit(0.0))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def parse_clock(text: Column) -> Column:
    p = F.split(text, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)).when(F.size(p) == 2, n(0) * 60 + n(1))


def term_hits(text: Column, terms: list[str]) -> Column:
    """Non-overlapping hits of terms in a text, lower-cased."""
    t = F.lower(text)
    return sum(((F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))) / len(x) for x in terms), F.lit(0.0))


def lenient_number(json: Column, path: str) -> Column:
    """A number that may be written as a string."""
    return F.get_json_object(json, path).try_cast("double")


def file_name(text: Column, cap: int = 60) -> Column:
    """Characters that file systems reserve become `_`, blanks collapse, `untitled` if nothing is left."""
    s = F.trim(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"\s+", " "))
    s = F.regexp_replace(F.substring(s, 1, cap), r"[ .]+$", "")
    return F.when(F.length(s) > 0, s).otherwise("untitled")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot product, of unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
