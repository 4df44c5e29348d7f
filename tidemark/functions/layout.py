"""Boxes, pans and caption clocks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fitted(x: Column, y: Column, w: Column, h: Column, aspect: float) -> Column:
    """The largest centred box of an aspect (width / height) inside a box."""
    fit_w, fit_h = F.least(w, h * aspect), F.least(h, w / aspect)
    return F.struct((x + (w - fit_w) / 2).alias("x"), (y + (h - fit_h) / 2).alias("y"), fit_w.alias("w"), fit_h.alias("h"))


def blended(a: Column, b: Column, share: Column) -> Column:
    """From a to b by a share that is held in [0, 1]."""
    return a + (b - a) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def ramp(v: Column, low: float, high: float, base: float, top: float) -> Column:
    """base up to `low`, top from `high` on, a line between; base if high isn't above low."""
    return blended(F.lit(base), F.lit(top), (v - low) / (high - low)) if high > low else F.lit(base)


def caption_time(seconds: Column) -> Column:
    """h:mm:ss.cc"""
    c = F.round(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360_000), F.floor(c / 6_000) % 60, F.floor(c / 100) % 60, c % 100)


def caption_colour(r: Column, g: Column, b: Column, a: Column) -> Column:
    """&HAABBGGRR, in which alpha is transparency."""
    return F.format_string("&H%02X%02X%02X%02X", 255 - a, b, g, r)


def person(track: Column) -> Column:
    """Person A to Z, and again from A."""
    return F.concat(F.lit("Person "), F.chr(F.lit(65) + track % 26))


def plain_dashes(title: Column) -> Column:
    return F.translate(title, "–—", "--")


def caption_text(text: Column) -> Column:
    """Text that a subtitle shows as typed: braces escaped, a backslash parted from what follows, newlines as breaks."""
    apart = F.replace(text, F.lit("\\"), F.lit("\\\u200b"))
    return F.replace(F.replace(F.replace(F.replace(apart, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\N"))


# Characters and device names that file names can't have.
_RESERVED, _DEVICES = r'[<>:"/\\|?*\x00-\x1F]', r"(?i)^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])(\.|$)"


def segment_name(raw: Column, fallback: str, chars: int) -> Column:
    """A part of a file name: reserved characters as _, blanks single, at most `chars` characters, no dot or blank at an end; the fallback for null or nothing."""
    one = F.regexp_replace(F.regexp_replace(raw, _RESERVED, "_"), r"\p{IsWhite_Space}+", " ")
    cut = F.regexp_replace(F.substring(F.trim(one), 1, chars), r"^[.\p{IsWhite_Space}]+|[.\p{IsWhite_Space}]+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(fallback)).when(F.rlike(cut, F.lit(_DEVICES)), F.concat(F.lit("_"), cut)).otherwise(cut)
