"""Caption lines as subtitle documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import layout as L

# The head of the format, and the fields of its lines.
_INFO = "[Script Info]\nScriptType: v4.00+\nPlayResX: {w}\nPlayResY: {h}\nScaledBorderAndShadow: yes\nWrapStyle: 2\n\n"
_STYLES = "[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
_EVENTS = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def pixels(v: float) -> str:
    """Whole numbers bare, others with one decimal; none below 0."""
    v = max(v, 0.0)
    return str(round(v)) if abs(v - round(v)) < 1e-3 else f"{v:.1f}"


def head(font: str = "Arial", size: int = 72, colours: tuple[str, str, str, str] = ("&H00FFFFFF", "&H0000FFFF", "&H00000000", "&H80000000"), bold: bool = True, box: bool = False, outline: float = 6.0, shadow: float = 2.0, width: int = 1080, height: int = 1920) -> str:
    style = ",".join(["Caption", font, str(size), *colours, "-1" if bold else "0", "0,0,0,100,100,0,0", "3" if box else "1", pixels(outline), pixels(shadow), "5,40,40,40,1"])
    return _INFO.format(w=width, h=height) + _STYLES + f"Style: {style}\n\n" + _EVENTS


def documents(lines: DataFrame, by: str, tags: str = "", top: str | None = None) -> DataFrame:
    """Lines (by, idx, layer, start_s, end_s, text) to (by, n_lines, document), in the order of layer, start_s and idx.

    Text is escaped, null is empty; `tags` stand before every text as they are.
    A document is one clip's; its size is that of the clip's captions."""
    at = F.concat(F.lit("Dialogue: "), F.col("layer").cast("string"), F.lit(","), L.caption_time(F.col("start_s")), F.lit(","), L.caption_time(F.col("end_s")), F.lit(f",Caption,,0,0,0,,{tags}"), L.caption_text(F.coalesce("text", F.lit(""))), F.lit("\n"))
    each = lines.select(by, F.struct("layer", "start_s", "idx", at.alias("line")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "")
    return each.groupBy(by).agg(F.count("*").alias("n_lines"), F.concat(F.lit(head() if top is None else top), joined).alias("document"))


# Seconds to read and to hold a caption, how far its sound may
# lag, the part of its peak at which the sound begins, the window of the peak,
# and the bars of silence, relative to the 95th percentile and absolute.
MIN_READ, MAX_HOLD, MAX_LEAD, RISE, PEAK_WINDOW, SILENCE, SILENCE_MOST = 0.40, 1.2, 0.20, 0.30, 0.6, 0.10, 0.006


def refined(units: DataFrame, envelope: DataFrame, by: str, hop: float, scale: float = 1.0, silence_most: float = SILENCE_MOST, keep_silent: bool = False) -> DataFrame:
    """Units (by, idx, start_s) with the sound's envelope (by, k, v) every `hop` seconds: start_s and end_s of those that are heard.

    A unit begins where the envelope reaches RISE of its peak, and ends at the
    next one's start, MAX_HOLD later at most and MIN_READ at least where there is
    room.  Units under the bar of silence go, unless kept.  `scale` stretches
    all times.  Units of a clip without envelope aren't listed."""
    n = envelope.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("v")).alias("_v"))
    loud = n.select(by, "n", F.least(F.lit(SILENCE) * F.expr("_v[least(int(floor(n * 0.95D)), int(n) - 1)]"), F.lit(silence_most)).alias("bar"))
    frame = lambda t: F.least(F.round(t / hop).cast("long"), F.col("n") - 1)
    start = F.col("start_s")
    following = F.greatest(start, F.coalesce(F.expr(f"lead(start_s) OVER (PARTITION BY {by} ORDER BY idx)"), F.col("n") * hop))
    own = units.select(by, "idx", "start_s").join(loud, by).withColumn("next", following).withColumn("k0", frame(start))
    own = own.withColumn("k1", F.least(F.greatest(frame(start + PEAK_WINDOW * scale), F.col("k0") + 1), F.col("n"))).withColumn("k2", frame(F.least(start + MAX_LEAD * scale, F.col("next"))))
    # a few frames for each unit
    near = own.withColumn("k", F.explode(F.sequence("k0", F.greatest("k1", F.col("k2") + 1) - 1))).join(envelope.select(by, "k", "v"), [by, "k"])
    top = near.groupBy(by, "idx").agg(F.max(F.when(F.col("k") < F.col("k1"), F.col("v"))).alias("peak"))
    heard = near.join(top, [by, "idx"]).where((F.col("k") < F.col("k2")) & (F.col("v") >= RISE * F.col("peak"))).groupBy(by, "idx").agg(F.min("k").alias("rise"))
    out = own.join(top, [by, "idx"]).join(heard, [by, "idx"], "left")
    if not keep_silent:
        out = out.where("peak >= bar")
    at = F.least(F.greatest(F.coalesce("rise", F.greatest("k0", "k2")) * hop, start), F.col("next"))
    out = out.withColumn("at", at)
    end = F.least(F.greatest(F.least(F.col("at") + MAX_HOLD * scale, F.col("next")), F.col("at") + MIN_READ * scale), F.col("next"))
    return out.select(by, "idx", F.col("at").alias("start_s"), end.alias("end_s"))


def laugh_trimmed(units: DataFrame, runs: DataFrame, by: str, read: float = MIN_READ) -> DataFrame:
    """Units (by, idx, start_s, end_s) that end where the first laugh (by, from_s, to_s) inside them begins, `read` after their start at least; one that starts in a laugh stays."""
    own = units.select(by, "idx", "start_s", "end_s", F.col("start_s").alias("_t"), F.lit(0).alias("_run"), F.lit(None).cast("double").alias("_from"), F.lit(None).cast("double").alias("_to"))
    laughs = runs.where(F.col(by).isNotNull() & F.col("from_s").isNotNull()).select(by, F.col("from_s").alias("_from"), F.col("to_s").alias("_to")).withColumn("_t", F.col("_from")).withColumn("_run", F.lit(1))
    # in the order of time a unit stands behind the laughs that begin with it: before it are those that may still go on, after it the one that may cut it
    both = own.unionByName(laughs, allowMissingColumns=True)
    past = f"PARTITION BY {by} ORDER BY _t, _run DESC ROWS UNBOUNDED PRECEDING"
    ahead = f"PARTITION BY {by} ORDER BY _t DESC, _run ROWS UNBOUNDED PRECEDING"
    n = both.withColumn("_until", F.expr(f"max(_to) OVER ({past})")).withColumn("_at", F.expr(f"last(_from, true) OVER ({ahead})")).where("_run = 0")
    inside = F.coalesce(F.col("start_s") < F.col("_until"), F.lit(False))
    cut = F.least(F.greatest(F.col("start_s") + read, F.col("_at")), F.col("end_s"))
    return n.select(by, "idx", "start_s", F.when(~inside & (F.col("_at") > F.col("start_s")) & (F.col("_at") < F.col("end_s")), cut).otherwise(F.col("end_s")).alias("end_s"))


def word_state(genre: Column, start: Column, t: Column) -> Column:
    """`hidden`, `base` or `sung`: how a word of a line is shown at a time."""
    begun = start <= t
    return F.when(genre == "rolling_pop", F.when(begun, "base").otherwise("hidden")).when(genre == "karaoke_fill", F.when(begun, "sung").otherwise("base")).otherwise("base")


def placed(x: Column, y: Column, scale: Column, size: int, manual: bool = False) -> Column:
    """(x, y, size) in canvas pixels of shares of the canvas and a scale of 0.3 to 3; null is the middle, 0.46 down, unscaled.

    An operator's own caption stands a block above."""
    unit = lambda c, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(d))))
    px, py = F.round(unit(x, 0.5) * 1080).cast("long"), F.round(unit(y, 0.46) * 1920).cast("long")
    pt = F.greatest(F.round(size * F.greatest(F.lit(0.3), F.least(F.lit(3.0), F.coalesce(scale, F.lit(1.0))))).cast("long"), F.lit(1))
    if manual:
        py = F.greatest(F.greatest(py - F.round(pt * 1.9).cast("long"), F.lit(0)), F.round(pt * 0.8).cast("long"))
    return F.struct(px.alias("x"), py.alias("y"), pt.alias("size"))
