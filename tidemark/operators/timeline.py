"""Timelines of a clip: boundaries, steps, presence, looks, clocks and anchors.

Spans and points belong to a group (`by`); a null time takes no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import moments as M
from tidemark.operators import series as S


def boundaries(cuts: DataFrame, clips: DataFrame, by: str, merge: float | None = None) -> DataFrame:
    """(by, t) for clips (by, duration): 0, the cuts (by, t) more than 0.03 s inside, and the end, of every clip.

    With `merge`, a boundary nearer than that to the one kept before it goes."""
    inner = cuts.select(by, "t").join(clips.select(by, "duration"), by).where("t > 0.03 AND t < duration - 0.03").select(by, "t")
    ends = clips.select(by, F.explode(F.array(F.lit(0.0), "duration")).alias("t"))
    every = ends.unionByName(inner)
    if merge is None:
        return every
    return thinned(every, by, merge)


def thinned(times: DataFrame, by: str, merge: float) -> DataFrame:
    """Times (by, t) without those nearer than `merge` to the one kept before."""
    # each is held against the last one kept, not against its neighbour
    kept = F.aggregate(F.array_sort(F.collect_list("t")), F.expr("cast(array() AS array<double>)"), lambda a, t: F.when((F.size(a) > 0) & (t - F.element_at(a, -1) < merge), a).otherwise(F.concat(a, F.array(t))))
    return times.groupBy(by).agg(kept.alias("kept")).select(by, F.explode("kept").alias("t"))


def segments(bounds: DataFrame, by: str) -> DataFrame:
    """(by, t0, t1) between neighbouring boundaries."""
    return bounds.withColumn("t1", F.expr(f"lead(t) OVER (PARTITION BY {by} ORDER BY t)")).where("t1 IS NOT NULL").select(by, F.col("t").alias("t0"), "t1")


def faceless(parts: DataFrame, seen: DataFrame, by: str, width: float, bins: int, least: float = 1.0, share: float = 0.1) -> DataFrame:
    """Segments (by, t0, t1) of at least `least` seconds in which less than `share` of the bins (by, bin) were seen."""
    edge = lambda c: F.least(F.lit(bins), F.round(F.col(c) / width).cast("long"))
    own = parts.where(F.col("t1") - F.col("t0") >= least).withColumn("b0", edge("t0")).withColumn("b1", F.greatest("b0", edge("t1"))).where("b1 > b0")
    # a segment meets each of its bins once
    each = own.withColumn("bin", F.explode(F.sequence("b0", F.col("b1") - 1))).join(seen.select(by, "bin").distinct().withColumn("_s", F.lit(1)), [by, "bin"], "left")
    n = each.groupBy(by, "t0", "t1", "b0", "b1").agg(F.count("_s").alias("seen"))
    return n.where(F.col("seen") < share * (F.col("b1") - F.col("b0"))).drop("seen")


def step_scores(bins: DataFrame, steps: DataFrame, by: str, width: float, step: float = 0.25) -> DataFrame:
    """Bins (by, bin) with the score of the step (by, step, score) over their centre; the last step past the end, 0 without steps."""
    last = steps.groupBy(by).agg(F.max("step").alias("_last"))
    at = bins.join(last, by, "left").withColumn("step", F.least(F.floor((F.col("bin") + 0.5) * width / step), F.col("_last")))
    return at.join(steps.select(by, "step", "score"), [by, "step"], "left").select(by, "bin", F.coalesce("score", F.lit(0.0)).alias("score"))


def value_at(points: DataFrame, bins: DataFrame, by: str, width: float) -> DataFrame:
    """Points (by, id, t) with who speaks (by, bin, speaker, confidence) in their bin: null and 0 where nobody is known."""
    at = points.select(by, "id", F.floor(F.greatest("t", F.lit(0.0)) / width).alias("bin"))
    return at.join(bins.select(by, "bin", "speaker", "confidence"), [by, "bin"], "left").select(by, "id", "speaker", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def presence(seen: DataFrame, by: str, bins: int, most: float = 1.5) -> DataFrame:
    """Mean tracks visible a bin, the share of bins of the most seen track, and whether a clip follows who is visible (a mean under `most`)."""
    n = seen.select(by, "track", "bin").distinct().groupBy(by, "track").agg(F.count("*").alias("n"))
    out = n.groupBy(by).agg((F.sum("n") / bins).alias("mean_faces"), (F.max("n") / bins).alias("top_share"))
    return out.withColumn("follow_visible", F.col("mean_faces") < most)


def luma_shares(pixels: DataFrame, by: str, bins: int = 16) -> DataFrame:
    """(by, bin, share) of the brightness of pixels (by, r, g, b in 0 to 255); empty bins aren't listed."""
    luma = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    own = pixels.groupBy(by, F.least(F.lit(bins - 1), F.floor(luma / 256 * bins)).alias("bin")).agg(F.count("*").alias("n"))
    total = own.groupBy(by).agg(F.sum("n").alias("total"))
    return own.join(total, by).select(by, "bin", (F.col("n") / F.col("total")).alias("share"))


def look_distance(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Half the L1 distance of two sets of shares (by, bin, share): 0 for the same, 1 for disjoint ones."""
    both = a.select(by, "bin", "share").unionByName(b.select(by, "bin", (-F.col("share")).alias("share"))).groupBy(by, "bin").agg(F.abs(F.sum("share")).alias("d"))
    return both.groupBy(by).agg((F.sum("d") / 2).alias("distance"))


def exported(points: DataFrame, kept: DataFrame, by: str, intro: float) -> DataFrame:
    """Times of an export (by, id, t) on the clock that has only kept spans after an intro."""
    src = F.col("t") - intro
    cut = F.greatest(F.lit(0.0), F.least(src, F.col("to_s")) - F.col("from_s"))
    own = points.join(kept.select(by, "from_s", "to_s"), by).groupBy(by, "id").agg(F.sum(cut).alias("s"))
    return points.join(own, [by, "id"], "left").select(by, "id", F.when((F.col("t") <= intro) | F.col("s").isNull(), F.col("t")).otherwise(intro + F.col("s")).alias("at"))


def nearest(points: DataFrame, anchors: DataFrame, by: str, tol: float) -> DataFrame:
    """Points (by, id, t) with the nearest anchor (by, at) within `tol`, the earlier on a tie; points without one aren't listed.

    Joined by cells of `tol`, never all against all."""
    cell = lambda c: F.floor(F.col(c) / tol)
    left = points.select(by, "id", "t").withColumn("_c", F.explode(F.array(cell("t") - 1, cell("t"), cell("t") + 1)))
    near = left.join(anchors.select(by, "at", cell("at").alias("_c")), [by, "_c"]).where(F.abs(F.col("at") - F.col("t")) <= tol)
    return near.groupBy(by, "id").agg(F.min(F.struct(F.abs(F.col("at") - F.col("t")).alias("d"), "at")).alias("x")).select(by, "id", F.col("x.at").alias("at"))


def pins(corrections: DataFrame, words: DataFrame, by: str, tol: float = 3.0) -> DataFrame:
    """Corrections (by, id, wrong, at_s) with the occurrence (by, idx, word, start_s) of their word nearest in time within `tol` (the earlier on a tie)."""
    cell = lambda c: F.floor(F.col(c) / tol)
    key = lambda c: F.lower(T.core(F.col(c)))
    left = corrections.withColumn("_w", key("wrong")).withColumn("_c", F.explode(F.array(cell("at_s") - 1, cell("at_s"), cell("at_s") + 1)))
    near = left.join(words.select(by, "idx", "start_s", key("word").alias("_w"), cell("start_s").alias("_c")), [by, "_w", "_c"]).where((F.col("_w") != "") & (F.abs(F.col("start_s") - F.col("at_s")) <= tol))
    return near.groupBy(by, "id").agg(F.min(F.struct(F.abs(F.col("start_s") - F.col("at_s")).alias("d"), "idx")).alias("x")).select(by, "id", F.col("x.idx").alias("idx"))


def peak_range(peak: Column, width: float, lead: Column, length: float, total: float) -> Column:
    """A fixed length around a peak bin, `lead` before its centre, inside [0, total]."""
    start = F.greatest(F.lit(0.0), peak * width + width / 2 - lead)
    return F.struct(start.alias("start_s"), F.least(start + length, F.greatest(F.lit(total), start)).alias("end_s"))


def with_signal(moments: DataFrame, values: DataFrame, name: str, weights: dict[str, float]) -> DataFrame:
    """Moments (series_id, id, signals) with another signal (series_id, id, v): its robust z among the candidates of the series, and the score anew."""
    z = S.robust_z(values.select("series_id", F.col("id").alias("bin"), "v")).select("series_id", F.col("bin").alias("id"), F.col("v").alias(name))
    return moments.drop(name, "score").join(z, ["series_id", "id"], "left").withColumn("score", M.combined_score(weights))


def max_pooled(series: DataFrame, spans: DataFrame) -> DataFrame:
    """The greatest value of a series (series_id, bin, v) in each span (series_id, id, b0, b1) of bins, 0 at least."""
    own = spans.withColumn("bin", F.explode(F.when(F.col("b1") > F.col("b0"), F.sequence("b0", F.col("b1") - 1))))
    top = own.join(series, ["series_id", "bin"]).groupBy("series_id", "id").agg(F.max("v").alias("v"))
    return spans.select("series_id", "id").join(top, ["series_id", "id"], "left").select("series_id", "id", F.greatest(F.lit(0.0), F.coalesce("v", F.lit(0.0))).alias("v"))


def silent(samples: DataFrame, by: str, peak: float = 0.01) -> DataFrame:
    """Whether no sample (by, x) of a clip reaches `peak`."""
    return samples.groupBy(by).agg((F.coalesce(F.max(F.abs("x")), F.lit(0.0)) < peak).alias("silent"))


def token_words(tokens: DataFrame, by: str) -> DataFrame:
    """Tokens (by, idx, raw, t0, t1, p) as words: one begins at each token with a blank (or ▁) before it; its confidence is that of its least sure token.

    Tokens of blanks only are left out."""
    own = tokens.withColumn("clean", F.regexp_replace("raw", r"^\p{IsWhite_Space}+", "")).where(F.trim("clean") != "")
    order = f"PARTITION BY {by} ORDER BY idx"
    begins = own.withColumn("_new", F.col("raw").startswith(" ") | F.col("raw").startswith("▁") | (F.expr(f"row_number() OVER ({order})") == 1))
    run = begins.withColumn("word", F.expr(f"sum(int(_new)) OVER ({order} ROWS UNBOUNDED PRECEDING) - 1"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "clean"))), lambda x: x["clean"]), "")
    return run.groupBy(by, "word").agg(joined.alias("text"), F.min_by("t0", "idx").alias("start_s"), F.max_by("t1", "idx").alias("end_s"), F.min("p").alias("confidence"))


def mishears(units: DataFrame, store: DataFrame) -> DataFrame:
    """Units (id, text) whose word a store (pos, wrong, right, context, at_s) corrects everywhere: the first entry of a word; marks around it stay.

    Blank, context and timed entries aren't applied.  Other units are as they were."""
    pairs = store.where("wrong <> '' AND right <> '' AND NOT context AND at_s IS NULL").groupBy(F.lower("wrong").alias("_k")).agg(F.min_by("right", "pos").alias("_r"))
    own = units.withColumn("_core", T.core(F.col("text"))).withColumn("_k", F.lower("_core"))
    fixed = F.concat(F.expr("substring(text, 1, locate(_core, text) - 1)"), F.col("_r"), F.expr("substring(text, locate(_core, text) + length(_core))"))
    return own.join(pairs, "_k", "left").select("id", F.when(F.col("_r").isNotNull() & (F.col("_core") != ""), fixed).otherwise(F.col("text")).alias("text"))


def kinds_of(store: DataFrame) -> DataFrame:
    """How many corrections are context overrides, timed, of one word and of several: those with a right side and a word to replace."""
    n = F.size(T.normalised(F.col("wrong")))
    kind = F.when(F.col("context"), "context").when(F.col("at_s").isNotNull(), "pinned").when(n == 1, "single_word").otherwise("multi_word")
    return store.where((F.col("right") != "") & (n > 0)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def anchors(parts: list[DataFrame], by: str) -> DataFrame:
    """Anchors (by, at, word) of several decodes in the order of time, nothing dropped: place and decode of each."""
    out = None
    for k, p in enumerate(parts):
        own = p.select(by, "at", "word", F.lit(k).alias("decode"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY at, decode, word)").cast("long"))


def scene_scores(lines: DataFrame, by: str) -> DataFrame:
    """(by, t, score) of a log (by, n, line): a time line and the next score line; a score without a time of its own, and a time without a score, go."""
    number = lambda mark: F.nullif(F.regexp_extract("line", rf"{mark}\s*(\S+)", 1), F.lit("")).try_cast("double")
    own = lines.withColumn("_t", number("pts_time:")).withColumn("_s", number("lavfi.scene_score=")).where("_t IS NOT NULL OR _s IS NOT NULL")
    order = f"PARTITION BY {by} ORDER BY n"
    # a line with a time counts as a time line only
    return own.withColumn("_before", F.expr(f"lag(_t) OVER ({order})")).where("_t IS NULL AND _before IS NOT NULL").select(by, F.col("_before").alias("t"), F.col("_s").alias("score"))


def segment_subjects(seen: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """Segments (by, seg, b0, b1) with their subject: `group` if two tracks or more are seen (by, track, bin) in most bins, else the track seen most (the last on a tie); null if none is."""
    each = parts.withColumn("bin", F.explode(F.when(F.col("b1") > F.col("b0"), F.sequence("b0", F.col("b1") - 1)))).join(seen.select(by, "track", "bin").distinct(), [by, "bin"])
    crowd = each.groupBy(by, "seg", "b0", "b1", "bin").agg(F.count("*").alias("n")).groupBy(by, "seg", "b0", "b1").agg(F.sum((F.col("n") >= 2).cast("int")).alias("crowd"))
    top = each.groupBy(by, "seg", "track").agg(F.count("*").alias("n")).groupBy(by, "seg").agg(F.max(F.struct("n", "track")).alias("x"))
    both = parts.select(by, "seg").join(crowd, [by, "seg"], "left").join(top, [by, "seg"], "left")
    return both.select(by, "seg", F.when(F.col("crowd") * 2 > F.col("b1") - F.col("b0"), "group").otherwise(F.col("x.track").cast("string")).alias("subject"))


def capped_tracks(tracks: DataFrame, by: str, most: int) -> DataFrame:
    """Tracks (by, track, presence, cx): the `most` most present ones (the smaller track on a tie), numbered from left to right."""
    rank = F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY presence DESC, track)")
    kept = tracks.withColumn("_k", rank).where(F.col("_k") <= most)
    return kept.withColumn("id", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY cx, presence DESC, track) - 1").cast("long")).drop("_k")


def log_softmax(emission: DataFrame, by: list[str]) -> DataFrame:
    """Logits (by, token, v) as log-probabilities of each frame."""
    top = emission.groupBy(*by).agg(F.max("v").alias("_m"))
    shifted = emission.join(top, by)
    total = shifted.groupBy(*by).agg((F.first("_m") + F.log(F.sum(F.exp(F.col("v") - F.col("_m"))))).alias("_l"))
    return emission.join(total, by).select(*by, "token", (F.col("v") - F.col("_l")).alias("v"))


def resampled(dst: DataFrame, src: DataFrame, by: str, src_w: int, src_h: int, dst_w: int, dst_h: int) -> DataFrame:
    """Cells (by, x, y) of a smaller frame with the value of the pixel (by, x, y, v) they fall on, by whole numbers."""
    at = dst.select(by, "x", "y", F.least(F.expr(f"x * {src_w} div {dst_w}"), F.lit(src_w - 1)).alias("_x"), F.least(F.expr(f"y * {src_h} div {dst_h}"), F.lit(src_h - 1)).alias("_y"))
    return at.join(src.select(by, F.col("x").alias("_x"), F.col("y").alias("_y"), "v"), [by, "_x", "_y"]).select(by, "x", "y", "v")
