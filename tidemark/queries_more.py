"""Registered queries of the frame, note and timeline operators, with their DuckDB SQL.

Lines of an order stand for boxes in a frame and for pixels; events for the
points, cuts and spans of a recording of 720 hours; words for tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import frames as C
from tidemark.functions import notes as N
from tidemark.operators import captions, intervals, sentences, sequences, stores
from tidemark.operators import series as S
from tidemark.operators import timeline as T
from tidemark.queries import _EV, _GRID, _WORDS, BINS, _every_word, _round, _rounded, hourly, query, table, timed, turns
from tidemark.sources import stores as sources

TOTAL = 2592000.0


def _boxes(spark, d):
    li = table(spark, d, "lineitem")
    box = F.struct((F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y"), (100 + F.col("l_quantity") * 8).alias("w"), (80 + F.col("l_tax") * 5000).alias("h"))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity", "l_discount", F.col("l_extendedprice").alias("p"), box.alias("c"))


_B = "b AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount, l_quantity * 10 AS x, l_discount * 1000 AS y, 100 + l_quantity * 8 AS w, 80 + l_tax * 5000 AS h, l_extendedprice AS p, l_linenumber::DOUBLE AS n FROM lineitem)"


def _of(df, box, *keys):
    return df.select("l_orderkey", "l_linenumber", *keys, *(F.round(F.col(f"{box}.{c}"), 4).alias(c) for c in "xywh"))


@query(f"WITH {_B} SELECT l_orderkey, l_linenumber, round(greatest(0, least(x + p / 50 - 900, greatest(1920 - w, 0))), 4) AS x, round(greatest(0, least(y + 600 - p / 100, greatest(1080 - h, 0))), 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM b")
def crop_pan(spark, d):
    b = _boxes(spark, d)
    return _of(b.withColumn("n", C.panned(b.c, F.lit(1920.0), F.lit(1080.0), b.p / 50 - 900, 600 - b.p / 100)), "n")


@query(f"WITH {_B}, f AS (SELECT *, greatest(16 / w, 16 / h) AS lo FROM b), g AS (SELECT *, greatest(lo, least(greatest(lo, least(1920 / w, 1080 / h)), n / 3 + 0.2::DOUBLE)) AS f FROM f) SELECT l_orderkey, l_linenumber, round(greatest(0, least(x + w / 4 - (x + w / 4 - x) / w * (w * f), 1920 - w * f)), 4) AS x, round(greatest(0, least(y + h / 2 - (y + h / 2 - y) / h * (h * f), 1080 - h * f)), 4) AS y, round(w * f, 4) AS w, round(h * f, 4) AS h FROM g")
def crop_zoom(spark, d):
    b = _boxes(spark, d)
    return _of(b.withColumn("n", C.zoomed(b.c, F.lit(1920.0), F.lit(1080.0), b.l_linenumber / 3 + 0.2, b.c.x + b.c.w / 4, b.c.y + b.c.h / 2)), "n")


@query(f"WITH {_B}, f AS (SELECT *, 0.5::DOUBLE + n / 2 AS a FROM b), g AS (SELECT *, least(h * a, 1920) AS w1, least(CASE WHEN h * a > 1920 THEN 1920 / a ELSE h END, 1080) AS h1 FROM f), k AS (SELECT *, CASE WHEN h1 < w1 / a THEN h1 * a ELSE w1 END AS w2 FROM g) SELECT l_orderkey, l_linenumber, round(greatest(0, least(x + w / 2 - w2 / 2, 1920 - w2)), 4) AS x, round(greatest(0, least(y + h / 2 - h1 / 2, 1080 - h1)), 4) AS y, round(w2, 4) AS w, round(h1, 4) AS h FROM k")
def crop_reaspect(spark, d):
    b = _boxes(spark, d)
    return _of(b.withColumn("n", C.reaspected(b.c, 0.5 + b.l_linenumber / 2, F.lit(1920.0), F.lit(1080.0))), "n")


@query(f"WITH {_B}, f AS (SELECT *, w * 4 AS sw, h * 4 AS sh, h * 4 * 0.5625::DOUBLE AS tw, w * 4 / 0.5625::DOUBLE AS wh FROM b) SELECT l_orderkey, l_linenumber, round(CASE WHEN tw <= sw THEN greatest(0, least(x - tw / 2, sw - tw)) ELSE 0 END, 4) AS x, round(CASE WHEN tw <= sw THEN 0 ELSE greatest(0, least(y - wh / 2, sh - wh)) END, 4) AS y, round(CASE WHEN tw <= sw THEN tw ELSE sw END, 4) AS w, round(CASE WHEN tw <= sw THEN sh ELSE wh END, 4) AS h FROM f")
def full_camera_crop(spark, d):
    b = _boxes(spark, d)
    return _of(b.withColumn("n", C.full_camera(b.c.x, b.c.y, b.c.w * 4, b.c.h * 4)), "n")


@query(f"WITH {_B}, f AS (SELECT *, w * 4 AS sw, h * 4 AS sh, least(w * 4 * 0.3::DOUBLE, h * 4 * (n / 2)) AS cw FROM b) SELECT l_orderkey, l_linenumber, round(sw - cw, 4) AS x, round(sh - cw / (n / 2), 4) AS y, round(cw, 4) AS w, round(cw / (n / 2), 4) AS h FROM f")
def default_camera_crop(spark, d):
    b = _boxes(spark, d)
    return _of(b.withColumn("n", C.default_camera(b.c.w * 4, b.c.h * 4, b.l_linenumber / 2)), "n")


@query(f"WITH {_B}, f AS (SELECT *, least(w * 4, h * 4 * 0.5625::DOUBLE) AS fw, least(h * 4, w * 4 / 0.5625::DOUBLE) AS fh FROM b) SELECT l_orderkey, l_linenumber, round((w * 4 - fw) / 2, 4) AS x, round((h * 4 - fh) / 2, 4) AS y, round(fw, 4) AS w, round(fh, 4) AS h FROM f")
def gameplay_crop(spark, d):
    b = _boxes(spark, d)
    return _of(b.withColumn("n", C.gameplay(b.c.w * 4, b.c.h * 4)), "n")


@query(f"WITH {_B}, f AS (SELECT *, greatest(2, least(1918, round(l_discount * 10 * 1920))) AS u FROM b) SELECT l_orderkey, l_linenumber, round(1080 / u, 6) AS upper_aspect, round(1080 / (1920 - u), 6) AS lower_aspect FROM f")
def panel_aspects(spark, d):
    b = _boxes(spark, d)
    up, low = C.panel_aspects(b.l_discount * 10)
    return b.select("l_orderkey", "l_linenumber", F.round(up, 6).alias("upper_aspect"), F.round(low, 6).alias("lower_aspect"))


@query(f"""WITH {_B}, g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS faces, min(x) FILTER (l_returnflag <> 'R') AS x0, min(y) FILTER (l_returnflag <> 'R') AS y0, max(x + w) FILTER (l_returnflag <> 'R') AS x1, max(y + h) FILTER (l_returnflag <> 'R') AS y1 FROM b GROUP BY 1),
e AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, least((x1 - x0) * 1.8::DOUBLE, 1200) AS ew, least((y1 - y0) * 2.4::DOUBLE, 1080) AS eh FROM g),
o AS (SELECT *, greatest(0, least(cx - ew / 2, 1200 - ew)) AS ex, greatest(0, least(cy - eh * 0.38::DOUBLE, 1080 - eh)) AS ey, least(ew, eh * 1.125::DOUBLE) AS fw, least(eh, ew / 1.125::DOUBLE) AS fh, least(least(greatest(ew, eh * 1.125::DOUBLE), 1200) / 1.125::DOUBLE, 1080) AS mh FROM e), m AS (SELECT *, least(mh * 1.125::DOUBLE, 1200) AS mw FROM o)
SELECT l_orderkey, faces, CASE WHEN faces = 0 THEN 'gameplay' WHEN faces = 1 AND (x1 - x0) / 1200 >= 0.28::DOUBLE AND cx / 1200 BETWEEN 0.25::DOUBLE AND 0.75::DOUBLE THEN 'full_camera' ELSE 'stacked' END AS layout,
round(CASE WHEN faces = 0 THEN NULL WHEN faces = 1 THEN ex + (ew - fw) / 2 ELSE greatest(0, least(cx - mw / 2, 1200 - mw)) END, 4) AS x, round(CASE WHEN faces = 0 THEN NULL WHEN faces = 1 THEN ey + (eh - fh) / 2 ELSE greatest(0, least(cy - mh * 0.38::DOUBLE, 1080 - mh)) END, 4) AS y, round(CASE WHEN faces = 0 THEN NULL WHEN faces = 1 THEN fw ELSE mw END, 4) AS w, round(CASE WHEN faces = 0 THEN NULL WHEN faces = 1 THEN fh ELSE mh END, 4) AS h FROM m""")
def layout_decision(spark, d):
    """Lines of an order that weren't returned are its faces, in a frame of 1200 by 1080."""
    face = F.col("l_returnflag") != "R"
    at = lambda f, v: f(F.when(face, v))
    c = F.col("c")
    g = _boxes(spark, d).groupBy("l_orderkey").agg(F.count(F.when(face, 1)).alias("faces"), at(F.min, c.x).alias("x0"), at(F.min, c.y).alias("y0"), at(F.max, c.x + c.w).alias("x1"), at(F.max, c.y + c.h).alias("y1"))
    sw, sh = F.lit(1200.0), F.lit(1080.0)
    crop = C.face_camera(g.x0, g.y0, g.x1, g.y1, g.faces, sw, sh, F.lit(1.125))
    g = g.select("l_orderkey", "faces", C.layout(g.faces, g.x1 - g.x0, (g.x0 + g.x1) / 2, sw).alias("layout"), crop.alias("n"))
    return g.select("l_orderkey", "faces", "layout", *(F.when(F.col("faces") > 0, F.round(F.col(f"n.{k}"), 4)).alias(k) for k in "xywh"))


@query(f"WITH {_B}, f AS (SELECT *, w * 4 AS sw, h * 5 AS sh FROM b) SELECT l_orderkey, l_linenumber, (floor(greatest(round(CASE WHEN sw >= sh THEN least(sw, 640) ELSE least(sh, 640) * sw / sh END), 2) / 2) * 2)::BIGINT AS w, (floor(greatest(round(CASE WHEN sw >= sh THEN least(sw, 640) * sh / sw ELSE least(sh, 640) END), 2) / 2) * 2)::BIGINT AS h FROM f")
def frame_dims(spark, d):
    b = _boxes(spark, d)
    w, h = C.scaled_dims(b.c.w * 4, b.c.h * 5, 640.0)
    return b.select("l_orderkey", "l_linenumber", w.cast("long").alias("w"), h.cast("long").alias("h"))


@query(f"WITH {_EV}, f AS (SELECT event_id, (us % 100000000) / 1e6 AS e, (user_id % 7)::DOUBLE AS i, (event_id % 5)::DOUBLE AS o FROM ev) SELECT event_id, round((CASE WHEN i > 0 THEN greatest(0, least(1, e / i)) ELSE 1 END) * (CASE WHEN o > 0 THEN greatest(0, least(1, (100 - e) / o)) ELSE 1 END), 6) AS visible FROM f")
def fade_visibility(spark, d):
    e = timed(spark, d)
    return e.select("event_id", _rounded(C.fade((F.col("us") % 100_000_000) / 1e6, F.lit(100.0), (F.col("user_id") % 7).cast("double"), (F.col("event_id") % 5).cast("double"))).alias("visible"))


def _points(spark, d, kind):
    return timed(spark, d).where(F.col("series_id") == kind).select("user_id", F.col("event_id").alias("id"), "t")


_CLICK = "c AS (SELECT user_id, event_id AS id, t FROM ev WHERE series_id = 'click'), k AS (SELECT user_id, t AS from_s, t + 5400 AS to_s FROM ev WHERE series_id = 'purchase')"


@query(f"WITH {_EV}, {_CLICK}, s AS (SELECT c.user_id, c.id, sum(greatest(0, least(t - 10, to_s) - from_s)) AS s FROM c JOIN k USING (user_id) GROUP BY 1, 2) SELECT c.user_id, c.id, round(CASE WHEN t <= 10 OR s IS NULL THEN t ELSE 10 + s END, 3) AS at FROM c LEFT JOIN s USING (user_id, id)")
def export_clock(spark, d):
    kept = _points(spark, d, "purchase").select("user_id", F.col("t").alias("from_s"), (F.col("t") + 5400).alias("to_s"))
    return _round(T.exported(_points(spark, d, "click"), kept, "user_id", 10.0), "at", places=3)


@query(f"WITH {_EV}, {_CLICK}, j AS (SELECT c.user_id, c.id, e.t AS near_t, row_number() OVER (PARTITION BY c.user_id, c.id ORDER BY abs(e.t - c.t), e.t) AS n FROM c JOIN ev e ON e.user_id = c.user_id AND e.series_id = 'view' AND abs(e.t - c.t) <= 7200) SELECT user_id, id, round(near_t, 3) AS \"at\" FROM j WHERE n = 1")
def nearest_anchor(spark, d):
    return _round(T.nearest(_points(spark, d, "click"), _points(spark, d, "view").select("user_id", F.col("t").alias("at")), "user_id", 7200.0), "at", places=3)


def _timed_words(spark, d):
    w = _every_word(table(spark, d, "conversations"), "conv_id", "turn")
    return w.select("conv_id", "turn", "k", "word", (F.col("turn").cast("long") * 100_000 + F.col("k")).alias("idx"), (F.col("turn") * 2.5 + F.col("k") * 0.125).alias("start_s"))


_TW = f"{_WORDS}, tw AS (SELECT conv_id, turn, k, word, turn * 100000 + k AS idx, turn * 2.5::DOUBLE + k * 0.125::DOUBLE AS start_s, lower(regexp_replace(word, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS core FROM ww)"


@query(f"WITH {_TW}, c AS (SELECT conv_id, turn AS id, core, start_s + 1.3125::DOUBLE AS at_s FROM tw WHERE k = 2 AND core <> ''), j AS (SELECT c.conv_id, c.id, idx, row_number() OVER (PARTITION BY c.conv_id, c.id ORDER BY abs(start_s - at_s), idx) AS n FROM c JOIN tw ON tw.conv_id = c.conv_id AND tw.core = c.core AND abs(start_s - at_s) <= 3) SELECT conv_id, id, idx FROM j WHERE n = 1")
def positional_pins(spark, d):
    w = _timed_words(spark, d)
    c = w.where("k = 2").select("conv_id", F.col("turn").alias("id"), F.col("word").alias("wrong"), (F.col("start_s") + 1.3125).alias("at_s"))
    return T.pins(c, w, "conv_id")


def _clips(spark, d):
    return timed(spark, d).select("user_id").distinct().withColumn("duration", F.lit(TOTAL))


_BOUNDS = "q AS (SELECT user_id, t FROM ev WHERE series_id = 'purchase' AND t > 0.03 AND t < 2591999.97 UNION ALL SELECT DISTINCT user_id, unnest([0.0::DOUBLE, 2592000.0::DOUBLE]) FROM ev)"


@query(f"WITH {_EV}, {_BOUNDS} SELECT user_id, round(t, 3) AS t FROM q")
def segment_boundaries(spark, d):
    return _round(T.boundaries(_points(spark, d, "purchase"), _clips(spark, d), "user_id"), "t", places=3)


@query()
def cut_boundaries(spark, d):
    """Boundaries nearer than two hours to the one kept before go: a running choice, tested by brute force."""
    return T.boundaries(_points(spark, d, "purchase"), _clips(spark, d), "user_id", 7200.0)


@query(f"WITH {_EV}, {_BOUNDS}, s AS (SELECT user_id, t AS t0, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1 FROM q), b AS (SELECT *, least(720, round(t0 / 3600)::BIGINT) AS b0, least(720, round(t1 / 3600)::BIGINT) AS b1 FROM s WHERE t1 - t0 >= 3600), v AS (SELECT DISTINCT user_id, (us // 3600000000)::BIGINT AS bin FROM ev WHERE series_id = 'view'), n AS (SELECT b.user_id, t0, t1, b0, b1, count(v.bin) AS seen FROM b LEFT JOIN v ON v.user_id = b.user_id AND v.bin >= b0 AND v.bin < b1 WHERE b1 > b0 GROUP BY ALL) SELECT user_id, round(t0, 3) AS t0, round(t1, 3) AS t1, b0, b1 FROM n WHERE seen < 0.1::DOUBLE * (b1 - b0)")
def faceless_segments(spark, d):
    bounds = T.boundaries(_points(spark, d, "purchase"), _clips(spark, d), "user_id")
    seen = timed(spark, d).where("series_id = 'view'").select("user_id", F.expr("us div 3600000000").alias("bin"))
    return _round(T.faceless(T.segments(bounds, "user_id"), seen, "user_id", 3600.0, BINS, 3600.0), "t0", "t1", places=3)


@query(f"WITH {_GRID}, st AS (SELECT series_id, bin AS step, v AS score FROM s WHERE bin < 200), l AS (SELECT series_id, max(step) AS last FROM st GROUP BY 1), p AS (SELECT s.series_id, s.bin, least(floor((s.bin + 0.5::DOUBLE) * 0.1::DOUBLE / 0.25::DOUBLE)::BIGINT, last) AS step FROM s JOIN l USING (series_id)) SELECT series_id, bin, coalesce(score, 0) AS score FROM p LEFT JOIN st USING (series_id, step)")
def steps_on_bins(spark, d):
    h = hourly(spark, d)
    steps = h.where("bin < 200").select("series_id", F.col("bin").alias("step"), F.col("v").alias("score"))
    return T.step_scores(h.select("series_id", "bin"), steps, "series_id", 0.1)


@query(f"WITH {_EV}, {_CLICK}, b AS (SELECT user_id, us // 3600000000 AS bin, max(series_id) AS speaker, count(*) / 10.0::DOUBLE AS confidence FROM ev WHERE series_id IN ('view', 'signup') GROUP BY 1, 2) SELECT c.user_id, c.id, speaker, coalesce(confidence, 0) AS confidence FROM c LEFT JOIN b ON b.user_id = c.user_id AND b.bin = floor(c.t / 3600)::BIGINT")
def speaker_lookup(spark, d):
    b = timed(spark, d).where("series_id IN ('view', 'signup')").groupBy("user_id", F.expr("us div 3600000000").alias("bin")).agg(F.max("series_id").alias("speaker"), (F.count("*") / 10.0).alias("confidence"))
    return T.value_at(_points(spark, d, "click"), b, "user_id", 3600.0)


@query(f"WITH {_EV}, n AS (SELECT user_id, series_id, count(DISTINCT us // 3600000000) AS n FROM ev GROUP BY 1, 2) SELECT user_id, round(sum(n) / 720.0::DOUBLE, 6) AS mean_faces, round(max(n) / 720.0::DOUBLE, 6) AS top_share, sum(n) / 720.0::DOUBLE < 1.5 AS follow_visible FROM n GROUP BY 1")
def visible_presence(spark, d):
    seen = timed(spark, d).select("user_id", F.col("series_id").alias("track"), F.expr("us div 3600000000").alias("bin"))
    return _round(T.presence(seen, "user_id", BINS), "mean_faces", "top_share")


def _pixels(spark, d):
    return _boxes(spark, d).select("l_returnflag", "l_linenumber", (F.col("l_quantity") * 5).alias("r"), (F.col("l_linenumber") * 36).alias("g"), (F.col("l_partkey") % 256).alias("b"))


_PX = "px AS (SELECT l_returnflag, l_linenumber, least(15, floor((0.299::DOUBLE * (l_quantity * 5) + 0.587::DOUBLE * (l_linenumber * 36) + 0.114::DOUBLE * (l_partkey % 256)) / 256 * 16))::BIGINT AS bin FROM lineitem)"


@query(f"WITH {_PX} SELECT l_returnflag, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM px GROUP BY 1, 2")
def luma_histogram(spark, d):
    return _round(T.luma_shares(_pixels(spark, d), "l_returnflag"), "share")


@query(f"WITH {_PX}, n AS (SELECT l_returnflag, l_linenumber <= 3 AS a, bin, count(*) AS n FROM px GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag, a) AS share FROM n), x AS (SELECT l_returnflag, bin, abs(sum(CASE WHEN a THEN share ELSE -share END)) AS diff FROM s GROUP BY 1, 2) SELECT l_returnflag, round(sum(diff) / 2, 6) AS distance FROM x GROUP BY 1")
def look_distance(spark, d):
    p = _pixels(spark, d)
    return _round(T.look_distance(T.luma_shares(p.where("l_linenumber <= 3"), "l_returnflag"), T.luma_shares(p.where("l_linenumber > 3"), "l_returnflag"), "l_returnflag"), "distance")


_PEAKS = f"{_GRID}, p0 AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM s WINDOW w AS (PARTITION BY series_id ORDER BY bin)), p AS (SELECT series_id, bin, v FROM p0 WHERE v >= 2 AND (l IS NULL OR v > l) AND (r IS NULL OR v >= r))"


@query(f"WITH {_PEAKS}, f AS (SELECT *, greatest(0, bin * 3600 + 1800 - v * 1000) AS start_s FROM p) SELECT series_id, bin, start_s, least(start_s + 30000, greatest(2592000, start_s)) AS end_s FROM f")
def fixed_peak_ranges(spark, d):
    p = S.peaks(hourly(spark, d), 2.0)
    r = p.withColumn("n", T.peak_range(F.col("bin"), 3600.0, F.col("v") * 1000, 30000.0, TOTAL))
    return r.select("series_id", "bin", "n.start_s", "n.end_s")


@query(f"WITH {_PEAKS}, x AS (SELECT series_id, bin, v, (bin % 7)::DOUBLE AS y FROM p), a AS (SELECT series_id, median(y) AS med, avg(y) AS mean, stddev_pop(y) AS std FROM x GROUP BY 1), b AS (SELECT series_id, 1.4826 * median(abs(y - med)) AS mad FROM x JOIN a USING (series_id) GROUP BY 1), z AS (SELECT series_id, bin, v, CASE WHEN mad > 1e-9 THEN (y - med) / mad WHEN std > 1e-9 THEN (y - mean) / std ELSE 0 END AS y FROM x JOIN a USING (series_id) JOIN b USING (series_id)) SELECT series_id, bin AS id, v AS chat, round(y, 6) AS lexicon, round((v * 0.5 + y * 0.3) / 0.8, 6) AS score FROM z")
def signal_join(spark, d):
    p = S.peaks(hourly(spark, d), 2.0).select("series_id", F.col("bin").alias("id"), F.col("v").alias("chat"))
    values = p.select("series_id", "id", (F.col("id") % 7).cast("double").alias("v"))
    return _round(T.with_signal(p, values, "lexicon", {"chat": 0.5, "lexicon": 0.3}), "lexicon", "score").select("series_id", "id", "chat", "lexicon", "score")


@query(f"WITH {_PEAKS} SELECT p.series_id, p.bin AS id, greatest(0, coalesce(max(s.v), 0)) AS v FROM p LEFT JOIN s ON s.series_id = p.series_id AND s.bin >= p.bin + 2 AND s.bin < p.bin + 6 GROUP BY 1, 2")
def max_pooled(spark, d):
    h = hourly(spark, d)
    p = S.peaks(h, 2.0).select("series_id", F.col("bin").alias("id"), (F.col("bin") + 2).alias("b0"), (F.col("bin") + 6).alias("b1"))
    return T.max_pooled(h, p)


@query(f"WITH {_EV} SELECT user_id, coalesce(max(abs(value / 10000)), 0) < 0.01 AS silent FROM ev GROUP BY 1")
def silent_clips(spark, d):
    return T.silent(timed(spark, d).select("user_id", (F.col("value") / 10000).alias("x")), "user_id")


@query(f"WITH {_TW}, t AS (SELECT *, k % 3 <> 1 OR row_number() OVER (PARTITION BY conv_id ORDER BY idx) = 1 AS fresh, ((k * 29) % 100) / 100.0::DOUBLE AS p FROM tw), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS n FROM t) SELECT conv_id, n AS word, md5(string_agg(word, '' ORDER BY idx)) AS text, arg_min(start_s, idx) AS start_s, arg_max(start_s, idx) + 0.125::DOUBLE AS end_s, min(p) AS confidence FROM r GROUP BY 1, 2")
def tokens_to_words(spark, d):
    w = _timed_words(spark, d)
    raw = F.when(F.col("k") % 3 == 1, F.col("word")).otherwise(F.concat(F.lit(" "), F.col("word")))
    t = w.select("conv_id", "idx", raw.alias("raw"), F.col("start_s").alias("t0"), (F.col("start_s") + 0.125).alias("t1"), (((F.col("k") * 29) % 100) / 100.0).alias("p"))
    return T.token_words(t, "conv_id").withColumn("text", F.md5("text"))


def _store(spark, d):
    b = _every_word(table(spark, d, "benchmark"), "item_id")
    b = b.select((F.col("item_id").cast("long") * 100_000 + F.col("k")).alias("pos"), F.lower("word").alias("wrong"))
    return b.select("pos", "wrong", F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("pos").cast("string"))).alias("right"), (F.col("pos") % 5 == 0).alias("context"), F.when(F.col("pos") % 7 == 0, 1.0).alias("at_s"))


_ST = "st AS (SELECT pos, word AS wrong, CASE WHEN pos % 3 = 0 THEN '' ELSE 'r' || pos END AS \"right\", pos % 5 = 0 AS context, CASE WHEN pos % 7 = 0 THEN 1.0 END AS at_s FROM bw)"


@query(f"WITH {_TW}, {_ST}, pr AS (SELECT wrong, arg_min(\"right\", pos) AS fix FROM st WHERE wrong <> '' AND \"right\" <> '' AND NOT context AND at_s IS NULL GROUP BY 1), u AS (SELECT conv_id * 1000000000 + idx AS id, word, regexp_replace(word, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS c FROM tw) SELECT id, CASE WHEN fix IS NOT NULL AND c <> '' THEN substr(word, 1, strpos(word, c) - 1) || fix || substr(word, strpos(word, c) + length(c)) ELSE word END AS text FROM u LEFT JOIN pr ON pr.wrong = lower(u.c)")
def known_mishears(spark, d):
    u = _timed_words(spark, d).select((F.col("conv_id").cast("long") * 1_000_000_000 + F.col("idx")).alias("id"), F.col("word").alias("text"))
    return T.mishears(u, _store(spark, d))


@query(f"WITH {_WORDS}, {_ST}, n AS (SELECT *, len(list_filter(regexp_split_to_array(regexp_replace(lower(wrong), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM st WHERE \"right\" <> '') SELECT CASE WHEN context THEN 'context' WHEN at_s IS NOT NULL THEN 'pinned' WHEN w = 1 THEN 'single_word' ELSE 'multi_word' END AS kind, count(*) AS n FROM n WHERE w > 0 GROUP BY 1")
def correction_kinds(spark, d):
    return T.kinds_of(_store(spark, d))


@query(f"WITH {_WORDS}, {_ST} SELECT pos, wrong FROM st WHERE wrong <> '' AND \"right\" = ''")
def open_todos(spark, d):
    s = _store(spark, d)
    return s.where(N.is_todo(s.wrong, s.right)).select("pos", "wrong")


@query(f"WITH {_WORDS}, {_ST} SELECT wrong, \"right\" FROM st WHERE context AND wrong <> '' AND \"right\" <> ''")
def context_overrides(spark, d):
    return _store(spark, d).where("context AND wrong <> '' AND right <> ''").select(F.lower("wrong").alias("wrong"), "right")


@query(f"WITH {_EV}, a AS (SELECT user_id, t, series_id, 0 AS decode FROM ev WHERE series_id = 'view' UNION ALL SELECT user_id, t, series_id, 1 FROM ev WHERE series_id = 'click') SELECT user_id, round(t, 3) AS at, series_id AS word, decode, row_number() OVER (PARTITION BY user_id ORDER BY t, decode, series_id) AS place FROM a")
def anchor_union(spark, d):
    e = timed(spark, d)
    parts = [e.where(F.col("series_id") == k).select("user_id", F.col("t").alias("at"), F.col("series_id").alias("word")) for k in ("view", "click")]
    return _round(T.anchors(parts, "user_id"), "at", places=3)


@query("WITH c AS (SELECT conv_id, turn, ((conv_id * 7 + turn * 13) % 100) / 100.0::DOUBLE AS confidence, nullif(substr(regexp_replace(coalesce(text, ''), '\"', '', 'g'), 1, 24), '') AS title, (turn * 977)::DOUBLE AS at_s FROM conversations) SELECT conv_id, turn, confidence, title, at_s FROM c")
def harvest_notes(spark, d):
    """Notes are written and read again: what comes out is what went in."""
    c = table(spark, d, "conversations")
    title = F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")), 1, 24)
    note = N.harvest_note(((c.conv_id * 7 + c.turn * 13) % 100) / 100.0, title, (c.turn * 977).cast("double"))
    p = c.select("conv_id", "turn", N.parse_note(note).alias("p"))
    return p.select("conv_id", "turn", F.round(F.col("p.confidence").cast("double"), 2).alias("confidence"), "p.title", "p.at_s")


@query("WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, md5(array_to_string(list_transform(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''), lambda x: x[1] || repeat('*', greatest(1, length(x) - 1))), ' ')) AS censored, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 39) || '…' END AS short, substr(t, 1, 25) AS head FROM c")
def short_texts(spark, d):
    c = table(spark, d, "conversations")
    t = F.coalesce("text", F.lit(""))
    return c.select("conv_id", "turn", F.md5(N.censored(t)).alias("censored"), N.ellipsized(t, 40).alias("short"), N.first_chars(t, 25).alias("head"))


@query("WITH c AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations), m AS (SELECT *, length(t) AS n, length(t) // 2 AS mid FROM c), b AS (SELECT *, list_min(list_transform(list_filter(range(1, n + 1), lambda i: t[i] = ' '), lambda i: abs(i - 1 - mid) * 10000000 + i - 1)) AS x FROM m), s AS (SELECT *, x % 10000000 AS i FROM b), h AS (SELECT *, CASE WHEN i IS NOT NULL THEN trim(substr(t, 1, i::BIGINT)) ELSE substr(t, 1, mid) END AS a, CASE WHEN i IS NOT NULL THEN trim(substr(t, i::BIGINT + 2)) ELSE substr(t, mid + 1) END AS z, CASE WHEN i IS NOT NULL THEN greatest(0.1::DOUBLE, least(0.9::DOUBLE, i / n::DOUBLE)) ELSE 0.5 END AS share FROM s) SELECT conv_id, turn, md5(a) AS first, md5(z) AS second, round(turn * 2.5::DOUBLE + 2 * share, 6) AS at FROM h WHERE n >= 2 AND a <> '' AND z <> ''")
def unit_halves(spark, d):
    c = table(spark, d, "conversations")
    h = c.select("conv_id", "turn", N.halves(F.coalesce("text", F.lit("")), c.turn * 2.5, c.turn * 2.5 + 2).alias("h")).where("h IS NOT NULL")
    return h.select("conv_id", "turn", F.md5("h.first").alias("first"), F.md5("h.second").alias("second"), _rounded(F.col("h.at")).alias("at"))


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS clip, CASE WHEN c_custkey % 4 = 0 THEN 'local' ELSE c_mktsegment END AS creator, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'at ' || c_nationkey END AS stream FROM customer) SELECT c_custkey, concat_ws('; ', 'clip \"' || clip || '\"', CASE WHEN creator <> 'local' THEN 'streamer ' || creator END, CASE WHEN trim(stream) <> '' THEN 'stream \"' || stream || '\"' END) AS topic FROM c")
def correction_topics(spark, d):
    c = table(spark, d, "customer")
    clip = F.when(c.c_custkey % 3 != 0, c.c_name)
    creator = F.when(c.c_custkey % 4 == 0, "local").otherwise(c.c_mktsegment)
    stream = F.when(c.c_custkey % 5 == 0, " ").otherwise(F.concat(F.lit("at "), c.c_nationkey.cast("string")))
    return c.select("c_custkey", N.topic(clip, creator, stream).alias("topic"))


@query(f"WITH {_EV}, k AS (SELECT event_id, event_id % 11 AS n, event_id % 5 AS form FROM ev) SELECT event_id, CASE WHEN form = 4 THEN 0 ELSE n END::DOUBLE AS score, CASE form WHEN 0 THEN 'why' WHEN 1 THEN '' WHEN 2 THEN 'after the 3rd try it is ' || n || ' out of 10' WHEN 3 THEN '7 people; Score: **' || n || '**/10' ELSE 'nothing' END AS reason, CASE form WHEN 0 THEN 'a - b' ELSE '' END AS title FROM k")
def judge_answers(spark, d):
    """Answers made from a known score: objects, prose with ordinals and denominators, a labelled score, nothing."""
    n, form = (F.col("event_id") % 11).cast("string"), F.col("event_id") % 5
    raw = F.when(form == 0, F.concat(F.lit('Sure: {"score": '), n, F.lit(', "reason": " why ", "title": "a — b"}'))).when(form == 1, F.concat(F.lit('{"score": "'), n, F.lit('"}')))
    raw = raw.when(form == 2, F.concat(F.lit("after the 3rd try it is "), n, F.lit(" out of 10"))).when(form == 3, F.concat(F.lit("7 people; Score: **"), n, F.lit("**/10 "))).otherwise("nothing")
    j = timed(spark, d).select("event_id", N.parse_judgment(raw).alias("j"))
    return j.select("event_id", "j.score", "j.reason", "j.title")


_SHOTS = "sh AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS idx, t AS start_s, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 5) AS nx FROM ev WHERE series_id = 'view'), se AS (SELECT user_id, idx, start_s, CASE WHEN idx % 3 = 0 THEN start_s + 1 ELSE nx END AS end_s FROM sh)"


def _shots(spark, d):
    order = "OVER (PARTITION BY user_id ORDER BY t, id)"
    v = _points(spark, d, "view").withColumn("idx", F.expr(f"row_number() {order}")).withColumn("nx", F.expr(f"coalesce(lead(t) {order}, t + 5)"))
    return v.select("user_id", "idx", F.col("t").alias("start_s"), F.when(F.col("idx") % 3 == 0, F.col("t") + 1).otherwise(F.col("nx")).alias("end_s"))


@query(f"WITH {_EV}, {_SHOTS}, b AS (SELECT *, coalesce(abs(start_s - lag(end_s) OVER (PARTITION BY user_id ORDER BY idx)) >= 1e-6, true) AS fresh FROM se), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT user_id, round(arg_min(start_s, idx), 3) AS from_s, round(arg_max(end_s, idx), 3) AS to_s FROM r GROUP BY user_id, run")
def touching_shots(spark, d):
    return _round(intervals.touching(_shots(spark, d), "user_id"), "from_s", "to_s", places=3)


@query(f"WITH {_EV}, {_SHOTS}, g AS (SELECT user_id, min(start_s) + 3 AS lo, min(start_s) + 90000 AS hi FROM se WHERE user_id % 2 = 0 GROUP BY 1), p AS (SELECT se.user_id, start_s AS from_s, least(end_s, coalesce(lo, end_s)) AS to_s FROM se LEFT JOIN g USING (user_id) UNION ALL SELECT se.user_id, greatest(start_s, coalesce(hi, end_s)), end_s FROM se LEFT JOIN g USING (user_id)) SELECT user_id, round(from_s, 3) AS from_s, round(to_s, 3) AS to_s FROM p WHERE from_s < to_s")
def span_removal(spark, d):
    s = _shots(spark, d)
    gone = s.where("user_id % 2 = 0").groupBy("user_id").agg((F.min("start_s") + 3).alias("lo"), (F.min("start_s") + 90000).alias("hi"))
    return _round(intervals.without(s.select("user_id", F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s")), gone, "user_id"), "from_s", "to_s", places=3)


_CU = "cu AS (SELECT series_id, event_id AS idx, t / 3600 AS start_s FROM ev WHERE user_id % 3 = 0 AND t >= 0 AND t < 2592000), un AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY start_s, idx) AS idx, start_s FROM cu)"


def _caption_units(spark, d):
    e = timed(spark, d).where("user_id % 3 = 0 AND t >= 0 AND t < 2592000").select("series_id", "event_id", (F.col("t") / 3600).alias("start_s"))
    return e.select("series_id", F.expr("row_number() OVER (PARTITION BY series_id ORDER BY start_s, event_id)").cast("long").alias("idx"), "start_s")


@query(f"""WITH {_GRID}, {_CU}, ev2 AS (SELECT series_id, bin AS k, v FROM s), lo AS (SELECT series_id, count(*) AS n, least(0.1::DOUBLE * list_sort(list(v))[least(floor(count(*) * 0.95::DOUBLE)::BIGINT, count(*) - 1) + 1], 1.0::DOUBLE) AS bar FROM ev2 GROUP BY 1),
o AS (SELECT un.*, n, bar, greatest(start_s, coalesce(lead(start_s) OVER (PARTITION BY un.series_id ORDER BY idx), n)) AS nx, least(round(start_s)::BIGINT, n - 1) AS k0 FROM un JOIN lo USING (series_id)),
q AS (SELECT *, least(greatest(least(round(start_s + 6)::BIGINT, n - 1), k0 + 1), n) AS k1, least(round(least(start_s + 2, nx))::BIGINT, n - 1) AS k2 FROM o),
pk AS (SELECT q.series_id, q.idx, max(v) AS peak FROM q JOIN ev2 ON ev2.series_id = q.series_id AND k >= k0 AND k < k1 GROUP BY 1, 2),
rs AS (SELECT q.series_id, q.idx, min(k) AS rise FROM q JOIN pk USING (series_id, idx) JOIN ev2 ON ev2.series_id = q.series_id AND k >= k0 AND k < k2 WHERE v >= 0.3::DOUBLE * peak GROUP BY 1, 2),
f AS (SELECT q.series_id, q.idx, nx, least(greatest(coalesce(rise, greatest(k0, k2)), start_s), nx) AS a FROM q JOIN pk USING (series_id, idx) LEFT JOIN rs USING (series_id, idx) WHERE peak >= bar)
SELECT series_id, idx, round(a, 6) AS start_s, round(least(greatest(least(a + 12, nx), a + 4), nx), 6) AS end_s FROM f""")
def caption_timing(spark, d):
    """Hours stand for the frames of the envelope; times are stretched tenfold."""
    env = hourly(spark, d).select("series_id", F.col("bin").alias("k"), "v")
    return _round(captions.refined(_caption_units(spark, d), env, "series_id", 1.0, 10.0, 1.0), "start_s", "end_s")


@query(f"WITH {_EV}, {_CU}, u AS (SELECT series_id, idx, start_s, start_s + 2 AS end_s FROM un), r AS (SELECT series_id, t / 3600 AS a, t / 3600 + 0.25::DOUBLE AS b FROM ev WHERE user_id % 7 = 0), j AS (SELECT u.series_id, u.idx, start_s, end_s, coalesce(bool_or(a <= start_s AND start_s < b), false) AS inside, min(CASE WHEN a > start_s AND a < end_s THEN a END) AS cut FROM u LEFT JOIN r USING (series_id) GROUP BY ALL) SELECT series_id, idx, round(start_s, 6) AS start_s, round(CASE WHEN NOT inside AND cut IS NOT NULL THEN least(greatest(start_s + 0.4::DOUBLE, cut), end_s) ELSE end_s END, 6) AS end_s FROM j")
def laugh_trims(spark, d):
    runs = timed(spark, d).where("user_id % 7 = 0").select("series_id", (F.col("t") / 3600).alias("from_s"), (F.col("t") / 3600 + 0.25).alias("to_s"))
    return _round(captions.laugh_trimmed(_caption_units(spark, d).withColumn("end_s", F.col("start_s") + 2), runs, "series_id"), "start_s", "end_s")


@query(f"WITH {_EV}, {_CU}, g AS (SELECT *, CASE idx % 3 WHEN 0 THEN 'huge_word' WHEN 1 THEN 'rolling_pop' ELSE 'karaoke_fill' END AS genre FROM un) SELECT series_id, idx, CASE genre WHEN 'rolling_pop' THEN CASE WHEN start_s <= 300 THEN 'base' ELSE 'hidden' END WHEN 'karaoke_fill' THEN CASE WHEN start_s <= 300 THEN 'sung' ELSE 'base' END ELSE 'base' END AS state FROM g")
def word_states(spark, d):
    genre = F.when(F.col("idx") % 3 == 0, "huge_word").when(F.col("idx") % 3 == 1, "rolling_pop").otherwise("karaoke_fill")
    return _caption_units(spark, d).select("series_id", "idx", captions.word_state(genre, F.col("start_s"), F.lit(300.0)).alias("state"))


@query(f"WITH {_B}, p AS (SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, CASE WHEN l_linenumber <> 1 THEN x / 300 - 0.1::DOUBLE ELSE 0.5 END)) * 1080)::BIGINT AS px, round(greatest(0, least(1, CASE WHEN l_linenumber <> 1 THEN l_discount * 11 ELSE 0.46::DOUBLE END)) * 1920)::BIGINT AS py, greatest(round(64 * greatest(0.3::DOUBLE, least(3, n * 0.55::DOUBLE)))::BIGINT, 1) AS pt FROM b) SELECT l_orderkey, l_linenumber, px AS x, py AS y, pt AS size, greatest(greatest(py - round(pt * 1.9::DOUBLE)::BIGINT, 0), round(pt * 0.8::DOUBLE)::BIGINT) AS manual_y FROM p")
def caption_places(spark, d):
    b = _boxes(spark, d)
    x, y = (F.when(F.col("l_linenumber") != 1, v) for v in (b.c.x / 300 - 0.1, b.l_discount * 11))
    a, m = (captions.placed(x, y, b.l_linenumber * 0.55, 64, manual) for manual in (False, True))
    return b.select("l_orderkey", "l_linenumber", a.alias("a"), m.alias("m")).select("l_orderkey", "l_linenumber", "a.x", "a.y", "a.size", F.col("m.y").alias("manual_y"))


@query(f"WITH {_EV}, {_CU}, u AS (SELECT series_id, idx, start_s, start_s + 0.5::DOUBLE AS end_s FROM un), m AS (SELECT series_id, min(start_s) AS from_s, min(start_s) + 100 AS to_s FROM un GROUP BY 1) SELECT u.series_id, idx, round(start_s, 6) AS start_s FROM u JOIN m USING (series_id) WHERE start_s >= from_s - 0.05::DOUBLE AND end_s <= to_s + 0.05::DOUBLE")
def clip_words(spark, d):
    u = _caption_units(spark, d).withColumn("end_s", F.col("start_s") + 0.5)
    m = u.groupBy("series_id").agg(F.min("start_s").alias("from_s"), (F.min("start_s") + 100).alias("to_s")).withColumn("id", F.lit(1))
    return _round(sentences.within(u, m, "series_id").select("series_id", "idx", "start_s"), "start_s")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2 END AS width, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS height, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END END AS duration_s, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE round(24000 / 1001.0::DOUBLE, 6) END END AS fps, CASE WHEN p_partkey % 3 <> 0 AND p_size % 3 <> 0 THEN p_size % 3 END::BIGINT AS channels FROM part")
def media_probes(spark, d):
    """Probe outputs are written and read: what comes out is what went in."""
    p = table(spark, d, "part")
    line = lambda k, v: F.concat(F.lit(f"{k}="), v, F.lit("\n"))
    length = F.when(p.p_partkey % 3 == 0, "N/A").otherwise(p.p_retailprice.cast("string"))
    video = F.concat(F.when(p.p_partkey % 5 != 0, line("width", (p.p_size * 2).cast("string"))).otherwise(""), line("height", p.p_size.cast("string")), line("duration", length), line("r_frame_rate", F.when(p.p_partkey % 4 == 0, "0/0").otherwise("24000/1001")))
    audio = F.concat(line("sample_rate", F.lit("44100")), line("channels", (p.p_size % 3).cast("string")), line("duration", length))
    o = p.select("p_partkey", N.video_probe(video).alias("v"), N.audio_probe(audio).alias("a"))
    return o.select("p_partkey", F.col("v.width").cast("int").alias("width"), F.col("v.height").cast("int").alias("height"), "v.duration_s", F.round("v.fps", 6).alias("fps"), "a.channels")


@query("SELECT o_orderkey, round(greatest(0, o_totalprice / 100 - 2), 6) AS start_s, round(least(o_totalprice / 100 + 12, CASE WHEN o_orderkey % 3 <> 0 THEN 1500 ELSE 1e300 END), 6) AS end_s, round(CASE WHEN o_orderkey % 4 <> 0 THEN greatest(0, (o_totalprice / 100 + 10) + 0.5::DOUBLE - (o_totalprice / 100 / 2 + 600)) ELSE 0 END, 6) AS missing, (o_orderkey % 90) * 60 + (o_custkey % 60) + 0.25::DOUBLE AS clock FROM orders")
def clip_padding(spark, d):
    o = table(spark, d, "orders")
    t = o.o_totalprice / 100
    text = F.concat((o.o_orderkey % 90).cast("string"), F.lit(":"), (o.o_custkey % 60).cast("string"), F.lit(".25"))
    p = o.select("o_orderkey", N.padded(t, t + 10, F.when(o.o_orderkey % 3 != 0, F.lit(1500.0))).alias("p"), N.tail_shortfall(t / 2, F.when(o.o_orderkey % 4 != 0, F.lit(600.0)).otherwise(0.0), t + 10).alias("missing"), N.minutes(text).alias("clock"))
    return _round(p.select("o_orderkey", "p.start_s", "p.end_s", "missing", "clock"), "start_s", "end_s", "missing")


@query("WITH i AS (SELECT p_size AS stream, p_partkey AS idx, p_partkey * 10 AS byte_len, p_retailprice / 1000 AS dur FROM part), t AS (SELECT *, sum(dur) OVER w - dur AS t0, sum(dur) OVER w AS t1, sum(byte_len) OVER w - byte_len AS b0, idx = max(idx) OVER (PARTITION BY stream) AS last, sum(dur) OVER (PARTITION BY stream) AS total FROM i WINDOW w AS (PARTITION BY stream ORDER BY idx ROWS UNBOUNDED PRECEDING)) SELECT stream, min(idx) AS first_idx, max(idx) AS last_idx, min(b0)::BIGINT AS byte_from, max(b0 + byte_len)::BIGINT AS byte_to, round(min(t0), 6) AS t0_s, round(max(t1), 6) AS t1_s FROM t WHERE total >= 2.5 AND (t1 > 2.5 OR last) AND (t0 < 4 OR t0 <= 2.5) GROUP BY 1")
def byte_windows(spark, d):
    i = table(spark, d, "part").select(F.col("p_size").alias("stream"), F.col("p_partkey").alias("idx"), (F.col("p_partkey") * 10).alias("byte_len"), (F.col("p_retailprice") / 1000).alias("dur"))
    return _round(sources.byte_windows(i, 2.5, 4.0), "t0_s", "t1_s")


@query()
def stable_subjects(spark, d):
    """The busiest kind of event of a user's hours, in runs; folded in order, tested by a loop."""
    n = timed(spark, d).groupBy("user_id", F.expr("us div 3600000000").alias("hour")).agg(F.max("series_id").alias("subject"))
    return sequences.stable_runs(n.select("user_id", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY hour)").cast("long").alias("bin"), "subject"), "user_id", 3)


@query()
def token_chunks(spark, d):
    """Words of a conversation as chunks of characters; greedy, tested by cases."""
    w = _timed_words(spark, d)
    return sequences.character_chunks(w.select("conv_id", "idx", F.col("word").alias("raw"), F.col("start_s").alias("t0"), (F.col("start_s") + 0.125).alias("t1"), F.lit(0.5).alias("p")), "conv_id", 8)


@query()
def box_tracks(spark, d):
    """Lines of an order as boxes of two frames; a greedy match, tested by a loop."""
    b = _boxes(spark, d)
    b = b.select("l_orderkey", (F.col("l_linenumber") % 2).alias("frame"), F.col("l_linenumber").alias("det"), *(F.col(f"c.{k}").alias(k) for k in "xywh"))
    return sequences.tracked(b, "l_orderkey", 120.0)


@query()
def sentence_bounds(spark, d):
    """Seeds of ten seconds in each conversation, on sentence bounds; sequential, tested by cases."""
    u = turns(spark, d)
    seeds = u.where("idx % 4 = 1").select("conv_id", F.col("idx").alias("id"), (F.col("start_s") + 1).alias("start_s"), (F.col("start_s") + 11).alias("end_s"))
    return sentences.moment_bounds(seeds, u, "conv_id", 12.0, 30.0)


_LOG = "lg AS (SELECT user_id, 2 * row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, series_id, us / 1e6 AS t, (event_id % 100) / 100.0::DOUBLE AS score FROM ev WHERE us >= 0)"


@query(f"WITH {_EV}, {_LOG} SELECT user_id, round(t, 3) AS t, score FROM lg WHERE series_id <> 'error' AND series_id <> 'view'")
def scene_log(spark, d):
    """A log with times, scores, and noise: an error has no score line, a view only a time that is no number."""
    e = timed(spark, d).where("us >= 0").select("user_id", "series_id", "t", F.col("event_id"), F.expr("2 * row_number() OVER (PARTITION BY user_id ORDER BY us, event_id)").alias("n"))
    time = F.when(F.col("series_id") == "view", "frame pts_time:N/A").otherwise(F.concat(F.lit("frame:1 pts_time:"), F.col("t").cast("string"), F.lit(" x")))
    score = F.when(F.col("series_id") == "error", "nothing").otherwise(F.concat(F.lit("lavfi.scene_score="), ((F.col("event_id") % 100) / 100.0).cast("string")))
    lines = e.where("series_id <> 'view'").select("user_id", F.col("n").alias("n"), time.alias("line")).unionByName(e.where("series_id <> 'view'").select("user_id", (F.col("n") + 1).alias("n"), score.alias("line"))).unionByName(e.where("series_id = 'view'").select("user_id", "n", F.lit("frame pts_time:N/A").alias("line")))
    return _round(T.scene_scores(lines, "user_id"), "t", places=3)


@query("SELECT p_partkey AS index, p_name || ', ' || p_type AS name FROM part")
def class_labels(spark, d):
    p = table(spark, d, "part")
    line = F.concat(p.p_partkey.cast("string"), F.lit(",/m/0,\""), p.p_name, F.lit(", "), p.p_type, F.lit("\""))
    return p.select(N.class_label(line).alias("c")).select("c.index", "c.name")


@query("SELECT c_custkey, c_custkey % 50 AS at, CASE WHEN c_custkey % 3 <> 0 THEN 'w' || c_nationkey END AS word FROM customer WHERE c_custkey % 4 <> 0")
def edit_decisions(spark, d):
    c = table(spark, d, "customer")
    n = (c.c_custkey % 50 + 1).cast("string")
    line = F.when(c.c_custkey % 4 == 0, "none of these").when(c.c_custkey % 3 == 0, F.concat(n, F.lit(") delete"))).otherwise(F.concat(F.lit(" "), n, F.lit(": \"w"), c.c_nationkey.cast("string"), F.lit("\", said")))
    return c.select("c_custkey", N.decision(line).alias("d")).where("d IS NOT NULL").select("c_custkey", "d.at", "d.word")


@query(f"WITH {_EV}, seen AS (SELECT DISTINCT user_id, series_id AS track, us // 3600000000 AS bin FROM ev), e AS (SELECT user_id, bin // 24 AS seg, bin, track FROM seen WHERE bin >= 0 AND bin < 720), c AS (SELECT user_id, seg, sum((n >= 2)::INT) AS crowd FROM (SELECT user_id, seg, bin, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1, 2), m AS (SELECT user_id, seg, track, row_number() OVER (PARTITION BY user_id, seg ORDER BY n DESC, track DESC) AS k FROM (SELECT user_id, seg, track, count(*) AS n FROM e GROUP BY ALL)) SELECT i.user_id, g.seg, CASE WHEN crowd * 2 > 24 THEN 'group' ELSE track END AS subject FROM (SELECT DISTINCT user_id FROM ev) i CROSS JOIN (SELECT unnest(range(0, 30)) AS seg) g LEFT JOIN c ON c.user_id = i.user_id AND c.seg = g.seg LEFT JOIN m ON m.user_id = i.user_id AND m.seg = g.seg AND k = 1")
def segment_subjects(spark, d):
    seen = timed(spark, d).select("user_id", F.col("series_id").alias("track"), F.expr("us div 3600000000").alias("bin"))
    parts = seen.select("user_id").distinct().withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("user_id", F.col("seg").cast("long").alias("seg"), (F.col("seg") * 24).cast("long").alias("b0"), (F.col("seg") * 24 + 24).cast("long").alias("b1"))
    return T.segment_subjects(seen, parts, "user_id")


@query("WITH t AS (SELECT o_custkey AS clip, o_orderkey AS track, o_totalprice AS presence, (o_orderkey * 37) % 1000 AS cx FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY presence DESC, track) AS n FROM t) SELECT clip, track, row_number() OVER (PARTITION BY clip ORDER BY cx, presence DESC, track) - 1 AS id FROM k WHERE n <= 4")
def track_labels(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("track"), F.col("o_totalprice").alias("presence"), ((F.col("o_orderkey") * 37) % 1000).alias("cx"))
    return T.capped_tracks(t, "clip", 4).select("clip", "track", "id")


@query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, max(v) AS m FROM e GROUP BY 1), l AS (SELECT vec_id, any_value(m) + ln(sum(exp(v - m))) AS l FROM e JOIN m USING (vec_id) GROUP BY 1) SELECT vec_id, token::INT AS token, round(v - l, 5) AS v FROM e JOIN l USING (vec_id)")
def log_probabilities(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "v")).withColumn("v", F.col("v").cast("double"))
    return _round(T.log_softmax(e, ["vec_id"]), "v", places=5)


@query("WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, x, y, round(v, 6) AS v FROM p JOIN (SELECT unnest(range(0, 3)) AS x) ON true JOIN (SELECT unnest(range(0, 5)) AS y) ON true WHERE k % 8 = least(x * 8 // 3, 7) AND k // 8 = least(y * 8 // 5, 7)")
def nearest_downscale(spark, d):
    """Vectors of 64 as frames of 8 by 8, resampled to 3 by 5."""
    e = table(spark, d, "embeddings")
    src = e.select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", (F.col("k") % 8).cast("long").alias("x"), F.floor(F.col("k") / 8).alias("y"), F.col("v").cast("double").alias("v"))
    dst = e.select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return _round(T.resampled(dst, src, "vec_id", 8, 8, 3, 5), "v")


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d-%02d-%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d-%02d', s // 60, s % 60) END AS stem, round(o_totalprice * 1000)::BIGINT AS clip_id FROM (SELECT *, round(o_totalprice)::BIGINT AS s FROM orders)")
def clip_stems(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", N.clock_stem(o.o_totalprice).alias("stem"), N.clip_id(o.o_totalprice).alias("clip_id"))


_PAIRS = "sto AS (SELECT p_name AS wrong, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'r' || p_partkey END AS \"right\", p_partkey AS pos FROM part WHERE p_partkey % 2 = 0), cl AS (SELECT p_size AS clip, p_partkey AS pos, upper(p_name) AS wrong, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'c' || p_partkey END AS \"right\", p_size % 7 = 0 AS clip_only FROM part)"


def _pair_stores(spark, d):
    p = table(spark, d, "part")
    right = lambda n, mark: F.when(p.p_partkey % n == 0, "").otherwise(F.concat(F.lit(mark), p.p_partkey.cast("string")))
    # a word stands once in a store
    store = p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("wrong"), right(3, "r").alias("right"), F.col("p_partkey").alias("pos"))
    store = store.groupBy("wrong").agg(F.min_by("right", "pos").alias("right"))
    return store, p.select(F.col("p_size").alias("clip"), F.col("p_partkey").alias("pos"), F.upper("p_name").alias("wrong"), right(5, "c").alias("right"), (F.col("p_size") % 7 == 0).alias("clip_only"))


_ONE = "s1 AS (SELECT wrong, arg_min(\"right\", pos) AS \"right\" FROM sto GROUP BY 1)"


@query(f"WITH {_PAIRS}, {_ONE}, t AS (SELECT *, row_number() OVER (PARTITION BY lower(wrong) ORDER BY clip, pos) AS n FROM cl WHERE \"right\" = '' AND lower(wrong) NOT IN (SELECT lower(wrong) FROM s1)) SELECT wrong, \"right\", NULL::BIGINT AS clip FROM s1 UNION ALL SELECT wrong, '', clip::BIGINT FROM t WHERE n = 1")
def clip_todos(spark, d):
    return stores.with_clip_todos(*_pair_stores(spark, d))


@query(f"WITH {_PAIRS}, {_ONE}, g AS (SELECT *, row_number() OVER (PARTITION BY lower(wrong) ORDER BY pos) AS n FROM cl WHERE \"right\" <> '' AND NOT clip_only) SELECT coalesce(s1.wrong, g.wrong) AS wrong, CASE WHEN coalesce(s1.\"right\", '') <> '' THEN s1.\"right\" ELSE coalesce(g.\"right\", '') END AS \"right\" FROM s1 FULL JOIN (SELECT * FROM g WHERE n = 1) g ON lower(g.wrong) = lower(s1.wrong)")
def promoted_corrections(spark, d):
    return stores.promoted(*_pair_stores(spark, d))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'en' END, CASE WHEN c_nationkey % 2 = 0 THEN 'ja' END, 'id') AS language FROM customer")
def resolved_languages(spark, d):
    c = table(spark, d, "customer")
    creators = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("creator"), F.lit("ja").alias("language"))
    return stores.languages(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("creator"), F.when(F.col("c_custkey") % 5 == 0, "en").alias("explicit")), creators)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS body FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def upserted_records(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("body"))
    some = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("body"))
    return stores.upserted(c, some.unionByName(some.withColumn("c_custkey", -F.col("c_custkey"))), "c_custkey")


@query("WITH f AS (SELECT p_size AS video, CASE p_partkey % 3 WHEN 0 THEN 'https' WHEN 1 THEN 'http' ELSE 'm3u8_native' END AS protocol, 'u' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 'avc1.x' ELSE 'none' END AS vcodec, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 2 THEN 'none' ELSE 'mp4a.40' END AS acodec, (p_partkey % 9) * 180 AS height, CASE WHEN p_partkey % 7 = 0 THEN 'webm' END AS container, p_retailprice AS tbr FROM part), v AS (SELECT video, url, row_number() OVER (PARTITION BY video ORDER BY height DESC, floor(tbr) DESC, url DESC) AS n FROM f WHERE protocol IN ('http', 'https') AND vcodec LIKE 'avc1%' AND acodec = 'none' AND height <= 1080 AND container IS NULL), a AS (SELECT video, url, row_number() OVER (PARTITION BY video ORDER BY floor(tbr) DESC, url DESC) AS n FROM f WHERE protocol IN ('http', 'https') AND acodec LIKE 'mp4a%' AND vcodec = 'none'), m AS (SELECT video, bool_or(protocol LIKE 'm3u8%' AND vcodec <> 'none' AND acodec <> 'none' AND height <= 1080) AS muxed FROM f GROUP BY 1) SELECT m.video AS stream, CASE WHEN a.url IS NOT NULL THEN v.url END AS video, CASE WHEN v.url IS NOT NULL THEN a.url END AS audio, muxed FROM m LEFT JOIN v ON v.video = m.video AND v.n = 1 LEFT JOIN a ON a.video = m.video AND a.n = 1")
def format_choice(spark, d):
    p = table(spark, d, "part")
    k = p.p_partkey
    f = p.select(F.col("p_size").alias("stream"), F.when(k % 3 == 0, "https").when(k % 3 == 1, "http").otherwise("m3u8_native").alias("protocol"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.when(k % 2 == 0, "avc1.x").otherwise("none").alias("vcodec"), F.when((k % 2 == 0) & (k % 3 != 2), "none").otherwise("mp4a.40").alias("acodec"), ((k % 9) * 180).alias("height"), F.when(k % 7 == 0, "webm").alias("container"), p.p_retailprice.alias("tbr"))
    return stores.dash_pairs(f, "stream")


@query("SELECT c_nationkey, c_custkey AS id, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || n || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def numbered_names(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stem"))
    return stores.numbered_names(c, "c_nationkey")
