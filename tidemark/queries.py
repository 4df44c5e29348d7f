"""Registered queries of the time-series, interval, store and text operators, with the DuckDB SQL of those that SQL expresses.

Events stand for the signals of a recording: an event type is a series, its
time runs from 2024-01-01, a bin is an hour.  Conversations stand for timed
text: a turn is a unit of 2 seconds, and every third pause is a long one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import layout as L
from tidemark.functions import text as T
from tidemark.operators import captions, intervals, moments, sentences, sequences, stores, waves, words
from tidemark.operators import series as S

BINS, HOUR = 720, 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "event_id", "user_id", "value", us.alias("us"), (us / 1e6).alias("t"), "props")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bin_counts(timed(spark, sf_dir), BINS, HOUR)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 2.5 + F.floor(F.col("turn") / 3) * 2.0
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), F.coalesce("text", F.lit("")).alias("text"), start.alias("start_s"), (start + 2.0).alias("end_s"), "role")


_EV = "ev AS (SELECT event_type AS series_id, event_id, user_id, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, props FROM events)"
_GRID = f"{_EV}, n AS (SELECT series_id, us // {HOUR} AS bin, count(*) AS c FROM ev WHERE us >= 0 AND us < {BINS * HOUR} GROUP BY ALL), s AS (SELECT i.series_id, g.bin, coalesce(n.c, 0)::DOUBLE AS v FROM (SELECT DISTINCT series_id FROM ev) i CROSS JOIN (SELECT unnest(range(0, {BINS})) AS bin) g LEFT JOIN n ON n.series_id = i.series_id AND n.bin = g.bin)"
_Z = f"{_GRID}, a AS (SELECT series_id, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS std FROM s GROUP BY 1), b AS (SELECT series_id, 1.4826 * median(abs(v - med)) AS mad FROM s JOIN a USING (series_id) GROUP BY 1), z AS (SELECT series_id, bin, CASE WHEN mad > 1e-9 THEN (v - med) / mad WHEN std > 1e-9 THEN (v - mean) / std ELSE 0 END AS v FROM s JOIN a USING (series_id) JOIN b USING (series_id))"
_TURNS = "u AS (SELECT conv_id, turn AS idx, coalesce(text, '') AS text, turn * 2.5::DOUBLE + floor(turn / 3) * 2.0 AS start_s, turn * 2.5::DOUBLE + floor(turn / 3) * 2.0 + 2.0 AS end_s, role FROM conversations)"


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


def _rounded(value, places: int = 6):
    """Rounded as DuckDB does: the scaled binary value counts, where Spark rounds the shortest decimal text (0.5029965 is a little less than that)."""
    return F.round(value * 10.0**places) / 10.0**places


@query(f"WITH {_GRID} SELECT series_id, bin, v FROM s")
def grid_bin_counts(spark, d):
    return hourly(spark, d)


@query(f"WITH {_EV} SELECT series_id, us // {HOUR} AS bin, round(sqrt(avg(value * value)), 6) AS v FROM ev WHERE us >= 0 AND value IS NOT NULL GROUP BY ALL")
def rms_per_bin(spark, d):
    return _round(S.rms_bins(timed(spark, d).where("value IS NOT NULL").withColumnRenamed("value", "x"), HOUR), "v")


@query(f"WITH {_Z} SELECT series_id, bin, round(v, 6) AS v FROM z")
def robust_z_scores(spark, d):
    return _round(S.robust_z(hourly(spark, d)), "v")


@query(f"WITH {_GRID} SELECT series_id, bin, round(avg(v) OVER (PARTITION BY series_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS mean_v, max(v) OVER (PARTITION BY series_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS max_v FROM s")
def centred_windows(spark, d):
    h = hourly(spark, d)
    return _round(S.smooth(h, 10).withColumnRenamed("v", "mean_v"), "mean_v").join(S.smooth_max(h, 10).withColumnRenamed("v", "max_v"), ["series_id", "bin"])


@query(f"WITH {_GRID}, p AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM s WINDOW w AS (PARTITION BY series_id ORDER BY bin)) SELECT series_id, bin, v FROM p WHERE v >= 2 AND (l IS NULL OR v > l) AND (r IS NULL OR v >= r)")
def local_peaks(spark, d):
    return S.peaks(hourly(spark, d), 2.0)


@query(f"WITH {_GRID}, o AS (SELECT *, bin - row_number() OVER (PARTITION BY series_id ORDER BY bin) AS g FROM s WHERE v >= 2) SELECT series_id, min(bin) AS start_bin, max(bin) AS end_bin, max(v) AS peak FROM o GROUP BY series_id, g")
def run_length_islands(spark, d):
    return S.mask_runs(hourly(spark, d), 2.0)


@query(f"WITH {_GRID}, k AS (SELECT series_id, bin, nullif(v, 0) AS v FROM s), g AS (SELECT *, count(v) OVER (PARTITION BY series_id ORDER BY bin) AS c FROM k) SELECT series_id, bin, coalesce(max(v) OVER (PARTITION BY series_id, c), (SELECT arg_min(x.v, x.bin) FROM k x WHERE x.v IS NOT NULL AND x.series_id = g.series_id)) AS v FROM g")
def forward_filled(spark, d):
    return S.filled(hourly(spark, d).withColumn("v", F.nullif("v", F.lit(0.0))))


@query(f"WITH {_EV}, q AS (SELECT series_id, list_sort(list(value)) AS s, count(value) AS n, median(value) AS med FROM ev WHERE value IS NOT NULL GROUP BY 1) SELECT series_id, round(med, 6) AS averaged, s[n // 2 + 1] AS upper_median, s[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS p95, s[least(floor(n * 0.9)::BIGINT, n - 1) + 1] AS p90, s[round((n - 1) * 0.1::DOUBLE)::BIGINT + 1] AS p10 FROM q")
def five_quantile_rules(spark, d):
    v, r = F.col("value"), S.ranked_quantile
    return timed(spark, d).where("value IS NOT NULL").groupBy("series_id").agg(F.round(F.median(v), 6).alias("averaged"), r(v, 0.5, "upper").alias("upper_median"), r(v, 0.95, "floor").alias("p95"), r(v, 0.9, "floor").alias("p90"), r(v, 0.1, "round").alias("p10"))


@query(f"WITH {_GRID} SELECT series_id, bin, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-7), 6) AS v FROM s WINDOW w AS (PARTITION BY series_id)")
def mean_variance_normalised(spark, d):
    return _round(S.normalised(hourly(spark, d)), "v")


_PIECES = f"{_EV}, k AS (SELECT user_id, t AS from_s, t + 5400 AS to_s FROM ev WHERE series_id = 'purchase'), p AS (SELECT user_id, event_id, t AS start_s, t + 3600 AS end_s FROM ev WHERE series_id = 'view')"


def _spans(spark, d):
    e = timed(spark, d)
    return e.where("series_id = 'view'").select("user_id", "event_id", F.col("t").alias("start_s"), (F.col("t") + 3600).alias("end_s")), e.where("series_id = 'purchase'").select("user_id", F.col("t").alias("from_s"), (F.col("t") + 5400).alias("to_s"))


@query(f"WITH {_PIECES} SELECT user_id, event_id, round(greatest(start_s, from_s), 3) AS lo, round(least(end_s, to_s), 3) AS hi FROM p JOIN k USING (user_id) WHERE least(end_s, to_s) - greatest(start_s, from_s) >= 0.05")
def interval_overlap_join(spark, d):
    return _round(intervals.cut_to(*_spans(spark, d), "user_id", 7200.0).select("user_id", "event_id", "lo", "hi"), "lo", "hi", places=3)


@query(f"WITH {_PIECES}, c AS (SELECT *, max(to_s) OVER (PARTITION BY user_id ORDER BY from_s, to_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k), g AS (SELECT user_id, coalesce(reach, 0) AS from_s, from_s AS to_s FROM c WHERE from_s > coalesce(reach, 0) UNION ALL SELECT user_id, max(to_s), 2592000 FROM k GROUP BY 1 HAVING max(to_s) < 2592000 UNION ALL SELECT DISTINCT user_id, 0, 2592000 FROM ev WHERE user_id NOT IN (SELECT user_id FROM k)) SELECT user_id, round(from_s, 3) AS from_s, round(to_s, 3) AS to_s FROM g")
def timeline_complement(spark, d):
    return _round(intervals.complement(_spans(spark, d)[1], "user_id", 2592000.0, timed(spark, d)), "from_s", "to_s", places=3)


_GAPS = f"{_PIECES}, c AS (SELECT *, max(to_s) OVER (PARTITION BY user_id ORDER BY from_s, to_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k), kept AS (SELECT user_id, coalesce(reach, 0) AS from_s, from_s AS to_s FROM c WHERE from_s > coalesce(reach, 0) UNION ALL SELECT user_id, max(to_s), 2592000 FROM k GROUP BY 1 HAVING max(to_s) < 2592000 UNION ALL SELECT DISTINCT user_id, 0, 2592000 FROM ev WHERE user_id NOT IN (SELECT user_id FROM k)), b AS (SELECT *, coalesce(sum(to_s - from_s) OVER (PARTITION BY user_id ORDER BY from_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM kept), j AS (SELECT p.*, from_s, base, greatest(start_s, from_s) AS lo, least(end_s, to_s) AS hi FROM p JOIN b USING (user_id) WHERE least(end_s, to_s) - greatest(start_s, from_s) > 1e-6), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY hi - lo DESC, from_s DESC) AS n FROM j)"


@query(f"WITH {_GAPS} SELECT user_id, event_id, round(base + lo - from_s, 2) AS new_start, round(base + hi - from_s, 2) AS new_end FROM r WHERE n = 1")
def best_overlap_remap(spark, d):
    units, cuts = _spans(spark, d)
    kept = intervals.complement(cuts, "user_id", 2592000.0, timed(spark, d))
    return _round(intervals.best_overlap(units, kept, "user_id", "event_id", 86400.0).select("user_id", "event_id", "new_start", "new_end"), "new_start", "new_end", places=2)


@query(f"WITH {_PIECES}, j AS (SELECT ev.user_id, ev.event_id, ev.t, from_s, row_number() OVER (PARTITION BY ev.user_id, ev.event_id ORDER BY abs(ev.t - (from_s + to_s) / 2), from_s) AS n FROM ev JOIN k ON k.user_id = ev.user_id AND from_s <= ev.t AND ev.t < to_s WHERE series_id = 'click') SELECT user_id, event_id, round(from_s, 3) AS from_s FROM j WHERE n = 1")
def nearest_covering_window(spark, d):
    points = timed(spark, d).where("series_id = 'click'").select("user_id", "event_id", "t")
    return _round(intervals.covering(points, _spans(spark, d)[1], "user_id", "event_id", 7200.0).select("user_id", "event_id", "from_s"), "from_s", places=3)


@query(f"WITH {_EV}, j AS (SELECT c.user_id, c.event_id, c.t, e.t AS snap_at, row_number() OVER (PARTITION BY c.user_id, c.event_id ORDER BY e.value DESC, e.t DESC) AS n FROM ev c LEFT JOIN ev e ON e.user_id = c.user_id AND e.series_id = 'view' AND e.value IS NOT NULL AND e.t >= c.t - 3600 AND e.t <= c.t + 600 WHERE c.series_id = 'click') SELECT user_id, event_id, round(coalesce(snap_at, t), 3) AS snapped FROM j WHERE n = 1")
def as_of_snap(spark, d):
    e = timed(spark, d)
    near = e.where("series_id = 'view' AND value IS NOT NULL").select("user_id", F.col("t").alias("at"), F.col("value").alias("score"))
    return _round(intervals.snapped(e.where("series_id = 'click'").select("user_id", "event_id", "t"), near, "user_id", "event_id", 3600.0, 600.0).select("user_id", "event_id", "snapped"), "snapped", places=3)


@query(f"WITH {_EV}, w AS (SELECT event_id, value AS a, CASE WHEN series_id <> 'view' THEN value / 2 END AS b, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE END AS c FROM ev) SELECT event_id, round(CASE WHEN (a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL) THEN (coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2) / ((a IS NOT NULL)::INT * 0.5::DOUBLE + (b IS NOT NULL)::INT * 0.3::DOUBLE + (c IS NOT NULL)::INT * 0.2::DOUBLE) ELSE 0 END, 6) AS score FROM w")
def null_aware_score(spark, d):
    e = timed(spark, d).select("event_id", F.col("value").alias("a"), F.when(F.col("series_id") != "view", F.col("value") / 2).alias("b"), F.when(F.col("event_id") % 3 == 0, F.lit(1.0)).alias("c"))
    return e.select("event_id", F.round(moments.combined_score({"a": 0.5, "b": 0.3, "c": 0.2}), 6).alias("score"))


_END = """'[.?!…。？！｡‼⁇⁈⁉]["'')\\]}」』）»]*$'"""


@query(f"WITH {_TURNS}, e AS (SELECT *, regexp_matches(rtrim(text, ' '), {_END}) AS shut0, lead(start_s) OVER (PARTITION BY conv_id ORDER BY idx) AS nx FROM u), f AS (SELECT *, shut0 OR coalesce(nx - end_s > 1.25, false) AS shut FROM e), g AS (SELECT *, coalesce(sum(shut::INT) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM f) SELECT conv_id, sentence, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS units, md5(string_agg(text, ' ' ORDER BY idx)) AS text_md5, bool_or(shut) AS closed FROM g GROUP BY 1, 2")
def sentence_segmentation(spark, d):
    return sentences.split(turns(spark, d), "conv_id").withColumn("text_md5", F.md5("text")).drop("text")


@query(f"WITH {_TURNS}, t AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY idx)) AS t, count(*) AS n FROM u GROUP BY 1) SELECT conv_id, round(((length(t) - length(replace(t, 'the', ''))) / 3.0::DOUBLE + (length(t) - length(replace(t, 'tion', ''))) / 4.0::DOUBLE) / n, 6) AS density FROM t")
def lexicon_density(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    t = turns(spark, d).groupBy("conv_id").agg(text.alias("text"), F.count("*").alias("n"))
    return t.select("conv_id", F.round(T.term_hits(F.col("text"), ["the", "tion"]) / F.col("n"), 6).alias("density"))


_CORR = "c AS (SELECT (p_partkey % 3)::INT AS layer, p_partkey AS pos, split_part(p_name, ' ', 1) AS wrong, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || p_partkey END AS \"right\", CASE WHEN p_size % 2 = 0 THEN (p_size % 10)::DOUBLE END AS at_s FROM part)"


@query(f"WITH {_CORR}, r AS (SELECT lower(wrong) AS k, *, row_number() OVER (PARTITION BY lower(wrong), at_s ORDER BY (\"right\" <> '') DESC, layer DESC, pos DESC, wrong DESC, \"right\" DESC) AS n, row_number() OVER (PARTITION BY lower(wrong), at_s ORDER BY layer, pos) AS m FROM c) SELECT w.wrong, w.right, w.at_s, p.layer, p.pos FROM (SELECT * FROM r WHERE n = 1) w JOIN (SELECT * FROM r WHERE m = 1) p ON w.k = p.k AND w.at_s IS NOT DISTINCT FROM p.at_s")
def layered_merge(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 3).cast("int").alias("layer"), F.col("p_partkey").alias("pos"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("wrong"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat("p_brand", F.col("p_partkey").cast("string"))).alias("right"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") % 10).cast("double")).alias("at_s"))
    return stores.layered(p)


@query(f"WITH {_EV}, v AS (SELECT us // {HOUR} AS pos, (event_id % 3)::INT AS variant, series_id AS token FROM ev), n AS (SELECT pos, token, count(*) AS n, max((variant = 0)::INT) AS b FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, b DESC, token) AS k FROM n) SELECT pos, token, n FROM r WHERE k = 1")
def plurality_vote(spark, d):
    return stores.voted(timed(spark, d).select(F.expr(f"us div {HOUR}L").alias("pos"), (F.col("event_id") % 3).cast("int").alias("variant"), F.col("series_id").alias("token")))


@query(f"WITH {_EV}, n AS (SELECT user_id AS cluster, series_id AS seat, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY cluster)::BIGINT AS total, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seat) AS k FROM n) SELECT cluster, seat, n, total FROM r WHERE k = 1 AND total >= 24 AND n / total >= 0.2")
def co_occurrence_join(spark, d):
    return stores.seats(timed(spark, d).select(F.col("user_id").alias("cluster"), F.col("series_id").alias("seat")), 24, 0.2)


@query(f"WITH {_EV}, g AS (SELECT series_id AS grp, value AS d, lead(value) OVER (PARTITION BY series_id ORDER BY value) AS nx FROM ev WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY nx - d DESC, d) AS k FROM g WHERE nx IS NOT NULL) SELECT i.grp, round(coalesce((nx + d) / 2, 0.5), 6) AS cut FROM (SELECT DISTINCT grp FROM g) i LEFT JOIN r ON r.grp = i.grp AND k = 1")
def largest_gap_cut(spark, d):
    return _round(stores.gap_cut(timed(spark, d).where("value IS NOT NULL").select(F.col("series_id").alias("grp"), F.col("value").alias("d"))), "cut")


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1) SELECT label, i::BIGINT AS i, round(v / norm, 5) AS v FROM m JOIN n USING (label)")
def embedding_mean(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    norm = x.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return x.join(norm, "label").select("label", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("v") / F.col("norm"), 5).alias("v"))


@query("SELECT a.vec_id, b.vec_id AS next_id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 5) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_distances(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("y"))
    return a.join(b, F.col("next_id") == F.col("vec_id") + 1).select("vec_id", "next_id", F.round(T.cosine_distance(F.col("x"), F.col("y")), 5).alias("dist"))


@query(f"WITH {_EV} SELECT event_id, CASE WHEN floor(s / 3600) > 0 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s % 3600 // 60, s % 60) END AS clock, s::DOUBLE AS parsed FROM (SELECT event_id, round(t)::BIGINT AS s FROM ev)")
def clock_round_trip(spark, d):
    c = timed(spark, d).select("event_id", T.clock(F.col("t")).alias("clock"))
    return c.withColumn("parsed", T.parse_clock(F.col("clock")))


@query("SELECT a.p_partkey, levenshtein(lower(a.p_name), lower(b.p_name)) <= 1 AS one_edit, starts_with(lower(a.p_name), lower(b.p_name)) OR starts_with(lower(b.p_name), lower(a.p_name)) OR levenshtein(lower(a.p_name), lower(b.p_name)) <= 2 AS similar FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def fuzzy_words(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"))
    q = p.select(F.col("p_partkey").alias("k"), F.col("a").alias("b"))
    return p.join(q, F.col("k") == F.col("p_partkey") + 1).select("p_partkey", T.within_one_edit(F.col("a"), F.col("b")).alias("one_edit"), T.similar(F.col("a"), F.col("b")).alias("similar"))


@query("WITH q AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'Other' ELSE c_mktsegment END AS title, c_custkey AS idx, c_name AS wrong FROM customer), g AS (SELECT title, min(idx) AS first_idx, count(*) AS n, md5(string_agg(wrong, '|' ORDER BY idx)) AS items FROM q GROUP BY 1) SELECT title, n, items, row_number() OVER (ORDER BY (title = 'Other')::INT, first_idx) AS place FROM g")
def review_groups(spark, d):
    q = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "Other").otherwise(F.col("c_mktsegment")).alias("title"), F.col("c_custkey").alias("idx"), F.col("c_name").alias("wrong"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "wrong"))), lambda x: x["wrong"]), "|")
    g = q.groupBy("title").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"), F.md5(items).alias("items"))
    return g.select("title", "n", "items", F.expr("row_number() OVER (ORDER BY (title = 'Other'), first_idx)").cast("long").alias("place"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 5 AS w, l_quantity / 2 + 1 AS h FROM lineitem), j AS (SELECT a.l_orderkey, a.l_linenumber, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS u FROM b a JOIN b b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) SELECT l_orderkey, l_linenumber, round(CASE WHEN u - i > 0 THEN i / (u - i) ELSE 0 END, 6) AS iou FROM j")
def box_overlap(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 5).alias("w"), (F.col("l_quantity") / 2 + 1).alias("h"))
    o = b.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("n"), *(F.col(c).alias(f"{c}2") for c in "xywh"))
    return b.join(o, (F.col("k") == F.col("l_orderkey")) & (F.col("n") == F.col("l_linenumber"))).select("l_orderkey", "l_linenumber", F.round(T.iou(*map(F.col, ("x", "y", "w", "h", "x2", "y2", "w2", "h2"))), 6).alias("iou"))


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey AS grp, o_totalprice AS score FROM orders) SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS new_id FROM o")
def rerank_and_renumber(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("score"))
    return moments.reranked(o.withColumn("new_id", F.col("id")).select("grp", "score", "id", "new_id"), "grp").select(F.col("new_id").alias("id"), "grp", F.col("id").alias("new_id"))


@query()
def detect_moments(spark, d):
    """The flagship: two signals of each user group to ranked moments; sequential rules, tested against brute force."""
    e = timed(spark, d).withColumn("series_id", F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")))
    return moments.detect(S.bin_counts(e.where("value IS NOT NULL"), BINS, HOUR), S.bin_counts(e, BINS, HOUR), 1.0, 10, 0.5, 6.0, 48.0, 25)


@query()
def greedy_peak_suppression(spark, d):
    return moments.non_maximum(S.peaks(hourly(spark, d), 1.0), 12)


@query()
def average_linkage_clusters(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 16).alias("grp"), F.col("vec_id").alias("item"), F.col("embedding").alias("emb"))
    return stores.clustered(e, "grp", 0.6)


@query()
def speaker_attribution(spark, d):
    e = timed(spark, d).where("value IS NOT NULL").groupBy((F.col("user_id") % 4).alias("clip"), F.expr(f"us div {HOUR}L").alias("bin"), F.col("series_id").alias("track")).agg(F.avg("value").alias("v"))
    e = e.withColumn("voiced", F.col("bin") % 7 != 0)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return stores.attributed(p, 3).assign(clip=p["clip"].iloc[0])[["clip", "bin", "speaker", "confidence"]]

    return e.groupBy("clip").applyInPandas(run, "clip long, bin long, speaker string, confidence double")


@query(f"WITH {_GRID}, q AS (SELECT series_id, list_sort(list(v)) AS l, count(*) AS n FROM s GROUP BY 1), b AS (SELECT series_id, greatest(0.22::DOUBLE * l[least(floor(n * 0.9)::BIGINT, n - 1) + 1], 0.004) AS bar FROM q) SELECT series_id, bin, v FROM s JOIN b USING (series_id) WHERE v > bar")
def voiced_bins(spark, d):
    return S.above_noise(hourly(spark, d))


@query("WITH l AS (SELECT user_id AS series_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT series_id, unnest(CASE WHEN n <= 20 THEN [0] ELSE list_distinct(list_append(range(0, n - 20 + 1, 15), n - 20)) END) AS start FROM l) SELECT series_id, start::BIGINT AS start FROM w")
def sliding_window_plan(spark, d):
    return S.window_starts(table(spark, d, "events").groupBy(F.col("user_id").alias("series_id")).agg(F.count("*").alias("n")), 20, 15)


@query(f"WITH {_GRID}, k AS (SELECT series_id, event_id AS span, t AS start_s, t + 9000 AS end_s FROM ev WHERE series_id = 'purchase') SELECT k.series_id, span, count_if(v >= 1) AS hits, count(v) AS total FROM k LEFT JOIN s ON s.series_id = k.series_id AND (bin + 0.5) * 3600 >= start_s AND (bin + 0.5) * 3600 < end_s GROUP BY 1, 2")
def mass_in_spans(spark, d):
    spans = timed(spark, d).where("series_id = 'purchase'").select("series_id", F.col("event_id").alias("span"), F.col("t").alias("start_s"), (F.col("t") + 9000).alias("end_s"))
    return _counts(S.mass(hourly(spark, d), spans, 3600.0, 1.0))


def _counts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("hits", "total")})


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 5 AS w, l_quantity / 2 + 1 AS h FROM lineitem), f AS (SELECT *, least(w, h * 0.5625::DOUBLE) AS fw, least(h, w / 0.5625::DOUBLE) AS fh FROM b) SELECT l_orderkey, l_linenumber, round(x + (w - fw) / 2, 6) AS fx, round(y + (h - fh) / 2, 6) AS fy, round(fw, 6) AS fw, round(fh, 6) AS fh, round(x + (y - x) * greatest(0, least(1, l_linenumber / 4.0::DOUBLE)), 6) AS pan FROM f")
def crop_geometry(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 5).alias("w"), (F.col("l_quantity") / 2 + 1).alias("h"))
    f = b.withColumn("f", L.fitted(*map(F.col, "xywh"), 0.5625))
    return f.select("l_orderkey", "l_linenumber", *(F.round(F.col(f"f.{c}"), 6).alias(f"f{c}") for c in "xywh"), F.round(L.blended(F.col("x"), F.col("y"), F.col("l_linenumber") / 4), 6).alias("pan"))


@query(f"WITH {_EV}, c AS (SELECT event_id, user_id, value, (round(greatest(t, 0) * 100))::BIGINT AS c FROM ev WHERE value IS NOT NULL) SELECT event_id, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS at, printf('&H%02X%02X%02X%02X', 255 - user_id % 256, event_id % 256, 7, 200) AS colour, 'Person ' || chr((65 + user_id % 26)::INT) AS person, round(8 + 4 * greatest(0, least(1, (value - 10) / 40)), 6) AS lead_s FROM c")
def caption_marks(spark, d):
    e = timed(spark, d).where("value IS NOT NULL")
    return e.select("event_id", L.caption_time(F.col("t")).alias("at"), L.caption_colour(F.lit(200), F.lit(7), F.col("event_id") % 256, F.col("user_id") % 256).alias("colour"), L.person(F.col("user_id")).alias("person"), F.round(L.ramp(F.col("value"), 10.0, 50.0, 8.0, 12.0), 6).alias("lead_s"))


_TOKENS = "tok AS (SELECT conv_id * 1000 + turn AS id, lower(split_part(text, ' ', 2)) AS token FROM conversations WHERE text IS NOT NULL), dict AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS word FROM benchmark), st AS (SELECT item_id AS pos, lower(split_part(text, ' ', 3)) AS wrong, 'r' || item_id AS \"right\" FROM (SELECT row_number() OVER (ORDER BY item_id) AS item_id, text FROM benchmark))"


@query("WITH e AS (SELECT p_partkey AS id, p_name AS wrong, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE upper(p_type) END AS \"right\" FROM part), c AS (SELECT DISTINCT lower(p_name) AS w, lower(p_type) AS r FROM part WHERE p_size % 2 = 0) SELECT id, wrong, \"right\" FROM e WHERE \"right\" <> '' AND lower(wrong) <> lower(\"right\") AND (lower(wrong), lower(\"right\")) IN (SELECT (w, r) FROM c)")
def allow_list_gate(spark, d):
    p = table(spark, d, "part")
    edits = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("wrong"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.upper("p_type")).alias("right"))
    return words.allowed(edits, p.where("p_size % 2 = 0").select(F.col("p_name").alias("wrong"), F.col("p_type").alias("right")))


@query("WITH v AS (SELECT 0 AS layer, p_partkey AS pos, p_type AS word FROM part UNION ALL SELECT 1, p_partkey, upper(split_part(p_name, ' ', 1)) FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY lower(word) ORDER BY layer, pos) AS n FROM v WHERE trim(word) <> '') SELECT count(*) AS words, string_agg(word, ', ' ORDER BY layer, pos) AS prompt FROM f WHERE n = 1")
def vocabulary_prompt(spark, d):
    p = table(spark, d, "part")
    own = p.select(F.lit(0).alias("layer"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("word"))
    return words.vocabulary(own.unionByName(p.select(F.lit(1).alias("layer"), F.col("p_partkey").alias("pos"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word"))))


@query()
def word_error_rates(spark, d):
    """Each turn against the one before it; an alignment, tested against brute force."""
    before = F.expr("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")
    return words.error_counts(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("got"), before.alias("want")))


def _every_word(texts, *keys):
    """The words between white space of every text, by number k from 0, and how many n the text has."""
    own = texts.select(*keys, F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    return own.select(*keys, F.size("w").alias("n"), F.posexplode("w").alias("k", "word"))


def _benchmark_words(spark, d):
    w = _every_word(table(spark, d, "benchmark"), "item_id")
    return w.select((F.col("item_id").cast("long") * 100_000 + F.col("k")).alias("pos"), F.lower("word").alias("word"))


_WORDS = "ww AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL)), bw AS (SELECT item_id * 100000 + k AS pos, lower(word) AS word FROM (SELECT item_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL)))"


@query(f"WITH {_WORDS}, o AS (SELECT conv_id AS clip, turn * 100000 + k AS idx, lower(regexp_replace(word, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS core, ((conv_id * 7 + turn * 13 + k * 29) % 100) / 100.0::DOUBLE AS confidence FROM ww), f AS (SELECT *, row_number() OVER (PARTITION BY clip, core ORDER BY idx) AS n FROM o WHERE confidence < 0.5 AND length(core) >= 4 AND regexp_matches(core, '\\p{{L}}') AND core NOT IN (SELECT word FROM bw)), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY confidence, idx) AS rank FROM f WHERE n = 1) SELECT clip, core, confidence, rank FROM r WHERE rank <= 8")
def harvest_candidates(spark, d):
    """Every word of the turns against every word of the known texts."""
    w = _every_word(table(spark, d, "conversations"), "conv_id", "turn")
    unsure = w.select(F.col("conv_id").alias("clip"), (F.col("turn").cast("long") * 100_000 + F.col("k")).alias("idx"), "word", (((F.col("conv_id") * 7 + F.col("turn") * 13 + F.col("k") * 29) % 100) / 100.0).alias("confidence"))
    return stores.harvested(unsure, _benchmark_words(spark, d).select("word"), 0.5, 4, 8)


@query()
def fuzzy_store_join(spark, d):
    """Every word of the turns against every word of the store and the dictionary; tested by brute force, as SQL would compare all pairs."""
    w = _every_word(table(spark, d, "conversations"), "conv_id", "turn")
    b = _benchmark_words(spark, d)
    store = b.select("pos", F.col("word").alias("wrong"), F.concat(F.lit("r"), F.col("pos").cast("string")).alias("right"))
    return words.fuzzy(w.select(((F.col("conv_id") * 1000 + F.col("turn")) * 100_000 + F.col("k")).alias("id"), F.lower("word").alias("token")), store, b.select("word"))


@query(f"WITH {_WORDS} SELECT turn, conv_id, k, regexp_replace(word, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS core, lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters FROM ww")
def text_cores(spark, d):
    w = _every_word(table(spark, d, "conversations"), "conv_id", "turn")
    return w.select("turn", "conv_id", F.col("k").cast("long").alias("k"), T.core(F.col("word")).alias("core"), T.alnum_lower(F.col("word")).alias("letters"))


@query()
def caption_line_groups(spark, d):
    """Every word of the turns, as captions of a conversation; the words of a turn share its time evenly, and a turn without words has no caption."""
    w = _every_word(turns(spark, d), "conv_id", "idx", "start_s")
    step = 2.0 / F.col("n")
    w = w.select("conv_id", (F.col("idx") * 100_000 + F.col("k")).alias("idx"), F.col("word").alias("text"), (F.col("start_s") + F.col("k") * step).alias("start_s"), (F.col("start_s") + (F.col("k") + 1) * step).alias("end_s"))
    return sequences.caption_lines(w, "conv_id")


@query()
def box_suppression(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("det"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 25).alias("w"), (F.col("l_quantity") / 2 + 11).alias("h"), F.col("l_extendedprice").alias("score"))
    return sequences.box_suppression(b, "l_orderkey", 0.3)


@query()
def refractory_onsets(spark, d):
    return sequences.onsets(timed(spark, d).select("user_id", "t"), "user_id", 7200.0)


@query()
def forced_alignment(spark, d):
    """Vectors as emissions of 16 frames over 4 tokens, aligned with three targets."""
    e = table(spark, d, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("clip"), F.expr("transform(sequence(0, 15), i -> transform(slice(embedding, i * 4 + 1, 4), x -> cast(x AS double)))").alias("logp"), F.expr("array(1 + cast(vec_id % 3 AS int), 2, 2)").alias("targets"))
    return sequences.forced_alignment(e)


@query(f"WITH {_EV}, m AS (SELECT user_id, event_id AS moment, t AS a, t + 5400 AS b FROM ev WHERE series_id = 'purchase'), j AS (SELECT c.user_id, c.event_id, moment, row_number() OVER (PARTITION BY c.event_id ORDER BY a, moment) AS n FROM ev c JOIN m ON m.user_id = c.user_id AND a - 1 <= t AND t <= b + 1 WHERE series_id = 'click') SELECT user_id, event_id, moment FROM j WHERE n = 1")
def clip_moment_link(spark, d):
    e = timed(spark, d)
    m = e.where("series_id = 'purchase'").select("user_id", F.col("event_id").alias("moment"), F.col("t").alias("from_s"), (F.col("t") + 5400).alias("to_s"))
    return intervals.first_within(e.where("series_id = 'click'").select("user_id", "event_id", "t"), m, "user_id", "event_id", "moment", 1.0, 7200.0).select("user_id", "event_id", "moment")


_NAME = r"""WITH a AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS one FROM pages), b AS (SELECT page_id, regexp_replace(one[:40], '^[.\s\p{Z}]+|[.\s\p{Z}]+$', '', 'g') AS cut FROM a) SELECT page_id, CASE WHEN coalesce(cut, '') = '' THEN 'page' WHEN regexp_matches(cut, '(?i)^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])(\.|$)') THEN '_' || cut ELSE cut END AS name FROM b"""


@query(_NAME)
def segment_names(spark, d):
    return table(spark, d, "pages").select("page_id", L.segment_name(F.col("url"), "page", 40).alias("name"))


_ASS_TIME = "printf('%d:%02d:%02d.%02d', {0} // 360000, {0} // 6000 % 60, {0} // 100 % 60, {0} % 100)"
_ASS_TEXT = "replace(replace(replace(replace(replace(text, '\\', '\\' || chr(8203)), '{', '\\{'), '}', '\\}'), chr(13), ''), chr(10), '\\N')"


@query(f"WITH {_TURNS}, e AS (SELECT conv_id, idx, (idx % 2)::INT AS layer, start_s, text, round(start_s * 100)::BIGINT AS a, round(end_s * 100)::BIGINT AS b FROM u), l AS (SELECT conv_id, layer, start_s, idx, 'Dialogue: ' || layer || ',' || {_ASS_TIME.format('a')} || ',' || {_ASS_TIME.format('b')} || ',Caption,,0,0,0,,' || {_ASS_TEXT} || chr(10) AS line FROM e) SELECT conv_id, count(*) AS n_lines, md5(string_agg(line, '' ORDER BY layer, start_s, idx)) AS document_md5 FROM l GROUP BY 1")
def subtitle_documents(spark, d):
    """Without the head, which is a constant."""
    lines = turns(spark, d).withColumn("layer", (F.col("idx") % 2).cast("int"))
    return captions.documents(lines, "conv_id", top="").select("conv_id", "n_lines", F.md5("document").alias("document_md5"))


def _spoken(spark, d):
    """Every word of the turns, in order; a word takes 0.1 to 0.5 seconds."""
    w = turns(spark, d).select("conv_id", F.col("idx").alias("turn"), "start_s", F.posexplode(F.split("text", " ")).alias("k", "text"))
    a = F.col("start_s") + F.col("k") * 0.5
    return w.select("conv_id", (F.col("turn") * 100_000 + F.col("k")).alias("idx"), "text", a.alias("start_s"), (a + 0.1 + (F.length("text") % 5) * 0.1).alias("end_s"), ((F.length("text") % 7) / 7.0).alias("confidence"))


@query()
def phrase_collapse(spark, d):
    """A sequential rule, tested by cases: the second and third word of each benchmark text are a phrase."""
    b = table(spark, d, "benchmark").where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("pos"), F.array_join(F.slice(F.split("text", " "), 2, 2), " ").alias("wrong"))
    return words.phrase_collapse(_spoken(spark, d), "conv_id", b.withColumn("right", F.upper(F.replace("wrong", F.lit(" "), F.lit("-")))))


@query()
def flash_respread(spark, d):
    """A sequential rule, tested by cases."""
    w = _spoken(spark, d)
    long = w.groupBy("conv_id").agg((F.max("end_s") + 1).alias("long"))
    return sequences.flash_respread(w.join(long, "conv_id"), "conv_id", "long")


def _sound(spark, d):
    """Each vector as 2,048 samples: its values, 32 times over, on a falling line."""
    e = table(spark, d, "embeddings").where("size(embedding) = 64")
    return e.select("vec_id", F.expr("transform(sequence(0, 2047), i -> cast(embedding[i % 64] AS double) * (1 - i / 4096))").alias("samples"))


@query()
def mel_filter_banks(spark, d):
    """Tested against a plain discrete Fourier sum."""
    return waves.filter_banks(_sound(spark, d), "vec_id")


@query()
def envelope_offsets(spark, d):
    """Each vector's values as loudness of 64 bins of 2048 samples, and the last three quarters as the take; tested by planted offsets."""
    e = table(spark, d, "embeddings").where("size(embedding) = 64")
    whole = e.select("vec_id", F.expr("transform(sequence(0, 64 * 512 - 1), i -> cast(embedding[i div 512] AS double))").alias("whole"))
    return waves.offsets(whole.withColumn("take", F.expr("slice(whole, 8193, 24576)")), "vec_id")


FLAGSHIP = detect_moments


# further queries register themselves
from tidemark import queries_more  # noqa: E402, F401
