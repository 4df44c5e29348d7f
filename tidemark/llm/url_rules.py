"""URL filters by a sort-merge range join.

The key of a host is the host reversed, and a dot: `gro.elpmaxe.`.  A host rule
and all its subdomains are then one interval of keys, and intervals of rules
are nested or apart.  Pages are dealt into key ranges (a hot host over several),
a rule into every range that it touches.  In each range a sweep in key order
keeps the stack of rules that the current host lies in; each entry holds the
paths of one rule host, longest first.

Of the rules that fit, the one with the longest text (host and path) wins, and
of equally long ones that with the longer host.  No rule: `allow`.

Null url and url without `://` have empty host and path.  Null page_id stays.
Pages that repeat each get a row.  Rules with null host or path are ignored; of
rules with one host and path, block wins.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packed as P
from tidemark.llm import ranges as R

DEFAULT = "allow"
#: Verdict, host and path of the rules that the query applies.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _deal_pages(cuts: list):
    def run(batches):
        for b in batches:
            ids, hosts = b.column("page_id").to_pylist(), b.column("host").to_pylist()
            keys = [h[::-1] + "." for h in hosts]
            to = [R.bucket(cuts, k, zlib.crc32(str(i).encode())) for i, k in zip(ids, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column("page_id"), b.column("host"), b.column("path"), pa.array(keys, pa.string())], names=["bucket", "page_id", "host", "path", "key"])

    return run


def _deal_rules(cuts: list):
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for verdict, host, path in zip(*(b.column(c).to_pylist() for c in ("verdict", "host", "path")), strict=True):
                key = host[::-1] + "."
                end = key[:-1] + "/"  # the character after the dot: no host of the interval reaches it
                out += [(k, key, end, verdict, host, path) for k in range(R.reach(cuts, key)[0], R.reach(cuts, end)[1] + 1)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["bucket", "key", "end", "verdict", "host", "path"])

    return run


def sweep(pages: list[tuple[str, str]], rules: list[tuple[str, str, str, str, str]]) -> list[tuple[str | None, str | None]]:
    """pages: sorted (key, path); rules: (key, end, verdict, host, path).  The rule and verdict of each page."""
    groups: dict[tuple[str, str], dict[str, tuple[str, str]]] = {}
    for key, end, verdict, host, path in sorted(rules):
        own = groups.setdefault((key, end), {})
        if path not in own or verdict == "block":
            own[path] = (host, verdict)
    opens = sorted(groups)
    stack: list[tuple[str, dict, list[int]]] = []
    out, at, last, found = [], 0, None, {}
    for page in pages:
        key, path = page
        if key != last:
            while at < len(opens) and opens[at][0] <= key:
                while stack and stack[-1][0] <= opens[at][0]:
                    stack.pop()
                own = groups[opens[at]]
                stack.append((opens[at][1], own, sorted({len(p) for p in own}, reverse=True)))
                at += 1
            while stack and stack[-1][0] <= key:
                stack.pop()
            last, found = key, {}
        if path not in found:
            best = None
            for _, own, sizes in stack:
                for n in sizes:
                    if path[:n] in own and len(path) >= n:
                        host, verdict = own[path[:n]]
                        rank = (len(host) + n, len(host))
                        if best is None or rank > best[0]:
                            best = (rank, host + path[:n], verdict)
                        break
            found[path] = best[1:] if best else (None, None)
        out.append(found[path])
    return out


def _sweep(key, left, right):
    left = left.sort_by([("key", "ascending"), ("path", "ascending")])
    rules = list(zip(*(right.column(c).to_pylist() for c in ("key", "end", "verdict", "host", "path")), strict=True))
    # Python's order of strings is that of code points, as Arrow's of UTF-8 bytes
    got = sweep(list(zip(left.column("key").to_pylist(), left.column("path").to_pylist(), strict=True)), rules)
    return pa.table({"page_id": left.column("page_id"), "host": left.column("host"), "path": left.column("path"), "rule": pa.array([r for r, _ in got], pa.string()), "verdict": pa.array([v or DEFAULT for _, v in got], pa.string())})


def judge(pages: DataFrame, rules: DataFrame, buckets: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    buckets = buckets or 4 * P.shuffle_parts(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    share = max(1, -(-rows.count() // R.SAMPLE))
    some = rows.where(F.pmod(F.xxhash64("page_id", "host"), F.lit(share)) == 0).select("host").limit(2 * R.SAMPLE).collect()
    cuts = R.bounds([x.host[::-1] + "." for x in some], buckets)
    dealt = rows.mapInArrow(_deal_pages(cuts), "bucket long, page_id long, host string, path string, key string")
    ruled = rules.where("host IS NOT NULL AND path IS NOT NULL").select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path")
    ruled = ruled.mapInArrow(_deal_rules(cuts), "bucket long, key string, end string, verdict string, host string, path string")
    return dealt.groupBy("bucket").cogroup(ruled.groupBy("bucket")).applyInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")


#: DuckDB SQL of judge() with RULES.
SQL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(verdict, rhost, rpath) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + """),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM b JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM b LEFT JOIN m ON m.page_id = b.page_id AND m.k = 1
"""
