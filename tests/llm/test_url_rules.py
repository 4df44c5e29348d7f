import random

import duckdb
import pandas as pd

from tidemark.llm import url_rules as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c in U._UPPER else c for c in host)
    best = max(((len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_as_brute_force(spark):
    r = random.Random(1)
    labels = ["a", "b", "com", "org", "example", "x-y", "ü"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    paths = ["/", "/a", "/a/b", "/fr/", "", "/fr/x", "/a/bc?q", "?x/y", "#/a"]
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((host(), r.choice(paths[:4])) for _ in range(60))}.values())
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{host().upper() if r.random() < 0.3 else host()}{r.choice(paths)}" for _ in range(500)]
    urls += [None, "", "no scheme/", "x://", "http://?a", "http://org", "http://.org/", "http://org./", "a://b://c/d"] + ["http://b.com/fr/x"] * 300
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, "http://a/", "r"), (0, urls[0], "r")], "page_id long, url string, rule string")
    got = sorted((tuple(x) for x in U.judge(pages, U.rules_table(spark, rules), 16).collect()), key=str)
    want = sorted(((i, *brute(u, rules)) for i, u in [*enumerate(urls), (None, "http://a/"), (0, urls[0])]), key=str)
    assert got == want


def test_sql_and_empty(spark):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(U.SQL).fetchall()
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = U.judge(df, U.rules_table(spark))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(pages) == len(want)
    assert U.judge(df.limit(0), U.rules_table(spark)).count() == 0
    assert U.judge(df, U.rules_table(spark).limit(0)).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
