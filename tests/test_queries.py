"""Every registered query with SQL gives the rows that DuckDB gives."""

import datetime
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.queries import QUERIES, SQL, _rounded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda data, cols: sorted((tuple(plain(r[cols.index(c)]) for c in sorted(names)) for r in data), key=str)
    want = rows(cur.fetchall(), names)
    have = rows([tuple(r) for r in got.collect()], got.columns)
    assert len(have) == len(want) and [a for a in zip(have, want) if a[0] != a[1]][:3] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_rounds_as_sql(spark, con):
    values = [0.5029965, 0.2617055, 0.5169265, 0.0634105, 0.1234565, -0.5029965, 1.0, 2.5e-7, 5e-7, 123456.7890125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(_rounded(F.col("v")).alias("r")).collect()
    assert [x.r for x in got] == [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_fade_exactly_as_sql(spark, tmp_path):
    us = [3_017_979, 1_570_233, 99_999_999, 0, 50_000_000]
    rows = [(9389 + 7 * k, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=u), 6, "view") for k, u in enumerate(us)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").selectExpr("*", "1D AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(tuple(x) for x in QUERIES["fade_visibility"](spark, str(tmp_path)).collect()) == sorted(c.execute(SQL["fade_visibility"]).fetchall())
