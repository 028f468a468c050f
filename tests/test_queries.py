"""Every query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SLOW = {"ate_aipw", "cate", "gbt_vol", "gbt_importances", "ridge_probe", "regimes", "holdout_bakeoff", "projection_robustness", "topic_assign", "logistic_probe"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return "None" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [[plain(r[names.index(c)]) for c in columns] for r in found.fetchall()]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted(want)


def test_titles_equal_oracle_on_odd_entities(spark, tmp_path):
    titles = ["cut at &amp", "a &amp;lt; b &lt c", "&eacute; &#39;q&apos; &quot;&#x27;", "no\u00a0break &nbsp; \u3000wide", "v\x0btab \t\r\n\f end ", "", " ", "&nbsp;", "x" * 600]
    rows = [(i, f"<html><TITLE>{t}</Title><title>no</title>") for i, t in enumerate(titles)] + [(90, None), (91, "none"), (92, "")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["title_extract"]).fetchall()
    got = QUERIES["title_extract"](spark, str(tmp_path)).select("page_id", "title").collect()
    assert sorted(map(tuple, got)) == sorted(want) and dict(want)[0] == "cut at &amp"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
