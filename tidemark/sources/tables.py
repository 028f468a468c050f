"""Research tables (prices, macro, news, ledger ...) derived from the benchmark tables, and their DuckDB text.

Prices are one row per ticker and day it was observed. Values that later steps compare or rank are rounded where they
are made, so that both engines start from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark, d) -> DataFrame:
    """(ts, ticker, close, volume)"""
    part = read(spark, d, "part").select("p_partkey", F.col("p_type").alias("ticker"))
    sold = read(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("ts"), "l_extendedprice", "l_quantity")
    rows = sold.join(part, sold["l_partkey"] == part["p_partkey"])
    return rows.groupBy("ts", "ticker").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"), F.sum("l_quantity").alias("volume"))


def macro(spark, d) -> DataFrame:
    """(ts, series_id, value)"""
    return read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("series_id")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


def calendar(spark, d) -> DataFrame:
    """(ts): weekdays with a price"""
    return read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("ts")).where(F.weekday("ts") < 5).distinct()


def happenings(spark, d) -> DataFrame:
    """(ts, day, event_id, event_type, value, props)"""
    return read(spark, d, "events").select("ts", F.to_date("ts").alias("day"), "event_id", "event_type", "value", "props")


def news(spark, d) -> DataFrame:
    """(day, doc_id, source, themes (JSON array), src_lang, tone, title)"""
    docs, ev = read(spark, d, "documents"), read(spark, d, "events")
    both = docs.join(ev, docs["doc_id"] == ev["event_id"])
    return both.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("day"), "doc_id", "source", F.to_json(F.array("event_type", "lang")).alias("themes"),
        F.col("lang").alias("src_lang"), F.col("value").alias("tone"), F.col("text").alias("title"),
    )


def lots(spark, d) -> DataFrame:
    """(lot_id, line, metal, purchased, disposed, weight, paid)"""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("lot_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("metal"), F.to_date("o_orderdate").alias("purchased"), F.to_date("l_shipdate").alias("disposed"),
        F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("paid"),
    )


def positioning(spark, d) -> DataFrame:
    """(week, metal, longs, shorts): weekly order counts by priority and status; week is its Tuesday"""
    o = read(spark, d, "orders").withColumn("week", F.date_add(F.trunc("o_orderdate", "week"), 1))
    count = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).cast("long")
    return o.groupBy("week", F.col("o_orderpriority").alias("metal")).agg(count("O").alias("longs"), count("F").alias("shorts"))


def clusters(spark, d) -> DataFrame:
    """(ts, ticker, cluster_id, confidence) from the size of a day's volume; -1 is noise"""
    p = prices(spark, d)
    return p.select("ts", "ticker", F.when(F.col("volume") < 20, -1).otherwise((F.col("volume") % 4)).cast("int").alias("cluster_id"), F.round(F.try_divide(F.col("volume") % 17, F.lit(17.0)), 6).alias("confidence"))


def predictions(spark, d) -> DataFrame:
    """(run_id, split_id, ts, ticker, horizon, prediction, actual): a random walk and a constant against the next price change"""
    from tidemark.functions import windows as w

    p = prices(spark, d).withColumn("r", F.round(w.log_price() - F.lag(w.log_price()).over(w.over("ticker")), 6))
    p = p.withColumn("actual", F.lead("r").over(w.over("ticker"))).where("r is not null and actual is not null")
    runs = F.array(F.struct(F.lit("walk").alias("run_id"), F.col("r").alias("prediction")), F.struct(F.lit("flat").alias("run_id"), F.lit(0.01).alias("prediction")))
    return p.select("ts", "ticker", F.year("ts").alias("split_id"), "actual", F.inline(runs)).withColumn("horizon", F.lit(1))


#: The same tables for DuckDB, as common table expressions by name.
SQL = {
    "px": "px AS (SELECT l_shipdate::date AS ts, p_type AS ticker, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
    "mx": "mx AS (SELECT o_orderdate::date AS ts, o_orderpriority AS series_id, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)",
    "cal": "cal AS (SELECT DISTINCT l_shipdate::date AS ts FROM lineitem WHERE isodow(l_shipdate) < 6)",
    "evt": "evt AS (SELECT ts, ts::date AS day, event_id, event_type, value, props FROM events)",
    "news": """news AS (SELECT DATE '2024-01-01' + (doc_id % 60)::int AS day, doc_id, source, '["' || event_type || '","' || lang || '"]' AS themes, lang AS src_lang, value AS tone, text AS title
        FROM documents JOIN events ON doc_id = event_id)""",
    "lots": "lots AS (SELECT l_orderkey AS lot_id, l_linenumber AS line, l_returnflag AS metal, o_orderdate::date AS purchased, l_shipdate::date AS disposed, l_quantity AS weight, l_extendedprice AS paid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "pos": "pos AS (SELECT (date_trunc('week', o_orderdate) + INTERVAL 1 DAY)::date AS week, o_orderpriority AS metal, count(*) FILTER (o_orderstatus = 'O') AS longs, count(*) FILTER (o_orderstatus = 'F') AS shorts FROM orders GROUP BY 1, 2)",
    "asg": "asg AS (SELECT ts, ticker, CASE WHEN volume < 20 THEN -1 ELSE (volume % 4)::int END AS cluster_id, round((volume % 17) / 17.0, 6) AS confidence FROM px)",
    "prd": """prd AS (SELECT q.run_id, year(ts) AS split_id, ts, ticker, 1 AS horizon, CASE q.run_id WHEN 'walk' THEN r ELSE 0.01 END AS prediction, actual
        FROM (SELECT *, lead(r) OVER (PARTITION BY ticker ORDER BY ts) AS actual FROM (SELECT *, round(ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY ts), 6) AS r FROM px)), (VALUES ('walk'), ('flat')) q(run_id)
        WHERE r IS NOT NULL AND actual IS NOT NULL)""",
}
NEEDS = {"asg": ["px"], "prd": ["px"]}


def ctes(*names: str, more: str = "") -> str:
    """``WITH`` and the named tables, those they need first, then ``more``."""
    order = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "WITH " + ", ".join([SQL[n] for n in order] + ([more] if more else [])) + " "
