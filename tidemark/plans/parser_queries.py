"""Published payloads made up from the benchmark tables, and read back by the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators import store
from tidemark.sources import parsers as P
from tidemark.sources import tables as T

from .registry import query, rounded


def _reports(spark, d):
    """(day, months, totals): orders by day as a report's rows, one a contract month (priorities stand for months)."""
    o = T.read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("m"))
    rows = o.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    label = F.concat(F.element_at(F.array(*map(F.lit, ("JAN", "MAR", "MAY", "JLY", "SEP"))), F.col("m")), F.lit(" "), F.date_format("day", "yy"))
    return rows.withColumn("label", label)


REPORT = """rp AS (SELECT o_orderdate::date AS day, substr(o_orderpriority, 1, 1)::int AS m, count(*) AS n, round(sum(o_totalprice))::bigint AS total FROM orders GROUP BY 1, 2),
    mo AS (SELECT day, '20' || strftime(day, '%y') || '-' || lpad((m * 2 - 1)::varchar, 2, '0') AS month, n, total, isodow(day) = 5 AS early FROM rp)"""


def _volumes(spark, d):
    month = F.struct(F.col("label").alias("month"), F.format_number("total", 0).alias("totalVolume"), F.when(F.col("n") % 2 == 0, "-").otherwise(F.col("n").cast("string")).alias("atClose"), (-F.col("n")).cast("string").alias("change"))
    whole = F.struct(F.format_number(F.sum("total"), 0).alias("totalVolume"), F.sum("n").cast("string").alias("atClose"), F.lit("0").alias("change"))
    body = _reports(spark, d).groupBy("day").agg(F.collect_list(month).alias("monthData"), whole.alias("totals"))  # five rows a day
    return P.volumes(body.select(F.to_json(F.struct(F.date_format("day", "yyyyMMdd").alias("tradeDate"), F.lit(False).alias("empty"), "totals", "monthData")).alias("payload")))


def _settlements(spark, d):
    rows = _reports(spark, d)
    month = F.struct(F.col("label").alias("month"), F.concat(F.format_number(F.col("n") * 10.5, 1), F.when(F.col("m") == 1, "A").otherwise("")).alias("settle"))
    body = rows.groupBy("day").agg(F.concat(F.collect_list(month), F.array(F.struct(F.lit("Total").alias("month"), F.lit("-").alias("settle")))).alias("settlements"))
    kind = F.when(F.weekday("day") == 4, "Preliminary").otherwise("Final")
    return P.settlements(body.select(F.to_json(F.struct(F.date_format("day", "MM/dd/yyyy").alias("tradeDate"), kind.alias("reportType"), F.lit(False).alias("empty"), "settlements")).alias("payload")))


@query(f"WITH {REPORT} SELECT day AS trade_date, month, total AS volume, CASE WHEN n % 2 = 1 THEN n END AS open_interest, -n AS change FROM mo UNION ALL SELECT day, 'AGG', sum(total)::bigint, sum(n)::bigint, 0 FROM mo GROUP BY day")
def volume_reports(spark, d):
    return _volumes(spark, d)


@query(f"WITH {REPORT} SELECT day AS trade_date, month, round(n * 10.5, 1)::double AS settle, early AS is_preliminary FROM mo")
def settlement_reports(spark, d):
    return rounded(_settlements(spark, d), 1)


@query(f"WITH {REPORT} SELECT day AS trade_date, month, total AS volume, CASE WHEN early AND month NOT LIKE '%-01' THEN NULL ELSE round(n * 10.5, 1)::double END AS settle FROM mo")
def settlements_attached(spark, d):
    """Prices by month; volumes of the first month count as preliminary here, and only those take preliminary prices."""
    vol = _volumes(spark, d).where(F.col("month") != P.ALL_MONTHS).withColumn("is_preliminary", F.col("month").endswith("-01"))
    return rounded(P.attach_settlements(vol, _settlements(spark, d)).select("trade_date", "month", "volume", "settle"), 1)


@query(
    """SELECT event_id, ts + INTERVAL 5 HOUR AS release_utc, CASE event_type WHEN 'click' THEN 'cpi' ELSE 'jobs' END AS field, CASE WHEN event_type = 'click' THEN round(event_id % 50 / 10.0, 1) WHEN event_id % 4 < 2 THEN (event_id % 300)::double END AS forecast,
    event_type = 'view' AND event_id % 4 >= 2 AS violation, TIMESTAMP '2024-01-20' <= ts + INTERVAL 5 HOUR AS is_realtime FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events WHERE event_type IN ('click', 'view'))"""
)
def consensus_feed(spark, d):
    """A calendar feed in New York's winter offset: percentages, thousands, and counts without a unit, which are violations."""
    e, k = T.read(spark, d, "events"), F.col("event_id")
    text = F.when(F.col("event_type") == "click", F.concat(F.format_string("%.1f", (k % 50) / 10.0), F.lit("%"))).when(k % 4 < 2, F.concat((k % 300).cast("string"), F.lit("K"))).otherwise((k % 300).cast("string"))
    row = F.struct(F.col("event_type").alias("title"), F.lit("USD").alias("country"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")).alias("date"), k.cast("string").alias("impact"), text.alias("forecast"), F.lit("").alias("previous"))
    got = P.consensus(e.select(F.to_json(F.array(row)).alias("payload"), "event_id"), {"click": ("cpi", "%"), "view": ("jobs", "count")}, "2024-01-20", keep=("event_id",))
    return rounded(got.select("event_id", "release_utc", "field", "forecast", "violation", "is_realtime"), 1)


@query("SELECT p_partkey, round(p_retailprice, 2) AS price, round(p_retailprice * 0.9, 2) AS buyback, CASE WHEN p_partkey % 2 = 0 THEN 'json-ld' ELSE 'element' END AS source FROM part")
def product_prices(spark, d):
    """Product pages whose price stands in nested JSON-LD, or in an element alone."""
    k = F.col("p_partkey")
    money = lambda x: F.format_number(F.round(x, 2), 2)
    linked = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","offers":{"@type":"Offer","price":"'), money(F.col("p_retailprice")), F.lit('"}}]}</script>'))
    shown = F.concat(F.lit('<b class="big price">$'), money(F.col("p_retailprice")), F.lit("</b>"))
    html = F.concat(F.when(k % 2 == 0, linked).otherwise(""), shown, F.lit(" Buy-back at $"), money(F.round(F.col("p_retailprice") * 0.9, 2)))
    return rounded(P.product_pages(T.read(spark, d, "part").select("p_partkey", html.alias("html"))).select("p_partkey", "price", "buyback", "source"), 2)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'gold' ELSE 'silver' END AS metal, (o_orderkey % 100 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END)::bigint AS longs, 0::bigint AS shorts FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def report_positions(spark, d):
    """Weekly report rows by market name, columns summed with nulls as zero; a column that the report lacks counts nothing."""
    o, k = T.read(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("report_date"), F.concat("o_orderpriority", F.lit(" - COMMODITY EXCHANGE")).alias("market"), (k % 100).cast("string").alias("a"), F.when(k % 3 != 0, F.col("o_custkey").cast("string")).alias("b"))
    return P.report_positions(rows, {"1-URGENT": "gold", "2-HIGH": "silver"}, {"longs": ["a", "b", "absent"], "shorts": ["missing"]}).withColumnRenamed("report_date", "o_orderkey")


@query(
    """WITH l AS (SELECT o_orderkey, o_orderdate::date + (o_orderkey % 1440 * INTERVAL 1 MINUTE) AS t FROM orders), u AS (SELECT *, timezone('UTC', timezone('America/New_York', t)) AS u FROM l),
    c AS (SELECT *, timezone('America/New_York', timezone('UTC', u)) <> t AS skipped, timezone('America/New_York', timezone('UTC', u + INTERVAL 1 HOUR)) = t OR timezone('America/New_York', timezone('UTC', u - INTERVAL 1 HOUR)) = t AS repeated, u > TIMESTAMP '1998-06-01' AS late FROM u)
    SELECT o_orderkey, CASE WHEN NOT (skipped OR repeated OR late) THEN u END AS utc, CASE WHEN skipped THEN 'skipped by the clock' WHEN repeated THEN 'repeated by the clock' WHEN late THEN 'in the future' END AS violation FROM c"""
)
def local_times(spark, d):
    """Times of New York in UTC; those that the clock skips or repeats, or after the export, are refused."""
    k = F.col("o_orderkey")
    local = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.lpad(F.floor(k % 1440 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00"))
    utc, rule = D.to_utc(local, "America/New_York", F.lit("1998-06-01").cast("timestamp"))
    return T.read(spark, d, "orders").select("o_orderkey", utc.alias("utc"), rule.alias("violation"))


def _lines(spark, head: list[str], rows):
    """(line, at): fixed lines, then ``rows`` (order, line)."""
    top = spark.createDataFrame([(x, i - 100) for i, x in enumerate(head)], "line string, at long")
    return top.unionByName(rows.select("line", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("at")))


@query(
    """SELECT m AS period_start, 'MONTH' AS unit, t AS term, 'US' AS geo, CASE WHEN v < 1 THEN 0.0 ELSE v::double END AS value, v < 1 AS below_one
    FROM (SELECT date_trunc('month', o_orderdate)::date AS m, t, count(*) FILTER (o_orderpriority = p) % 100 AS v FROM orders, (VALUES ('1-URGENT', 'sell gold'), ('2-HIGH', 'cash')) q(p, t) GROUP BY 1, 2)"""
)
def trend_export(spark, d):
    """Monthly interest by term, read back from the lines of an export."""
    n = lambda p: F.count_if(F.col("o_orderpriority") == p) % 100
    shown = lambda c: F.when(c < 1, "<1").otherwise(c.cast("string"))
    months = T.read(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(n("1-URGENT").alias("a"), n("2-HIGH").alias("b"))
    rows = months.select("day", F.concat_ws(",", F.date_format("day", "yyyy-MM"), shown(F.col("a")), shown(F.col("b"))).alias("line"))
    return P.trend_rows(_lines(spark, ["Category: All categories", "", "Month,sell gold: (US),cash: (US)"], rows))


@query("SELECT day AS price_date, metal, price, 'close' AS quote FROM (SELECT o_orderdate::date AS day, unnest(['platinum', 'palladium']) AS metal, unnest([round(avg(o_totalprice), 2), CASE WHEN count(*) % 3 <> 0 THEN round(max(o_totalprice), 2) END]) AS price FROM orders GROUP BY 1) WHERE price IS NOT NULL")
def metal_table(spark, d):
    """Day-first prices by metal, some blank, read back from the lines of a published table."""
    o = T.read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 2).alias("a"), F.round(F.max("o_totalprice"), 2).alias("b"), F.count(F.lit(1)).alias("n"))
    b = F.when(F.col("n") % 3 != 0, F.col("b").cast("string")).otherwise("")
    rows = o.select("day", F.concat_ws(",", F.date_format("day", "dd/MM/yyyy"), F.col("a").cast("string"), b).alias("line"))
    return rounded(P.metal_rows(_lines(spark, ["Base prices", "Date,Platinum,Palladium"], rows), "close"), 2)


@query("SELECT day, a, b FROM (SELECT o_orderkey, o_orderdate::date AS day, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice, 2) END AS a, CASE WHEN o_orderkey % 5 = 0 THEN round(o_totalprice + 1, 2) END AS b FROM orders) WHERE coalesce(a, b) IS NOT NULL")
def sheet_measures(spark, d):
    """A sheet's rows as landed strings: those with a measure are kept."""
    o, k = T.read(spark, d, "orders"), F.col("o_orderkey")
    cell = lambda test, x: F.when(test, F.round(x, 2).cast("string")).otherwise("-")
    return rounded(P.sheet_rows(o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), cell(k % 3 == 0, F.col("o_totalprice")).alias("a"), cell(k % 5 == 0, F.col("o_totalprice") + 1).alias("b")), "day", ["a", "b"]), 2)


@query("""SELECT DISTINCT o_orderdate::date AS day, 'cpi' AS event_type, '08:30' AS release_time, '{"kind":"' || o_orderpriority || '"}' AS metadata FROM orders WHERE o_orderdate <= '1997-12-31' AND o_orderstatus <> 'P'""")
def release_calendar(spark, d):
    """Releases with valid days and times up to a cutoff."""
    o = T.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderstatus") == "P", "25:99").otherwise("08:30").alias("time"), F.col("o_orderpriority").alias("kind"))
    return P.calendar_rows(o, "day", "time", "cpi", "1997-12-31")[0]


@query(
    """WITH c AS (SELECT o_orderdate::date::varchar AS day, CASE WHEN o_orderstatus = 'P' THEN '25:99' ELSE '08:30' END AS t, o_orderpriority AS kind FROM orders WHERE o_orderdate <= '1997-12-31')
    SELECT day AS value, 'bad time' AS rule FROM c WHERE t = '25:99' UNION ALL SELECT day, 'repeated row' FROM (SELECT day, t, kind FROM c GROUP BY ALL HAVING count(*) > 1)"""
)
def release_violations(spark, d):
    o = T.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderstatus") == "P", "25:99").otherwise("08:30").alias("time"), F.col("o_orderpriority").alias("kind"))
    return P.calendar_rows(o, "day", "time", "cpi", "1997-12-31")[1]


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def preflight(spark, d):
    """Row counts of the tables that a run needs, none empty."""
    counts = store.preflight({n: T.read(spark, d, n) for n in ("orders", "part", "events")})
    return spark.createDataFrame(list(counts.items()), "name string, n long")
