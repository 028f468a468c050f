"""Coverage, validation, selection and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import quality as Q
from tidemark.operators import selection as S
from tidemark.operators import upserts as U
from tidemark.sources import tables as T
from tidemark.sources.tables import ctes

from .registry import query, rounded


@query(ctes("px") + "SELECT ticker, year(ts)::int AS year, count(*) AS n, round(count(*) / 250.0, 6) AS share FROM px GROUP BY 1, 2")
def coverage_by_year(spark, d):
    return rounded(Q.coverage(T.prices(spark, d), ["ticker", F.year("ts").alias("year")], 250.0))


@query(ctes("mx") + "SELECT series_id, count(*) AS n, min(ts) AS first_day, max(ts) AS last_day, round(count(*) / (max(ts) - min(ts) + 1), 6) AS share, count(*) / (max(ts) - min(ts) + 1) < 0.7 AS low FROM mx GROUP BY 1")
def coverage_by_series(spark, d):
    got = T.macro(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"))
    return rounded(got.withColumn("share", F.col("n") / (F.datediff("last_day", "first_day") + 1)).withColumn("low", F.col("share") < 0.7))


@query("SELECT year(o_orderdate)::int AS year, count(*) AS n_rows, count(nullif(o_orderstatus, 'P')) AS n_final FROM orders GROUP BY 1")
def null_coverage(spark, d):
    return T.read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.nullif("o_orderstatus", F.lit("P"))).alias("n_final"))


@query("SELECT ticker, bool_or(y = 1996) AS has_1996, sum(CASE WHEN y = 1996 THEN n ELSE 0 END)::bigint AS n_1996, sum(CASE WHEN y = 1997 THEN n ELSE 0 END)::bigint AS n_1997 FROM (" + ctes("px") + "SELECT ticker, year(ts) AS y, count(*) AS n FROM px GROUP BY 1, 2) GROUP BY ticker")
def coverage_matrix(spark, d):
    p = T.prices(spark, d).withColumn("y", F.year("ts"))
    return p.groupBy("ticker").agg(F.bool_or(F.col("y") == 1996).alias("has_1996"), F.count_if(F.col("y") == 1996).alias("n_1996"), F.count_if(F.col("y") == 1997).alias("n_1997"))


SPARSE = "sp AS (SELECT DISTINCT o_orderdate::date AS day FROM orders WHERE o_orderstatus = 'P')"


def sparse_days(spark, d):
    return T.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day")).distinct()


@query(
    f"""WITH {SPARSE}, e AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::date AS day FROM sp), m AS (SELECT day FROM e WHERE day NOT IN (SELECT day FROM sp))
    SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM (SELECT day, day - (row_number() OVER (ORDER BY day))::int AS g FROM m) GROUP BY g"""
)
def missing_ranges(spark, d):
    return Q.islands(Q.missing_days(sparse_days(spark, d), "day", weekdays_only=False), "day")


HOLIDAYS = ", ".join(f"DATE '{x}'" for x in X.exchange_holidays(1995, 2001))


@query(ctes("cal") + f"SELECT day FROM (SELECT unnest(generate_series((SELECT min(ts) FROM cal), (SELECT max(ts) FROM cal), INTERVAL 1 DAY))::date AS day) WHERE isodow(day) < 6 AND day NOT IN ({HOLIDAYS}) AND day NOT IN (SELECT l_shipdate::date FROM lineitem WHERE l_linenumber = 7)")
def expected_missing(spark, d):
    """Trading days, by rule, that a thin capture lacks."""
    cal = T.calendar(spark, d)
    seen = T.read(spark, d, "lineitem").where("l_linenumber = 7").select(F.to_date("l_shipdate").alias("day")).distinct()
    closed = spark.createDataFrame([(x,) for x in X.exchange_holidays(1995, 2001)], "day date")
    return Q.missing_days(cal, "ts", closed=closed).unionByName(cal.select(F.col("ts").alias("day")).join(closed, "day", "left_anti")).join(seen, "day", "left_anti")


@query(f"""WITH {SPARSE} SELECT day, n, median FROM (SELECT day, n, median(n) OVER (PARTITION BY year(day)) AS median FROM (SELECT o_orderdate::date AS day, count(*) AS n FROM orders GROUP BY 1)) WHERE n < 0.5 * median""")
def partial_days(spark, d):
    counts = T.read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return Q.partial_days(counts)


@query(
    ctes("mx") + """SELECT series_id, ts AS day, before, (SELECT count(*) FROM range(1, (ts - before)::bigint + 1) r(i) WHERE isodow(before + i::int - 1) < 6) AS gap FROM (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM mx)
    WHERE (SELECT count(*) FROM range(1, (ts - before)::bigint + 1) r(i) WHERE isodow(before + i::int - 1) < 6) > 3"""
)
def business_gaps(spark, d):
    return Q.business_gaps(T.macro(spark, d), "series_id", "ts", 3)


@query(ctes("px") + """SELECT ticker, max(n) AS longest, arg_max(n, g) AS trailing FROM (SELECT ticker, g, count(*) AS n FROM (SELECT ticker, ts, sum(c) OVER (PARTITION BY ticker ORDER BY ts) AS g FROM (SELECT ticker, ts, (volume % 3 IS DISTINCT FROM lag(volume % 3) OVER (PARTITION BY ticker ORDER BY ts) OR lag(ts) OVER (PARTITION BY ticker ORDER BY ts) IS NULL)::int AS c FROM px)) GROUP BY 1, 2) GROUP BY ticker""")
def stale_runs(spark, d):
    return Q.equal_runs(T.prices(spark, d).withColumn("v", F.col("volume") % 3), "ticker", "v")


@query(ctes("mx") + "SELECT series_id, max(ts) - 3 AS last_success, max(ts) AS last_data, DATE '1998-08-10' - max(ts) > 5 AND DATE '1998-08-10' - (max(ts) - 3) > 5 AS stale FROM mx GROUP BY 1")
def collector_staleness(spark, d):
    latest = T.macro(spark, d).groupBy("series_id").agg(F.max("ts").alias("last_data"))
    return Q.stale(latest, latest.select("series_id", F.date_sub("last_data", 3).alias("last_success")), "series_id", "1998-08-10", 5)


@query(ctes("lots") + "SELECT metal, count(*) AS n, round(avg(disposed - purchased), 6) AS mean_days, round(avg(disposed - purchased) * 5 / 7, 6) AS trading_days FROM lots WHERE disposed >= purchased GROUP BY metal HAVING count(*) >= 5")
def float_days(spark, d):
    held = T.lots(spark, d).where("disposed >= purchased").groupBy("metal").agg(F.count(F.lit(1)).alias("n"), F.avg(F.datediff("disposed", "purchased")).alias("mean_days")).where("n >= 5")
    return rounded(held.withColumn("trading_days", F.col("mean_days") * 5 / 7))


@query("SELECT m.metal, coalesce(t.days, 20.0) AS days, t.days IS NULL AS is_fallback FROM (VALUES ('A'), ('N'), ('R'), ('X')) m(metal) LEFT JOIN (" + ctes("lots") + "SELECT metal, round(avg(disposed - purchased), 6) AS days FROM lots WHERE disposed >= purchased GROUP BY 1) t ON m.metal = t.metal")
def float_days_fallback(spark, d):
    names = spark.createDataFrame([(m,) for m in "ANRX"], "metal string")
    days = rounded(T.lots(spark, d).where("disposed >= purchased").groupBy("metal").agg(F.avg(F.datediff("disposed", "purchased")).alias("days")))
    return names.join(days, "metal", "left").select("metal", F.coalesce("days", F.lit(20.0)).alias("days"), F.col("days").isNull().alias("is_fallback"))


def ledger_rules():
    return [("metal known", F.col("metal").isin("A", "N")), ("weight positive", F.col("weight") > 1), ("disposed after purchase", F.col("disposed") >= F.col("purchased")), ("paid plausible", F.col("paid").between(1000, 50000))]


@query(
    ctes("lots") + """SELECT lot_id * 10 + line AS line_no, rule FROM (SELECT *, unnest([CASE WHEN metal NOT IN ('A', 'N') THEN 'metal known' END, CASE WHEN NOT weight > 1 THEN 'weight positive' END, CASE WHEN disposed < purchased THEN 'disposed after purchase' END,
    CASE WHEN paid NOT BETWEEN 1000 AND 50000 THEN 'paid plausible' END]) AS rule FROM lots) WHERE rule IS NOT NULL"""
)
def ledger_violations(spark, d):
    return Q.violations(T.lots(spark, d).withColumn("line_no", F.col("lot_id") * 10 + F.col("line")), "line_no", ledger_rules())


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_linenumber AS k, l_quantity AS q, l_shipdate::date AS s, l_discount AS d FROM lineitem)
    SELECT line, 'weight' AS "column", 'not a double' AS rule, 'violation' AS severity FROM c WHERE k = 1 UNION ALL SELECT line, 'weight', 'too high', 'violation' FROM c WHERE k <> 1 AND q > 45
    UNION ALL SELECT line, 'weight', 'unusually high', 'warning' FROM c WHERE k <> 1 AND q > 40 AND q <= 45 UNION ALL SELECT line, 'day', 'required', 'violation' FROM c WHERE k = 2 UNION ALL SELECT line, 'day', 'too high', 'violation' FROM c WHERE k <> 2 AND s > DATE '1998-06-01'
    UNION ALL SELECT line, 'note', 'unusually high', 'warning' FROM c WHERE k <> 3 AND d > 0.08"""
)
def ledger_cells(spark, d):
    """Cells of an export as strings: malformed, missing, out of range and odd ones by line."""
    li, k = T.read(spark, d, "lineitem"), F.col("l_linenumber")
    rows = li.select(
        (F.col("l_orderkey") * 10 + k).alias("n"), F.when(k == 1, "heavy").otherwise(F.col("l_quantity").cast("string")).alias("weight"),
        F.when(k != 2, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"), F.when(k != 3, F.col("l_discount").cast("string")).otherwise(" ").alias("note"),
    )
    return Q.cell_report(rows, "n", {"weight": ("double", True, 0, 45, 40), "day": ("date", True, "1990-01-01", "1998-06-01", None), "note": ("double", False, None, None, 0.08)})


@query(ctes("lots") + "SELECT CASE WHEN e > 0.05 THEN 'reject' WHEN e > 0.01 THEN 'warn' ELSE 'ok' END AS verdict, count(*) AS n FROM (SELECT round(abs(weight * (1 + (lot_id % 9) / 100.0) / weight - 1), 9) AS e FROM lots) GROUP BY 1")
def assay_check(spark, d):
    """Weights off by 0 to 8 per cent; an error of exactly a limit is within it."""
    lots = T.lots(spark, d)
    return lots.groupBy(Q.relative_check(F.col("weight") * (1 + (F.col("lot_id") % 9) / 100), F.col("weight")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_partkey % 3 AS grp, count(*) AS n, string_agg(l_linenumber::varchar, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, d):
    li = T.read(spark, d, "lineitem").withColumn("grp", F.col("l_partkey") % 3)
    return Q.repeated_keys(li, ["l_orderkey", "grp"], "l_linenumber").withColumn("lines", F.col("lines").cast("string"))


@query("SELECT DISTINCT l_shipdate::date AS day FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1996-07-01'")
def distinct_dates(spark, d):
    return T.read(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1996-07-01'").select(F.to_date("l_shipdate").alias("day")).distinct()


@query("SELECT i AS month_start, least((i + INTERVAL 1 MONTH)::date, hi + 1) AS month_end FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH))::date AS i, max(o_orderdate)::date AS hi FROM orders)")
def month_parts(spark, d):
    span = T.read(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    starts = span.select("hi", F.explode(F.expr("sequence(trunc(lo, 'month'), hi, interval 1 month)")).alias("month_start"))
    return starts.select("month_start", F.least(F.add_months("month_start", 1), F.date_add("hi", 1)).alias("month_end"))


@query("SELECT o_orderkey, o_orderdate::date AS day FROM orders ORDER BY md5(o_orderkey || '|s1'), o_orderkey LIMIT 100")
def hash_sample(spark, d):
    return S.hash_sample(T.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey", 100, "s1")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|s2'), doc_id) <= 25")
def hash_sample_by_language(spark, d):
    return S.hash_sample(T.read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25, "s2", ["lang"])


@query(ctes("evt") + "SELECT day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY day) AS n FROM evt) e WHERE n <= 7 OR r IN (SELECT (i * e.n) // 7 FROM range(7) t(i))")
def systematic_pick(spark, d):
    return S.systematic(T.happenings(spark, d), "day", ["ts", "event_id"], 7).select("day", "event_id")


@query(
    ctes("evt")
    + """, s AS (SELECT *, hour(ts) BETWEEN 13 AND 21 AS s FROM evt), c AS (SELECT *, count(*) OVER (PARTITION BY day, s) AS n, count(*) OVER (PARTITION BY day) AS a, row_number() OVER (PARTITION BY day, s ORDER BY ts, event_id) - 1 AS r FROM s),
    q AS (SELECT *, least(n, greatest(CASE WHEN s THEN 24 ELSE 16 END, 40 - (a - n))) AS k FROM c) SELECT day, event_id FROM q WHERE n <= k OR r IN (SELECT (i * q.n) // q.k FROM range(40) t(i) WHERE i < q.k)"""
)
def session_cap(spark, d):
    return S.session_cap(T.happenings(spark, d), "day", F.hour("ts").between(13, 21), ["ts", "event_id"], 40, 0.6).select("day", "event_id")


ALLOC = """n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), q AS (SELECT *, least(20, sum(n) OVER g) AS t, least(20, sum(n) OVER g) * n / sum(n) OVER g AS q FROM n WINDOW g AS (PARTITION BY source)),
    f AS (SELECT *, floor(q) AS f, t - sum(floor(q)) OVER (PARTITION BY source) AS rest FROM q),
    al AS (SELECT source, lang, n, (f + (row_number() OVER (PARTITION BY source ORDER BY round(q - f, 9) DESC, lang) <= rest)::int)::bigint AS quota FROM f)"""


@query(f"WITH {ALLOC} SELECT source, lang, n, quota FROM al")
def allocate_strata(spark, d):
    return S.allocate(T.read(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), "source", "lang", "n", 20)


@query(f"WITH {ALLOC} SELECT d.source, d.lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id || '|s3'), doc_id) AS nth FROM documents) d JOIN al ON d.source = al.source AND d.lang = al.lang WHERE nth <= quota")
def language_cap(spark, d):
    return S.stratified_cap(T.read(spark, d, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id", 20, "s3")


@query(ctes("cal") + """SELECT day, stratum FROM (SELECT ts AS day, CASE WHEN isodow(ts) = 3 THEN 'event' WHEN day(ts) <= 5 THEN 'pgm' ELSE 'random' END AS stratum FROM cal)
    QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(day || '|s4')) <= CASE stratum WHEN 'event' THEN 20 WHEN 'pgm' THEN 10 ELSE 30 END""")
def stratified_days(spark, d):
    kinds = [("event", F.weekday("ts") == 2, 20), ("pgm", F.dayofmonth("ts") <= 5, 10), ("random", F.lit(True), 30)]
    return S.prioritised_days(T.calendar(spark, d), "ts", kinds, "s4")


OUTLETS = "|".join(X.OUTLETS).replace("'", "''")


@query(ctes("news") + rf"SELECT day, key, doc_id FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(title, '^\s+|\s+$', '', 'g')), '\s*[-|–—:]\s*(?:{OUTLETS})\s*$', ''), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM news) QUALIFY row_number() OVER (PARTITION BY day, key ORDER BY doc_id) = 1")
def dedupe_first(spark, d):
    rows = T.news(spark, d).withColumn("key", X.title_key(F.col("title")))
    return S.first_of_key(rows, ["day", "key"], ["doc_id"]).select("day", "key", "doc_id")


@query(ctes("evt") + "SELECT day, event_id, rank FROM (SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS rank FROM evt) WHERE rank <= 5")
def first_n_per_day(spark, d):
    return S.top_per_group(T.happenings(spark, d), "day", ["ts", "event_id"], 5).select("day", "event_id", "rank")


@query("SELECT o_orderkey, o_orderdate::date AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_runs(spark, d):
    return T.read(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def vintages(spark, d):
    """Two overlapping pulls of events: a stored one with flags and gaps, and a later one with other values."""
    e, i = T.read(spark, d, "events"), F.col("event_id")
    both = [i.alias("event_id"), F.col("event_type").alias("kind")]
    old = e.where(i % 3 != 0).select(*both, F.round("value", 4).alias("value"), F.when(i % 5 != 0, F.col("event_type")).alias("title"), (i % 7 == 0).alias("is_realtime"), F.lit("2024-01-01").alias("pulled_at"), F.when(i % 11 == 0, "barred").alias("reason"))
    new = e.where(i % 2 == 0).select(*both, F.round(F.col("value") + 1, 4).alias("value"), F.when(i % 4 == 0, F.lit("new")).alias("title"), (i % 6 == 0).alias("is_realtime"), F.lit("2024-02-01").alias("pulled_at"), F.lit(None).cast("string").alias("reason"))
    return old, new


VINTAGE = """o AS (SELECT event_id, event_type AS kind, round(value, 4) AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS title, event_id % 7 = 0 AS is_realtime, '2024-01-01' AS pulled_at, CASE WHEN event_id % 11 = 0 THEN 'barred' END AS reason FROM events WHERE event_id % 3 <> 0),
    n AS (SELECT event_id, event_type AS kind, round(value + 1, 4) AS value, CASE WHEN event_id % 4 = 0 THEN 'new' END AS title, event_id % 6 = 0 AS is_realtime, '2024-02-01' AS pulled_at, NULL::varchar AS reason FROM events WHERE event_id % 2 = 0)"""


def _merge_sql(**rules: str) -> str:
    one = lambda c: f"CASE WHEN o.event_id IS NULL THEN n.{c} WHEN n.event_id IS NULL THEN o.{c} ELSE {rules.get(c, f'n.{c}')} END AS {c}"
    return f"WITH {VINTAGE} SELECT coalesce(o.event_id, n.event_id) AS event_id, " + ", ".join(one(c) for c in ("kind", "value", "title", "is_realtime", "pulled_at", "reason")) + " FROM o FULL JOIN n ON o.event_id = n.event_id"


@query(_merge_sql())
def upsert_overwrite(spark, d):
    return U.upsert(*vintages(spark, d), ["event_id"])


@query(_merge_sql(title="coalesce(n.title, o.title)", reason="o.reason"))
def upsert_coalesce(spark, d):
    """Null titles don't clobber; the quarantine column belongs to the stored side."""
    return U.upsert(*vintages(spark, d), ["event_id"], {"title": "coalesce", "reason": "keep"})


@query(_merge_sql(value="CASE WHEN o.is_realtime THEN o.value ELSE n.value END", title="CASE WHEN o.is_realtime THEN o.title ELSE n.title END", is_realtime="o.is_realtime OR n.is_realtime"))
def upsert_pin_realtime(spark, d):
    return U.upsert(*vintages(spark, d), ["event_id"], {"is_realtime": "or"}, pin="is_realtime", pinned=("value", "title"))


@query(_merge_sql(pulled_at="o.pulled_at", is_realtime="o.is_realtime OR n.is_realtime"))
def upsert_first_capture(spark, d):
    return U.upsert(*vintages(spark, d), ["event_id"], {"pulled_at": "keep", "is_realtime": "or"})


@query(_merge_sql(is_realtime="o.is_realtime OR n.is_realtime"))
def upsert_never_demote(spark, d):
    return U.upsert(*vintages(spark, d), ["event_id"], {"is_realtime": "or"})


@query(f"WITH {VINTAGE} SELECT * FROM n WHERE event_id NOT IN (SELECT event_id FROM o)")
def upsert_append_only(spark, d):
    return U.append_only(*vintages(spark, d), ["event_id"])


@query(f"WITH {VINTAGE} SELECT o.event_id, o.kind, o.value, CASE WHEN n.event_id IS NOT NULL THEN n.title ELSE o.title END AS title, o.is_realtime, o.pulled_at, o.reason FROM o LEFT JOIN n ON o.event_id = n.event_id")
def label_writeback(spark, d):
    old, new = vintages(spark, d)
    return U.write_labels(old, new, "event_id", "title")


@query(f"WITH {VINTAGE} SELECT event_id, CASE WHEN reason IS NULL AND kind = 'view' THEN 'blocked source' ELSE reason END AS reason FROM o")
def quarantine_stamp(spark, d):
    return U.stamp(vintages(spark, d)[0], "reason", "blocked source", F.col("kind") == "view").select("event_id", "reason")


@query(f"WITH {VINTAGE} SELECT kind, count(*) AS n FROM o WHERE reason IS NULL GROUP BY kind")
def not_quarantined(spark, d):
    return vintages(spark, d)[0].where("reason is null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def bulk_update_dedup(spark, d):
    """The latest row of each key, as a bulk update takes it from landed files."""
    return S.first_of_key(T.read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT c_custkey, c_name, coalesce(o_orderpriority, c_mktsegment) AS c_mktsegment, o_orderkey IS NOT NULL AS updated FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ON c_custkey = o_custkey")
def bulk_update(spark, d):
    """A table's column set from the latest landed row of its key, where there is one."""
    fresh = bulk_update_dedup(spark, d).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    stored = T.read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    hit = fresh.select("c_custkey", F.lit(True).alias("hit"))
    return U.write_labels(stored, fresh, "c_custkey", "c_mktsegment").join(hit, "c_custkey", "left").select("c_custkey", "c_name", "c_mktsegment", F.coalesce("hit", F.lit(False)).alias("updated"))


@query(ctes("px") + "SELECT count(*) AS n, min(ts) AS first_day, max(ts) AS last_day, count(DISTINCT ticker) AS n_tickers FROM px")
def price_facts(spark, d):
    return T.prices(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"), F.count_distinct("ticker").alias("n_tickers"))


@query("SELECT day, count(*) AS n FROM (" + ctes("evt") + "SELECT day FROM evt) GROUP BY day")
def daily_counts(spark, d):
    return T.happenings(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
