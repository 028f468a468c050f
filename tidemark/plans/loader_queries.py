"""Scans of the research tables, reshaping, and annotation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import context as K
from tidemark.operators import annotation as N
from tidemark.operators import returns as R
from tidemark.operators import selection as S
from tidemark.sources import tables as T
from tidemark.sources.tables import ctes

from .registry import query, rounded


@query(ctes("evt") + "SELECT day, event_id, event_type, value FROM evt WHERE event_type = 'click' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def load_events(spark, d):
    return T.happenings(spark, d).where("event_type = 'click' and day between date'2024-01-05' and date'2024-01-20'").select("day", "event_id", "event_type", "value")


@query(ctes("pos") + "SELECT week, longs, shorts FROM pos WHERE metal = '2-HIGH' AND week >= DATE '1996-01-01'")
def load_positioning(spark, d):
    """One metal's weeks; already stamped by release, so not shifted again."""
    return T.positioning(spark, d).where("metal = '2-HIGH' and week >= date'1996-01-01'").drop("metal")


@query(ctes("news") + "SELECT day, doc_id, json_extract_string(themes, '$[0]') AS first_theme, json_array_length(themes)::int AS n_themes FROM news WHERE day >= DATE '2024-01-10' AND day < DATE '2024-02-01'")
def load_headlines(spark, d):
    from tidemark.functions import text as X

    n = T.news(spark, d).where("day >= date'2024-01-10' and day < date'2024-02-01'").withColumn("list", X.tolerant_themes(F.col("themes")))
    return n.select("day", "doc_id", F.get("list", F.lit(0)).alias("first_theme"), F.size("list").alias("n_themes"))


@query(ctes("news") + "SELECT doc_id, title, rank FROM (SELECT *, row_number() OVER (ORDER BY day, doc_id) AS rank FROM news WHERE day = DATE '2024-01-10' AND title IS NOT NULL)")
def load_day_titles(spark, d):
    """A half-open day in a total order."""
    day = T.news(spark, d).where("day >= date'2024-01-10' and day < date'2024-01-11' and title is not null")
    return S.top_per_group(day, "day", ["day", "doc_id"], 1 << 30).select("doc_id", "title", "rank")


@query("SELECT vec_id, label, len(embedding)::int AS dimension, round(embedding[1]::double, 6) AS first_value, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) AS squares FROM embeddings")
def load_vectors(spark, d):
    return rounded(T.read(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dimension"), F.get("embedding", F.lit(0)).cast("double").alias("first_value"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("squares")))


@query(ctes("asg") + "SELECT ts, ticker, coalesce(l.name, 'noise') AS regime FROM asg LEFT JOIN (VALUES (0, 'calm'), (1, 'rising'), (2, 'falling'), (3, 'stress')) l(id, name) ON cluster_id = l.id")
def load_regimes(spark, d):
    names = spark.createDataFrame([(0, "calm"), (1, "rising"), (2, "falling"), (3, "stress")], "cluster_id int, name string")
    # four names
    return T.clusters(spark, d).join(F.broadcast(names), "cluster_id", "left").select("ts", "ticker", F.coalesce("name", F.lit("noise")).alias("regime"))


@query("SELECT o_orderkey, a, b, c FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 7 = 0 THEN 1.0::double END AS c FROM orders) WHERE coalesce(a, b, c) IS NOT NULL")
def surprise_rows(spark, d):
    """Rows with at least one measure."""
    k = F.col("o_orderkey")
    rows = T.read(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, F.col("o_totalprice")).alias("a"), F.when(k % 5 == 0, F.col("o_totalprice")).alias("b"), F.when(k % 7 == 0, 1.0).alias("c"))
    return rows.where(F.coalesce("a", "b", "c").isNotNull())


@query("SELECT event_id, event_type FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-06' AND regexp_matches(event_type || ',12;other', '(^|;)(click|view)(,|;|$)')")
def themed_partition(spark, d):
    """Partition bounds and an anchored theme pattern, as a warehouse query sends them."""
    e = T.read(spark, d, "events").where("ts >= timestamp_ntz'2024-01-03' and ts < timestamp_ntz'2024-01-06'")
    return e.where(F.concat("event_type", F.lit(",12;other")).rlike("(^|;)(click|view)(,|;|$)")).select("event_id", "event_type")


@query(ctes("prd", more="m AS (SELECT run_id, ticker, sqrt(avg((prediction - actual) ** 2)) AS rmse, avg(abs(prediction - actual)) AS mae FROM prd GROUP BY 1, 2)") + "SELECT run_id, ticker, 'rmse' AS metric, round(rmse, 6) AS value FROM m UNION ALL SELECT run_id, ticker, 'mae', round(mae, 6) FROM m")
def melt_metrics(spark, d):
    from tidemark.operators import stats as M

    m = M.run_metrics(T.predictions(spark, d), ["run_id", "ticker"]).select("run_id", "ticker", "rmse", "mae")
    return rounded(m.unpivot(["run_id", "ticker"], ["rmse", "mae"], "metric", "value"))


@query(ctes("prd") + "SELECT ticker, round(sqrt(avg((prediction - actual) ** 2) FILTER (run_id = 'walk')), 6) AS walk, round(sqrt(avg((prediction - actual) ** 2) FILTER (run_id = 'flat')), 6) AS flat FROM prd GROUP BY ticker")
def pivot_runs(spark, d):
    p = T.predictions(spark, d).withColumn("e2", (F.col("prediction") - F.col("actual")) ** 2)
    return rounded(p.groupBy("ticker").pivot("run_id", ["walk", "flat"]).agg(F.sqrt(F.avg("e2"))))


@query(ctes("asg") + "SELECT ts, ticker, " + ", ".join(f"(isodow(ts) = {k + 1})::int::double AS d_{k}" for k in range(3)) + " FROM asg")
def one_hot(spark, d):
    """Dummies of the weekdays that the training part, Monday to Wednesday, knows; other days have none."""
    a = T.clusters(spark, d).select("ts", "ticker", F.weekday("ts").alias("day"))
    return K.one_hot(a, "day", F.col("day") < 3, "d_").drop("day")


@query("SELECT o_custkey AS cluster_id, o_orderkey AS label_id, o_orderstatus AS label FROM orders WHERE o_orderpriority = '1-URGENT'")
def load_labels(spark, d):
    """The labels of one model version (priorities stand for versions), in order of cluster."""
    rows = T.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return rows.select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("label_id"), F.col("o_orderstatus").alias("label")).orderBy("cluster_id", "label_id")


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS raw_title FROM pages WHERE regexp_matches(html, '(?is)<title>')")
def narrow_titles(spark, d):
    """The narrow scan: one expression over the markup instead of the whole column."""
    return T.read(spark, d, "pages").where(F.col("html").rlike("(?is)<title>")).select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("raw_title"))


@query(ctes("px", "mx") + "SELECT ts, ticker, close FROM px WHERE ts IN (SELECT ts FROM mx WHERE series_id = '1-URGENT')")
def shared_rows(spark, d):
    return T.prices(spark, d).join(T.macro(spark, d).where("series_id = '1-URGENT'").select("ts").distinct(), "ts", "left_semi").select("ts", "ticker", "close")


@query(ctes("px") + "SELECT ts, ticker, round(close, 6) AS close, volume FROM px WHERE (ticker, ts) IN (SELECT (ticker, max(ts)) FROM px GROUP BY ticker)")
def latest_prices(spark, d):
    return rounded(R.latest(T.prices(spark, d), "ticker").select("ts", "ticker", "close", "volume"))


@query(ctes("px", "mx") + "SELECT DISTINCT ts FROM px EXCEPT SELECT ts FROM mx")
def set_difference(spark, d):
    return T.prices(spark, d).select("ts").distinct().join(T.macro(spark, d).select("ts").distinct(), "ts", "left_anti")


@query(ctes("px") + "SELECT ts, ticker, close FROM px WHERE ticker = 'PROMO' UNION ALL SELECT ts, ticker, NULL FROM px WHERE ticker = 'ECONOMY'")
def concat_frames(spark, d):
    p = T.prices(spark, d)
    return R.union_all([p.where("ticker = 'PROMO'").select("ts", "ticker", "close"), p.where("ticker = 'ECONOMY'").select("ts", "ticker")])


@query("SELECT o_orderkey, o_orderdate::date AS day, (o_orderdate::date + (o_orderkey % 9)::int) - o_orderdate::date <= 4 AS is_realtime FROM orders")
def realtime_flag(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.withColumn("is_realtime", F.datediff(F.date_add("day", (F.col("o_orderkey") % 9).cast("int")), "day") <= 4)


@query(
    """WITH b AS (SELECT lang, source, quality = 1 AS ok, 's' || (doc_id % 4) AS why FROM labels JOIN documents USING (doc_id)), r AS (SELECT lang, why, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, why) AS r FROM b WHERE NOT ok GROUP BY 1, 2)
    SELECT w.lang, n, precision, reasons, CASE WHEN p >= 0.85 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT lang, count(*) AS n, round(avg(ok::int), 6) AS precision, avg(ok::int) AS p FROM b GROUP BY 1) w LEFT JOIN (SELECT lang, string_agg(why, '|' ORDER BY r) AS reasons FROM r WHERE r <= 3 GROUP BY 1) t ON w.lang = t.lang"""
)
def precision_reasons(spark, d):
    both = T.read(spark, d, "labels").join(T.read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(N.precision(both, "lang", F.col("quality") == 1, F.concat(F.lit("s"), F.col("doc_id") % 4)))


POOL = "SELECT count(*) AS n, round(avg((quality = 1)::int), 6) AS coverage, round(avg((toxic = 1)::int) FILTER (quality = 1), 6) AS spurious, round(avg((doc_id % 3 = 0)::int), 6) AS masked FROM labels"


@query(POOL)
def pooled_shares(spark, d):
    lab = T.read(spark, d, "labels")
    return rounded(N.shares(lab, {"coverage": F.col("quality") == 1, "spurious": F.when(F.col("quality") == 1, F.col("toxic") == 1), "masked": F.col("doc_id") % 3 == 0}))


@query(f"WITH p AS ({POOL}), g AS (SELECT 'coverage' AS gate, coverage AS value, coverage >= 0.8 AS passed FROM p UNION ALL SELECT 'spurious', spurious, spurious <= 0.2 FROM p UNION ALL SELECT 'masked', masked, masked <= 0.1 FROM p) SELECT gate, value, passed, bool_and(passed) OVER () AS all_passed FROM g")
def report_card(spark, d):
    return N.report_card(pooled_shares(spark, d), {"coverage": ("coverage", 0.8, True), "spurious": ("spurious", 0.2, False), "masked": ("masked", 0.1, False)})


@query(ctes("news") + "SELECT n.day, r.record_id, r.nth::int AS nth, r.place, doc_id, src_lang FROM (SELECT DISTINCT day FROM news) n, (VALUES (1, 0, 1), (1, 1, 3), (2, 0, 2), (2, 1, 99999)) r(record_id, nth, place) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY doc_id) AS rn FROM news) t ON t.day = n.day AND t.rn = r.place")
def record_titles(spark, d):
    """Cited places of records matched to the day's numbered titles."""
    news = T.news(spark, d).withColumn("title_id", F.col("doc_id"))
    made = F.array(F.struct(F.lit(1).alias("record_id"), F.array(F.lit(1), F.lit(3)).alias("ids")), F.struct(F.lit(2).alias("record_id"), F.array(F.lit(2), F.lit(99999)).alias("ids")))
    records = news.select("day").distinct().select("day", F.inline(made))
    return N.place_records(records, news).select("day", "record_id", "nth", "place", "doc_id", "src_lang")


@query("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, round(avg((a = b)::int), 6) AS agree, count(*) FILTER (b IS NULL) AS a_only, count(*) FILTER (a IS NULL) AS b_only FROM (SELECT turn, conv_id, max(length(text) % 3) FILTER (conv_id % 5 <> 0) AS a, max(length(role) % 3) FILTER (conv_id % 7 <> 0) AS b FROM conversations GROUP BY 1, 2)")
def variant_agreement(spark, d):
    c = T.read(spark, d, "conversations")
    a = c.where("conv_id % 5 <> 0").select("conv_id", "turn", F.lit("blind").alias("v"), (F.length("text") % 3).alias("x"))
    b = c.where("conv_id % 7 <> 0").select("conv_id", "turn", F.lit("dated").alias("v"), (F.length("role") % 3).alias("x"))
    gone = c.where("conv_id % 35 = 0").select("conv_id", "turn", F.lit("none").alias("v"), F.lit(None).cast("int").alias("x"))
    return rounded(N.variant_agreement(a.unionByName(b).unionByName(gone), ["conv_id", "turn"], "v", "x", "blind", "dated"))


@query("SELECT count(*) AS n, count(*) FILTER (s1 = s2) AS n_same_input, round(avg((v1 IS NOT DISTINCT FROM v2)::int) FILTER (s1 = s2), 6) AS agree FROM (SELECT doc_id, sha256(text) AS s1, n_chars % 2 AS v1, sha256(CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE text END) AS s2, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars % 2 END AS v2 FROM documents)")
def run_agreement(spark, d):
    x = T.read(spark, d, "documents")
    first = x.select("doc_id", F.sha2("text", 256).alias("sha"), (F.col("n_chars") % 2).alias("v"))
    second = x.select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("text")), 256).alias("sha"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("n_chars") % 2).alias("v"))
    return rounded(N.run_agreement(first, second, "doc_id", "sha", "v"))


@query(ctes("news") + "SELECT count(*) AS n, sum(round_even(length(title) / 3.6, 0))::bigint AS tokens_in, round((sum(round_even(length(title) / 3.6, 0)) * 3 + count(*) * 50 * 15) / 1e6, 6) AS dollars, round((sum(round_even(length(title) / 3.6, 0)) * 3 + count(*) * 50 * 15) / 1e6 * 12, 6) AS era_dollars FROM news")
def cost_estimate(spark, d):
    return rounded(N.cost(T.news(spark, d), "title", 3.0, 15.0, 50, 12.0))


@query(
    ctes("news") + """, a AS (SELECT day, (epoch(day) / 86400)::bigint % 5 AS cluster_id, round(avg(tone), 6) AS confidence FROM news GROUP BY 1, 2), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, day) <= 8)
    SELECT cluster_id, count(*) AS n_days, min(day) AS first_day, sum((SELECT count(*) FROM (SELECT 1 FROM news n WHERE n.day = b.day LIMIT 2)))::bigint AS n_titles FROM b GROUP BY cluster_id"""
)
def cluster_evidence(spark, d):
    news = T.news(spark, d).withColumn("title_id", F.col("doc_id"))
    a = news.groupBy("day").agg(F.round(F.avg("tone"), 6).alias("confidence")).withColumn("cluster_id", F.unix_date("day").cast("long") % 5)
    e = N.evidence(a, news, "cluster_id")
    return e.select("cluster_id", F.size("days").cast("long").alias("n_days"), F.get("days", F.lit(0))["day"].alias("first_day"), F.aggregate("days", F.lit(0), lambda n, x: n + F.size(x["titles"])).cast("long").alias("n_titles"))
