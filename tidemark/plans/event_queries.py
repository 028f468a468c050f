"""Calendar alignment, macro features, events, treatments and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import windows as w
from tidemark.operators import alignment as A
from tidemark.operators import returns as R
from tidemark.sources import tables as T
from tidemark.sources.tables import ctes

from .price_queries import LOGS, ask, frame
from .registry import query, rounded

CARRY = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
GRID = f"""al AS (SELECT g.ts, g.series_id, last_value(mx.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM (SELECT ts, series_id FROM cal, (SELECT DISTINCT series_id FROM mx)) g LEFT JOIN mx ON g.ts = mx.ts AND g.series_id = mx.series_id)"""


def aligned(spark, d):
    return A.align_ffill(T.calendar(spark, d), T.macro(spark, d))


@query(ctes("mx", "cal", more=GRID) + "SELECT ts, series_id, value FROM al")
def align_ffill(spark, d):
    return aligned(spark, d)


@query(ctes("mx", "cal") + "SELECT g.ts, g.series_id, mx.value FROM (SELECT ts, series_id FROM cal, (SELECT DISTINCT series_id FROM mx)) g ASOF LEFT JOIN mx ON g.series_id = mx.series_id AND g.ts >= mx.ts")
def as_of(spark, d):
    return A.as_of(T.calendar(spark, d), T.macro(spark, d))


@query(
    ctes("mx", "cal", more=GRID) + """SELECT ts, series_id, round(value - lag(value, 5) OVER o, 6) AS chg_5d, round(value - lag(value, 20) OVER o, 6) AS chg_20d, round(value / nullif(lag(value, 5) OVER o, 0) - 1, 6) AS pct_5d
    FROM al WINDOW o AS (PARTITION BY series_id ORDER BY ts)"""
)
def macro_changes(spark, d):
    v = F.col("value")
    t = lambda kind, k: A.transform(v, kind, k, "series_id")
    return rounded(aligned(spark, d).select("ts", "series_id", t("diff", 5).alias("chg_5d"), t("diff", 20).alias("chg_20d"), t("pct_change", 5).alias("pct_5d")))


@query(
    ctes("mx", "cal", more=GRID) + """, wd AS (SELECT ts, max(value) FILTER (series_id = '1-URGENT') AS a, max(value) FILTER (series_id = '2-HIGH') AS b, max(value) FILTER (series_id = '3-MEDIUM') AS c FROM al GROUP BY ts)
    SELECT ts, round(a - b, 6) AS real_yield, round(a - b - lag(a - b, 5) OVER o, 6) AS real_yield_chg_5d, round(a - b - lag(a - b, 20) OVER o, 6) AS real_yield_chg_20d, round(a - c, 6) AS slope, round(a - c - lag(a - c, 5) OVER o, 6) AS slope_chg_5d FROM wd WINDOW o AS (ORDER BY ts)"""
)
def macro_spreads(spark, d):
    """Differences of series (as a real yield and a curve's slope) and their changes, by calendar day."""
    of = lambda s: F.max(F.when(F.col("series_id") == s, F.col("value")))
    wide = aligned(spark, d).groupBy("ts").agg((of("1-URGENT") - of("2-HIGH")).alias("real_yield"), (of("1-URGENT") - of("3-MEDIUM")).alias("slope"))
    by = Window.partitionBy(F.lit(0)).orderBy("ts")  # one row a day
    change = lambda c, k: (F.col(c) - F.lag(c, k).over(by)).alias(f"{c}_chg_{k}d")
    return rounded(wide.select("ts", "real_yield", change("real_yield", 5), change("real_yield", 20), "slope", change("slope", 5)))


@query(
    ctes("mx", "cal", more=GRID) + """SELECT ts, series_id, CASE WHEN len(l) = 60 AND value IS NOT NULL THEN round((len(list_filter(l, lambda x: x < value)) + (len(list_filter(l, lambda x: x = value)) + 1) / 2.0) / 60, 6) END AS pctile
    FROM (SELECT *, list_filter(list(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS l FROM al)"""
)
def macro_pctile(spark, d):
    return rounded(aligned(spark, d).select("ts", "series_id", w.percentile_rank(F.col("value"), "series_id", 60).alias("pctile")))


FLAGS = "fg AS (SELECT o_orderdate::date AS day, o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'O' THEN '{\"is_scheduled\": true}' WHEN 'F' THEN '{\"is_scheduled\": false}' ELSE '{}' END AS props FROM orders)"
EVENT_DAYS = FLAGS + ", ev AS (SELECT day, coalesce(json_extract_string(props, '$.is_scheduled') = 'false', FALSE) AS is_unscheduled FROM fg QUALIFY row_number() OVER (PARTITION BY year(day), month(day) ORDER BY o_totalprice DESC, o_orderkey) = 1)"
CLOSES = "cl AS (SELECT ts, value, lag(value) OVER (ORDER BY ts) AS before, lag(ts) OVER (ORDER BY ts) AS prior_day FROM mx WHERE series_id = '1-URGENT')"


def flags(spark, d):
    """(day, key, total, is_unscheduled) of every order, from JSON whose flag may be missing, which means scheduled."""
    o = T.read(spark, d, "orders")
    props = F.when(F.col("o_orderstatus") == "O", '{"is_scheduled": true}').when(F.col("o_orderstatus") == "F", '{"is_scheduled": false}').otherwise("{}")
    return o.select(F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice", (~X.json_flag(props, "$.is_scheduled", True)).alias("is_unscheduled"))


def announcements(spark, d):
    """A day a month, that of its largest order, with its flag."""
    by = Window.partitionBy(F.trunc("day", "month")).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return flags(spark, d).withColumn("nth", F.row_number().over(by)).where("nth = 1").select("day", "is_unscheduled")


def closes(spark, d):
    return T.macro(spark, d).where("series_id = '1-URGENT'").select("ts", "value")


@query(ctes("mx", more=f"{EVENT_DAYS}, {CLOSES}") + "SELECT day, is_unscheduled, prior_day, round((value - before) * 100, 4) AS change_bp FROM ev JOIN cl ON ev.day = cl.ts WHERE before IS NOT NULL")
def yield_surprise(spark, d):
    return rounded(A.event_changes(announcements(spark, d), closes(spark, d)), 4)


@query(ctes("mx", more=f"{EVENT_DAYS}, {CLOSES}") + "SELECT day, is_unscheduled FROM ev WHERE day NOT IN (SELECT ts FROM cl)")
def yield_surprise_excluded(spark, d):
    return A.event_changes(announcements(spark, d), closes(spark, d), inclusive=False)


@query(
    ctes("mx", more=f"{EVENT_DAYS}, {CLOSES}")
    + """, a AS (SELECT day, avg((value - before) * 100) AS x FROM ev JOIN cl ON ev.day = cl.ts WHERE before IS NOT NULL GROUP BY day), b AS (SELECT ts, series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS y FROM mx WHERE series_id IN ('2-HIGH', '3-MEDIUM'))
    SELECT series_id, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS corr, round(avg((sign(x) = sign(y))::int) FILTER (x <> 0 AND y <> 0), 6) AS same_sign FROM a JOIN b ON a.day = b.ts WHERE y IS NOT NULL GROUP BY series_id"""
)
def surprise_validation(spark, d):
    """Against two published series: correlation, and how often signs agree where neither change is zero."""
    a = A.event_changes(announcements(spark, d), closes(spark, d)).groupBy("day").agg(F.avg("change_bp").alias("x"))
    b = T.macro(spark, d).where(F.col("series_id").isin("2-HIGH", "3-MEDIUM")).select(F.col("ts").alias("day"), "series_id", (F.col("value") - F.lag("value").over(w.over("series_id"))).alias("y")).where("y is not null")
    corr = F.try_divide(F.covar_pop("x", "y"), F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0)))
    same = F.avg(F.when((F.col("x") != 0) & (F.col("y") != 0), (F.signum("x") == F.signum("y")).cast("int")))
    return rounded(a.join(b, "day").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), corr.alias("corr"), same.alias("same_sign")))


@query(ctes("cal", more=EVENT_DAYS) + "SELECT day AS event_day, min(ts) AS trading_day FROM (SELECT DISTINCT day FROM ev) e JOIN cal ON cal.ts >= e.day GROUP BY day")
def event_roll_forward(spark, d):
    return A.roll_forward(announcements(spark, d), T.calendar(spark, d))


@query(ctes("cal", more=EVENT_DAYS) + "SELECT ts AS day, day AS event_day, (ev.day - cal.ts)::int AS offset FROM cal JOIN (SELECT DISTINCT day FROM ev) ev ON abs(ev.day - cal.ts) <= 3 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY abs(ev.day - cal.ts), ev.day) = 1")
def nearest_event(spark, d):
    return A.nearest_event(T.calendar(spark, d).select(F.col("ts").alias("day")), announcements(spark, d).select(F.col("day").alias("event_day")))


def _moves(spark, d):
    return aligned(spark, d).select("ts", "series_id", F.round(A.transform(F.col("value"), "diff", 1, "series_id"), 6).alias("move"))


MOVES = GRID + ", mv AS (SELECT ts, series_id, round(value - lag(value) OVER (PARTITION BY series_id ORDER BY ts), 6) AS move FROM al)"


INSIDE = "ts >= DATE '1994-01-01' AND ts < DATE '1998-01-01'"


def _treat_sql(cut: str, sign: str) -> str:
    return ctes("mx", "cal", more=MOVES) + f"SELECT ts, mv.series_id, move, round(threshold, 5) AS threshold, coalesce(move {sign} threshold, FALSE)::int AS treated FROM mv JOIN (SELECT series_id, {cut} AS threshold FROM mv WHERE {INSIDE} GROUP BY 1) c ON mv.series_id = c.series_id"


def _treat(spark, d, rule, level):
    return A.treatment(_moves(spark, d), "move", rule, level, in_window=F.expr(INSIDE.replace("DATE ", "date"))).select("ts", "series_id", "move", F.round("threshold", 5).alias("threshold"), "treated")


@query(_treat_sql("quantile_cont(move, 2.0/3)", ">"))
def treatment_tercile(spark, d):
    return _treat(spark, d, "tercile_high", 0)


@query(_treat_sql("quantile_cont(move, 0.9)", ">"))
def treatment_pct(spark, d):
    return _treat(spark, d, "pct_high", 90)


@query(_treat_sql("-1.5 * stddev_samp(move)", "<"))
def treatment_sigma(spark, d):
    return _treat(spark, d, "sigma_low", 1.5)


@query(
    ask(
        f"""SELECT ts, ticker, round(lag(s) OVER o, 6) AS ret_sum, round(lag(v) OVER o, 6) AS vol, round(lag(c) OVER o, 6) AS chg_5d FROM (SELECT *, CASE WHEN count(r) {frame(20)} = 20 THEN sum(r) {frame(20)} END AS s,
    CASE WHEN count(r) {frame(20)} = 20 THEN stddev_samp(r) {frame(20)} END AS v, close / nullif(lag(close, 5) OVER (PARTITION BY ticker ORDER BY ts), 0) - 1 AS c FROM rt) WINDOW o AS (PARTITION BY ticker ORDER BY ts)"""
    )
)
def confounders(spark, d):
    return rounded(A.confounders(T.prices(spark, d)))


@query(
    ctes("px", more=LOGS)
    + """, b AS (SELECT lo + to_months(24) + to_months((i * 6)::int) AS train_end, lo, hi FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM px), range(0, 100) t(i)),
    c AS (SELECT train_end::date AS train_end, (train_end + INTERVAL 6 MONTH)::date AS val_end, (train_end + INTERVAL 12 MONTH)::date AS test_end, lo FROM b WHERE train_end <= hi AND train_end + INTERVAL 12 MONTH <= hi),
    n AS (SELECT train_end, val_end, test_end, count(*) FILTER (ts < train_end) AS n_train, count(*) FILTER (ts >= train_end AND ts < val_end) AS n_val, count(*) FILTER (ts >= val_end AND ts < test_end) AS n_test
        FROM (SELECT DISTINCT ts FROM px) JOIN c ON ts < test_end GROUP BY ALL)
    SELECT train_end, val_end, test_end, n_train, n_val, n_test, (row_number() OVER (ORDER BY train_end) - 1)::int AS split_id FROM n WHERE n_train > 0 AND n_val > 0 AND n_test > 0"""
)
def walk_forward_splits(spark, d):
    return A.walk_forward(T.prices(spark, d).select("ts").distinct(), 24, 6, 6, 6)


@query(ctes("px") + "SELECT ticker, bool_and(n = 1) AS strictly_increasing, sum(n)::bigint AS n_rows FROM (SELECT ticker, ts, count(*) AS n FROM px GROUP BY 1, 2) GROUP BY ticker")
def chronology_check(spark, d):
    return T.prices(spark, d).groupBy("ticker").agg((F.count("ts") == F.count_distinct("ts")).alias("strictly_increasing"), F.count(F.lit(1)).alias("n_rows"))


def _edge(spark, d, order, k, least):
    rows = R.forward_vol(T.prices(spark, d), 5, 20).withColumn("nth", F.row_number().over(Window.partitionBy("ticker").orderBy(order)))
    return rows.where(F.col("nth") <= k).groupBy("ticker").agg((F.count("target") == 0 if least == 0 else F.count("target") < k).alias("holds"), F.count(F.lit(1)).alias("n_rows"))


TARGET = LOGS + f", tg AS (SELECT ts, ticker, lead(v, 24) OVER (PARTITION BY ticker ORDER BY ts) AS target FROM (SELECT *, CASE WHEN count(r) {frame(20)} = 20 THEN stddev_samp(r) {frame(20)} END AS v FROM rt))"


@query(ctes("px", more=TARGET) + "SELECT ticker, count(target) = 0 AS holds, count(*) AS n_rows FROM (SELECT * FROM tg QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 24) GROUP BY ticker")
def nan_tail_check(spark, d):
    """The last h + w - 1 targets are null: they would need the future."""
    return _edge(spark, d, F.desc("ts"), 24, 0)


@query(ctes("px", more=LOGS) + f"SELECT ticker, count(v) < 20 AS holds, count(*) AS n_rows FROM (SELECT ticker, ts, CASE WHEN count(r) {frame(20)} = 20 THEN stddev_samp(r) {frame(20)} END AS v FROM rt QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts) <= 20) GROUP BY ticker")
def warmup_check(spark, d):
    """Some of the first w features are null: the window isn't full yet."""
    rows = R.realized_vol(T.prices(spark, d), (20,)).withColumn("nth", F.row_number().over(w.over("ticker")))
    return rows.where("nth <= 20").groupBy("ticker").agg((F.count("rvol_20d") < 20).alias("holds"), F.count(F.lit(1)).alias("n_rows"))


@query(
    ctes("px", "asg")
    + f"""SELECT a.ts, a.ticker, a.cluster_id, round(coalesce(e.m, g.m), 6) AS encoded FROM (SELECT * FROM asg) a LEFT JOIN (SELECT cluster_id, avg(close) AS m FROM px JOIN asg USING (ts, ticker) WHERE ts < DATE '1999-01-01' - {A.purge_days(5, 20)} AND cluster_id > 0 GROUP BY 1) e
    ON a.cluster_id = e.cluster_id, (SELECT avg(close) AS m FROM px WHERE ts < DATE '1999-01-01' - {A.purge_days(5, 20)}) g"""
)
def purged_target_encoding(spark, d):
    """Cluster means of the training prefix, purged by the target's reach; ids the prefix lacks get its overall mean."""
    a, p = T.clusters(spark, d), T.prices(spark, d)
    past = p.where(F.col("ts") < F.date_sub(F.lit("1999-01-01").cast("date"), A.purge_days(5, 20)))
    means = past.join(a, ["ts", "ticker"]).where("cluster_id > 0").groupBy("cluster_id").agg(F.avg("close").alias("m"))
    return rounded(a.join(means, "cluster_id", "left").join(F.broadcast(past.agg(F.avg("close").alias("g")))).select("ts", "ticker", "cluster_id", F.coalesce("m", "g").alias("encoded")))


PREFIX = "ts < DATE '1999-01-01'"


@query(ctes("mx", "cal") + f"SELECT g.ts, g.series_id, round(coalesce(mx.value, m.v, 0), 6) AS value FROM (SELECT ts, series_id FROM cal, (SELECT DISTINCT series_id FROM mx)) g LEFT JOIN mx ON g.ts = mx.ts AND g.series_id = mx.series_id JOIN (SELECT series_id, avg(value) FILTER ({PREFIX}) AS v FROM mx WHERE ts IN (SELECT ts FROM cal) GROUP BY 1) m ON g.series_id = m.series_id")
def train_impute(spark, d):
    """Gaps on the calendar filled by the training prefix's mean, or zero where that has no value."""
    cal, m = T.calendar(spark, d), T.macro(spark, d)
    # the names of series, five here; every series on every day is what is asked for
    grid = cal.join(F.broadcast(m.select("series_id").distinct())).join(m, ["ts", "series_id"], "left")
    means = grid.groupBy("series_id").agg(F.avg(F.when(F.expr(PREFIX), F.col("value"))).alias("v"))
    return rounded(grid.join(means, "series_id").select("ts", "series_id", F.coalesce("value", "v", F.lit(0.0)).alias("value")))


@query(ctes("mx") + f"SELECT ts, mx.series_id, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM mx JOIN (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM mx WHERE {PREFIX} GROUP BY 1) f ON mx.series_id = f.series_id")
def standardize_frozen(spark, d):
    """Standardised with the training prefix's mean and population deviation, a deviation of zero counting as one."""
    m = T.macro(spark, d)
    fit = m.where(PREFIX).groupBy("series_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rounded(m.join(fit, "series_id").select("ts", "series_id", ((F.col("value") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("z")))


CLOSED = ", ".join(f"DATE '{x}'" for x in X.federal_holidays(1991, 2002))


@query(
    ctes("pos", more=f"hol AS (SELECT unnest([{CLOSED}]) AS h), bd AS (SELECT x, row_number() OVER (ORDER BY x) AS nth FROM (SELECT unnest(generate_series(DATE '1991-01-01', DATE '2002-12-31', INTERVAL 1 DAY))::date AS x) WHERE isodow(x) < 6 AND x NOT IN (SELECT h FROM hol))")
    + """, rel AS (SELECT week, (SELECT count(*) FROM hol WHERE h BETWEEN week + 1 AND week + 3) AS late, (SELECT max(nth) FROM bd WHERE x <= week + 3) AS back, (SELECT min(nth) FROM bd WHERE x >= week + 3) AS ahead FROM (SELECT DISTINCT week FROM pos))
    SELECT p.week, metal, longs - shorts AS net, (SELECT x FROM bd WHERE nth = CASE WHEN late = 0 THEN ahead ELSE back + late END) AS release_day,
    CASE WHEN count(longs - shorts) OVER w = 52 THEN round((longs - shorts - avg(longs - shorts) OVER w) / nullif(stddev_samp(longs - shorts) OVER w, 0), 6) END AS z FROM pos p JOIN rel ON p.week = rel.week WINDOW w AS (PARTITION BY metal ORDER BY p.week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"""
)
def cot_zscore(spark, d):
    """Weekly net positions, z-scored over a year, stamped with their release: Friday, a business day later for each federal holiday since Tuesday."""
    p = T.positioning(spark, d).withColumn("net", F.col("longs") - F.col("shorts"))
    closed = spark.createDataFrame([(x,) for x in X.federal_holidays(1991, 2002)], "day date")
    stamped = A.release_days(p.select("week").distinct(), "week", closed)
    return rounded(p.join(stamped, "week").withColumn("ts", F.col("week")).select("week", "metal", "net", "release_day", w.zscore(F.col("net"), "metal", 52).alias("z")))
