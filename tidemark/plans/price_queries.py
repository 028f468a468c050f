"""Price features, targets and spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import quality as Q
from tidemark.operators import returns as R
from tidemark.sources import tables as T
from tidemark.sources.tables import ctes

from .registry import query, rounded

BY = "OVER (PARTITION BY ticker ORDER BY ts)"
LOGS = "lg AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lp FROM px), rt AS (SELECT *, lp - lag(lp) OVER (PARTITION BY ticker ORDER BY ts) AS r FROM lg)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ask(select: str, *names: str, more: str = LOGS) -> str:
    return ctes("px", *names, more=more) + select


@query(ctes("px") + "SELECT ts, max(close) FILTER (ticker = 'STANDARD') AS standard, max(close) FILTER (ticker = 'PROMO') AS promo FROM px WHERE ticker IN ('STANDARD', 'PROMO') AND ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY ts")
def load_prices_wide(spark, d):
    p = T.prices(spark, d).where(F.col("ts").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date")))
    return R.wide(p, ["STANDARD", "PROMO"]).withColumnsRenamed({"STANDARD": "standard", "PROMO": "promo"})


@query(ctes("mx") + "SELECT ts, series_id, value FROM mx WHERE series_id IN ('1-URGENT', '2-HIGH') AND ts >= DATE '1996-01-01'")
def load_macro(spark, d):
    return T.macro(spark, d).where(F.col("series_id").isin("1-URGENT", "2-HIGH") & (F.col("ts") >= F.lit("1996-01-01").cast("date")))


@query(ask(f"SELECT ts, ticker, round(lp - lag(lp, 1) {BY}, 6) AS ret_1d, round(lp - lag(lp, 5) {BY}, 6) AS ret_5d, round(lp - lag(lp, 20) {BY}, 6) AS ret_20d FROM lg"))
def log_returns(spark, d):
    return rounded(R.log_returns(T.prices(spark, d)))


@query(ask("SELECT ts, ticker, " + ", ".join(f"CASE WHEN count(r) {frame(n)} = {n} THEN round(stddev_samp(r) {frame(n)} * sqrt(252), 6) END AS rvol_{n}d" for n in (5, 20, 60)) + " FROM rt"))
def realized_vol(spark, d):
    return rounded(R.realized_vol(T.prices(spark, d)))


@query(ask(f"SELECT ts, ticker, CASE WHEN count(r) {frame(20)} = 20 THEN round(skewness(r) {frame(20)}, 5) END AS skew_20d, CASE WHEN count(r) {frame(20)} = 20 THEN round(kurtosis(r) {frame(20)}, 5) END AS kurt_20d FROM rt"))
def skew_kurt(spark, d):
    return rounded(R.skew_kurt(T.prices(spark, d)), 5)


@query(ask(f"SELECT ts, ticker, CASE WHEN count(close) {frame(60)} = 60 THEN round(close / max(close) {frame(60)} - 1, 6) END AS mdd_60d FROM px"))
def max_drawdown(spark, d):
    return rounded(R.max_drawdown(T.prices(spark, d)))


@query(ask(f"SELECT ts, ticker, CASE WHEN count(r) {frame(60)} = 60 THEN round(sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r >= 0 THEN 0 END) {frame(60)}), 6) END AS dvol_60d FROM rt"))
def downside_vol(spark, d):
    return rounded(R.downside_vol(T.prices(spark, d)))


@query(ask("SELECT ts, ticker, " + ", ".join(f"round(lead(lp, {h}) {BY} - lp, 6) AS fwd_{h}d" for h in (1, 5, 20, 60)) + " FROM lg"))
def forward_returns(spark, d):
    return rounded(R.forward_returns(T.prices(spark, d)))


@query(ask("SELECT ts, ticker, CASE WHEN count(r) OVER w = 5 THEN round(sum(r) OVER w, 6) END AS cum_5d FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"))
def cum_fwd_return(spark, d):
    return rounded(R.cumulative_forward(T.prices(spark, d), 5))


@query(ask(f"SELECT ts, ticker, round(lead(v, 24) {BY}, 6) AS target FROM (SELECT *, CASE WHEN count(r) {frame(20)} = 20 THEN stddev_samp(r) {frame(20)} * sqrt(252) END AS v FROM rt)"))
def fwd_realized_vol(spark, d):
    return rounded(R.forward_vol(T.prices(spark, d), 5, 20))


PAIRS = [("standard_promo", "STANDARD", "PROMO"), ("standard_absent", "STANDARD", "ABSENT")]
RATIO = """p AS (SELECT ts, max(close) FILTER (ticker = 'STANDARD') AS a, max(close) FILTER (ticker = 'PROMO') AS b FROM px WHERE ticker IN ('STANDARD', 'PROMO') GROUP BY ts),
    q AS (SELECT ts, 'standard_promo' AS name, a / nullif(b, 0) AS ratio FROM p UNION ALL SELECT ts, 'standard_absent', NULL FROM p)"""


@query(ctes("px", more=RATIO) + "SELECT ts, name, round(ratio, 6) AS ratio FROM q")
def spread_ratio(spark, d):
    return rounded(R.spread(T.prices(spark, d), PAIRS))


@query(
    ctes("px", more=RATIO) + """SELECT ts, name, round(ratio, 6) AS ratio, round(ln(ratio) - lag(ln(ratio), 5) OVER (PARTITION BY name ORDER BY ts), 6) AS logchg,
    CASE WHEN count(ratio) OVER w = 60 THEN round((ratio - avg(ratio) OVER w) / nullif(stddev_samp(ratio) OVER w, 0), 6) END AS z FROM q WINDOW w AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)
def spread_zscore(spark, d):
    return rounded(R.spread_features(T.prices(spark, d), PAIRS))


@query(
    ask(
        """SELECT count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS corr, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) < 0.95 AS low FROM
    (SELECT ts, max(r) FILTER (ticker = 'STANDARD') AS x, max(r) FILTER (ticker = 'PROMO') AS y FROM rt GROUP BY ts) WHERE x IS NOT NULL AND y IS NOT NULL"""
    )
)
def return_correlation(spark, d):
    return rounded(R.pairwise_correlation(T.prices(spark, d), "STANDARD", "PROMO", 0.95))


def _rates(spark, d):
    return T.macro(spark, d).where("series_id = '1-URGENT'").select("ts", (F.col("value") / 10_000_000).alias("rate"))


def _implied(spark, d):
    """A quoted yearly volatility in per cent, as a day's."""
    return T.macro(spark, d).where("series_id = '2-HIGH'").select("ts", (F.col("value") / 10_000 / 100 / F.sqrt(F.lit(252.0))).alias("vol"))


def _rules(spark, d):
    """Holding days by ticker: the mean over lots, with 20 assumed where fewer than ten were closed; PROMO has quotes of volatility."""
    held = T.lots(spark, d).where("disposed >= purchased")
    days = held.groupBy((F.col("lot_id") % 6).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.datediff("disposed", "purchased")).alias("mean"))
    names = T.read(spark, d, "part").select(F.col("p_type").alias("ticker")).distinct().withColumn("k", F.length("ticker") % 6)
    enough = F.coalesce(F.col("n") >= 10, F.lit(False))
    return names.join(days, "k", "left").select(
        "ticker", (F.length("ticker") / 100).alias("haircut"), F.when(enough, F.col("mean") * 5 / 7).otherwise(F.lit(20.0)).alias("days"),
        F.when(enough, "float=measured").otherwise("float=assumed").alias("float_flag"), (F.col("ticker") == "PROMO").alias("implied"),
    )


FLOOR = """rules AS (SELECT ticker, length(ticker) / 100.0 AS haircut, CASE WHEN n >= 10 THEN m * 5 / 7 ELSE 20.0 END AS days, CASE WHEN n >= 10 THEN 'float=measured' ELSE 'float=assumed' END AS float_flag FROM (SELECT DISTINCT p_type AS ticker FROM part) t
        LEFT JOIN (SELECT lot_id % 6 AS k, count(*) AS n, avg(disposed - purchased) AS m FROM lots WHERE disposed >= purchased GROUP BY 1) l ON length(ticker) % 6 = l.k),
    dv AS (SELECT *, CASE WHEN count(r) OVER w = 60 THEN sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r >= 0 THEN 0 END) OVER w) END AS downside FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    dy AS (SELECT p.ts, (SELECT arg_max(m.value, m.ts) FROM mx m WHERE m.series_id = '1-URGENT' AND m.ts <= p.ts AND m.ts IN (SELECT ts FROM px)) / 10000000 AS rate, v.value / 1000000 / sqrt(252) AS vol FROM (SELECT DISTINCT ts FROM px) p LEFT JOIN mx v ON v.series_id = '2-HIGH' AND v.ts = p.ts),
    fl AS (SELECT dv.ts, dv.ticker, close, coalesce(CASE WHEN dv.ticker = 'PROMO' THEN vol END, downside) AS tail, coalesce(rate, 0) AS rate, days, haircut, CASE WHEN dv.ticker = 'PROMO' AND vol IS NOT NULL THEN 'vol=implied' ELSE 'vol=realized_downside' END || '|tail=normal_approx|' || float_flag || '|carry=rf_only|exit=fixed_haircut' AS flags
        FROM dv JOIN dy ON dv.ts = dy.ts JOIN rules ON dv.ticker = rules.ticker),
    floors AS (SELECT ts, ticker, round(close, 6) AS close, round(tail, 6) AS tail_vol, round(1.645 * tail * sqrt(days) * close, 6) AS cushion, round(close * rate * (days * 7 / 5) / 365, 6) AS carry, round(close * (1 - haircut), 6) AS exit_floor,
        round(close * (1 - haircut) - 1.645 * tail * sqrt(days) * close - close * rate * (days * 7 / 5) / 365, 6) AS max_buy, round((1 - haircut) - 1.645 * tail * sqrt(days) - rate * (days * 7 / 5) / 365, 6) AS max_buy_frac, flags FROM fl WHERE tail IS NOT NULL)"""


@query(ask("SELECT * FROM floors", "mx", "lots", more=f"{LOGS}, {FLOOR}"))
def spread_floor(spark, d):
    return rounded(R.spread_floor(T.prices(spark, d), _rates(spark, d), _implied(spark, d), _rules(spark, d)))


@query(ask("SELECT * FROM floors QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1", "mx", "lots", more=f"{LOGS}, {FLOOR}"))
def spread_floor_latest(spark, d):
    return R.latest(spread_floor(spark, d), "ticker")


@query(ctes("px") + "SELECT ts, ticker, round((close / nullif(10 * 1.05, 0) - 1) * 100, 6) AS premium FROM px WHERE close > 0")
def premium_over_melt(spark, d):
    """Premium of a price over melt value (spot 10, 1.05 ounces), in per cent."""
    return rounded(T.prices(spark, d).where("close > 0").select("ts", "ticker", ((F.try_divide(F.col("close"), F.lit(10 * 1.05)) - 1) * 100).alias("premium")))


@query(
    ask(
        f"""SELECT ts, ticker, round(r, 6) AS r, round(z, 5) AS z FROM (SELECT *, CASE WHEN count(r) {frame(252)} >= 60 THEN (r - avg(r) {frame(252)}) / nullif(stddev_samp(r) {frame(252)}, 0) END AS z FROM rt) WHERE abs(z) > 3"""
    )
)
def outlier_returns(spark, d):
    return Q.outliers(R.daily(T.prices(spark, d)), "r", "ticker", bar=3.0).select("ts", "ticker", F.round("r", 6).alias("r"), "z")
