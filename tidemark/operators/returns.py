"""Returns, volatility and spreads over a long price table (ts, ticker, close)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w

YEAR = 252


def _logs(prices: DataFrame) -> DataFrame:
    return prices.withColumn("lp", w.log_price())


def log_returns(prices: DataFrame, horizons=(1, 5, 20)) -> DataFrame:
    """ln(p / p[-h]) by ticker; a price that isn't positive has no log."""
    by = w.over("ticker")
    return _logs(prices).select("ts", "ticker", *[(F.col("lp") - F.lag("lp", h).over(by)).alias(f"ret_{h}d") for h in horizons])


def daily(prices: DataFrame) -> DataFrame:
    return log_returns(prices, (1,)).withColumnRenamed("ret_1d", "r")


def realized_vol(prices: DataFrame, windows=(5, 20, 60)) -> DataFrame:
    return daily(prices).select("ts", "ticker", *[(w.rolling_std(F.col("r"), "ticker", n) * YEAR**0.5).alias(f"rvol_{n}d") for n in windows])


def skew_kurt(prices: DataFrame, n: int = 20) -> DataFrame:
    return daily(prices).select("ts", "ticker", w.skew(F.col("r"), "ticker", n).alias(f"skew_{n}d"), w.excess_kurtosis(F.col("r"), "ticker", n).alias(f"kurt_{n}d"))


def max_drawdown(prices: DataFrame, n: int = 60) -> DataFrame:
    """Price against the highest of a full window, less one."""
    return prices.select("ts", "ticker", (F.col("close") / w.full(F.col("close"), w.trailing("ticker", n), n, F.max) - 1).alias(f"mdd_{n}d"))


def downside_vol(prices: DataFrame, n: int = 60) -> DataFrame:
    """Root mean square of negative returns over a full window."""
    low = F.least(F.col("r"), F.lit(0.0))
    square = F.when(F.col("r").isNotNull(), low * low)
    return daily(prices).select("ts", "ticker", F.sqrt(w.full(square, w.trailing("ticker", n), n, F.avg)).alias(f"dvol_{n}d"))


def forward_returns(prices: DataFrame, horizons=(1, 5, 20, 60)) -> DataFrame:
    by = w.over("ticker")
    return _logs(prices).select("ts", "ticker", *[(F.lead("lp", h).over(by) - F.col("lp")).alias(f"fwd_{h}d") for h in horizons])


def cumulative_forward(prices: DataFrame, horizon: int) -> DataFrame:
    """Sum of the next ``horizon`` daily returns, null unless all are there."""
    frame = w.over("ticker").rowsBetween(1, horizon)
    return daily(prices).select("ts", "ticker", w.full(F.col("r"), frame, horizon, F.sum).alias(f"cum_{horizon}d"))


def shift_target(df: DataFrame, column: str, h: int, out: str, keys="ticker") -> DataFrame:
    if h <= 0:
        raise ValueError("a target must lie in the future")
    return df.withColumn(out, F.lead(column, h).over(w.over(keys)))


def forward_vol(prices: DataFrame, h: int = 5, n: int = 20) -> DataFrame:
    """Realised volatility over [t + h, t + h + n - 1]."""
    return shift_target(realized_vol(prices, (n,)), f"rvol_{n}d", h + n - 1, "target").select("ts", "ticker", "target")


def wide(prices: DataFrame, tickers: list[str], value: str = "close") -> DataFrame:
    """One row per ts with a column per ticker; a ticker without rows is a null column."""
    return prices.where(F.col("ticker").isin(tickers)).groupBy("ts").agg(*[F.max(F.when(F.col("ticker") == t, F.col(value))).alias(t) for t in tickers])


def spread(prices: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Long (ts, name, ratio) of ticker pairs, on every ts where either has a price."""
    names = list(dict.fromkeys(t for _, a, b in pairs for t in (a, b)))
    panel = wide(prices, names)
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.try_divide(F.col(f"`{a}`"), F.nullif(F.col(f"`{b}`"), F.lit(0.0))).alias("ratio")) for n, a, b in pairs])
    return panel.select("ts", F.inline(parts))


def spread_features(prices: DataFrame, pairs, horizon: int = 5, n: int = 60) -> DataFrame:
    """Log change over ``horizon`` and z-score over ``n`` rows of each ratio."""
    ratio = spread(prices, pairs).withColumn("lr", w.log_price("ratio"))
    return ratio.select("ts", "name", "ratio", (F.col("lr") - F.lag("lr", horizon).over(w.over("name"))).alias("logchg"), w.zscore(F.col("ratio"), "name", n).alias("z"))


def pairwise_correlation(prices: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Correlation of daily returns on days both have one, with a flag below ``threshold``; constants give null."""
    both = wide(daily(prices), [a, b], "r").where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y"))
    corr = F.try_divide(F.covar_pop("x", "y"), F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0)))
    return both.agg(F.count(F.lit(1)).alias("n"), corr.alias("corr")).withColumn("low", F.col("corr") < threshold)


def spread_floor(prices: DataFrame, rates: DataFrame, implied: DataFrame, rules: DataFrame, n: int = 60, k: float = 1.645) -> DataFrame:
    """Most to pay for stock held for its usual days, by ticker and day, and what it is made of.

    max_buy = spot * (1 - haircut) - k * tail volatility * sqrt(days) * spot - spot * rate * days * 7/5 / 365. The tail
    volatility is the implied one (``implied``: ts, vol, a day's) of tickers that ``rules`` marks, where the day has one,
    else the downside deviation over ``n`` rows; days without either are dropped. ``rates`` is (ts, rate), carried
    forward over the price days of all tickers, zero before the first. ``rules`` is (ticker, haircut, days, float_flag,
    implied). One pass of windows by ticker; days' rates and volatilities join by day.
    """
    days = prices.select("ts").distinct().join(rates.select("ts", "rate"), "ts", "left").join(implied.select("ts", "vol"), "ts", "left")
    carried = F.last("rate", True).over(Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    days = days.select("ts", F.coalesce(carried, F.lit(0.0)).alias("rate"), "vol")
    r = F.col("lp") - F.lag("lp").over(w.over("ticker"))
    rows = _logs(prices).withColumn("r", r).withColumn("square", F.when(F.col("r").isNotNull(), F.least("r", F.lit(0.0)) * F.least("r", F.lit(0.0))))
    rows = rows.withColumn("downside", F.sqrt(w.full(F.col("square"), w.trailing("ticker", n), n, F.avg))).join(days, "ts").join(rules, "ticker")
    own = F.col("implied") & F.col("vol").isNotNull()
    rows = rows.withColumn("tail_vol", F.when(own, F.col("vol")).otherwise(F.col("downside")))
    rows = rows.withColumns({"cushion": k * F.col("tail_vol") * F.sqrt("days") * F.col("close"), "carry": F.col("close") * F.col("rate") * (F.col("days") * 7 / 5) / 365, "exit_floor": F.col("close") * (1 - F.col("haircut"))})
    rows = rows.withColumn("max_buy", F.col("exit_floor") - F.col("cushion") - F.col("carry")).where("max_buy is not null")
    flags = F.concat_ws("|", F.when(own, "vol=implied").otherwise("vol=realized_downside"), F.lit("tail=normal_approx"), "float_flag", F.lit("carry=rf_only"), F.lit("exit=fixed_haircut"))
    return rows.select("ts", "ticker", "close", "tail_vol", "cushion", "carry", "exit_floor", "max_buy", F.try_divide("max_buy", "close").alias("max_buy_frac"), flags.alias("flags"))


def latest(df: DataFrame, key: str, order: str = "ts", *ties: str) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(t) for t in ties])
    return df.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Row concatenation by column name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
