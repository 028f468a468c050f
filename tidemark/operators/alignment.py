"""Aligning series and events to a trading calendar, treatments, confounders and event studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w


def _grid(calendar: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """Every key on every calendar day; the calendar is broadcast, being days: some 36,500 a century."""
    return series.select(key).distinct().join(F.broadcast(calendar.select("ts").distinct()))


def align_ffill(calendar: DataFrame, series: DataFrame, key: str = "series_id", value: str = "value") -> DataFrame:
    """Every (calendar ts, key) with the last value observed *on a calendar day*: equal days are joined, then carried.

    A value printed off the calendar is dropped, not used as of the next day; see ``as_of`` for that.
    """
    grid = _grid(calendar, series, key)
    return grid.join(series.select("ts", key, value), ["ts", key], "left").select("ts", key, w.carried(F.col(value), key).alias(value))


def as_of(calendar: DataFrame, series: DataFrame, key: str = "series_id", value: str = "value") -> DataFrame:
    """Every (calendar ts, key) with the last value at or before it, on or off the calendar."""
    grid = _grid(calendar, series, key).withColumns({value: F.lit(None).cast("double"), "__on": F.lit(1)})
    both = grid.unionByName(series.select("ts", key, value).withColumn("__on", F.lit(0)))
    carried = F.last(value, True).over(Window.partitionBy(key).orderBy("ts", "__on").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, carried).where("__on = 1").drop("__on")


def roll_forward(events: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    """Event days and the first calendar day at or after each; days past the calendar's end are dropped."""
    days = events.select(F.col(day).alias("event_day")).where("event_day is not null").distinct().select(F.col("event_day").alias("ts"), F.col("event_day"), F.lit(None).cast("date").alias("trading_day"))
    cal = calendar.select("ts", F.lit(None).cast("date").alias("event_day"), F.col("ts").alias("trading_day"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = days.unionByName(cal)
    return both.withColumn("trading_day", F.min("trading_day").over(ahead)).where("event_day is not null and trading_day is not null").select("event_day", "trading_day")


def release_days(reports: DataFrame, day: str, closed: DataFrame, after: int = 3) -> DataFrame:
    """(day, release_day): ``after`` days on, a business day later for each closed day since, and never on a day off.

    ``closed`` is (day) of holidays on weekdays. Late rather than early: nothing is known before it could be.
    """
    reports = reports.select(day).distinct()
    span = 2 * after + 15  # days looked ahead: as many holidays as ``after`` holds, each with a weekend
    ahead = reports.select(day, F.explode(F.sequence(F.lit(1), F.lit(span))).alias("k")).withColumn("x", F.date_add(day, F.col("k")))
    ahead = ahead.join(closed.select(F.col("day").alias("x"), F.lit(True).alias("off")).distinct(), "x", "left")
    open_ = (F.weekday("x") < 5) & F.col("off").isNull()
    late = F.count_if((F.col("k") <= after) & F.col("off").isNotNull())
    days = ahead.groupBy(day).agg(late.alias("late"), F.array_sort(F.collect_list(F.when(open_ & (F.col("k") >= after), F.col("x")))).alias("open"), F.max(F.when(open_ & (F.col("k") == after), True)).alias("on_day"))
    # a nominal day off is no step of its own: the first open day behind it is the first step
    step = F.when((F.col("late") == 0) | F.col("on_day").isNotNull(), F.col("late")).otherwise(F.col("late") - 1)
    return days.select(day, F.get("open", step.cast("int")).alias("release_day"))


def nearest_event(days: DataFrame, events: DataFrame, within: int = 3) -> DataFrame:
    """The nearest event day of each day within ``within`` days, by signed offset; of two as near, the earlier."""
    shifted = days.select("day", F.explode(F.sequence(F.lit(-within), F.lit(within))).alias("offset")).withColumn("event_day", F.date_add("day", F.col("offset")))
    hits = shifted.join(events.select("event_day").distinct(), "event_day")
    return hits.groupBy("day").agg(F.min(F.struct(F.abs("offset").alias("far"), "offset", "event_day")).alias("b")).select("day", "b.event_day", "b.offset")


def transform(x: Column, kind: str, k: int, keys) -> Column:
    """level, diff over k rows or relative change over k rows."""
    before = F.lag(x, k).over(w.over(keys))
    return {"level": x, "diff": x - before, "pct_change": F.try_divide(x, F.nullif(before, F.lit(0.0))) - 1}[kind]


def treatment(df: DataFrame, value: str, rule: str, level: float, key: str = "series_id", in_window: Column | None = None) -> DataFrame:
    """0/1 column ``treated``: 1 strictly beyond a threshold fitted, by key, on rows where ``in_window`` holds; a null is 0.

    ``tercile_high`` and ``tercile_low`` cut at a third, ``pct_high`` at ``level`` per cent, ``sigma_high`` and
    ``sigma_low`` at ``level`` standard deviations around zero, not around the mean. A key without a value inside the
    window has no threshold and is an error.
    """
    quantiles = {"tercile_high": 2 / 3, "tercile_low": 1 / 3, "pct_high": level / 100}
    if rule not in (*quantiles, "sigma_high", "sigma_low"):
        raise ValueError(f"unknown rule {rule}")
    inside = F.col(value) if in_window is None else F.when(in_window, F.col(value))
    cut = F.percentile(inside, quantiles[rule]) if rule in quantiles else F.stddev_samp(inside) * (level if rule == "sigma_high" else -level)
    cuts = df.groupBy(F.col(key).alias("__key")).agg(cut.alias("threshold"), F.count(inside).alias("__n"))
    cuts = cuts.withColumn("threshold", F.when(F.col("__n") > 0, F.col("threshold")).otherwise(F.raise_error(F.lit("no value in the window")).cast("double"))).drop("__n")
    beyond = F.col(value) > F.col("threshold") if rule.endswith("high") else F.col(value) < F.col("threshold")
    return df.join(cuts, df[key].eqNullSafe(F.col("__key"))).drop("__key").withColumn("treated", F.coalesce(beyond, F.lit(False)).cast("int"))


def confounders(prices: DataFrame, n: int = 20, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Trailing sum and volatility of returns, all lagged one row, and the lagged five-row change of the price."""
    by = w.over("ticker")
    logs = prices.withColumn("lp", w.log_price())
    rows = logs.withColumn("r", F.col("lp") - F.lag("lp").over(by))
    made = {
        "ret_sum": w.full(F.col("r"), w.trailing("ticker", n), n, F.sum),
        "vol": w.rolling_std(F.col("r"), "ticker", n),
        "chg_5d": transform(F.col("close"), "pct_change", 5, "ticker"),
    }
    if unknown := set(exclude) - set(made):
        raise ValueError(f"unknown confounders {sorted(unknown)}")
    rows = rows.withColumns({k: x for k, x in made.items() if k not in exclude})
    return rows.select("ts", "ticker", *[F.lag(k).over(by).alias(k) for k in made if k not in exclude])


def event_changes(events: DataFrame, closes: DataFrame, inclusive: bool = True) -> DataFrame:
    """Change of a close from the observation before, on event days that have both, in basis points of 1.

    ``events`` is (day, is_unscheduled), ``closes`` is (ts, value); the earlier observation's day is kept. With
    ``inclusive`` false: the event days without a close.
    """
    by = Window.partitionBy(F.lit(0)).orderBy("ts")
    steps = closes.select("ts", "value", F.lag("value").over(by).alias("before"), F.lag("ts").over(by).alias("prior_day"))
    found = events.join(steps.where("before is not null"), events["day"] == steps["ts"]) if inclusive else events.join(steps, events["day"] == steps["ts"], "left_anti")
    return found.select("day", "is_unscheduled", "prior_day", ((F.col("value") - F.col("before")) * 100).alias("change_bp")) if inclusive else found


def purge_days(h: int, n: int, slack: int = 5) -> int:
    """Calendar days that a target over [t + h, t + h + n - 1] business days reaches, and slack."""
    return -(-(h + n - 1) * 7 // 5) + slack


def walk_forward(days: DataFrame, train_months: int, val_months: int, test_months: int, step_months: int) -> DataFrame:
    """Expanding splits with row counts; splits with an empty part are dropped and the rest numbered anew."""
    ends = days.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    starts = ends.where(F.add_months("lo", train_months) <= F.col("hi")).select("lo", "hi", F.explode(F.expr(f"sequence(add_months(lo, {train_months}), hi, interval {step_months} month)")).alias("train_end"))
    bounds = starts.select("lo", "train_end", F.add_months("train_end", val_months).alias("val_end"), F.add_months("train_end", val_months + test_months).alias("test_end"), "hi").where("test_end <= hi")
    part = lambda a, b: F.sum(F.when((F.col("ts") >= F.col(a)) & (F.col("ts") < F.col(b)), 1).otherwise(0)).cast("long")
    # a row a split: some dozens in a century
    counted = days.join(F.broadcast(bounds), F.col("ts") < F.col("test_end")).groupBy("train_end", "val_end", "test_end").agg(part("lo", "train_end").alias("n_train"), part("train_end", "val_end").alias("n_val"), part("val_end", "test_end").alias("n_test"))
    full = counted.where("n_train > 0 and n_val > 0 and n_test > 0")
    return full.withColumn("split_id", F.row_number().over(Window.orderBy("train_end")) - 1)
