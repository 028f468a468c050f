"""Coverage, gaps, runs, staleness and ledger validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w


def islands(days: DataFrame, day: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, first, last, n_days) of runs of consecutive days. Distinct days are few, so one group a key is fine."""
    rows = days.select(*keys, F.col(day).alias("d")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("d"))
    return rows.withColumn("g", F.date_sub("d", nth)).groupBy(*keys, "g").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("g")


def missing_days(present: DataFrame, day: str, weekdays_only: bool = True, closed: DataFrame | None = None) -> DataFrame:
    """Days between the first and last present one that aren't present."""
    span = present.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo is not null")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    every = every.where(F.weekday("day") < 5) if weekdays_only else every
    every = every.join(closed, "day", "left_anti") if closed is not None else every
    return every.join(present.select(F.col(day).alias("day")).distinct(), "day", "left_anti")


def business_gaps(days: DataFrame, key: str, day: str, more_than: int) -> DataFrame:
    """Neighbouring observations with over ``more_than`` weekdays from one to the next."""
    index = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date"))  # noqa: E731  Monday
    weekdays = lambda d: F.floor(index(d) / 7) * 5 + F.least(F.pmod(index(d), F.lit(7)), F.lit(5))
    steps = days.select(key, F.col(day).alias("day"), F.lag(day).over(w.over(key, day)).alias("before"))
    return steps.withColumn("gap", (weekdays(F.col("day")) - weekdays(F.col("before"))).cast("long")).where(F.col("gap") > more_than)


def equal_runs(df: DataFrame, key: str, value: str, order: str = "ts") -> DataFrame:
    """By key: the longest run of equal values and the run at the end."""
    by = w.over(key, order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int"), F.lit(1))
    runs = df.withColumn("c", changed).withColumn("g", F.sum("c").over(by)).groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "g").alias("trailing"))


def coverage(df: DataFrame, keys: list[str | Column], expected: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / expected)


def partial_days(counts: DataFrame, below: float = 0.5) -> DataFrame:
    """Days with fewer rows than ``below`` of their year's median."""
    medians = counts.groupBy(F.year("day").alias("year")).agg(F.percentile("n", 0.5).alias("median"))
    both = counts.withColumn("year", F.year("day")).join(medians, "year")
    return both.where(F.col("n") < below * F.col("median")).select("day", "n", "median")


def stale(latest: DataFrame, state: DataFrame, key: str, today: str, days: int) -> DataFrame:
    """A collector is stale only if its data *and* its last success are older than ``days``."""
    both = state.join(latest, key, "left")
    old = lambda c: F.coalesce(F.datediff(F.lit(today).cast("date"), F.col(c)) > days, F.lit(True))
    return both.select(key, "last_data", "last_success", (old("last_data") & old("last_success")).alias("stale"))


def violations(df: DataFrame, line: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(line, rule) for each broken rule of each row; a rule that can't be decided is broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    return df.select(line, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def accept_all_or_none(df: DataFrame, found: DataFrame) -> DataFrame:
    """The whole table if nothing is broken, else no row."""
    return df.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("__bad"))), F.col("__bad") == 0).drop("__bad")


def repeated_keys(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Keys of more than one row, with their lines in order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(line)), ",").alias("lines")).where("n > 1")


def relative_check(measured: Column, stated: Column, warn: float = 0.01, reject: float = 0.05) -> Column:
    error = F.round(F.abs(F.try_divide(measured, F.nullif(stated, F.lit(0.0))) - 1), 9)  # an error of exactly a limit is within it
    return F.when(error.isNull() | (error > reject), "reject").when(error > warn, "warn").otherwise("ok")


def cell_report(rows: DataFrame, line: str, cells: dict[str, tuple]) -> DataFrame:
    """(line, column, rule, severity) of all-string rows: what keeps a ledger out, and what is only odd.

    ``cells`` maps a column to (type, required, lowest, highest, odd above): limits are literals of that type or None. A
    blank cell breaks only ``required``; a cell that isn't of its type is judged no further. Any violation refuses the
    whole ledger (``accept_all_or_none``), warnings don't.
    """
    found = []
    for name, (kind, required, low, high, odd) in cells.items():
        text = F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))
        value = text.try_cast(kind)
        limit = lambda x, kind=kind: F.lit(x).cast(kind)
        rule = F.when(text == "", F.lit("required" if required else None)).when(value.isNull(), f"not a {kind}")
        rule = rule.when(value < limit(low), "too low") if low is not None else rule
        rule = rule.when(value > limit(high), "too high") if high is not None else rule
        found.append(F.when(rule.isNotNull(), F.struct(F.lit(name).alias("column"), rule.alias("rule"), F.lit("violation").alias("severity"))))
        if odd is not None:
            found.append(F.when(rule.isNull() & (value > limit(odd)), F.struct(F.lit(name).alias("column"), F.lit("unusually high").alias("rule"), F.lit("warning").alias("severity"))))
    return rows.select(F.col(line).alias("line"), F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def outliers(df: DataFrame, value: str, key: str, n: int = 252, least: int = 60, bar: float = 6.0) -> DataFrame:
    """Rows whose trailing z-score, rounded to 5 places, lies beyond ``bar`` either way, with it as ``z``."""
    return df.withColumn("z", F.round(w.zscore(F.col(value), key, n, least), 5)).where(F.abs("z") > bar)
