"""Row-based rolling windows with an explicit minimum of observations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def over(keys: str | Sequence[str], order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def trailing(keys, w: int, order: str = "ts") -> WindowSpec:
    return over(keys, order).rowsBetween(-(w - 1), 0)


def full(x: Column, w: WindowSpec, least: int, value: Callable[[Column], Column]) -> Column:
    """``value(x)`` over ``w``, null unless the frame holds ``least`` non-null ``x``."""
    return F.when(F.count(x).over(w) >= least, value(x).over(w))


def log_price(price: str = "close") -> Column:
    """Natural log of a positive price, else null."""
    p = F.col(price)
    return F.when(p > 0, F.ln(p))


def rolling_std(x: Column, keys, w: int, least: int | None = None) -> Column:
    return full(x, trailing(keys, w), least or w, F.stddev_samp)


def zscore(x: Column, keys, w: int, least: int | None = None) -> Column:
    frame = trailing(keys, w)
    return F.when(F.count(x).over(frame) >= (least or w), F.try_divide(x - F.avg(x).over(frame), F.nullif(F.stddev_samp(x).over(frame), F.lit(0.0))))


def skew(x: Column, keys, w: int) -> Column:
    """Bias-corrected skewness of a full window."""
    return full(x, trailing(keys, w), w, F.skewness) * ((w * (w - 1)) ** 0.5 / (w - 2))


def excess_kurtosis(x: Column, keys, w: int) -> Column:
    """Bias-corrected excess kurtosis of a full window."""
    return (full(x, trailing(keys, w), w, F.kurtosis) * (w + 1) + 6) * ((w - 1) / ((w - 2) * (w - 3)))


def percentile_rank(x: Column, keys, w: int) -> Column:
    """Average rank of the last value in a full window, as a share of ``w``."""
    values = F.collect_list(x).over(trailing(keys, w))
    below, equal = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return F.when((F.size(values) == w) & x.isNotNull(), (below + (equal + 1) / 2) / w)


def carried(x: Column, keys, order: str = "ts") -> Column:
    """The last non-null value at or before each row."""
    return F.last(x, ignorenulls=True).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))
