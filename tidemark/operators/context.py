"""The daily context of one ticker, and sets and views of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w

TEXT = ("n_articles", "mean_tone", "topic_", "text_pca_", "dispersion")


def build_context(prices: DataFrame, ticker: str, macro: DataFrame, series: list[str], text: DataFrame | None = None, topics: DataFrame | None = None, positions: DataFrame | None = None, rank: int = 252) -> DataFrame:
    """One row per price day: macro levels' changes, the ticker's own state, news and positions.

    Days are those on which any ticker has a price. Macro values and net positions join on equal days and are carried
    forward; news (``text``: ts, n_articles and tones) and topics (``topics``: ts, topic_*) are those of the day before,
    counts and topics zero where there were none, tones left null. ``positions`` is (ts, net), z-scored over ``rank``
    carried days. Every join is by day; windows run over days, one row each.
    """
    by = Window.partitionBy(F.lit(0)).orderBy("ts")
    far = by.rowsBetween(Window.unboundedPreceding, 0)
    # unpartitioned on purpose: the calendar is one row a trading day
    days = prices.groupBy("ts").agg(F.max(F.when((F.col("ticker") == ticker) & (F.col("close") > 0), F.ln("close"))).alias("lp"))
    wide = macro.where(F.col("series_id").isin(series)).groupBy("ts").agg(*[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(f"m{i}") for i, s in enumerate(series)])
    rows = days.join(wide, "ts", "left")
    made = ["ts"]
    if text is not None:
        tones = [c for c in text.columns if c not in ("ts", "n_articles")]
        rows = rows.join(text, "ts", "left")
    if topics is not None:
        names = [c for c in topics.columns if c != "ts"]
        rows = rows.join(topics, "ts", "left")
    if positions is not None:
        rows = rows.join(positions.select("ts", "net"), "ts", "left")
    rows = rows.withColumns({f"m{i}": F.last(f"m{i}", True).over(far) for i in range(len(series))} | {"r": F.col("lp") - F.lag("lp").over(by)} | ({"net": F.last("net", True).over(far)} if positions is not None else {}))
    out = {}
    for i, s in enumerate(series):
        out |= {f"{s}_chg_{h}d": F.col(f"m{i}") - F.lag(f"m{i}", h).over(by) for h in (5, 20)}
    out |= {f"{ticker}_ret_{h}d": F.col("lp") - F.lag("lp", h).over(by) for h in (5, 20)}
    out[f"{ticker}_rvol_20d"] = w.full(F.col("r"), by.rowsBetween(-19, 0), 20, F.stddev_samp) * 252**0.5
    if text is not None:
        out["n_articles"] = F.coalesce(F.lag("n_articles").over(by).cast("double"), F.lit(0.0))
        out |= {c: F.lag(c).over(by) for c in tones}
    if topics is not None:
        out |= {c: F.coalesce(F.lag(c).over(by), F.lit(0.0)) for c in names}
    if positions is not None:
        span = by.rowsBetween(-(rank - 1), 0)
        out["net_z"] = F.try_divide(F.col("net") - w.full(F.col("net"), span, rank, F.avg), F.nullif(w.full(F.col("net"), span, rank, F.stddev_samp), F.lit(0.0)))
    return rows.select(*made, *[x.alias(c) for c, x in out.items()])


def one_hot(df: DataFrame, column: str, train, prefix: str, most: int = 100) -> DataFrame:
    """``df`` with a 0/1 column for each value that training rows have, in order, ``most`` at most; a value they lack is zero
    everywhere. More values are an error, not a cut."""
    found = df.where(train).select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return df.withColumns({f"{prefix}{r[0]}": (F.coalesce(F.col(column) == F.lit(r[0]), F.lit(False))).cast("double") for r in found})


def feature_columns(columns: list[str], kind: str, ticker: str, marks: tuple[str, ...] = ("_ret_", "_rvol_", "_skew_", "_kurt_", "_mdd_")) -> list[str]:
    """``full``: all; ``lean``: without returns and volatilities (names that hold a mark); ``lean_own``: without other tickers'."""
    if kind not in ("full", "lean", "lean_own"):
        raise ValueError(f"unknown feature set {kind}")
    marked = {c for c in columns if any(m in c for m in marks)} if kind != "full" else set()
    own = {c for c in marked if c.startswith(f"{ticker}_")} if kind == "lean_own" else set()
    return [c for c in columns if c not in marked - own]


def ablations(columns: list[str], groups: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """``all``, and ``no_<group>`` and ``only_<group>`` of every group (substrings of names) that has a column."""
    out = {"all": list(columns)}
    for name, marks in groups.items():
        group = [c for c in columns if any(m in c for m in marks)]
        if group:
            out |= {f"no_{name}": [c for c in columns if c not in group], f"only_{name}": group}
    return out


def split_views(columns: list[str], text: tuple[str, ...] = TEXT) -> tuple[list[str], list[str]]:
    """(price columns, text columns) of a context, by the beginnings of names."""
    return [c for c in columns if not c.startswith(text)], [c for c in columns if c.startswith(text)]
