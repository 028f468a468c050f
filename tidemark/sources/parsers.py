"""Readers of published files: calendars, exports, trend and metal tables, settlement and calendar JSON, product pages.

Files with a fixed header are read as text or raw strings and fail on drift; a malformed row becomes a violation row or
a null, as stated at each reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X


class Drift(ValueError):
    """A file isn't in the form that its reader knows."""


def raw_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; the header must be exactly ``columns``."""
    header = spark.read.text(path).limit(1).collect()
    found = [c.strip().lstrip("﻿") for c in header[0][0].split(",")] if header else []
    if found != columns:
        raise Drift(f"header {found}, expected {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=True)


def event_calendar(spark: SparkSession, path: str, day: str, time: str, columns: list[str], event_type: str, cutoff: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``calendar_rows`` of a CSV file whose header is exactly ``columns``."""
    return calendar_rows(raw_csv(spark, path, columns), day, time, event_type, cutoff)


def calendar_rows(rows: DataFrame, day: str, time: str, event_type: str, cutoff: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, violations) of all-string rows: days, HH:MM times and unique (day, rest) rows; other columns go to JSON
    metadata. Days after ``cutoff`` are left out."""
    columns = rows.columns
    rows = rows.withColumn("__day", F.col(day).try_cast("date")).withColumn("__time", F.col(time).rlike(r"^([01]\d|2[0-3]):[0-5]\d$"))
    rows = rows.where(F.col("__day").isNull() | (F.col("__day") <= F.lit(cutoff).cast("date"))) if cutoff else rows
    bad = F.when(F.col("__day").isNull(), "bad date").when(F.coalesce(~F.col("__time"), F.col(time).isNotNull()), "bad time")
    rows = rows.withColumn("rule", bad)
    repeats = rows.groupBy(*columns).count().where("count > 1").select(F.col(day).alias("value"), F.lit("repeated row").alias("rule"))
    meta = F.to_json(F.struct(*[c for c in columns if c not in (day, time)]))
    events = rows.where("rule is null").select(F.col("__day").alias("day"), F.lit(event_type).alias("event_type"), F.col(time).alias("release_time"), meta.alias("metadata")).distinct()
    return events, rows.where("rule is not null").select(F.col(day).alias("value"), "rule").unionByName(repeats)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, at) of a text file, ``at`` rising with the lines."""
    return spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.monotonically_increasing_id().alias("at"))


def _table(lines: DataFrame, names: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """(cells of the first line that starts with one of ``names``, the lines behind it that aren't blank); only that line is collected."""
    head = lines.where(F.trim(F.substring_index("line", ",", 1)).isin(list(names))).orderBy("at").limit(1).collect()
    if not head:
        raise Drift(f"no line starts with {' or '.join(names)}")
    return [c.strip().strip('"') for c in head[0]["line"].split(",")], lines.where((F.col("at") > head[0]["at"]) & (F.trim("line") != "")).select(F.split("line", ",").alias("cells"))


def trends(spark: SparkSession, path: str) -> DataFrame:
    """``trend_rows`` of an export file."""
    return trend_rows(numbered(spark, path))


def trend_rows(lines: DataFrame) -> DataFrame:
    """(period_start, unit, term, geo, value, below_one) of an export with a preamble, terms as columns ``term: (geo)``."""
    (unit, *terms), rows = _table(lines, ("Day", "Week", "Month"))
    if ragged := rows.where(F.size("cells") != len(terms) + 1).count():
        raise Drift(f"{ragged} ragged rows")
    heads = F.array(*[F.struct(F.lit(t).alias("head"), F.lit(i + 1).alias("i")) for i, t in enumerate(terms)])
    df = rows.select("cells", F.explode(heads).alias("h"))
    value = F.get("cells", F.col("h.i"))
    start = F.get("cells", F.lit(0))
    return df.select(
        F.when(F.length(start) == 7, F.concat(start, F.lit("-01"))).otherwise(start).try_cast("date").alias("period_start"), F.lit(unit.upper()).alias("unit"), F.regexp_extract("h.head", r"^(.*): \(", 1).alias("term"),
        F.regexp_extract("h.head", r"\((.*)\)$", 1).alias("geo"), F.when(value == "<1", 0.0).otherwise(value.try_cast("double")).alias("value"), (value == "<1").alias("below_one"),
    )


def reconcile_trends(df: DataFrame, terms: list[str], geo: str) -> DataFrame:
    """(term, rule): missing, unexpected and repeated terms, another geo, values that aren't 0 to 100."""
    want = df.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    seen = df.select("term").distinct()
    parts = [
        want.join(seen, "term", "left_anti").withColumn("rule", F.lit("missing")), seen.join(want, "term", "left_anti").withColumn("rule", F.lit("unexpected")),
        df.groupBy("term", "period_start").count().where("count > 1").select("term").distinct().withColumn("rule", F.lit("repeated")), df.where(F.col("geo") != geo).select("term").distinct().withColumn("rule", F.lit("geo")),
        df.where(~F.coalesce(F.col("value").between(0, 100), F.lit(False))).select("term").distinct().withColumn("rule", F.lit("range")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metal_prices(spark: SparkSession, path: str, quote: str, tolerance: float = 0.01) -> DataFrame:
    """``metal_rows`` of a published file."""
    return metal_rows(numbered(spark, path), quote, tolerance)


def metal_rows(lines: DataFrame, quote: str, tolerance: float = 0.01) -> DataFrame:
    """(price_date, metal, price, quote): a title line, then day-first dates and a column per metal; blanks are left out.

    More than ``tolerance`` of unreadable dates is an error; fewer are left out.
    """
    (_, *metals), rows = _table(lines, ("Date",))
    df = rows.select(F.try_to_timestamp(F.trim(F.get("cells", F.lit(0))), F.lit("dd/MM/yyyy")).cast("date").alias("price_date"), "cells")
    bad, n = df.agg(F.count_if(F.col("price_date").isNull()), F.count(F.lit(1))).first()
    if bad > tolerance * n:
        raise Drift(f"{bad} of {n} dates can't be read")
    values = F.array(*[F.struct(F.lit(m.lower()).alias("metal"), X.plain_number(F.get("cells", F.lit(i + 1))).alias("price")) for i, m in enumerate(metals)])
    return df.where("price_date is not null").select("price_date", F.inline(values)).where("price is not null").withColumn("quote", F.lit(quote))


def sheet_rows(rows: DataFrame, day: str, measures: list[str]) -> DataFrame:
    """Rows of a landed sheet (all strings) with a day and at least one measure that is a number; the rest are left out."""
    typed = rows.select(F.col(day).try_cast("date").alias(day), *[X.plain_number(F.col(f"`{m}`")).alias(m) for m in measures])
    return typed.where(F.col(day).isNotNull() & F.coalesce(*[F.col(f"`{m}`") for m in measures]).isNotNull())


SETTLEMENTS = "tradeDate string, reportType string, empty boolean, settlements array<struct<month:string,settle:string>>"
VOLUMES = "tradeDate string, empty boolean, totals struct<totalVolume:string,atClose:string,change:string>, monthData array<struct<month:string,totalVolume:string,atClose:string,change:string>>"
#: Contract month of a report's totals (fixed value).
ALL_MONTHS = "AGG"


def preliminary(kind: Column) -> Column:
    """Whether a report type says preliminary; one that says neither that nor final is an error."""
    plain = F.lower(F.trim(kind))
    return F.when(plain.startswith("prelim"), True).when(plain.startswith("final"), False).otherwise(F.raise_error(F.concat(F.lit("report type: "), F.coalesce(kind, F.lit("none")))).cast("boolean"))


def trade_dates(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(trade_date, is_preliminary) from lists of [MM/DD/YYYY, type]."""
    pairs = payloads.select(F.explode(F.from_json(column, "array<array<string>>")).alias("p"))
    return pairs.select(F.to_date(F.get("p", F.lit(0)), "MM/dd/yyyy").alias("trade_date"), preliminary(F.get("p", F.lit(1))).alias("is_preliminary"))


def settlements(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(trade_date, month, settle, is_preliminary): the total's row is left out, a letter behind a price too."""
    rows = payloads.select(F.from_json(column, SETTLEMENTS).alias("p")).where(~F.coalesce("p.empty", F.lit(False))).select("p.tradeDate", "p.reportType", F.explode("p.settlements").alias("s")).where("trim(s.month) <> 'Total'")
    price = X.plain_number(F.regexp_replace("s.settle", "[AB]$", ""))
    return rows.select(F.to_date("tradeDate", "MM/dd/yyyy").alias("trade_date"), X.contract_month(F.col("s.month")).alias("month"), price.alias("settle"), preliminary(F.col("reportType")).alias("is_preliminary"))


def volumes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(trade_date, month, volume, open_interest, change): a row a contract month, and the totals as ``ALL_MONTHS``."""
    rows = payloads.select(F.from_json(column, VOLUMES).alias("p")).where(~F.coalesce("p.empty", F.lit(False)))
    total = F.when(F.col("p.totals").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("month"), "p.totals.totalVolume", "p.totals.atClose", "p.totals.change")))
    rows = rows.select("p.tradeDate", F.explode(F.concat("p.monthData", F.coalesce(total, F.slice("p.monthData", 1, 0)))).alias("m"))
    count = lambda c: X.plain_number(F.col(c)).cast("long")
    month = F.coalesce(X.contract_month(F.col("m.month")), F.lit(ALL_MONTHS))
    return rows.select(F.try_to_timestamp("tradeDate", F.lit("yyyyMMdd")).cast("date").alias("trade_date"), month.alias("month"), count("m.totalVolume").alias("volume"), count("m.atClose").alias("open_interest"), count("m.change").alias("change"))


def attach_settlements(vol: DataFrame, settle: DataFrame) -> DataFrame:
    """Volumes (with is_preliminary) and settle prices by day and month; a final volume takes no preliminary price."""
    prices = settle.select("trade_date", "month", F.col("settle").alias("__settle"), F.col("is_preliminary").alias("__early"))
    both = vol.join(prices, ["trade_date", "month"], "left")
    return both.withColumn("settle", F.when(F.col("is_preliminary") | ~F.coalesce("__early", F.lit(False)), F.col("__settle"))).drop("__settle", "__early")


CALENDAR = "array<struct<title:string,country:string,date:string,impact:string,forecast:string,previous:string>>"


def consensus(payloads: DataFrame, titles: dict[str, tuple[str, str]], pulled_at: str, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """US rows of the listed titles: UTC release time, forecast and previous by unit, whether pulled before release, violations."""
    rows = payloads.select(*keep, F.inline(F.from_json(column, CALENDAR))).where("country = 'USD'")
    names = rows.sparkSession.createDataFrame([(t, f, u) for t, (f, u) in titles.items()], "title string, field string, unit string")
    # ``names`` is the listed titles, a dozen
    rows = rows.join(F.broadcast(names), "title").withColumn("release_utc", F.to_utc_timestamp(F.to_timestamp("date", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.current_timezone()).cast("timestamp_ntz"))
    forecast, bad = X.suffixed_number(F.col("forecast"), F.col("unit"))
    previous, worse = X.suffixed_number(F.col("previous"), F.col("unit"))
    return rows.select(*keep, "release_utc", "field", forecast.alias("forecast"), previous.alias("previous"), (F.lit(pulled_at).cast("timestamp_ntz") <= F.col("release_utc")).alias("is_realtime"), (bad | worse).alias("violation"))


LINKED = r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'
OFFER = r'(?s)"@type"\s*:\s*(?:"Product"|\[[^\]]*"Product"[^\]]*\])'


def product_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns, price, buyback, source): the offer in JSON-LD, else the price element.

    Every ``price`` and ``lowPrice`` of a JSON-LD block that describes a product counts, wherever the block nests it.
    Offers that differ from each other or from the element are an error, as is no price where a product is described.
    """
    blocks = F.filter(F.regexp_extract_all(html, F.lit(LINKED), 1), lambda b: b.rlike(OFFER) | b.rlike(r'(?s)"offers"\s*:'))
    offered = lambda b: F.regexp_extract_all(b, F.lit(r'"(?:price|lowPrice)"\s*:\s*"?[$€£]?\s*([\d,]+(?:\.\d+)?)'), 1)
    linked = F.array_distinct(F.transform(F.flatten(F.transform(blocks, offered)), lambda v: X.plain_number(v)))
    shown = X.plain_number(F.regexp_replace(F.regexp_extract(html, r'(?is)class="[^"]*\bprice\b[^"]*"[^>]*>\s*([$€£]?\s*[\d,]+\.\d{2})', 1), r"[$€£\s]", ""))
    buy = X.plain_number(F.regexp_extract(html, r"(?is)buy-?back[^$€£]{0,80}[$€£]\s*([\d,]+\.\d{2})", 1))
    first = F.get(linked, F.lit(0))
    differ = (F.size(linked) > 1) | F.coalesce(F.abs(first - shown) > 0.005, F.lit(False))
    wrong = F.when(differ, "prices on one page differ").when((F.size(blocks) > 0) & (F.size(linked) == 0) & shown.isNull(), "a product without a price")
    price = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(F.coalesce(first, shown))
    return pages.withColumns({"price": price, "buyback": buy, "source": F.when(F.size(linked) > 0, "json-ld").when(shown.isNotNull(), "element")})


def report_positions(rows: DataFrame, markets: dict[str, str], groups: dict[str, list[str]]) -> DataFrame:
    """Report rows of the markets whose name starts as listed; each group sums its columns, nulls as zero."""
    metal = F.coalesce(*[F.when(F.col("market").startswith(prefix), F.lit(m)) for prefix, m in markets.items()])
    total = lambda cs: sum((F.coalesce(F.col(c).try_cast("long"), F.lit(0)) for c in cs), F.lit(0)).cast("long")
    return rows.withColumn("metal", metal).where("metal is not null").select("report_date", "metal", *[total([c for c in cs if c in rows.columns]).alias(g) for g, cs in groups.items()])
