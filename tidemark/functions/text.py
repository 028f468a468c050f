"""Text, URL, JSON and number functions as Column expressions."""

from __future__ import annotations

import datetime as dt
import html as markup
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extensions cut off URL segments; months of contract labels; outlets whose names end titles.
EXTENSIONS = r"(?i)\.(?:html?|s?html|ece|chn|cms|amp|aspx?|php|jsp|stm|asp)$"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
OUTLETS = ["reuters", "bloomberg", "kitco", "cnbc", "marketwatch", r"yahoo(?:\s+finance)?", "forbes", r"investing\.?com", "fxstreet", "barron'?s", "wsj", "financial times", "the economic times", "business insider", "seeking alpha", "benzinga", r"mining\.?com", "money ?control", "the hindu", "ndtv"]


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """All HTML entities, named and numeric, undone once; Spark has no function for them."""
    return x.map(markup.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def folded(x: pd.Series) -> pd.Series:
    """Entities undone, then Unicode's NFKC form, which Spark has no function for either."""
    return x.map(lambda t: unicodedata.normalize("NFKC", markup.unescape(t)), na_action="ignore")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


def page_title(blob: Column, cap: int = 512, tag: str = "PAGE_TITLE", entities: list[tuple[str, str]] | None = None) -> Column:
    """The first ``tag`` element of a feed's markup, entities unescaped, whitespace collapsed, cut to ``cap``; empty is null.

    HTML's rules undo every entity, also one without its semicolon. ``entities`` (text, what it stands for) instead names
    the only ones to be replaced, one after another; then ASCII whitespace alone is collapsed, as SQL engines' \\s does.
    """
    raw = F.regexp_extract(blob, rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    plain = unescaped(raw) if entities is None else reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities, raw)
    return F.nullif(F.substring(F.trim(F.regexp_replace(plain, r"(?U)\s+" if entities is None else r"[ \t\n\f\r]+", " ")), 1, cap), F.lit(""))


def source_language(info: Column) -> Column:
    """``srclc:xyz;...`` to its code of two or three letters; nothing at all means English, anything else null."""
    return F.when(F.trim(F.coalesce(info, F.lit(""))) == "", "eng").otherwise(F.nullif(F.lower(F.regexp_extract(info, "(?i)srclc:([a-z]{2,3})", 1)), F.lit("")))


def theme_tokens(raw: Column, curated: list[str]) -> Column:
    """``A,12;B,7;A`` to the distinct curated names in order."""
    names = F.transform(F.split(raw, ";"), lambda t: F.trim(F.substring_index(t, ",", 1)))
    return F.array_distinct(F.filter(names, lambda t: t.isin(curated)))


def tolerant_themes(raw: Column) -> Column:
    """A JSON array of names, else what stands between commas; null and blank give an empty array."""
    text = F.trim(raw)
    listed = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.from_json(F.when(text.startswith("["), text), "array<string>"), listed, F.array().cast("array<string>"))


def tone_fields(raw: Column, names: list[str]) -> list[Column]:
    return [F.get(F.split(raw, ","), i).try_cast("double").alias(n) for i, n in enumerate(names)]


def compact_timestamp(x: Column) -> Column:
    """Integer YYYYMMDDhhmmss to a timestamp without zone; anything else null."""
    return F.try_to_timestamp(F.lpad(x.cast("string"), 14, "0"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def stable_id(ts: Column, url: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lit("_"), F.substring(url, 1, 200))


def url_slug(url: Column) -> Column:
    """The path segment, without extension, with most words of three letters or more (ties: most letters, then the
    first); empty where no segment has one, or without a host."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+([^?#]*)", 1)
    parts = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.regexp_replace(p, EXTENSIONS, ""))
    words = lambda p: F.filter(F.split(p, r"[-_\s]+"), lambda t: t.rlike(r"^\p{L}{3,}$"))
    letters = lambda w: F.aggregate(w, F.lit(0), lambda a, t: a + F.length(t))
    scored = F.transform(parts, lambda p, i: F.struct(F.size(words(p)).alias("w"), letters(words(p)).alias("c"), (-i).alias("at"), p.alias("segment")))
    best = F.array_max(scored)
    return F.when(best["w"] > 0, best["segment"]).otherwise("")


def slug_words(slug: Column) -> Column:
    """Lower-case words of a slug: extension cut, camel case split, one-letter and numeric words dropped, and ids of over 30 % digits."""
    parts = F.split(F.regexp_replace(F.regexp_replace(slug, EXTENSIONS, ""), "(?<=[a-z])(?=[A-Z])", " "), r"[-_\s]+")
    kept = F.filter(parts, lambda t: (F.length(t) > 1) & (F.regexp_count(t, F.lit("[0-9]")) * 10 <= F.length(t) * 3))
    return F.lower(F.array_join(kept, " "))


def truncate_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(x, " "), 1, n), " ")


def mask_dates(x: Column) -> Column:
    """Dates with a year, and month and day in CJK, as [DATE]; years 1900-2099 that stand alone as [YEAR], unless a
    currency sign, digit, point or comma makes them a number's part."""
    year = r"(?:19|20)\d{2}"
    months = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
    dates = [
        rf"\b{year}-\d{{1,2}}-\d{{1,2}}\b", rf"\b\d{{1,2}}[./-]\d{{1,2}}[./-]{year}\b", rf"\b{year}[./-]\d{{1,2}}[./-]\d{{1,2}}\b",
        rf"(?i)\b{months}\.? \d{{1,2}}(?:st|nd|rd|th)?,? ?{year}\b", rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)? {months}\.?,? ?{year}\b",
        rf"{year}年(?:\d{{1,2}}月(?:\d{{1,2}}日)?)?", r"\d{1,2}月\d{1,2}日",
    ]
    masked = reduce(lambda y, p: F.regexp_replace(y, f"(?U){p}", "[DATE]"), dates, x)
    return F.regexp_replace(masked, rf"(?U)(?<![\d,.$€£¥₹])\b{year}\b(?![\d,.]\d)", "[YEAR]")


def title_key(x: Column) -> Column:
    """What titles of one story share: entities undone, NFKC, lower case, without a known outlet at the end, punctuation or runs of blanks."""
    plain = F.lower(F.regexp_replace(folded(x), r"(?U)^\s+|\s+$", ""))
    plain = F.regexp_replace(plain, r"(?Ui)\s*[-|–—:]\s*(?:" + "|".join(OUTLETS) + r")\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def admitted(title: Column, lang: Column, keyword: str, stop: str, has_theme: Column, other: dict[str, tuple[str, str | None]]) -> tuple[Column, Column]:
    """(kept, by the bridge alone): the base gate is (keyword or theme) and not (stop without theme) in any language;
    the bridge is a language's own terms without its stops; either admits."""
    hit = lambda p: F.coalesce(title.rlike(f"(?iu){p}"), F.lit(False))
    base = (hit(keyword) | has_theme) & ~(hit(stop) & ~has_theme)
    own = lambda term, bars: hit(term) & ~hit(bars) if bars else hit(term)
    bridge = reduce(lambda c, kv: c | (F.coalesce(lang == kv[0], F.lit(False)) & own(*kv[1])), other.items(), F.lit(False))
    return base | bridge, bridge & ~base


def contract_month(label: Column) -> Column:
    """``JUN 26``, ``JLY 26`` and ``JUN 2026`` to 2026-06; null stays null and any other label is an error."""
    parts = F.split(F.upper(F.trim(label)), r"\s+")
    name, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(name == "JLY", "JUL").otherwise(name))
    fits = (F.size(parts) == 2) & (month > 0) & year.rlike(r"^(?:\d{2}|\d{4})$")
    made = F.concat(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    return F.when(label.isNull(), F.lit(None).cast("string")).when(F.coalesce(fits, F.lit(False)), made).otherwise(F.raise_error(F.concat(F.lit("no contract month: "), label)).cast("string"))


def plain_number(x: Column) -> Column:
    """Thousands separators dropped; a dash, blank or anything else that's no number is null."""
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")


def suffixed_number(x: Column, unit: Column) -> tuple[Column, Column]:
    """(value, violation): 3.1% with unit %, thousands with unit count (215K is 215, 1.2M is 1200). Blank is no value;
    anything else, a count without K or M too, is a violation."""
    pattern = r"^(-?\d+(?:\.\d+)?)([%KM]?)$"
    number, suffix = F.regexp_extract(F.trim(x), pattern, 1).try_cast("double"), F.regexp_extract(F.trim(x), pattern, 2)
    fits = number.isNotNull() & F.when(unit == "%", suffix == "%").otherwise(suffix.isin("K", "M"))
    blank = F.coalesce(F.trim(x) == "", F.lit(True))
    return F.when(fits, F.when(suffix == "M", number * 1000).otherwise(number)), ~blank & ~F.coalesce(fits, F.lit(False))


def llm_object(x: Column, schema: str) -> Column:
    """The first JSON object of a reply, fenced or not."""
    return F.from_json(F.regexp_extract(F.regexp_replace(x, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1), schema)


def clamped(x: Column, allowed: list[str], other: str) -> Column:
    """A label in lower case if it is one of ``allowed``, else ``other``."""
    plain = F.lower(F.trim(x))
    return F.when(plain.isin(allowed), plain).otherwise(F.lit(other))


def json_flag(x: Column, path: str, default: bool) -> Column:
    return F.coalesce(F.get_json_object(x, path).try_cast("boolean"), F.lit(default))


def token_estimate(x: Column) -> Column:
    return F.bround(F.length(x) / 3.6).cast("long")


def fingerprint(x: Column, prefix: int = 3) -> tuple[Column, Column]:
    """(SHA-256, its shard prefix)"""
    h = F.sha2(x.cast("binary"), 256)
    return h, F.substring(h, 1, prefix)


def period_end(start: Column, unit: Column) -> Column:
    return F.when(unit == "DAY", start).when(unit == "WEEK", F.date_add(start, 6)).when(unit == "MONTH", F.last_day(start))


def federal_holidays(first: int, last: int) -> list[dt.date]:
    """Weekdays on which US federal offices are closed in whole years, by rule; Juneteenth from 2021 on."""

    def nth(year, month, weekday, n):
        start = dt.date(year, month, 1)
        return start + dt.timedelta((weekday - start.weekday()) % 7 + 7 * (n - 1))

    def observed(day):
        return day - dt.timedelta(1) if day.weekday() == 5 else day + dt.timedelta(1) if day.weekday() == 6 else day

    out = []
    for y in range(first, last + 1):
        out += [nth(y, 1, 0, 3), nth(y, 2, 0, 3), max(dt.date(y, 5, d) for d in range(25, 32) if dt.date(y, 5, d).weekday() == 0), nth(y, 9, 0, 1), nth(y, 10, 0, 2), nth(y, 11, 3, 4)]
        out += [observed(dt.date(y, m, d)) for m, d in ((1, 1), (7, 4), (11, 11), (12, 25))] + ([observed(dt.date(y, 6, 19))] if y >= 2021 else [])
    return sorted(set(out))


def easter(year: int) -> dt.date:
    """Anonymous Gregorian rule."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return dt.date(year, month, day + 1)


def exchange_holidays(first: int, last: int) -> list[dt.date]:
    """Closed weekdays of a US exchange in whole years, by rule: fixed days observed off weekends, and floating Mondays."""

    def nth(year, month, weekday, n):
        start = dt.date(year, month, 1)
        return start + dt.timedelta((weekday - start.weekday()) % 7 + 7 * (n - 1))

    def observed(day):
        return day - dt.timedelta(1) if day.weekday() == 5 else day + dt.timedelta(1) if day.weekday() == 6 else day

    out = []
    for y in range(first, last + 1):
        last_monday = max(dt.date(y, 5, d) for d in range(25, 32) if dt.date(y, 5, d).weekday() == 0)
        days = [nth(y, 1, 0, 3), nth(y, 2, 0, 3), easter(y) - dt.timedelta(2), last_monday, nth(y, 9, 0, 1), nth(y, 11, 3, 4), observed(dt.date(y, 7, 4)), observed(dt.date(y, 12, 25))]
        days += [observed(dt.date(y, 1, 1))] if dt.date(y, 1, 1).weekday() != 5 else []
        days += [observed(dt.date(y, 6, 19))] if y >= 2022 else []
        out += days
    return sorted(out)
