"""Local times and business dates as exports write them, with the rules by which a value is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"


def to_utc(x: Column, zone: str, now: Column | None = None, required: bool = True) -> tuple[Column, Column]:
    """(UTC time without zone, violation) of a timestamp string.

    A time without an offset is local to ``zone``; one that the clock skips or repeats there is refused, as is a time
    after ``now``. Blank is a violation if ``required``. A refused value has no time. The session's zone must be UTC.
    """
    text = F.trim(x)
    blank = F.coalesce(text == "", F.lit(True))
    fixed = text.rlike(OFFSET)
    local = F.when(~fixed, text).try_cast("timestamp_ntz").cast("timestamp")
    utc = F.to_utc_timestamp(local, zone)
    skipped = F.from_utc_timestamp(utc, zone) != local
    repeated = (F.from_utc_timestamp(utc + F.expr("interval 1 hour"), zone) == local) | (F.from_utc_timestamp(utc - F.expr("interval 1 hour"), zone) == local)
    found = F.when(fixed, text.try_cast("timestamp")).otherwise(utc)
    rule = F.when(blank, F.lit("required") if required else F.lit(None).cast("string")).when(found.isNull(), "not a timestamp").when(~fixed & skipped, "skipped by the clock").when(~fixed & repeated, "repeated by the clock")
    rule = rule.when(found > now, "in the future") if now is not None else rule
    return F.when(~blank & rule.isNull(), found.cast("timestamp_ntz")), rule


def business_date(x: Column, today: Column) -> tuple[Column, Column]:
    """(date, violation) of a plain date YYYY-MM-DD that isn't after ``today``."""
    text = F.trim(x)
    found = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")
    rule = F.when(F.coalesce(text == "", F.lit(True)), "required").when(found.isNull(), F.when(text.try_cast("timestamp").isNull(), "not a date").otherwise("not a plain date")).when(found > today, "in the future")
    return F.when(rule.isNull(), found), rule
