"""Spark session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidemark", **settings: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution; keyword settings win, dots written as two underscores."""
    builder = SparkSession.builder.appName(app)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (fixed | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
