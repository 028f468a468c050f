"""Tables under one folder: snapshots with a manifest, a ledger of schema changes, fitted parameters, chunks that land once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .upserts import replace_table


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def preflight(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table; an error that names all empty ones."""
    counts = {name: df.count() for name, df in tables.items()}
    if empty := sorted(n for n, c in counts.items() if not c):
        raise ValueError(f"empty tables: {', '.join(empty)}")
    return counts


def snapshot(tables: dict[str, DataFrame], folder: str, stamp: str, keep: int = 3) -> dict[str, int]:
    """Write every table and then a manifest of row counts under ``folder/stamp``; all but the ``keep`` newest stamps go.

    The manifest comes last: a snapshot without one is unfinished, is not counted and goes too unless it is the newest.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{stamp}/{name}")
        counts[name] = spark.read.parquet(f"{folder}/{stamp}/{name}").count()
    text = json.dumps({"stamp": stamp, "rows": counts}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{stamp}/_manifest")
    whole = [s for s in names(spark, folder) if exists(spark, f"{folder}/{s}/_manifest/_SUCCESS")]
    for old in names(spark, folder):
        if old not in whole[-keep:] and old != stamp:
            fs, at = _fs(spark, f"{folder}/{old}")
            fs.delete(at, True)
    return counts


def manifest(spark: SparkSession, folder: str, stamp: str) -> dict[str, int]:
    return json.loads(spark.read.text(f"{folder}/{stamp}/_manifest").first()[0])["rows"]


def migrate(spark: SparkSession, folder: str, steps: dict[str, list[tuple[str, str]]], applied_at: str) -> list[str]:
    """Apply, in order of name, the steps that the ledger in ``folder/_ledger`` lacks; the names applied.

    A step is a list of (table, SQL over it as ``{t}``), whose result replaces the table.
    """
    schema = "step string, applied_at string"
    path = f"{folder}/_ledger"
    done = {r["step"] for r in spark.read.schema(schema).parquet(path).collect()} if exists(spark, path) else set()
    fresh = [s for s in sorted(steps) if s not in done]
    for step in fresh:
        for table, sql in steps[step]:
            replace_table(spark.sql(sql, t=spark.read.parquet(f"{folder}/{table}")), f"{folder}/{table}")
        spark.createDataFrame([(step, applied_at)], schema).coalesce(1).write.mode("append").parquet(path)
    return fresh


def save_model(spark: SparkSession, folder: str, version: str, parameters: dict, about: dict) -> None:
    """Parameters by name as JSON rows beside what they were fitted on; a version that is there already is an error."""
    if exists(spark, f"{folder}/{version}"):
        raise ValueError(f"version {version} exists")
    rows = [(k, json.dumps(v)) for k, v in parameters.items()] + [("_about", json.dumps(about, sort_keys=True))]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.parquet(f"{folder}/{version}")


def load_model(spark: SparkSession, folder: str, version: str) -> tuple[dict, dict]:
    """(parameters, about) of a saved version."""
    rows = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{folder}/{version}").collect()}
    return {k: v for k, v in rows.items() if k != "_about"}, rows["_about"]


def land(chunks: dict[str, DataFrame], folder: str) -> list[str]:
    """Write each named chunk to a folder of its own, first beside it and then by one rename; those there already are
    skipped, so that a job that died goes on where it was. The names written."""
    written = []
    for name, df in chunks.items():
        spark = df.sparkSession
        if exists(spark, f"{folder}/{name}"):
            continue
        df.write.mode("overwrite").parquet(f"{folder}/.{name}.part")
        fs, at = _fs(spark, f"{folder}/.{name}.part")
        fs.rename(at, _fs(spark, f"{folder}/{name}")[1])
        written.append(name)
    return written


def stages(docs: DataFrame, steps: list[tuple[str, object]], folder: str, only: str | None = None, resume: bool = True) -> DataFrame:
    """Run named steps (DataFrame to DataFrame), each written under ``folder`` and read back. ``resume`` reads finished steps
    instead of running them; ``only`` runs one step on what the step before left."""
    spark = docs.sparkSession
    for name, step in steps:
        path = f"{folder}/{name}"
        finished = exists(spark, f"{path}/_SUCCESS")
        if only not in (None, name) or (resume and only is None and finished):
            docs = spark.read.parquet(path) if finished else docs
            continue
        step(docs).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if only == name:
            break
    return docs
