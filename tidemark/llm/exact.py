"""Exact dedup by skew-safe combining.

Copies are combined three times, each time by digest *and* full text: inside each scan task (the map side of
the first aggregation), then by digest and salt, then over the salt winners of a digest. A group that holds a
third of all rows therefore reaches a reducer as one row per scan task, and the last merge sees at most
``salts`` rows of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

SALTS = 16


def _combine(rows: DataFrame, salts: int, row: bool) -> DataFrame:
    """One row per distinct text of (id, text[, row]): sha, text, keep_id, group_size[, the kept row's ``row``]."""
    win = [F.max_by("row", F.struct("id")).alias("row")] if row else []
    rows = rows.withColumns({"sha": F.sha2(F.col("text").cast("binary"), 256), "salt": F.spark_partition_id() % salts})
    salted = rows.groupBy("sha", "salt", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"), *win)
    merged = salted.repartition("sha").groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), *win)
    texts = merged.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("sha")))
    clash = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest"))).otherwise(F.col("sha"))
    return texts.withColumn("sha", clash).drop("texts")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(sha, keep_id, group_size): one row per distinct text; keep_id is the largest id.

    Null text counts as empty. Null ids lose to any id; a group of null ids alone keeps a null id. Two texts
    with one SHA-256 digest would raise an error, since the texts themselves are compared.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return _combine(rows, salts, False).drop("text")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows that repeat both id and text are alike and all carry the same verdict. See ``text_groups`` for nulls;
    an empty table gives an empty result; other columns of ``docs`` are not read. The join's sides are ids with digests
    and one row a digest; a digest of very many rows makes its left partition large, which adaptive execution splits:
    the check on digests in ``_combine`` renames the column, so that the join has an exchange of its own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("sha"))
    found = rows.join(text_groups(docs, id_col, text_col, salts), "sha")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of ``docs``, all columns, for each distinct text: a row of the id that the group keeps.

    The other columns travel with each combining stage's winner, so no text is joined back. Rows repeated whole stay
    once; of rows that share id and text, one stays.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("__null"), *[F.col(f"`{c}`") for c in others])
    kept = _combine(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), row.alias("row")), salts, True)
    text = F.when(~F.col("row.__null"), F.col("text")).alias(text_col)
    return kept.select(*[text if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
