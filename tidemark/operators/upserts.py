"""Upserts by key with a policy for each column, as one full outer join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a column is after a conflict, from its stored and incoming values (and a stored row's pin).
POLICIES: dict[str, Callable[[Column, Column], Column]] = {
    "overwrite": lambda old, new: new,
    "coalesce": lambda old, new: F.coalesce(new, old),
    "keep": lambda old, new: old,
    "or": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
}


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, str] | None = None, pin: str | None = None, pinned: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with ``incoming`` rows inserted, or merged where keys are equal.

    Columns follow ``policies`` (default overwrite). Where the stored row's boolean ``pin`` is set, columns in
    ``pinned`` keep their stored values. Keys in ``incoming`` must be unique; see ``unique``.
    """
    columns = [c for c in stored.columns if c not in keys]
    old = stored.select(*[F.col(k) for k in keys], F.struct(*columns).alias("__old"))
    new = incoming.select(*[F.col(k) for k in keys], F.struct(*columns).alias("__new"))
    both = old.join(new, keys, "full_outer")

    def merged(c: str) -> Column:
        a, b = F.col(f"__old.{c}"), F.col(f"__new.{c}")
        value = POLICIES[(policies or {}).get(c, "overwrite")](a, b)
        if pin and c in pinned:
            value = F.when(F.coalesce(F.col(f"__old.{pin}"), F.lit(False)), a).otherwise(value)
        return F.when(F.col("__old").isNull(), b).when(F.col("__new").isNull(), a).otherwise(value).alias(c)

    return both.select(*keys, *map(merged, columns))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, failing when it is run if a key occurs twice."""
    bad = df.groupBy(*keys).count().where("count > 1").select(F.count(F.lit(1)).alias("__n")).select(F.assert_true(F.col("__n") == 0, "keys repeat in one batch").alias("__ok"))
    return df.join(F.broadcast(bad), F.col("__ok").isNull()).drop("__ok")


def append_only(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: those whose key isn't stored, one of each key (the least by its other columns)."""
    fresh = incoming.join(stored.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in incoming.columns if c not in keys]
    by = Window.partitionBy(*keys).orderBy(*rest) if rest else Window.partitionBy(*keys).orderBy(*keys)
    return fresh.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")


def write_labels(stored: DataFrame, labels: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set from ``labels`` where the key has a row there, even a null one."""
    found = labels.select(key, F.col(column).alias("__label"), F.lit(True).alias("__hit"))
    return stored.join(found, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__label")).otherwise(F.col(column))).drop("__label", "__hit")


def stamp(df: DataFrame, column: str, reason: str, where: Column) -> DataFrame:
    """``reason`` where it applies and nothing stands there yet."""
    return df.withColumn(column, F.when(F.col(column).isNull() & F.coalesce(where, F.lit(False)), F.lit(reason)).otherwise(F.col(column)))


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap by two renames. Between them, for a moment, there is no table, and a crash there leaves
    the old one under ``.__old``: the next call puts it back first. Readers that can't wait should read ``.__old`` then."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh, old = make(f"{path}.__new"), make(f"{path}.__old")
    if fs.exists(old) and not fs.exists(make(path)):
        fs.rename(old, make(path))
    df.write.mode("overwrite").parquet(fresh.toString())
    if fs.exists(make(path)):
        fs.delete(old, True)
        fs.rename(make(path), old)
    fs.rename(fresh, make(path))
    fs.delete(old, True)
