"""Run registry, predictions and importances as Parquet tables under one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .upserts import append_only, replace_table, upsert

KEYS = {"runs": ["run_id"], "run_predictions": ["run_id", "ts", "ticker", "horizon"], "run_feature_importances": ["run_id", "split_id", "feature", "kind"]}
SCHEMAS = {
    "runs": "run_id string, name string, created_at timestamp_ntz, config string",
    "run_predictions": "run_id string, ts date, ticker string, horizon int, prediction double, actual double",
    "run_feature_importances": "run_id string, split_id int, feature string, kind string, importance double",
}


class Harness:
    """Tables are replaced as a whole: each write merges by key and swaps the folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], SCHEMAS[name])

    def register(self, run_id: str, name: str, created_at: str, config: dict) -> None:
        """Insert a run; an id that is there already is an error."""
        row = self.spark.createDataFrame([(run_id, name, json.dumps(config, sort_keys=True))], "run_id string, name string, config string").withColumn("created_at", F.lit(created_at).cast("timestamp_ntz"))
        if not append_only(self.table("runs"), row, ["run_id"]).head(1):
            raise ValueError(f"run {run_id} exists")
        replace_table(self.table("runs").unionByName(row), f"{self.root}/runs")

    def log(self, name: str, rows: DataFrame) -> None:
        """Merge predictions or importances by their key."""
        replace_table(upsert(self.table(name), rows.select(*self.table(name).columns), KEYS[name]), f"{self.root}/{name}")

    def recent(self, n: int) -> DataFrame:
        return self.table("runs").orderBy(F.desc("created_at"), "run_id").limit(n)

    def predictions(self, run_id: str) -> DataFrame:
        return self.table("run_predictions").where(F.col("run_id") == run_id).orderBy("ts", "ticker", "horizon")

    def importances(self, run_id: str, kind: str | None = None) -> DataFrame:
        rows = self.table("run_feature_importances").where(F.col("run_id") == run_id)
        return rows.where(F.col("kind") == kind) if kind else rows

    def export(self, folder: str) -> dict[str, int]:
        """ZSTD Parquet of every table, and the row counts that a re-import must reach."""
        counts = {}
        for name in KEYS:
            self.table(name).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
            counts[name] = self.spark.read.parquet(f"{folder}/{name}").count()
        return counts

    def restore(self, folder: str) -> dict[str, int]:
        """Add exported rows whose keys aren't there; the rows added by table. A second restore adds none."""
        added = {}
        for name, keys in KEYS.items():
            fresh = append_only(self.table(name), self.spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}"), keys)
            added[name] = fresh.count()
            replace_table(self.table(name).unionByName(fresh), f"{self.root}/{name}")
        return added


def compact(spark: SparkSession, path: str, files: int, schema: str | None = None) -> int:
    """Rewrite a table into ``files`` files, refusing to lose a column; its rows."""
    old = spark.read.parquet(path)
    new = spark.read.schema(schema).parquet(path) if schema else old
    if lost := set(old.columns) - set(new.columns):
        raise ValueError(f"columns {sorted(lost)} would be lost")
    before = old.count()
    replace_table(new.repartition(files), path)
    after = spark.read.parquet(path).count()
    if before != after:
        raise ValueError(f"{before} rows before, {after} after")
    return after
