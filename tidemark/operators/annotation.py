"""Checks of model-made annotations against their inputs, by day and record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place_records(records: DataFrame, titles: DataFrame, day: str = "day") -> DataFrame:
    """Records (day, ids array of 1-based places) to one row per cited title; a place without a title keeps null columns."""
    cited = records.select(day, "record_id", F.posexplode("ids").alias("nth", "place"))
    numbered = titles.withColumn("place", F.row_number().over(Window.partitionBy(day).orderBy("title_id")))
    return cited.join(numbered, [day, "place"], "left")


def variant_agreement(rows: DataFrame, keys: list[str], variant: str, value: str, a: str, b: str) -> DataFrame:
    """(n, agree, a_only, b_only): two variants of the same record, compared where both have one."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    both = rows.groupBy(*keys).agg(pick(a).alias("a"), pick(b).alias("b"))
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agree"), F.count_if(F.col("b").isNull()).alias("a_only"), F.count_if(F.col("a").isNull()).alias("b_only"))


def run_agreement(first: DataFrame, second: DataFrame, key: str, sha: str, value: str) -> DataFrame:
    """(n, n_same_input, agree): only days whose inputs have one hash are compared."""
    both = first.select(key, F.col(sha).alias("s1"), F.col(value).alias("v1")).join(second.select(key, F.col(sha).alias("s2"), F.col(value).alias("v2")), key)
    same = F.col("s1") == F.col("s2")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same_input"), F.avg(F.when(same, F.col("v1").eqNullSafe(F.col("v2")).cast("int"))).alias("agree"))


def precision(rows: DataFrame, group: str, correct: Column, reason: Column, bar: float = 0.85, top: int = 3) -> DataFrame:
    """By group: n, precision, the most frequent reasons of wrong ones (ties by name) and whether the bar is met."""
    marked = rows.withColumns({"__ok": correct, "__why": reason})
    ranked = marked.where(~F.col("__ok")).groupBy(group, "__why").agg(F.count(F.lit(1)).alias("__c"))
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__c"), "__why"))).where(F.col("__r") <= top)
    names = ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__why"))), lambda s: s["__why"]).alias("__names")).select(F.col(group).alias("__g"), F.array_join("__names", "|").alias("reasons"))
    whole = marked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("__ok").cast("int")).alias("precision"))
    return whole.join(names, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g").withColumn("verdict", F.when(F.col("precision") >= bar, "pass").otherwise("fail"))


def shares(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: n and the share of rows that meet each test, rows where it can't be told left out."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(t.cast("int")).alias(k) for k, t in tests.items()])


def report_card(facts: DataFrame, gates: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """(gate, value, passed, all_passed) of a one-row table: column, limit and whether the limit is a floor; null fails."""
    cells = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"), F.coalesce(F.col(c) >= x if floor else F.col(c) <= x, F.lit(False)).alias("passed")) for g, (c, x, floor) in gates.items()])
    return facts.select(F.inline(cells)).withColumn("all_passed", F.min("passed").over(Window.partitionBy(F.lit(0))))


def cost(rows: DataFrame, text: str, price_in: float, price_out: float, out_tokens: int, scale: float) -> DataFrame:
    """Tokens by length, their price per million, and both scaled to an era."""
    tokens = F.bround(F.length(text) / 3.6)
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).cast("long").alias("tokens_in"))
    dollars = (F.col("tokens_in") * price_in + F.col("n") * out_tokens * price_out) / 1e6
    return got.withColumn("dollars", dollars).withColumn("era_dollars", dollars * scale)


def evidence(assigned: DataFrame, headlines: DataFrame, cluster: str, days: int = 8, per_day: int = 2) -> DataFrame:
    """By cluster: its most confident days in time order, each with its first headlines."""
    best = assigned.withColumn("__r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("confidence"), "day"))).where(F.col("__r") <= days)
    first = headlines.withColumn("__h", F.row_number().over(Window.partitionBy("day").orderBy("title_id"))).where(F.col("__h") <= per_day)
    texts = best.select(cluster, "day", "confidence").join(first.select("day", "__h", "title"), "day", "left").groupBy(cluster, "day", "confidence").agg(F.transform(F.array_sort(F.collect_list(F.struct("__h", "title"))), lambda s: s["title"]).alias("titles"))
    return texts.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("day", "confidence", "titles"))).alias("days"))
