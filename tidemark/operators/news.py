"""Aggregates over a news corpus: themes, topics, tone and vectors by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X


def theme_prevalence(news: DataFrame, topics: dict[str, int]) -> DataFrame:
    """Articles with a theme as a share of *all* articles of the day, those without themes included."""
    rows = news.select("day", F.array_distinct(X.tolerant_themes(F.col("themes"))).alias("themes"))
    per_day = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n_day"))
    known = F.create_map(*[x for k, v in topics.items() for x in (F.lit(k), F.lit(v))])
    hits = rows.select("day", F.explode("themes").alias("theme")).withColumn("topic_id", F.try_element_at(known, F.col("theme"))).where("topic_id is not null")
    return hits.groupBy("day", "topic_id").agg(F.count(F.lit(1)).alias("n")).join(per_day, "day").select("day", "topic_id", (F.col("n") / F.col("n_day")).alias("prevalence"))


def assigned_prevalence(assigned: DataFrame, day: str = "day", topic: str = "topic_id") -> DataFrame:
    """Shares of topics among *assigned* articles: noise (negative or null topic) is in neither part."""
    counts = assigned.where(F.col(topic) >= 0).groupBy(day, topic).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prevalence", F.col("n") / F.sum("n").over(Window.partitionBy(day)))


def topic_wide(prevalence: DataFrame, topics: list[int]) -> DataFrame:
    """A column per listed topic, a missing pair counting as zero."""
    return prevalence.groupBy("day").agg(*[F.coalesce(F.max(F.when(F.col("topic_id") == t, F.col("prevalence"))), F.lit(0.0)).alias(f"topic_{t}") for t in topics])


def daily_text_state(news: DataFrame, metals_of: dict[str, list[str]]) -> DataFrame:
    """By day and metal: articles with a known theme for it and the null-skipping mean tone."""
    rows = news.select("day", "tone", X.tolerant_themes(F.col("themes")).alias("themes"))
    table = F.create_map(*[x for k, v in metals_of.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    metals = F.array_distinct(F.flatten(F.transform("themes", lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))
    return rows.select("day", "tone", F.explode(metals).alias("metal")).groupBy("day", "metal").agg(F.count(F.lit(1)).alias("n_articles"), F.avg("tone").alias("mean_tone"))


def vector_state(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean unit vector, dispersion): vectors are scaled to unit length; dispersion is one less the mean's
    length, null for a single vector. Positions are summed as rows of (key, position), so no group is gathered."""
    unit = vectors.withColumn("len", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).where("len > 0")
    cells = unit.select(key, "len", F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double") / F.col("len")).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy(key).agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    return whole.select(key, "n", "norm", F.transform("mean", lambda m: m / F.col("norm")).alias("centroid"), F.when(F.col("n") >= 2, 1 - F.col("norm")).alias("dispersion"))


def market_state(articles: DataFrame, vectors: DataFrame, key: str, tones: list[str], vector: str) -> DataFrame:
    """By day: articles, the null-skipping mean of each tone, the mean unit vector and the dispersion around it."""
    state = articles.groupBy("day").agg(F.count(F.lit(1)).alias("n_articles"), *[F.avg(t).alias(f"tone_{t}") for t in tones])
    spread = vector_state(articles.select("day", key).join(vectors, key), "day", vector).select("day", "centroid", "dispersion")
    return state.join(spread, "day", "left")


def language_counts(news: DataFrame, base: Column, bridge: Column) -> DataFrame:
    """By language: rows, those the base gate admits, those the bridge alone adds, the same as distinct (day, lower title), and days."""
    rows = news.select("src_lang", "day", F.xxhash64("day", F.lower("title")).alias("key"), F.coalesce(base, F.lit(False)).alias("cur"), F.coalesce(bridge, F.lit(False)).alias("new"))
    distinct = lambda c: F.count_distinct(F.when(F.col(c), F.col("key")))
    return rows.groupBy("src_lang").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("cur").alias("n_cur"), F.count_if("new").alias("n_new"), distinct("cur").alias("uniq_cur"), distinct("new").alias("uniq_new"), F.count_distinct("day").alias("n_days"))
