"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets whole epochs first: every document once for each time the source fits in its target. What is left of
the target is a fraction of one epoch, filled in the order of exponential keys -ln(u)/quality, where u is a hash of the
id: the prefix of that order whose sizes come nearest the budget. Keys are cut into cells by the leading bits of a whole
number of the same order, 2^``DIGIT`` cells a level; sizes are summed per source and cell, the cell in which a source's
budget ends is found from those sums and cut again by the bits that follow, until no source has more than ``LAST`` rows
in it, whatever the weights. Only those rows are sorted, rows equal in key, id and size as one. A source with a third of
all rows is thus never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Bits of a key's place and of one level of cells; rows that a source's last cell may hold.
PLACE, DIGIT, LAST = 52, 8, 2_000
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SEED = "mix-1"
#: Sources whose plans, some 100 bytes each, are broadcast; and the parts of a source beyond that.
FEW_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source; the excess goes to the others by weight until none is above. In closed form: sort by
    size per weight and cap the longest prefix whose caps lie below its share of what the caps before leave over.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("nth", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum(F.col("source_size")).over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(-F.col("cap") / F.col("weight"), -F.col("nth"), F.col("level").alias("level")))).over(everything)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def key_of(id_text: Column, quality: Column, seed: str = SEED) -> Column:
    """Exponential key -ln(u)/quality; u in (0, 1) from 52 bits of md5(seed:id)."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / quality


def place_of(key: Column) -> Column:
    """A whole number under 2^``PLACE`` in the order of keys: the logarithm in steps of 2^-45, from -48 on."""
    at = F.floor((F.ln(key) + 48) * float(1 << 45))
    return F.greatest(F.lit(0).cast("long"), F.least(at, F.lit((1 << PLACE) - 1)))


def mix(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: str = SEED, last: int = LAST) -> DataFrame:
    """One row per row of ``docs``: id, size (words), source_size, target, copies and taken (size * copies).

    ``quality`` is a column expression over ``docs``, a positive weight; null or absent is 1. Null text has size 0,
    null source is a source of its own, null ids share one key. Documents of size 0 never change a sum and are taken
    with their epoch only. Equal keys order by id, then size; repeated rows beyond that are taken together.
    """
    q = F.lit(1.0) if quality is None else F.coalesce(quality, F.lit(1.0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), key_of(F.col(id_col).cast("string"), q, seed).alias("key"))
    rows = cut(rows.withColumn("place", place_of(F.col("key"))))  # a few dozen bytes a document, so that texts are read once
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "s")
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # ``cell`` holds the place, less its last ``shift`` bits, where the budget ends; ``before`` the sizes ahead of it
    plan = cut(plan.withColumns({"cell": F.when(F.col("source_size") > 0, F.lit(0).cast("long")), "before": F.lit(0).cast("long")}))
    plan, shift = narrow(rows, plan, last)
    known = _with_plan(rows, plan).withColumn("at", F.shiftright("place", shift))
    done = known.where("cell is null or at <> cell").withColumn("extra", F.coalesce(F.col("at") < F.col("cell"), F.lit(True)))
    end = known.where("at = cell")
    by = Window.partitionBy("source").orderBy("key", "id", "size")
    alike = end.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    alike = alike.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("n")).over(by)).select("source", "key", "id", "size", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).alias("extra"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("source", "key", "id", "size")]
    end = end.alias("e").join(alike.alias("a"), same).select("e.*", "a.extra")
    both = done.unionByName(end)
    copies = F.col("epochs") + F.when(F.col("extra"), 1).otherwise(0)
    return both.select(F.col("id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), F.least(copies, F.lit(most)).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def narrow(rows: DataFrame, plan: DataFrame, last: int, shift: int = PLACE) -> tuple[DataFrame, int]:
    """(plan, shift) with cells of at most ``last`` rows a source, or of rows whose places are equal."""
    while shift > 0 and _most(rows, plan, shift) > last:
        plan, shift = cut(_narrowed(rows, plan, shift)), max(0, shift - DIGIT)
    return plan, shift


def _inside(rows: DataFrame, plan: DataFrame, shift: int) -> DataFrame:
    """Rows in the cell where their source's budget ends."""
    return _with_plan(rows, plan.select("s", "cell", "before", "rest")).where(F.shiftright("place", shift) == F.col("cell"))


def _most(rows: DataFrame, plan: DataFrame, shift: int) -> int:
    """The most rows that a source has in its cell."""
    return _inside(rows, plan, shift).groupBy("source").count().agg(F.max("count")).first()[0] or 0


def _narrowed(rows: DataFrame, plan: DataFrame, shift: int) -> DataFrame:
    """``plan`` with cells cut by the next ``DIGIT`` bits: a window over 2^``DIGIT`` sums a source."""
    sums = _inside(rows, plan, shift).groupBy("source", F.shiftright("place", max(0, shift - DIGIT)).alias("next")).agg(F.sum("size").alias("held"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.col("before") + F.sum("held").over(Window.partitionBy("source").orderBy("next"))).where("upto > rest")
    ends = sums.groupBy(F.col("source").alias("ended")).agg(F.min(F.struct("next", (F.col("upto") - F.col("held")).alias("before"))).alias("end"))
    return plan.drop("before").join(ends, F.expr("s <=> ended"), "left").select("s", "source_size", "target", "epochs", "rest", F.col("end.next").alias("cell"), F.col("end.before").alias("before"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its source's plan: broadcast up to ``FEW_SOURCES`` sources, counted first; beyond, joined by source and salt."""
    same = F.expr("source <=> s")
    if plan.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(plan), same)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)))
    copies = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("salt") == F.col("plan_salt"))).drop("salt", "plan_salt")


def take_mix(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", **named) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it. An id that repeats is taken as its most copies."""
    copies = mix(docs, quality, id_col, **named).where("copies > 0").groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").alias("__copies"))
    found = docs.join(copies, F.col(id_col).eqNullSafe(F.col("__id")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), "__copies")).alias("__nth")).drop("__nth")


def mix_sql(quality: str = "1.0", weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> str:
    """DuckDB SQL of ``mix`` over ``documents``, sorting every source whole."""
    cases = " ".join(f"WHEN {i} THEN {w}::double" for i, w in enumerate(weights))
    return rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
        -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5) / 4503599627370496.0) / {quality} AS key FROM documents),
    s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS weight, {most}.0 * source_size AS cap FROM s),
    o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
        coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before FROM w
        WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, (total - cap_before)::double / (all_weight - weight_before) AS level FROM o),
    t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight)::double AS target FROM l),
    r AS (SELECT d.doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) AS run
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, round(target, 6) AS target, least({most}, epochs + (run - size / 2.0 <= target - epochs * source_size)::int)::int AS copies, (size * least({most}, epochs + (run - size / 2.0 <= target - epochs * source_size)::int))::bigint AS taken FROM r"""
