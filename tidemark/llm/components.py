"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root): every linked node and the smallest node it reaches.

    Nodes are longs; self-links, repeated links and null ends are ignored, and an empty table gives an empty
    result. Each round writes its links to the shared folder; only a count and a hash come to the driver.
    A hub's links are pre-aggregated to their minimum, and the joins back may be split by adaptive execution.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), (F.col(src).isNotNull() & F.col(dst).isNotNull()).alias("ok"))
    e = cut(e.where("ok and u <> v").select("u", "v").distinct())
    sign = _sign(e)
    while sign[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, sign = sign, _sign(e)
        if before == sign:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
