"""Connected components of an edge table without ever gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Alternating large-star and small-star steps: each node hands the least of its neighbourhood to the others, until
    nothing changes. Every step is cut by a reliable checkpoint. NULL ends and loops link nothing; an empty table gives
    no rows.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = cut(e)
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v"), F.col("m"))  # larger neighbours to the least one
        small = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        star = small.join(low, "u").select("u", "v", "m")
        e2 = star.select(F.col("m").alias("u"), F.col("v")).union(star.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
        e2 = cut(e2)
        state = e2.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        e = e2
        if state == last:
            break
        last = state
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u"), F.col("u")).distinct())
