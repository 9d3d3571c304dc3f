"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Sorted by start per entity, each start is compared with the running maximum of the ends before it. An entity may hold a
third of all rows, so its time line is cut into slices of fixed width: windows run inside a slice, and a summary of one
row per slice carries the running maximum and the open period from slice to slice. Spans with the same start are
reduced to the longest one before the first shuffle, so that a slice never holds more rows than it has distinct starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice in the unit of the starts (milliseconds: one hour).
SLICE = 3_600_000


def _carried(summary: DataFrame, keys: list[str], value: str, as_name: str) -> DataFrame:
    """The maximum of `value` over the slices before each slice."""
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, "_slice", F.max(value).over(before).alias(as_name))


def periods_and_gaps(spans: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", slice_width: int = SLICE) -> DataFrame:
    """Rows (keys, kind 'period' or 'gap', start, end) of the union of each entity's spans.

    Spans that touch are continuous. Spans with a NULL end, or an end before the start, and rows with a NULL key don't
    count; a span of no length is a period of its own if nothing covers it. Repeated rows change nothing. An empty table
    gives no rows. Further columns are ignored; key columns keep their types.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    x = spans.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    x = x.where(" AND ".join(f"{k} IS NOT NULL" for k in [*ks, "_s", "_e"])).where("_e >= _s")
    x = x.groupBy(*ks, "_s").agg(F.max("_e").alias("_e")).withColumn("_slice", F.floor(F.col("_s") / slice_width))
    ends = x.groupBy(*ks, "_slice").agg(F.max("_e").alias("_top"))
    x = x.join(_carried(ends, ks, "_top", "_before"), [*ks, "_slice"])
    inside = Window.partitionBy(*ks, "_slice").orderBy("_s")
    x = x.withColumn("_prev", F.greatest("_before", F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1))))
    x = x.withColumn("_first", F.when(F.col("_prev").isNull() | (F.col("_s") > F.col("_prev")), F.col("_s")))
    firsts = x.groupBy(*ks, "_slice").agg(F.max("_first").alias("_open"))
    x = x.join(_carried(firsts, ks, "_open", "_open_before"), [*ks, "_slice"])
    x = x.withColumn("_island", F.greatest("_open_before", F.max("_first").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    named = [F.col(n).alias(k) for k, n in zip(keys, ks)]
    islands = x.groupBy(*ks, "_island").agg(F.max("_e").alias("_end"), F.max(F.when(F.col("_first") == F.col("_island"), F.col("_prev"))).alias("_gap_from"))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias(start), F.col(b).alias(end))
    both = F.array(row("period", "_island", "_end"), F.when(F.col("_gap_from").isNotNull(), row("gap", "_gap_from", "_island")))
    return islands.select(*named, F.explode(F.filter(both, lambda r: r.isNotNull())).alias("_r")).select(*keys, "_r.*")
