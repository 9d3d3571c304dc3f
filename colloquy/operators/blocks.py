"""Order within a transcript without one task per transcript.

A transcript may hold a third of all rows. Its rows are cut into blocks by index, so a block never holds more than BLOCK
rows; windows run inside blocks, and a summary of one row per block carries values from block to block. Summaries and
windows read the same exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
KEYS = ["transcript_id", "_block"]


def blocked(df: DataFrame) -> DataFrame:
    """Rows (transcript_id, index, ...) spread by transcript and block."""
    return df.withColumn("_block", F.floor(F.col("index") / BLOCK)).repartition(*KEYS)


def inside() -> Window:
    return Window.partitionBy(*KEYS).orderBy("index")


def _over_blocks() -> Window:
    return Window.partitionBy("transcript_id").orderBy("_block")


def with_previous(df: DataFrame, columns: list[str], name: str = "_prev") -> DataFrame:
    """Adds the struct of `columns` of the row before; NULL for the first row of a transcript."""
    row = F.struct(*columns)
    ends = df.groupBy(*KEYS).agg(F.max_by(row, "index").alias("_end"))
    carried = ends.select(*KEYS, F.lag("_end").over(_over_blocks()).alias("_carried")).where("_carried IS NOT NULL")
    return df.join(carried, KEYS, "left").withColumn(name, F.coalesce(F.lag(row).over(inside()), "_carried")).drop("_carried")


def numbered(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Adds how many rows of the transcript up to and with this one have the flag."""
    x = df.withColumn("_flag", F.coalesce(flag.cast("bigint"), F.lit(0)))
    sums = x.groupBy(*KEYS).agg(F.sum("_flag").alias("_n"))
    before = sums.select(*KEYS, F.sum("_n").over(_over_blocks().rowsBetween(Window.unboundedPreceding, -1)).alias("_offset")).where("_offset > 0")
    x = x.join(before, KEYS, "left").withColumn(name, F.sum("_flag").over(inside()) + F.coalesce("_offset", F.lit(0)))
    return x.drop("_flag", "_offset")


def last_known(df: DataFrame, column: str, run: str, name: str) -> DataFrame:
    """Adds the last value of `column` that isn't NULL before this row in its run (a number that never falls)."""
    ends = df.groupBy(*KEYS).agg(F.max_by(F.struct(column, run), F.when(F.col(column).isNotNull(), F.col("index"))).alias("_end"))
    carried = ends.select(*KEYS, F.last("_end", ignorenulls=True).over(_over_blocks().rowsBetween(Window.unboundedPreceding, -1)).alias("_carried")).where("_carried IS NOT NULL")
    here = F.last(column, ignorenulls=True).over(Window.partitionBy(*KEYS, run).orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    far = F.when(F.col(f"_carried.{run}") == F.col(run), F.col(f"_carried.{column}"))
    return df.join(carried, KEYS, "left").withColumn(name, F.coalesce(here, far)).drop("_carried")
