"""The turn table: one row per (transcript_id, index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN_COLUMNS = {"text": "string", "speaker": "string", "raw_speaker": "string", "start_ms": "bigint", "end_ms": "bigint"}


def as_turns(df: DataFrame, transcript: str = "transcript_id", order: str = "index", **columns: str) -> DataFrame:
    """Any table with at least `text` as turns; `columns` maps turn columns to the table's, missing ones are typed NULLs.

    Unknown times stay NULL. Rows without transcript or index don't count; further columns are left out.
    """
    at = lambda n: F.col(columns.get(n, n)) if columns.get(n, n) in df.columns else F.lit(None)
    if columns.get("text", "text") not in df.columns:
        raise ValueError("a turn table needs a text column")
    x = df.select(F.col(transcript).alias("transcript_id"), F.col(order).cast("bigint").alias("index"), *[at(n).cast(t).alias(n) for n, t in TURN_COLUMNS.items()])
    return x.where(F.col("transcript_id").isNotNull() & F.col("index").isNotNull())
