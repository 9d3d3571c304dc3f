"""Results as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """One column `value`: each row as a JSON object; NULL fields are kept, non-ASCII stays as it is."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one file per partition."""
    as_json(df).write.mode(mode).text(path)


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks in the shape of their JSON: eleven keys, the last one free for the user."""
    fields = "id text speakers primary_speaker start_ms end_ms turn_start turn_end overlap_indices source".split()
    return chunks.select(*fields, F.create_map().cast("map<string,string>").alias("meta"))


def finding_records(findings: DataFrame) -> DataFrame:
    """Findings in the shape of their JSON: eight keys."""
    return findings.select(*"kind start_index end_index speakers reason confidence start_ms end_ms".split())
