"""Queries and SQL of the general operators for time values, intervals and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.intervals import periods_and_gaps
from colloquy.operators.nested import flatten_payloads
from colloquy.operators.times import to_utc
from colloquy.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_utc(table(spark, sf_dir, "vendor_times"), table(spark, sf_dir, "transcripts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: table(spark, sf_dir, name).select(F.lit(name).alias("origin"), "transcript_id", "start_ms", "end_ms")
    return periods_and_gaps(one("turns").unionByName(one("findings")), ["origin", "transcript_id"]).select("origin", "transcript_id", "kind", "start_ms", "end_ms")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_payloads(table(spark, sf_dir, "asr_payloads"))["tokens"].select("payload_id", "record_pos", "parent_pos", "child_pos", "token")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found}

SQL = {
    "p3_found": """
WITH s AS (
  SELECT DISTINCT origin, transcript_id, start_ms, end_ms FROM (
    SELECT 'turns' AS origin, transcript_id, start_ms, end_ms FROM turns
    UNION ALL SELECT 'findings', transcript_id, start_ms, end_ms FROM findings)
  WHERE transcript_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms),
p AS (SELECT *, max(end_ms) OVER (PARTITION BY origin, transcript_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR start_ms > prev THEN 1 ELSE 0 END) OVER (PARTITION BY origin, transcript_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM p)
SELECT origin, transcript_id, 'period' AS kind, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY origin, transcript_id, island
UNION ALL
SELECT origin, transcript_id, 'gap', prev, start_ms FROM i WHERE start_ms > prev
""",
}
