"""Transcripts from files or tables: detection, parsing, and a quarantine for what no parser reads."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.turns import merge_turns
from colloquy.session import cut, ship
from colloquy.sources.asr import parse_asr
from colloquy.sources.captions import parse_plain, parse_srt, parse_vtt
from colloquy.sources.detect import detect_text_format, detect_vendor

CUES = ["transcript_id", "index", "text", "speaker", "raw_speaker", "start_ms", "end_ms", "rolling_duplicate_cues"]
_PATH_LIKE = r"(?i)^\S{1,300}\.(vtt|srt|txt|json|jsonl|md|sbv|ass|ssa)$"


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files as (transcript_id, source, text): the path, its last part, the content with uniform line ends and valid UTF-8."""
    ship(spark)
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("transcript_id"), F.col("_metadata.file_name").alias("source"), F.make_valid_utf8("value").alias("text"))
    return x.withColumn("text", F.regexp_replace("text", r"\r\n?", "\n"))


def with_format(texts: DataFrame, text: str = "text", format: str | None = None) -> DataFrame:
    """`texts` with `format` (json, vtt, srt, plain; NULL: none) and `vendor`."""
    keep = [c for c in texts.columns if c not in ("format", "vendor")]
    # generators keep the tests where they are: filters on their result would carry a copy of them down to the scan
    x = texts.select(*keep, F.inline(F.array(F.struct(detect_vendor(F.col(text)).alias("vendor")))))
    told = F.lit(format) if format else F.when(F.col("vendor").isNotNull(), "json").otherwise(detect_text_format(F.col(text)))
    x = x.select(*keep, "vendor", F.inline(F.array(F.struct(told.alias("format")))))
    return x.select(*keep, "format", F.when(F.col("format") == "json", F.col("vendor")).alias("vendor"))


def parse_cues(texts: DataFrame, text: str = "text", format: str | None = None, vendor: str | None = None, part: str | None = None) -> DataFrame:
    """Cues of all texts (transcript_id, `text`), each by the parser of its format; JSON may come in parts (see `parse_asr`)."""
    x = cut(with_format(texts.select("transcript_id", F.col(text).alias("text"), *([F.col(part).alias("part")] if part else [])), "text", format))  # formats are told once
    found = {r[0] for r in x.select("format").distinct().collect()}  # four at most
    if part and found - {"json", None}:
        raise ValueError("only JSON may come in parts")
    of = {"vtt": parse_vtt, "srt": parse_srt, "plain": parse_plain, "json": partial(parse_asr, vendor=vendor, part=part and "part")}
    parts = [parse(x.where(F.col("format") == f)).select(*CUES) for f, parse in of.items() if f in found]
    return reduce(DataFrame.unionByName, parts or [parse_srt(x).select(*CUES)])


def parse_transcripts(texts: DataFrame, text: str = "text", format: str | None = None, merge: bool = True, max_gap_ms: int | None = None, vendor: str | None = None, part: str | None = None) -> DataFrame:
    """Turns of all texts; `merge=False` gives the cues. Texts of no known format give no row (see `quarantine`)."""
    cues = parse_cues(texts, text, format, vendor, part)
    return merge_turns(cut(cues), max_gap_ms) if merge else cues  # merging reads the cues more than once


def quarantine(texts: DataFrame, text: str = "text", mode: str = "PERMISSIVE") -> DataFrame:
    """The texts no parser reads, with a reason; `mode='FAILFAST'` raises instead."""
    x = with_format(texts, text).where("format IS NULL")
    hint = F.when(F.col(text).rlike(_PATH_LIKE), "this is a path, not a transcript: read the file first").when(F.ltrim(F.col(text)).rlike(r"^[\[{]"), "JSON of no known vendor").otherwise("no known format")
    x = x.withColumn("reason", hint)
    return x.withColumn("reason", F.raise_error(F.col("reason")).cast("string")) if mode == "FAILFAST" else x
