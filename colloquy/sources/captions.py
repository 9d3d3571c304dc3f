"""Caption files and plain text into cues: (transcript_id, index, text, speaker, raw_speaker, start_ms, end_ms).

Texts are cut into blocks or lines without leaving the row; what depends on the cue before (rolling captions, pending
speakers) comes from windows over the transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import after_inline_speaker, inline_speaker, parse_timestamp, strip, strip_tags, unbold, voice_speaker, without_rolling
from colloquy.sources.detect import STAMP, leading_clock, name_and_clock

#: First words of blocks that hold no cue.
BLOCK_WORDS = "NOTE STYLE REGION COMMENT".split()


def _text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^﻿+", ""), r"\r\n?", "\n")


def _timing(line: Column) -> tuple[Column, Column]:
    left, right = F.regexp_extract(line, r"^(.*?)\s*-->\s*(.*)$", 1), F.regexp_extract(line, r"^(.*?)\s*-->\s*(.*)$", 2)
    return parse_timestamp(F.regexp_extract(left, r"(\S+)\s*$", 1)), parse_timestamp(F.regexp_extract(right, r"^\s*(\S+)", 1))


def _name_clock_words(line: Column) -> tuple[Column, Column, Column]:
    """(name, clock time, words) of `Name (12:34): words`; NULL if it is none."""
    tag = F.regexp_extract(line, rf"[(\[]\s*{STAMP}\s*[)\]]\s*:", 0)
    at = F.position(tag, line)
    name = strip(F.substr(line, F.lit(1), at - 1))
    there = (tag != "") & F.length(name).between(1, 48) & ~name.contains(":")
    words = F.substr(line, at + F.length(tag))
    return F.when(there, name), F.when(there, F.regexp_extract(tag, STAMP, 0)), F.when(there, strip(words))


def _finish(cues: DataFrame) -> DataFrame:
    """Rows (transcript_id, pos, timing, raw) as cues: tags, rolling captions, labels."""
    start, end = _timing(F.col("timing"))
    x = cues.select("transcript_id", "pos", start.alias("start_ms"), end.alias("end_ms"), "voice", F.filter(F.transform(F.split(strip_tags(F.col("raw")), "\n"), strip), lambda s: s != "").alias("lines")).where(F.size("lines") > 0)
    w = Window.partitionBy("transcript_id").orderBy("pos")
    x = x.withColumn("_kept", without_rolling(F.lag("lines").over(w), F.col("lines")))
    x = x.select("transcript_id", "pos", "start_ms", "end_ms", "voice", (F.size("_kept") < F.size("lines")).alias("rolling"), strip(F.array_join("_kept", " ")).alias("body"))
    inline = F.when(F.col("voice").isNull(), inline_speaker(F.col("body")))
    x = x.withColumn("speaker", F.coalesce("voice", inline)).withColumn("text", F.when(inline.isNotNull(), after_inline_speaker(F.col("body"))).otherwise(F.col("body")))
    x = x.withColumn("rolling_duplicate_cues", F.sum(F.col("rolling").cast("bigint")).over(Window.partitionBy("transcript_id"))).where("text <> ''")
    return x.select("transcript_id", (F.row_number().over(w) - 1).cast("bigint").alias("index"), "text", "speaker", F.col("speaker").alias("raw_speaker"), "start_ms", "end_ms", "rolling_duplicate_cues")


def parse_vtt(texts: DataFrame, text: str = "text") -> DataFrame:
    """Cues of WebVTT texts. NULL and empty texts have none; unreadable times are NULL."""
    blocks = F.transform(F.split(_text(F.col(text)), r"\n(?:[^\S\n]*\n)+|^[^\S\n]*\n"), lambda b: F.filter(F.split(b, "\n"), lambda s: strip(s) != ""))

    def cue(lines: Column, pos: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda s: s.contains("-->")), True)
        before = F.filter(lines, lambda s, i: i < at - 1)
        skipped = F.exists(before, lambda s: strip(s).rlike(f"^({'|'.join(BLOCK_WORDS)})"))
        return F.when((at > 0) & ~skipped, F.struct(pos.alias("pos"), F.element_at(lines, at.cast("int")).alias("timing"), F.array_join(F.filter(lines, lambda s, i: i >= at), "\n").alias("raw")))

    x = texts.select("transcript_id", F.inline(F.filter(F.transform(blocks, cue), lambda c: c.isNotNull() & (c["raw"] != ""))))
    return _finish(x.withColumn("voice", voice_speaker(F.col("raw"))))


def parse_srt(texts: DataFrame, text: str = "text") -> DataFrame:
    """Cues of SubRip texts; a number line before the times is dropped."""
    whole = strip(F.regexp_replace(F.regexp_replace(F.col(text), "^﻿+", ""), "\r\n", "\n"))

    def cue(block: Column, pos: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda s: strip(s) != "")
        lines = F.when((F.size(lines) > 1) & strip(F.get(lines, F.lit(0))).rlike(r"^\d+$"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        first = F.get(lines, F.lit(0))
        return F.when(first.contains("-->"), F.struct(pos.alias("pos"), first.alias("timing"), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n").alias("raw")))

    x = texts.select("transcript_id", F.inline(F.filter(F.transform(F.split(whole, r"\n\s*\n"), cue), lambda c: c.isNotNull() & (c["raw"] != ""))))
    return _finish(x.withColumn("voice", F.lit(None).cast("string")))


def parse_plain(texts: DataFrame, text: str = "text") -> DataFrame:
    """Cues of plain transcripts: `Name  12:34` lines, `Name (12:34): words`, leading times, inline labels, continuations. `end_ms` is NULL."""
    x = texts.select("transcript_id", F.posexplode(F.split(_text(F.col(text)), "\n")).alias("pos", "line"))
    x = x.select("transcript_id", "pos", strip(unbold(F.col("line"))).alias("line")).where("line <> ''")
    someone = lambda name: F.when(inline_speaker(F.concat(name, F.lit(": x"))).isNotNull(), strip(name))
    line = F.col("line")
    (alone, alone_at), (named, named_at, named_words), (clock, rest) = name_and_clock(line), _name_clock_words(line), leading_clock(line)
    x = x.withColumns({"_a": someone(alone), "_a_at": alone_at})
    x = x.withColumns({"_b": F.when(F.col("_a").isNull(), someone(named)), "_b_at": named_at, "_b_words": named_words})
    timed = F.col("_a").isNull() & F.col("_b").isNull() & (rest != "")
    x = x.withColumn("_ts", F.when(timed, parse_timestamp(clock))).withColumn("_rest", F.when(timed, strip(rest)).otherwise(line))
    x = x.withColumn("_c", F.when(F.col("_a").isNull() & F.col("_b").isNull(), inline_speaker(F.col("_rest"))))
    w = Window.partitionBy("transcript_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pending = F.last(F.coalesce("_a", "_b", "_c"), ignorenulls=True).over(before)
    pending_ts = F.lag(F.when(F.col("_a").isNotNull(), parse_timestamp(F.col("_a_at")))).over(w)
    speaker = F.coalesce("_b", "_c", pending)
    words = F.when(F.col("_b").isNotNull(), F.col("_b_words")).when(F.col("_c").isNotNull(), after_inline_speaker(F.col("_rest"))).otherwise(F.col("_rest"))
    start = F.when(F.col("_b").isNotNull(), parse_timestamp(F.col("_b_at"))).otherwise(F.coalesce("_ts", pending_ts))
    x = x.select("transcript_id", "pos", "_a", strip(words).alias("text"), speaker.alias("speaker"), start.alias("start_ms")).where("_a IS NULL AND text <> ''")
    return x.select("transcript_id", (F.row_number().over(w) - 1).cast("bigint").alias("index"), "text", "speaker", F.col("speaker").alias("raw_speaker"), "start_ms", F.lit(None).cast("bigint").alias("end_ms"), F.lit(0).cast("bigint").alias("rolling_duplicate_cues"))
