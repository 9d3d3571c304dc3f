"""Cues into turns, and what a transcript as a whole shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import strip
from colloquy.operators.blocks import blocked, last_known, numbered, with_previous


def merge_turns(cues: DataFrame, max_gap_ms: int | None = None, join: str = " ") -> DataFrame:
    """Consecutive cues of one speaker as one turn, re-indexed from 0; unknown speakers merge with each other.

    Blank cues go. With `max_gap_ms`, a turn also ends where the next start is later than the last known end by more.
    The first known start and the last known end hold; NULL times stay NULL. Boundaries come from blocks of
    the transcript (see `blocks`), so only the rows of one turn are ever gathered.
    """
    x = blocked(cues.withColumn("text", strip(F.col("text"))).where(F.col("text") != ""))
    x = with_previous(x, ["speaker"])
    other = F.col("_prev").isNull() | ~F.col("speaker").eqNullSafe(F.col("_prev.speaker"))
    if max_gap_ms is not None:
        x = numbered(x, other, "_run").withColumn("_known", F.when(F.col("end_ms").isNotNull(), F.struct("end_ms", "index")))
        x = last_known(x, "_known", "_run", "_before")
        late = x.where(F.col("start_ms") - F.col("_before.end_ms") > max_gap_ms)
        # the first late start after a known end opens a turn; for those after it that end lies in the turn before
        late = late.groupBy("transcript_id", F.col("_before.index").alias("_at")).agg(F.min("index").alias("index")).select("transcript_id", "index", F.lit(True).alias("_late"))
        x = x.join(late, ["transcript_id", "index"], "left")
        other = other | F.col("_late").isNotNull()
    x = numbered(x, other, "_number").withColumn("_turn", F.col("_number") - 1)
    order = F.col("index")
    return x.groupBy("transcript_id", F.col("_turn").cast("bigint").alias("index")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda r: r["text"]), join).alias("text"),
        F.min_by("speaker", order).alias("speaker"), F.min_by("raw_speaker", order).alias("raw_speaker"),
        F.min_by("start_ms", F.when(F.col("start_ms").isNotNull(), order)).alias("start_ms"), F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), order)).alias("end_ms"),
    )


def transcript_attributes(turns: DataFrame) -> DataFrame:
    """One row per transcript: speakers in order of appearance, has_timestamps, duration_ms (latest end), n_turns, n_chars."""
    first = turns.groupBy("transcript_id", "speaker").agg(F.min("index").alias("_first"), F.max(F.col("start_ms").isNotNull()).alias("_timed"), F.max("end_ms").alias("_end"), F.count(F.lit(1)).alias("_n"), F.sum(F.length("text")).alias("_chars"))
    order = F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("_first", "speaker"))))
    return first.groupBy("transcript_id").agg(F.transform(order, lambda r: r["speaker"]).alias("speakers"), F.max("_timed").alias("has_timestamps"), F.max("_end").alias("duration_ms"), F.sum("_n").alias("n_turns"), F.sum("_chars").alias("n_chars"))


def turn_duration(turns: DataFrame) -> DataFrame:
    """`turns` with `duration_ms`: never negative, NULL if an end is unknown."""
    d = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    return turns.withColumn("duration_ms", F.when(F.col("end_ms").isNotNull() & F.col("start_ms").isNotNull(), d))


def group_words(words: DataFrame) -> DataFrame:
    """Timed words (transcript_id, index, text, speaker, start_ms, end_ms, is_punct) as turns; punctuation sticks to its turn without a blank."""
    w = Window.partitionBy("transcript_id").orderBy("index")
    x = words.where("text IS NOT NULL AND text <> ''")
    x = x.withColumn("_n", F.row_number().over(w))
    voiced = F.when(~F.col("is_punct") | (F.col("_n") == 1), F.struct(F.col("speaker").alias("s")))
    held = F.last(voiced, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_break", (F.col("_n") == 1) | (~F.col("is_punct") & ~F.col("speaker").eqNullSafe(held["s"])))
    x = x.withColumn("_turn", F.sum(F.col("_break").cast("int")).over(w) - 1)
    x = x.withColumn("_piece", F.concat(F.when(F.col("is_punct") | F.col("_break"), "").otherwise(" "), F.col("text")))
    order = F.col("index")
    g = x.groupBy("transcript_id", F.col("_turn").cast("bigint").alias("index")).agg(
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "_piece"))), lambda r: r["_piece"]), "")).alias("text"),
        F.min_by("speaker", order).alias("speaker"), F.min_by("start_ms", order).alias("start_ms"), F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), order)).alias("end_ms"),
    )
    return g.where("text <> ''")
