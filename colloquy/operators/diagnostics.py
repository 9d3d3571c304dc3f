"""Turn boundaries that look like mistakes of speaker separation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import ends_open, is_generic_label, starts_lower, strip, word_count
from colloquy.operators.blocks import blocked, with_previous

FINDING = ["transcript_id", "kind", "start_index", "end_index", "speakers", "reason", "confidence", "start_ms", "end_ms"]
LEVELS = {"low": 1, "medium": 2, "high": 3}


def _order():
    return Window.partitionBy("transcript_id").orderBy("index")


def uses_capitals(turns: DataFrame) -> DataFrame:
    """(transcript_id, capitals): of two or more turns that begin with a letter, half or more begin with a capital."""
    first = F.substring(strip(F.col("text")), 1, 1)
    letter = first.rlike(r"\p{L}")
    x = turns.groupBy("transcript_id").agg(F.sum(letter.cast("int")).alias("_n"), F.sum(first.rlike(r"\p{Lu}").cast("int")).alias("_u"))
    return x.select("transcript_id", F.coalesce((F.col("_n") >= 2) & (F.col("_u") * 2 >= F.col("_n")), F.lit(False)).alias("capitals"))


def flips(turns: DataFrame, max_gap_ms: int = 300) -> DataFrame:
    """mid_utterance_flip: the speaker changes within `max_gap_ms` while the sentence is open."""
    x = with_previous(blocked(turns), ["text", "speaker", "start_ms", "end_ms", "index"])
    x = x.select("transcript_id", "index", "text", "speaker", "start_ms", "end_ms", *[F.col(f"_prev.{c}").alias(f"p_{c}") for c in ("text", "speaker", "start_ms", "end_ms", "index")])
    x = x.where((F.col("speaker") != F.col("p_speaker")) & (F.col("start_ms") - F.col("p_end_ms") <= max_gap_ms) & ends_open(F.col("p_text")))
    x = x.join(uses_capitals(turns), "transcript_id")
    sure = F.col("capitals") & starts_lower(F.col("text"))
    reason = F.format_string("%s stops mid-sentence and %s goes on %d ms later", "p_speaker", "speaker", F.col("start_ms") - F.col("p_end_ms"))
    return x.select("transcript_id", F.lit("mid_utterance_flip").alias("kind"), F.col("p_index").alias("start_index"), F.col("index").alias("end_index"), F.array("p_speaker", "speaker").alias("speakers"), reason.alias("reason"), F.when(sure, "high").otherwise("medium").alias("confidence"), F.col("p_start_ms").alias("start_ms"), "end_ms")


def flapping(turns: DataFrame, min_run: int = 4, max_words: int = 4) -> DataFrame:
    """Two labels that alternate over `min_run` or more short turns.

    Maximal runs come from windows; two neighbouring runs share at most one turn, which the earlier one keeps if it
    counts. Only the runs of a transcript are folded, to settle that.
    """
    w = _order()
    x = turns.withColumn("_ok", F.col("speaker").isNotNull() & (word_count(F.col("text")) <= max_words)).withColumn("_pos", F.row_number().over(w))
    edge = F.col("_ok") & F.lag("_ok").over(w) & (F.col("speaker") != F.lag("speaker").over(w))
    x = x.withColumn("_edge", F.coalesce(edge, F.lit(False)))
    on = F.col("_edge") & F.coalesce(F.lag("_edge").over(w), F.lit(False)) & F.col("speaker").eqNullSafe(F.lag("speaker", 2).over(w))
    x = x.withColumn("_run", F.sum((F.col("_edge") & ~on).cast("int")).over(w)).withColumn("_before", F.lag("speaker").over(w))
    runs = x.where("_edge").groupBy("transcript_id", "_run").agg((F.min("_pos") - 1).alias("s"), F.max("_pos").alias("e"))
    # a run starts one turn later if the run just before it counts and ends with that turn
    r = Window.partitionBy("transcript_id").orderBy("s")
    chained = (F.lag("e").over(r) == F.col("s"))
    runs = runs.withColumn("_chain", F.sum((~F.coalesce(chained, F.lit(False))).cast("int")).over(r))
    folded = runs.groupBy("transcript_id", "_chain").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_runs"))
    least = F.lit(max(2, min_run))
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("out"), F.lit(-1).alias("taken"))

    def step(a, q):
        s = F.when(a["taken"] == q["s"], q["s"] + 1).otherwise(q["s"])
        good = q["e"] - s + 1 >= least
        return F.struct(F.when(good, F.concat(a["out"], F.array(F.struct(s.alias("s"), q["e"].alias("e"))))).otherwise(a["out"]).alias("out"), F.when(good, q["e"]).otherwise(F.lit(-1)).alias("taken"))

    kept = folded.select("transcript_id", F.inline(F.aggregate("_runs", start, step)["out"])).withColumnRenamed("transcript_id", "_t")
    at = x.select("transcript_id", "_pos", "index", "speaker", "start_ms", "end_ms")
    first = at.join(kept, (F.col("transcript_id") == F.col("_t")) & (F.col("_pos") == F.col("s"))).select("transcript_id", "s", "e", F.col("index").alias("start_index"), F.col("speaker").alias("_s1"), "start_ms")
    last = at.select(F.col("transcript_id").alias("_t"), F.col("_pos").alias("_p"), F.col("index").alias("end_index"), F.col("speaker").alias("_s2"), F.col("end_ms").alias("_end"))
    both = first.join(last, (F.col("transcript_id") == F.col("_t")) & (F.col("e") == F.col("_p")))
    second = at.select(F.col("transcript_id").alias("_u"), F.col("_pos").alias("_q"), F.col("speaker").alias("_other"))
    both = both.join(second, (F.col("transcript_id") == F.col("_u")) & (F.col("s") + 1 == F.col("_q")))
    n = F.col("e") - F.col("s") + 1
    reason = F.format_string("%s and %s alternate over %d short turns", "_s1", "_other", n)
    return both.select("transcript_id", F.lit("flapping").alias("kind"), "start_index", "end_index", F.array("_s1", "_other").alias("speakers"), reason.alias("reason"), F.lit("medium").alias("confidence"), "start_ms", F.col("_end").alias("end_ms"))


def ghosts(turns: DataFrame, max_turns: int = 2, max_share: float = 0.005) -> DataFrame:
    """ghost_speaker: a generic label with hardly any turns or text beside another speaker."""
    by = turns.groupBy("transcript_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("index").alias("start_index"), F.max("index").alias("end_index"), F.min_by("start_ms", "index").alias("start_ms"), F.max_by("end_ms", "index").alias("end_ms"))
    all_ = by.groupBy("transcript_id").agg(F.sum("chars").alias("total"), F.count("speaker").alias("voices"))
    x = by.where("speaker IS NOT NULL").join(all_, "transcript_id").where((F.col("voices") >= 2) & is_generic_label(F.col("speaker")) & (F.col("n") <= max_turns) & (F.col("chars") <= max_share * F.col("total")))
    reason = F.format_string("%s has %d turns and %d of %d characters", "speaker", "n", "chars", "total")
    return x.select("transcript_id", F.lit("ghost_speaker").alias("kind"), "start_index", "end_index", F.array("speaker").alias("speakers"), reason.alias("reason"), F.lit("low").alias("confidence"), "start_ms", "end_ms")


def diarization_warnings(turns: DataFrame, max_gap_ms: int = 300, flap_min_run: int = 4) -> DataFrame:
    """All findings; order by transcript_id, start_index, kind to read them. Transcripts of one turn have none."""
    return flips(turns, max_gap_ms).select(*FINDING).unionByName(flapping(turns, flap_min_run).select(*FINDING)).unionByName(ghosts(turns).select(*FINDING))


def at_least(findings: DataFrame, level: str) -> DataFrame:
    """The findings of a confidence or higher."""
    return findings.where(F.col("confidence").isin([k for k, v in LEVELS.items() if v >= LEVELS[level]]))
