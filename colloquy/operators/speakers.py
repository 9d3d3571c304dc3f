"""Spellings of speakers within a transcript, joined without ever guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import canonical_key, is_generic_label, strip_role
from colloquy.session import cut

#: Beyond this many different names in one transcript, partial names aren't matched (fixed value).
MAX_LABELS = 1000


def is_initial_form(short: Column, full: Column) -> Column:
    """As many tokens, each equal or the first letter of its partner."""
    ok = F.forall(F.arrays_zip(short.alias("s"), full.alias("f")), lambda p: (p["s"] == p["f"]) | ((F.length(p["s"]) == 1) & p["f"].startswith(p["s"])))
    return (F.size(short) == F.size(full)) & ok


def compatible(short: Column, full: Column) -> Column:
    """`short` can be another form of the longer `full`: initials, or fewer tokens that are all in it."""
    return (short != full) & (F.size(short) <= F.size(full)) & (is_initial_form(short, full) | ((F.size(short) < F.size(full)) & (F.size(F.array_except(short, full)) == 0)))


def build_speaker_map(labels: DataFrame, merge_partial_names: bool = True, max_merge_labels: int = MAX_LABELS) -> DataFrame:
    """(transcript_id, raw, resolved, n) from labels (transcript_id, raw, n, first_pos).

    Labels with one canonical key are one name, shown as its best spelling: mixed case, then the most frequent, the
    longest, the first seen. A partial name joins the fuller one only if exactly one fits; chains are followed.
    """
    x = labels.where("raw IS NOT NULL").select("transcript_id", "raw", "n", "first_pos", strip_role(F.col("raw")).alias("shown"))
    x = cut(x.withColumn("key", canonical_key("shown")))
    mixed = (F.lower("shown") != F.col("shown")) & (F.upper("shown") != F.col("shown"))
    best = F.max_by("shown", F.struct(mixed, F.col("n"), F.length("shown"), -F.col("first_pos")))
    g = x.groupBy("transcript_id", "key").agg(best.alias("shown"), F.max(is_generic_label(F.col("raw"))).alias("generic"))
    alias = g.select("transcript_id", "key", F.col("key").alias("to"))
    if merge_partial_names:
        counted = g.join(g.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("_names")).where(F.col("_names") <= max_merge_labels), "transcript_id").where("NOT generic")
        t = counted.select("transcript_id", "key", F.split("key", " ").alias("tokens")).where("key <> ''")
        token = t.select("*", F.explode(F.array_distinct("tokens")).alias("token"))
        a, b = (token.select("transcript_id", "token", F.col("key").alias(f"key_{s}"), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
        pairs = a.join(b, ["transcript_id", "token"]).where(compatible(F.col("tokens_a"), F.col("tokens_b")))
        one = pairs.groupBy("transcript_id", F.col("key_a").alias("key")).agg(F.min("key_b").alias("up"), (F.min("key_b") == F.max("key_b")).alias("sure")).where("sure").select("transcript_id", "key", "up")
        one = cut(one)
        alias = alias.join(one, ["transcript_id", "key"], "left").select("transcript_id", "key", F.coalesce("up", "key").alias("to"))
        up = one.select("transcript_id", F.col("key").alias("to"), F.col("up").alias("next"))
        while True:  # one step along all chains at a time; each step leads to a fuller name, so there are no cycles and no more steps than a name has tokens and initials
            alias = cut(alias.join(up, ["transcript_id", "to"], "left").select("transcript_id", "key", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            if alias.where("moved").isEmpty():
                break
            alias = alias.drop("moved")
        alias = alias.select("transcript_id", "key", "to")
    end = alias.join(g.select("transcript_id", F.col("key").alias("to"), "shown"), ["transcript_id", "to"]).select("transcript_id", "key", F.col("shown").alias("resolved"))
    return x.join(end, ["transcript_id", "key"]).select("transcript_id", "raw", "resolved", "n")


def label_counts(turns: DataFrame) -> DataFrame:
    """(transcript_id, raw, n, first_pos) of the labels as they were in the file, else as they are."""
    raw = F.coalesce(F.nullif("raw_speaker", F.lit("")), F.col("speaker"))
    return turns.select("transcript_id", raw.alias("raw"), "index").where("raw IS NOT NULL").groupBy("transcript_id", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first_pos"))


def resolve_speakers(turns: DataFrame, merge_partial_names: bool = True, rename: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns with resolved `speaker`, the map). `rename` wins: first by the raw label, then by the resolved name; `raw_speaker` keeps what the file said."""
    m = build_speaker_map(label_counts(turns), merge_partial_names)
    if rename:
        names = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
        m = m.withColumn("resolved", F.coalesce(F.element_at(names, F.col("raw")), F.element_at(names, F.col("resolved")), "resolved"))
    raw = F.coalesce(F.nullif("raw_speaker", F.lit("")), F.col("speaker"))
    x = turns.withColumn("raw", raw).join(m.select("transcript_id", "raw", "resolved"), ["transcript_id", "raw"], "left")
    return x.select(*[F.coalesce("resolved", "speaker").alias("speaker") if c == "speaker" else F.col("raw").alias("raw_speaker") if c == "raw_speaker" else F.col(c) for c in turns.columns]), m
