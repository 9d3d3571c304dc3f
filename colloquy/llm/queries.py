"""Queries and SQL of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.leaks import leaked_items
from colloquy.llm.mixing import mix_sources
from colloquy.llm.names import linked_pairs
from colloquy.llm.repeats import repeated_events
from colloquy.llm.sentences import turn_sentences
from colloquy.llm.subjects import document_subjects
from colloquy.llm.turns import clean_turns
from colloquy.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_pairs(table(spark, sf_dir, "speaker_labels"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_turns(table(spark, sf_dir, "turns"), table(spark, sf_dir, "transcripts")).select("transcript_id", "first_turn_index", "last_turn_index", "words")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_events(table(spark, sf_dir, "turns"), table(spark, sf_dir, "transcripts")).select("transcript_id", "first_turn_index", "last_turn_index", "n_turns")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_sentences(table(spark, sf_dir, "turns"), table(spark, sf_dir, "transcripts"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, shares = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return records.join(F.broadcast(shares.select("source", "target_share", "reached_share")), "source")  # one row per target


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_labels")).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p1_found, p5_found, p6_found, p7_found, p8_found, p9_mix, p9_shares, p10_found)}
SQL: dict[str, str] = {}
