"""Speech transcripts into clean speaker turns, in spoken order.

Fields are extracted with SQL expressions: the time and label at the head of a text, and its words without marked noise.
Times are filled forward over the file order by windows. Speakers need no filling: an unlabelled turn has an unknown
speaker. Turns are then ordered in blocks (see `spoken`), islands of one speaker are numbered over them, and each island
is one turn.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.names import FILLERS, LEGAL, MACHINE, ORGANISATIONS, TITLES, link_names
from colloquy.llm.noise import HEAD, HESITATIONS, LABEL, MARKS, NOTES, STOPWORDS, TIME
from colloquy.llm.spoken import ORDER, Blocks, in_spoken_order
from colloquy.session import cut, join_small

#: Turns of one file whose times are filled forward together.
BLOCK = 4096


def names_someone(label: Column) -> Column:
    """Whether a text before a colon is a label of somebody: numbered like a machine's, or with a word of two letters or more that is no title, article or legal form, nor cut by a period."""
    plain = F.regexp_replace(label, r"\s*(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})", " ")
    plain = F.when(plain.rlike(r"[\p{L}\p{Nd}]"), plain).otherwise(label)
    words = F.split(F.lower(plain), r"[\s,;/&+_]+")

    def counts(w: Column) -> Column:
        bare = F.regexp_replace(w, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")
        cut = w.rlike(r"…$|\.\.\.$") | (F.endswith(w, F.lit(".")) & (F.length(bare) >= 3))
        return (F.length(bare) >= 2) & bare.rlike(r"[\p{L}\p{Nd}]") & ~bare.isin(*FILLERS, *LEGAL, *TITLES) & (~cut | bare.isin(*ORGANISATIONS))

    return label.rlike(rf"(?i){MACHINE}") | F.exists(words, counts)


def clock_ms(clock: Column) -> Column:
    """Milliseconds of `h:mm:ss.fff` or `m:ss`; NULL for an empty text."""
    c = F.replace(clock, F.lit(","), F.lit("."))
    parts = F.reverse(F.split(F.substring_index(c, ".", 1), ":"))
    n = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("bigint"), F.lit(0))
    fraction = F.when(F.contains(c, F.lit(".")), F.rpad(F.substring_index(c, ".", -1), 3, "0").try_cast("bigint")).otherwise(0)
    return F.when(clock != "", ((n(2) * 60 + n(1)) * 60 + n(0)) * 1000 + fraction)


def _rest(text: Column, head: Column) -> Column:
    return F.when(head != "", F.substr(text, F.length(head) + 1)).otherwise(text)


def without_noise(rows: DataFrame, text: str, lang: Column, name: str) -> DataFrame:
    """`rows` with `name` in place of `text`: its words, joined by one blank, without marked noise and the hesitation sounds of the language.

    Each step is a column of its own, and the branches by language are a lambda: Java leaves methods over 8,000 bytes
    uncompiled, and nested steps are repeated in each branch.
    """
    holds = [F.contains(text, F.lit(m)) for m in MARKS] + [F.contains(text, F.lit(":")) & F.col(text).rlike(r"\d:\d\d:")]
    x = rows.withColumn("_bare", F.when(reduce(operator.or_, holds), F.regexp_replace(text, "(?iu)" + NOTES, " ")).otherwise(F.col(text)))
    x = x.withColumn("_words", F.concat(F.lit(" "), F.trim(F.regexp_replace("_bare", r"[^\p{L}\p{M}\p{Nd}]+", " "))))

    def silent(words: Column) -> Column:
        def sound(x: str) -> Column:
            any_ = HESITATIONS["*"] + x
            heads = "".join(sorted({a[0] for a in any_.split("|")}))  # most words are done with at their first letter
            return F.trim(F.regexp_replace(words, rf"(?iu) (?=[{heads}])(?:{any_})(?= |$)", ""))

        out = None
        for g, h in HESITATIONS.items():
            if g != "*":
                out = F.when(lang == g, sound(f"|{h}")) if out is None else out.when(lang == g, sound(f"|{h}"))
        return out.otherwise(sound(""))

    return x.select(*[c for c in rows.columns if c != text], F.coalesce(F.get(F.transform(F.array("_words"), silent), F.lit(0)), F.lit("")).alias(name))


def read_fields(rows: DataFrame) -> DataFrame:
    """`rows` (text, raw, lang) with `head_ms` (time at the head), `label` (before the words, for rows without `raw`) and `words` in place of `text`."""
    clocked = lambda text, of: F.when(F.contains(text, F.lit(":")), of).otherwise(F.lit(""))  # noqa: E731  # no time or label is without a colon
    x = rows.withColumn("_head", clocked("text", F.regexp_extract("text", "(?U)" + HEAD, 0)))
    x = x.withColumn("_body", _rest(F.col("text"), F.col("_head")))
    x = x.withColumn("_front", F.when(F.col("raw").isNull(), clocked("_body", F.regexp_extract("_body", "(?U)" + LABEL, 0))))
    label = F.when(F.col("_front") != "", F.regexp_extract("_body", "(?U)" + LABEL, 1))
    x = x.withColumn("_label", F.when(F.size(F.split(F.trim(label), r"(?U)\s+")) <= 6, label))
    x = x.withColumn("_is", F.coalesce(names_someone(F.col("_label")), F.lit(False)))
    x = x.withColumn("_body", F.when(F.col("_is"), _rest(F.col("_body"), F.col("_front"))).otherwise(F.col("_body")))
    x = x.withColumn("_second", F.when(F.col("_is") & (F.col("_head") == ""), F.regexp_extract("_body", "(?U)" + HEAD, 0)).otherwise(F.lit("")))
    clock = F.regexp_extract(F.when(F.col("_head") != "", F.col("_head")).otherwise(F.col("_second")), TIME, 0)
    lang = F.lower(F.substring_index(F.coalesce("lang", F.lit("*")), "-", 1))
    keep = [c for c in rows.columns if c not in ("text", "lang")]
    x = x.select(*keep, "lang", lang.alias("_lang"), F.when((F.col("_head") != "") | (F.col("_second") != ""), clock_ms(clock)).alias("head_ms"), F.when(F.col("_is"), F.col("_label")).alias("label"), _rest(F.col("_body"), F.col("_second")).alias("_text"))
    return without_noise(x, "_text", F.col("_lang"), "words").drop("_lang")


def languages(turns: DataFrame, recordings: DataFrame) -> DataFrame:
    """(transcript_id, workspace, lang); a missing lang is the one whose frequent words occur most in the transcript."""
    r = recordings.select("transcript_id", F.col("workspace_id").alias("workspace"), "lang").where("transcript_id IS NOT NULL").dropDuplicates(["transcript_id"])
    blank = r.where("lang IS NULL").select("transcript_id")
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    hits = [F.sum(F.size(F.array_intersect(words, F.array(*map(F.lit, w))))).alias(k) for k, w in STOPWORDS.items()]
    best = join_small(turns.select("transcript_id", "text"), cut(blank), ["transcript_id"], "left_semi").groupBy("transcript_id").agg(*hits)
    top = F.greatest(*STOPWORDS)
    guess = F.when(top > 0, F.coalesce(*[F.when(F.col(k) == top, k) for k in STOPWORDS]))
    return r.join(best.select("transcript_id", guess.alias("_guess")), "transcript_id", "left").select("transcript_id", "workspace", F.coalesce("lang", "_guess").alias("lang"))


def read_turns(turns: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, written table to count them by), see `in_spoken_order`: one row per row of `turns` with words, repeated ones included: transcript_id, turn_index, `at` (spoken time, NULL: none known before it in the file), `start_ms`, `end_ms`, `entity`, `words`.

    `words` are the words without noise, cased as in the text and joined by one space. `entity` is the speaker: labels
    linked by `link_names` in the workspace are one, turns without any label are one unknown speaker.
    """
    t = turns.select("transcript_id", F.col("turn_index").cast("bigint").alias("turn_index"), "text", F.nullif(F.trim("raw_speaker"), F.lit("")).alias("raw"), F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"))
    t = t.where("transcript_id IS NOT NULL AND turn_index IS NOT NULL")
    x = join_small(t, cut(languages(t, recordings)), ["transcript_id"])
    x = read_fields(x.select("transcript_id", "turn_index", "workspace", "raw", "lang", "start_ms", "end_ms", "text"))
    x = written = cut(x.select("transcript_id", "turn_index", F.coalesce("workspace", F.lit("")).alias("workspace"), F.coalesce("raw", "label").alias("shown"), F.coalesce("start_ms", "head_ms").alias("start_ms"), "end_ms", "words"))
    # times, on slim rows: the rows without a time take the last one before them in the file
    slim = x.select("transcript_id", "turn_index", "start_ms", F.floor(F.col("turn_index") / BLOCK).alias("_block"))
    tops = slim.groupBy("transcript_id", "_block").agg(F.max_by("start_ms", F.when(F.col("start_ms").isNotNull(), F.col("turn_index"))).alias("_last"))
    before = Window.partitionBy("transcript_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut(tops.select("transcript_id", "_block", F.last("_last", ignorenulls=True).over(before).alias("_before")).where("_before IS NOT NULL"))
    inside = Window.partitionBy("transcript_id", "_block").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    late = join_small(slim.withColumn("_inside", F.last("start_ms", ignorenulls=True).over(inside)).where("start_ms IS NULL"), tops, ["transcript_id", "_block"])
    late = cut(late.select("transcript_id", "turn_index", F.coalesce("_inside", "_before").alias("_at")).where("_at IS NOT NULL").distinct())
    x = join_small(x, late, ["transcript_id", "turn_index"], limit=500_000)
    x = join_small(x, cut(link_names(x, "workspace", "shown").select("workspace", "shown", "entity")), ["workspace", "shown"])
    x = x.select("transcript_id", "turn_index", F.coalesce("start_ms", "_at").alias("at"), "start_ms", "end_ms", F.coalesce("entity", F.lit("unknown")).alias("entity"), "words")
    return x.where("words <> ''"), written


def clean_turns(turns: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row per clean turn: transcript_id, first_turn_index, last_turn_index, n_turns, from_ms, to_ms, entity, words (lower case).

    Turns whose text is NULL, empty or nothing but noise are dropped; neighbours in spoken order by one speaker are
    joined. Rows without transcript_id or turn_index don't count, repeated ones count once, transcripts that
    `recordings` lacks are read without language and workspace. Ties in time go by turn_index; leading turns without
    time come first. Empty tables give no rows; further columns are ignored.
    """
    out = in_spoken_order(*read_turns(turns, recordings), _islands)
    return out.select("transcript_id", F.col("_first.turn_index").alias("first_turn_index"), F.col("_last.turn_index").alias("last_turn_index"), "n_turns", "from_ms", "to_ms", "entity", F.lower("words").alias("words"))


def _islands(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """One row per island of one speaker."""
    x = blocks.before(rows.withColumn("_me", F.struct("entity", "turn_index")), "_me", "_prev").drop("_me")
    x = x.where(~F.col("turn_index").eqNullSafe(F.col("_prev.turn_index")))  # a repeated row follows its like
    x = blocks.numbered(x, _island=~F.col("entity").eqNullSafe(F.col("_prev.entity")))
    order = F.struct(*ORDER)
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*at, "words"))), lambda r: r["words"]), " ").alias("words")
    out = x.groupBy(*blocks.keys, "_island").agg(
        F.min(order).alias("_first"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("n_turns"), F.min_by("start_ms", order).alias("from_ms"), F.max(F.coalesce("end_ms", "start_ms")).alias("to_ms"), F.first("entity").alias("entity"), joined(ORDER)
    )
    if blocks.several:  # islands that go on in the next block
        out = out.groupBy("transcript_id", "_island").agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("n_turns").alias("n_turns"), F.min_by("from_ms", "_first").alias("from_ms"), F.max("to_ms").alias("to_ms"), F.first("entity").alias("entity"), joined(["_first"])
        )
    return out.select("transcript_id", "_first", "_last", "n_turns", "from_ms", "to_ms", "entity", "words")
