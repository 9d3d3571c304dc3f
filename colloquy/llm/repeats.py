"""Repeated consecutive events: runs of one speaker saying the same, collapsed into one event.

Only boundaries are kept: turns that say something else than their predecessor in spoken order. The lead over these gives
each run its end: differences of positions are the counts, and the last time known before the next boundary ends the
duration. Near-identical turns may all differ from the first in another spot, so that neighbours differ in two: a run
that says the same as the first turn of the repeated run it follows joins it, by a second pass over the boundaries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.spoken import Blocks, in_spoken_order
from colloquy.llm.turns import read_turns
from colloquy.session import cut

#: Words of a reworded spot on either side at most, and unchanged words at least.
SPOT, UNCHANGED = 3, 4
#: Words after which a noun names a thing.
DETERMINERS = frozenset("the a an my your his her our their this that these those el la los las un una le les l une des du der die das den dem ein eine einen".split())
#: Words that may follow such a noun.
FUNCTION = frozenset("and or of in on at to for with by from is are was were be not no that which who before after than rose fell will would has have had y o de en con por es son und oder von in mit für ist sind et ou dans avec pour est sont".split())


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether `most` or fewer letters must be added, left out, changed or swapped with a neighbour."""
    if abs(len(a) - len(b)) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        before = last
    return row[-1] <= most


@lru_cache(maxsize=200_000)
def slip(a: str, b: str) -> bool:
    """The same word but for slips of spelling: numbers and words of scripts without spaces must be equal."""
    if a == b:
        return True
    if any(c.isdigit() or ord(c) >= 0x0900 for c in a + b):
        return False
    n = min(len(a), len(b))
    most = 2 if n >= 5 else 1 if n >= 3 else 0
    return len(set(a) ^ set(b)) <= 2 * most and distance_within(a, b, most)  # a changed letter takes one out and brings one in


@lru_cache(maxsize=100_000)
def same_statement(a: str, b: str) -> bool:
    """Two cased word strings say the same: equal but for case, slips, and one reworded spot that holds no number, name or thing."""
    x, y = a.lower().split(" "), b.lower().split(" ")
    if x == y:
        return True
    if abs(len(x) - len(y)) >= SPOT:
        return False
    n = min(len(x), len(y))
    i = next((k for k in range(n) if not slip(x[k], y[k])), n)
    if i == len(x) == len(y):
        return True
    j = next((k for k in range(n - i) if not slip(x[-1 - k], y[-1 - k])), n - i)
    left, right = x[i : len(x) - j], y[i : len(y) - j]
    if not left or not right or max(len(left), len(right)) > SPOT or i + j < UNCHANGED:
        return False
    cased = a.split(" ")[i : len(x) - j] + b.split(" ")[i : len(y) - j]
    if any(c.isdigit() or ord(c) >= 0x0900 for w in cased for c in w) or (i and any(w[:1].isupper() for w in cased)):
        return False
    after = x[len(x) - j] if j else ""
    return not (i and x[i - 1] in DETERMINERS and (not after or after in FUNCTION))


@F.pandas_udf(T.BooleanType())
def _same_statement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and same_statement(x, y) for x, y in zip(a, b)], dtype=bool)


def _may_be_the_same(a: Column, b: Column) -> Column:
    """What two texts must fulfil for `same_statement`: about as many words, and the first two or the last two within its reach (of four unchanged words around one spot, two stand on one side)."""
    x, y = F.lower(a), F.lower(b)
    blanks = lambda v: F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit("")))

    def near(of: Callable[[Column], Column]) -> Column:  # two slips are four single-letter edits at most, one is two
        v, w = of(x), of(y)
        n = F.least(F.length(v), F.length(w))
        return F.levenshtein(v, w, 4).between(0, F.when(n >= 5, 4).when(n >= 3, 2).otherwise(0))

    def ends(k: int) -> Column:  # a text of one word has it in both places
        return near(lambda v: F.substring_index(v, " ", k)) & near(lambda v: F.substring_index(F.substring_index(v, " ", 2 * k), " ", -k))

    return (F.abs(blanks(x) - blanks(y)) < SPOT) & (ends(1) | ends(-1))


def _says_the_same(a: Column, b: Column, asked: Column) -> Column:
    """`same_statement` where `asked`; Python sees different texts alone."""
    open_ = asked & (F.lower(a) != F.lower(b))
    return asked & ((F.lower(a) == F.lower(b)) | _same_statement(F.when(open_, a), F.when(open_, b)))


def repeated_events(turns: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row per maximal run of two or more turns: transcript_id, first_turn_index, last_turn_index, n_turns, start_ms, duration_ms, words.

    A turn goes on with the run if it says the same as the turn before. A run that follows a repeated one of the same
    speaker joins it if its first turn says the same as that one's first. Turns of nothing but noise are passed over.
    `duration_ms` runs from the start of the first turn to the last time known by the end of the run, NULL where the
    first start is unknown. For NULLs, repeated rows, ties, empty tables and further columns see `clean_turns`.
    """
    return in_spoken_order(*read_turns(turns, recordings), _events)


def _events(rows: DataFrame, blocks: Blocks) -> DataFrame:
    time = F.coalesce("end_ms", "start_ms")
    x = blocks.along(rows, written=True, known_ms=("by", time), _known=("before", time), **{f"_prev_{c}": ("previous", F.col(c)) for c in ("turn_index", "entity", "words")})
    x = x.where(~F.col("turn_index").eqNullSafe(F.col("_prev_turn_index")))  # a repeated row follows its like
    x = x.withColumn("_one", F.coalesce(F.col("_prev_entity") == F.col("entity"), F.lit(False)))
    x = x.withColumn("_may", F.col("_one") & _may_be_the_same(F.col("_prev_words"), F.col("words")))
    x = x.select(*blocks.keys, "at", "turn_index", "start_ms", "known_ms", "words", "_one", "_may", F.struct(F.col("_prev_turn_index").alias("turn_index"), F.col("_known").alias("known_ms")).alias("_before"), F.when(F.col("_may"), F.col("_prev_words")).alias("_said"))
    # a turn that can't say the same as the one before, nor the next as it, bounds no repeated run unless it follows one that may, or any that may in its stretch of one speaker
    led = F.when(F.col("_may"), True).when(~F.col("_one"), False)
    x = blocks.along(x, pos=("count", F.lit(True)), _stretch=("count", ~F.col("_one")), _ahead=("next", F.col("_may")), _behind=("previous", F.col("_may")), _led=("by", led), _n=("total", F.lit(True)), _end=("last", F.struct("turn_index", "known_ms")))
    goes_on, led = F.coalesce("_ahead", F.lit(False)), F.coalesce("_led", F.lit(False))
    x = x.where(led | goes_on | F.coalesce("_behind", F.lit(False)))
    # boundaries only, and the lead over them
    bounds = x.where(~_says_the_same(F.col("_said"), F.col("words"), F.col("_may")))
    bounds = bounds.select(*blocks.keys, "at", "turn_index", "pos", "_stretch", "start_ms", "known_ms", "_n", "_end", goes_on.alias("_goes_on"), F.when(led | goes_on, F.col("words")).alias("words"), "_before")
    bounds = blocks.along(bounds, _next=("next", F.struct("pos", "_before.turn_index", "_before.known_ms"))).drop("_before")
    next_ = F.coalesce("_next", F.struct((F.col("_n") + 1).alias("pos"), "_end.turn_index", "_end.known_ms"))
    runs = bounds.withColumn("_next", next_).withColumn("n", F.when(F.col("_goes_on"), F.col("_next.pos") - F.col("pos")).otherwise(1))
    # runs that say the same as the first turn of the repeated run before them
    runs = blocks.along(runs, _lead=("before", F.when(F.col("n") >= 2, F.struct("pos", "words", "_stretch"))))
    asked = F.coalesce((F.col("_lead._stretch") == F.col("_stretch")) & _may_be_the_same(F.col("_lead.words"), F.col("words")), F.lit(False))
    runs = runs.withColumn("_like", _says_the_same(F.col("_lead.words"), F.col("words"), asked)).where("_like OR n >= 2")
    runs = cut(runs.select(*blocks.keys, "at", "turn_index", "pos", "n", "start_ms", F.when(F.col("n") > 1, F.col("_next.turn_index")).otherwise(F.col("turn_index")).alias("last_turn_index"), F.when(F.col("n") > 1, F.col("_next.known_ms")).otherwise(F.col("known_ms")).alias("known_ms"), "words", "_like", F.col("_lead.pos").alias("_lead_pos")))
    # they join it if no other run lies between
    runs = blocks.along(runs, written=True, _prev_end=("previous", F.col("pos") + F.col("n")))
    runs = blocks.along(runs, _since=("by", F.when(~F.col("pos").eqNullSafe(F.col("_prev_end")), F.col("pos"))))
    runs = blocks.numbered(runs, _event=~F.coalesce(F.col("_like") & (F.col("_lead_pos") >= F.col("_since")), F.lit(False)))
    first = lambda c: F.min_by(c, "pos").alias(c)
    events = runs.groupBy("transcript_id", "_event").agg(first("turn_index"), F.max_by("last_turn_index", "pos").alias("last_turn_index"), F.sum("n").alias("n_turns"), first("start_ms"), F.max_by("known_ms", "pos").alias("known_ms"), first("words")).where("n_turns >= 2")
    return events.select("transcript_id", F.col("turn_index").alias("first_turn_index"), "last_turn_index", "n_turns", "start_ms", F.greatest(F.col("known_ms") - F.col("start_ms"), F.when(F.col("start_ms").isNotNull(), 0)).alias("duration_ms"), "words")
