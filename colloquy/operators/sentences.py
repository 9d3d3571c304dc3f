"""Rule-based sentence spans: slices that tile the text exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose period ends no sentence.
ABBREVIATIONS = frozenset(
    """mr mrs ms dr prof sr jr st mt rev hon gen col lt sgt capt cmdr adm gov pres supt rep sen atty asst assoc dept univ
    inc ltd co corp llc plc vs etc eg ie al approx est fig vol no pp ed cf viz ca circa jan feb mar apr jun jul aug sep
    sept oct nov dec mon tue tues wed thu thur thurs fri sat sun am pm ph phd md ba ma bsc msc llb u.s u.k u.n e.g i.e
    a.m p.m""".split()
)
CLOSERS = "\"'’”)]}」』"
OPENERS = "\"'“‘([{「『"
#: Ends for certain: a mark other than a period, or several marks, before a blank; an ideographic mark even without one.
_SURE = re.compile(rf"(?:[.!?…。！？]{{2,}}|[!?…])[{re.escape(CLOSERS)}]*\s+|[.!?…]*[。！？][.!?…。！？]*[{re.escape(CLOSERS)}]*\s*")
#: A period that stands alone before a blank, with the letters and periods it is written together with.
_PERIOD = re.compile(rf"(?<![A-Za-z.])([A-Za-z.]*)(?<![.!?…。！？])\.(?![.!?…。！？])[{re.escape(CLOSERS)}]*\s+")


def uncapitalised(text: str) -> bool:
    """At least 40 letters in the first 20,000 characters, and under one per cent of them capital."""
    head = text[:20_000]
    letters = sum(map(str.isalpha, head))
    return letters >= 40 and sum(map(str.isupper, head)) < 0.01 * letters


def _begins(c: str) -> bool:
    """Whether a sentence may begin with this character: a capital, a digit, an opening mark, or a letter without case."""
    return c in OPENERS or c.isdigit() or (c.isalpha() and (c.isupper() or c.upper() == c.lower()))


def split_text(text: str) -> list[str]:
    """Sentences of `text`; joined they are the text again. Each boundary is decided by what stands around it alone."""
    unsure = {m.end() for m in _PERIOD.finditer(text) if len(w := m[1].lstrip(".").lower()) != 1 and w not in ABBREVIATIONS and m.end() < len(text)}
    low = {e for e in unsure if not _begins(text[e])}
    if low and not uncapitalised(text):
        unsure -= low
    cuts = sorted({0, len(text)} | unsure | {m.end() for m in _SURE.finditer(text)})
    return [text[x:y] for x, y in pairwise(cuts)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentences per text; NULL stays NULL, an empty text has none."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else split_text(t))


def uncapitalised_flag(c: Column) -> Column:
    head = F.substring(c, 1, 20_000)
    letters = F.length(F.regexp_replace(head, r"[^\p{L}]", ""))
    return (letters >= 40) & (F.length(F.regexp_replace(head, r"[^\p{Lu}]", "")) < letters * 0.01)


def candidates(c: Column) -> Column:
    """Segments up to each possible boundary, JVM only: the first step, without the tests."""
    marked = F.regexp_replace(c, "([.!?…。！？]+[\"'’”)\\]}」』]*[ \\t\\n\\r\\f\\x0B]*)", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")
