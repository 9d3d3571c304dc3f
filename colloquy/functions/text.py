"""Column helpers for transcript text; JVM expressions except where Spark has no built-in (two Arrow functions)."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words before a colon that name no speaker.
NO_SPEAKER = "note notes warning caution example tip update edit source sources ref reference todo fixme summary action actions e.g i.e http https subject re from to cc date time title topic agenda".split()
#: Caption formatting tags that go after unescaping.
CAPTION_TAGS = "i b u c v em strong ruby rt lang font br".split()
_STAMP = r"^(?:(\d{1,3}):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, also inside lambdas, and out of generated code, which long expressions outgrow."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def part(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match; NULL if nothing matches or the group is empty."""
    return null_if_empty(F.regexp_extract(c, pattern, group))


def parse_timestamp(c: Column) -> Column:
    """Milliseconds of `[h:]m:s[.fff]`, the whole text; minutes and seconds have no upper bound; else NULL."""
    n = lambda k: F.coalesce(part(c, _STAMP, k).cast("bigint"), F.lit(0))
    fraction = F.coalesce(F.rpad(part(c, _STAMP, 4), 3, "0").cast("bigint"), F.lit(0))
    return F.when(c.rlike(_STAMP), (n(1) * 3600 + n(2) * 60 + n(3)) * 1000 + fraction)


def format_timestamp(ms: Column, always_hours: bool = False) -> Column:
    """`H:MM:SS`, or `MM:SS` below an hour; NULL is `--:--`, negative is 0."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, sec = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    long = F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(sec))
    return F.when(ms.isNull(), "--:--").when(F.lit(always_hours) | (h > 0), long).otherwise(F.concat(two(m), F.lit(":"), two(sec)))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities decoded."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


@F.pandas_udf(T.StringType())
def canonical_key(names: pd.Series) -> pd.Series:
    """Name without accents and punctuation, lower case, one blank between words."""

    def key(n: str | None) -> str | None:
        if n is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^\w\s]", " ", plain).lower().split())

    return names.map(key)


def drop_tags(c: Column) -> Column:
    """Real markup and word times, before unescaping."""
    return F.regexp_replace(c, r"</?[a-zA-Z][^>]*>|<\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}>", "")


def strip_tags(c: Column, entities: bool = True) -> Column:
    """Markup dropped, entities decoded, then caption tags that were escaped dropped; other text in angle brackets stays."""
    out = drop_tags(c)
    return F.regexp_replace(unescape(out) if entities else out, rf"(?i)</?(?:{'|'.join(CAPTION_TAGS)})\b[^>]*/?>", "")


def voice_speaker(c: Column) -> Column:
    """Name in the first voice span; NULL if there is none."""
    return null_if_empty(strip(F.regexp_extract(c, r"(?i)<v(?:\.[^\s>]+)*\s+([^>]+?)\s*>", 1)))


def looks_like_speaker(c: Column) -> Column:
    """Whether a text before a colon can be a speaker's label."""
    name = strip(c)
    words = F.split(name, r"(?U)\s+")
    bare = F.regexp_replace(F.lower(name), r"^\.+|\.+$", "")
    return (
        (F.length(name) <= 48)
        & F.size(words).between(1, 6)
        & ~name.rlike(r"(?i)[,;!?]|\bhttps?\b")
        & ~name.endswith(".")
        & name.rlike(r"[\p{L}\p{Nd}]")
        & ~bare.isin(NO_SPEAKER)
        & ((F.size(words) == 1) | F.forall(words, lambda w: w.rlike(r"^[\p{Lu}\p{Nd}_]")))
    )


_INLINE = r"(?s)^\s*([^\s:][^:\n]{0,48}?)\s*:\s+(\S.*)$"


def inline_speaker(c: Column) -> Column:
    """Label before the first colon; NULL if there is none."""
    name = strip(F.regexp_extract(c, _INLINE, 1))
    return F.when(c.rlike(_INLINE) & looks_like_speaker(name), name)


def after_inline_speaker(c: Column) -> Column:
    """The text after the label; the text itself if there is none."""
    return F.when(inline_speaker(c).isNotNull(), F.regexp_extract(c, _INLINE, 2)).otherwise(c)


def unbold(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\*\*(.+?)\*\*", "$1"), r"__(.+?)__", "$1")


def without_rolling(previous: Column, lines: Column) -> Column:
    """`lines` without the longest head that repeats the tail of `previous`."""
    most = F.least(F.size(previous), F.size(lines))
    sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    k = F.coalesce(F.array_max(F.filter(sizes, lambda n: F.slice(previous, -n, n) == F.slice(lines, F.lit(1), n))), F.lit(0))
    return F.when(previous.isNull(), lines).otherwise(F.slice(lines, k + 1, F.greatest(F.size(lines) - k, F.lit(0))))


def strip_role(c: Column) -> Column:
    """Name without a trailing bracket or ` - Company`; unchanged if nothing would be left."""
    return F.coalesce(null_if_empty(strip(F.regexp_replace(c, r"\s*[\(\[\{].*?[\)\]\}]\s*$|\s+[-–—]\s+.*$", ""))), c)


def is_generic_label(c: Column) -> Column:
    return strip(c).rlike(r"(?i)^(speaker|spk|s)[\s_\-]*\d+$")


def ends_open(c: Column) -> Column:
    """The text ends without finishing its sentence."""
    bare = F.regexp_replace(c, "(?U)\\s+$", "")
    bare = F.regexp_replace(bare, "[\"'’”)\\]}」』]+$", "")
    return (bare != "") & ~bare.rlike(r"[.!?…。！？]$")


def starts_lower(c: Column) -> Column:
    """The first letter is small, and no digit comes before it."""
    return F.regexp_extract(c, r"^[^\p{L}\p{Nd}]*([\p{L}\p{Nd}])", 1).rlike(r"\p{Ll}")


def word_count(c: Column) -> Column:
    return F.when(strip(c) == "", 0).otherwise(F.size(F.split(strip(c), r"(?U)\s+")))
