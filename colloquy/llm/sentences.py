"""Sentence boundaries across languages and scripts.

Per language, abbreviations, collocations and sentence starters are learned from all texts without labels by
log-likelihood ratios; each period is then classified with these statistics. Other marks and scripts follow fixed
rules: ideographic marks, the danda, and spaces between Thai clauses end sentences, marks inside quotations don't.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.noise import HESITATIONS, NOTES, is_sound
from colloquy.llm.turns import languages
from colloquy.session import cut, join_small

#: Scaled log-likelihood from which a type with a period is an abbreviation, and plain ratios for the other two.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: An abbreviation stands before small letters, digits or marks in at least this share of its uses, or hardly ever ends a text.
OPEN_SHARE, END_SHARE = 0.05, 0.2
#: A word stands for "number" if at least this share of its periods is followed by digits.
NUMBER_SHARE = 0.3
#: The model is sent to every worker; more entries than this is an error, not a cut.
MODEL_LIMIT = 1_000_000
_CLOSE = "\"'’”»›)]}」』）】〉》"
_QUOTES = "\"'’”“»›」』"
_END = re.compile(rf"(?:\.{{2,}}|[.!?…。！？．؟।॥۔]+)(?:[ \u00a0\u202f]?[»›]|[{re.escape(_CLOSE)}])*")
_PERIOD = regex.compile(r"(?<![\w.])((?:\p{L}[\p{L}\p{M}]*\.)*\p{L}[\p{L}\p{M}]*|\d[\d.,]*)\.(?!\w)(?!\.)")
_TOKEN = regex.compile(r"(?:\p{L}[\p{L}\p{M}]*\.)*\p{L}[\p{L}\p{M}]*|\d[\d.,]*\d|\d")
_SOUNDS = {g: regex.compile(rf"(?:{HESITATIONS['*']}" + (f"|{x})" if g != "*" else ")"), regex.I) for g, x in HESITATIONS.items()}
_NEXTS = {g: regex.compile(rf"(?:\s+|{NOTES}|{x.pattern}(?![\w'’])[,.…-]*)*[\s\"'“”„«»¿¡(\[「『‘]*", regex.I) for g, x in _SOUNDS.items()}
_THAI_GAP = regex.compile(r"(?<=[฀-๿\d%])\s+(?=[฀-๿])")
_SURE = re.compile(r"[!?]+(?=\s)")
NUMBER = "##"


_FAST_PERIOD = re.compile(r"(?<![\w.])((?:[^\W\d_]+\.)*[^\W\d_]+|\d[\d.,]*)\.(?!\w)(?!\.)")
_FAST_TOKEN = re.compile(r"(?:[^\W\d_]+\.)*[^\W\d_]+|\d[\d.,]*\d|\d")
_FAST_WORD = re.compile(r"[^\W_]+")


def _type(word: str) -> str:
    return NUMBER if word[0].isdigit() else word.lower()


def _simple(text: str) -> bool:
    """Latin, Greek or Cyrillic letters without combining marks: the faster patterns hold."""
    return text.isascii() or max(text) < "\u0300" or not any("\u0300" <= c < "\u0370" or "\u0530" <= c < "\u2000" or c >= "\u2c00" for c in text)


def _follow(text: str, at: int, lang: str) -> tuple[str, str]:
    """What comes after position `at` and any noise: kind (end, upper, lower, digit, mark, other) and the next word's type."""
    i, n = at, len(text)
    while i < n and text[i].isspace():
        i += 1
    if i < n and (not text[i].isalnum() or ((w := _FAST_WORD.match(text, i)) and is_sound(w[0], lang))):
        i = _NEXTS.get(lang, _NEXTS["*"]).match(text, at).end()
    if i >= n:
        return "end", ""
    c = text[i]
    w = (_FAST_TOKEN if c < "\u0300" else _TOKEN).match(text, i)
    word = _type(w[0]) if w else ""
    if c.isdigit():
        return "digit", word
    if not c.isalpha():
        return "mark", word
    return ("upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "other"), word


def _word_before(text: str, end: int) -> str:
    """The dotted word or number right before a position; empty if there is none."""
    i = end
    while i and ((c := text[i - 1]).isalnum() or c in ".," or (c >= "\u0300" and unicodedata.category(c)[0] == "M")):
        i -= 1
    word = text[i:end].lstrip(".,")
    return word if not word or word[0].isdigit() else word.rpartition(",")[2].lstrip(".")


def count(texts: Iterator[tuple[str, str]]) -> Counter:
    """Counts by (lang, kind, a, b) over cased texts: types, types with period, what follows them, and words after sure ends."""
    out: Counter = Counter()
    tokens: dict[str, Counter] = {}
    for lang, text in texts:
        simple = _simple(text)
        tokens.setdefault(lang, Counter()).update((_FAST_TOKEN if simple else _TOKEN).findall(text.lower()))
        cased = not text.islower()
        if "." in text:
            for m in (_FAST_PERIOD if simple else _PERIOD).finditer(text):
                w = _type(m[1])
                kind, nxt = _follow(text, m.end(), lang)
                out[lang, "with", w, ""] += 1
                if cased:
                    out[lang, "dot", w, kind] += 1
                    if nxt:
                        out[lang, "pair_" + kind, w, nxt] += 1
                if kind == "upper" and nxt and len(w) > 4 and "." not in w:
                    out[lang, "start", nxt, ""] += 1
        if cased and ("!" in text or "?" in text):
            for m in _SURE.finditer(text):
                kind, nxt = _follow(text, m.end(), lang)
                if kind == "upper" and nxt:
                    out[lang, "start", nxt, ""] += 1
    for lang, c in tokens.items():
        for w, n in c.items():
            out[lang, "all", _type(w), ""] += n
    return out


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.ln(q) + (n - k) * F.ln(1 - q)


def _ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's ratio for `b` more often after `a` than elsewhere; 0 if it is less often."""
    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    ll = -2 * (_log_likelihood(both, a, p) + _log_likelihood(b - both, n - a, p) - _log_likelihood(both, a, p1) - _log_likelihood(b - both, n - a, p2))
    return F.when(p1 > p, ll).otherwise(0.0)


def learn(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The model: rows (lang, kind, a, b) with kind 'abbreviation' (b 'title': never followed by a new sentence), 'inside' (a pair within a sentence), 'starter'.

    Statistics cover all rows; rows with NULL text don't count, a NULL language is a language of its own.
    """
    schema = "lang string, kind string, a string, b string, n bigint"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = count(zip(batch["lang"], batch["text"]))
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["lang", "kind", "a", "b", "n"])

    x = texts.select(F.coalesce(F.substring_index(F.lower(F.col(lang)), "-", 1), F.lit("")).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    s = cut(x.mapInPandas(part, schema).groupBy("lang", "kind", "a", "b").agg(F.sum("n").cast("double").alias("n")))
    of = lambda kind: s.where(F.col("kind") == kind)
    totals = of("all").groupBy("lang").agg(F.sum("n").alias("total")).join(of("with").groupBy("lang").agg(F.sum("n").alias("periods")), "lang")
    types = of("with").select("lang", "a", F.col("n").alias("cp")).join(of("all").select("lang", "a", F.col("n").alias("ct")), ["lang", "a"]).withColumn("ct", F.greatest("ct", "cp")).join(F.broadcast(totals), "lang")
    letters, dots = F.length(F.replace("a", F.lit("."), F.lit(""))), F.length("a") - F.length(F.replace("a", F.lit("."), F.lit("")))
    null, alt = _log_likelihood(F.col("cp"), F.col("ct"), F.col("periods") / F.col("total")), _log_likelihood(F.col("cp"), F.col("ct"), F.lit(0.99))
    score = 2 * (alt - null) * F.exp(-letters) * (dots + 1) * F.pow(F.greatest(letters, F.lit(1)), -(F.col("ct") - F.col("cp")))
    follow = of("dot").groupBy("lang", "a").agg(F.sum("n").alias("dots"), *[F.sum(F.when(F.col("b") == k, F.col("n")).otherwise(0.0)).alias(k) for k in ("end", "lower", "digit", "mark", "other")])
    ends = follow.groupBy("lang").agg((F.sum("end") / F.sum("dots")).alias("usual_end"))
    f = types.join(follow, ["lang", "a"]).join(F.broadcast(ends), "lang").withColumn("open", (F.col("lower") + F.col("digit") + F.col("mark")) / F.col("dots")).withColumn("shut", F.col("end") / F.col("dots"))
    rarely_last = F.col("shut") < END_SHARE * F.col("usual_end")
    # a type that ends sentences as often as others do is a common last word, however rarely it lacks the period; inner periods speak for themselves
    abbreviation = (score >= ABBREVIATION) & (rarely_last | (F.col("open") >= OPEN_SHARE) | (dots > 0))
    before_number = (F.col("digit") >= NUMBER_SHARE * F.col("dots")) & (F.col("digit") >= 2)
    f = f.where((F.col("a") != NUMBER) & (abbreviation | before_number))
    some = F.when(~abbreviation, "number").when(rarely_last & (F.col("lower") < OPEN_SHARE * F.col("dots")), "title").otherwise("both")
    abbreviations = f.select("lang", F.lit("abbreviation").alias("kind"), "a", some.alias("b"))
    known = abbreviations.select("lang", "a").union(totals.select("lang", F.lit(NUMBER)))
    pairs = s.where(F.col("kind").isin("pair_lower", "pair_upper", "pair_other")).groupBy("lang", "a", "b").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("kind") == "pair_lower", F.col("n"))).alias("low"), F.sum(F.when(F.col("kind") == "pair_upper", F.col("n"))).alias("up")).join(known, ["lang", "a"], "left_semi")
    pairs = pairs.join(types.select("lang", "a", "cp"), ["lang", "a"]).join(of("all").select("lang", F.col("a").alias("b"), F.col("n").alias("nb")), ["lang", "b"]).join(F.broadcast(totals), "lang")
    starts = of("start").select("lang", "a", F.col("n").alias("ns")).join(of("all").select("lang", "a", F.col("n").alias("na")), ["lang", "a"]).join(F.broadcast(of("start").groupBy("lang").agg(F.sum("n").alias("breaks"))), "lang").join(F.broadcast(totals), "lang")
    starters = starts.where(_ratio(F.col("ns"), F.col("breaks"), F.greatest("na", "ns"), F.col("total")) >= STARTER).select("lang", F.lit("starter").alias("kind"), "a", F.lit("").alias("b"))
    tied = _ratio(F.col("both"), F.col("cp"), F.greatest("nb", "both"), F.col("total")) >= COLLOCATION
    cased = F.coalesce("up", F.lit(0.0)) > 0
    # a pair is asked for only where the second word is capital after this one, or a starter: others would make the model grow with the vocabulary
    opening = starters.select("lang", F.col("a").alias("b"), F.lit(True).alias("_starter"))
    inside = pairs.join(opening, ["lang", "b"], "left").where((F.col("low").isNotNull() & (cased | F.col("_starter"))) | (tied & cased & (F.col("a") == NUMBER)))
    begins = starters.select("lang", F.col("a").alias("b"), F.lit(NUMBER).alias("a"))
    inside = inside.join(begins, ["lang", "a", "b"], "left_anti")  # after a number, a usual first word begins a sentence
    inside = inside.select("lang", F.lit("inside").alias("kind"), "a", "b")
    return cut(abbreviations.unionByName(inside).unionByName(starters))


class Model:
    """The learned rows as look-up tables, for one worker."""

    def __init__(self, rows: list[tuple[str, str, str, str]]):
        self.abbreviations = {(g, a): b for g, k, a, b in rows if k == "abbreviation"}
        self.inside = {(g, a, b) for g, k, a, b in rows if k == "inside"}
        self.starters = {(g, a) for g, k, a, b in rows if k == "starter"}

    def ends(self, text: str, lang: str) -> list[int]:
        """Positions after the last character of each sentence."""
        out, last = [], len(text.rstrip())
        if not last:
            return out
        cased = text.lower() != text
        thai = [] if text.isascii() else [m.start() for m in _THAI_GAP.finditer(text)]
        for m in _END.finditer(text):
            at = m.end()
            if '"' in m[0] and text.count('"', 0, m.start()) % 2 == 0:  # this quotation mark opens the next sentence
                at = m.start() + m[0].index('"')
            elif at < len(text) and text[at] == "“" and text.count("„", 0, at) > text.count("“", 0, at):
                at += 1
            if at >= last:
                break
            if self._is_end(text, lang, text[m.start() : at], m.start(), at, cased):
                out.append(at)
        return sorted({*out, *thai, last})

    def _is_end(self, text: str, lang: str, mark: str, begin: int, at: int, cased: bool) -> bool:
        closers = [c for c in mark if c in _CLOSE or c == "“"]
        quoted = any(c in _QUOTES for c in closers)
        ideographic = mark[0] in "。！？．"
        if ideographic:
            return not (quoted or text[at] in "、，,とって") if quoted or closers else True
        glued = not text[at].isspace() and mark[0] not in "।॥۔؟"
        caseless = text[at].isalpha() and text[at].lower() == text[at].upper()
        if glued and not (text[at].isupper() or text[at] in "¿¡«„" or (mark[0] in "!?" and (caseless or text[at] == '"'))):
            return False
        kind, nxt = _follow(text, at, lang)
        if quoted:
            return kind == "upper" or (kind == "digit" and cased)
        if mark[0] in "।॥۔؟":
            return True
        if kind == "mark" and text[at:].lstrip()[:1] in ",;:-–—":
            return False
        word = _word_before(text, begin)
        start = (lang, nxt) in self.starters
        if glued and mark[0] == "." and (len(word) < 2 or "." in word or (lang, _type(word)) in self.abbreviations):
            return False
        if mark.startswith(("..", "…")):
            return not (word and is_sound(word, lang)) and (kind == "upper" or (kind == "mark" and cased))
        if mark[0] in "!?":
            return kind != "lower" or not cased or start
        if not word:
            return kind != "lower" or not cased
        t = _type(word)
        if t == NUMBER:
            if "." in word or "," in word:
                return kind != "lower" or not cased or start
            return (lang, NUMBER, nxt) not in self.inside and (kind != "lower" or not cased or start)
        if len(word) == 1 and (word.isupper() or not word.isascii() or (lang, t) in self.abbreviations or not cased):
            return False
        how = self.abbreviations.get((lang, t))
        if how is None:
            return True
        if kind == "digit":
            return False
        if how == "number":
            return True
        if how == "title":
            return False
        if (lang, t, nxt) in self.inside:
            return kind == "upper" and start
        return kind == "mark" or (kind == "upper") or (not cased and start) or (kind == "other" and start)


def sentence_ends(texts: DataFrame, model: DataFrame, keys: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """(keys, end_pos) for each sentence of each row; NULL, empty and blank texts have none; the end of a text ends a sentence."""
    n = model.count()
    if n > MODEL_LIMIT:
        raise ValueError(f"the sentence model has {n} entries, more than {MODEL_LIMIT}")
    learned = Model([tuple(r) for r in model.select("lang", "kind", "a", "b").toLocalIterator()])
    shared = texts.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ends(t: pd.Series, g: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.ends(a, b) if a else [] for a, b in zip(t, g)])

    return texts.select(*keys, F.explode(ends(F.col(text), F.coalesce(F.substring_index(F.lower(F.col(lang)), "-", 1), F.lit("")))).alias("end_pos"))


def turn_sentences(turns: DataFrame, recordings: DataFrame) -> DataFrame:
    """(transcript_id, turn_index, end_pos) for the turns of recordings whose src_format begins with 'json:'; learned from all turns."""
    t = turns.select("transcript_id", F.col("turn_index").cast("bigint").alias("turn_index"), "text").where("transcript_id IS NOT NULL AND turn_index IS NOT NULL")
    t = t.dropDuplicates(["transcript_id", "turn_index"])
    r = recordings.select("transcript_id", "src_format").where("transcript_id IS NOT NULL").dropDuplicates(["transcript_id"])
    r = cut(r.join(languages(turns, recordings).select("transcript_id", "lang"), "transcript_id"))
    x = cut(join_small(t, r, ["transcript_id"]))
    return sentence_ends(x.where("src_format LIKE 'json:%'"), learn(x), ["transcript_id", "turn_index"])
