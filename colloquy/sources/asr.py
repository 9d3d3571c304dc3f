"""Speech-to-text JSON of ten vendors into cues, in JVM expressions over raw JSON text.

Each vendor's texts become an array of the same struct by a projection of their own. Word-level vendors are grouped into
turns by windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import let, strip
from colloquy.operators.turns import group_words
from colloquy.session import cut
from colloquy.sources.detect import detect_vendor, finite_json, unblank

#: Names that fields go by in unknown JSON, first come first served.
TEXT_KEYS = "text transcript value content".split()
SPEAKER_KEYS = "speaker speaker_label speakerId spk".split()
START_KEYS = "start start_ms startTime ts begin".split()
END_KEYS = "end end_ms endTime end_ts stop".split()


def _get(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def _list(c: Column) -> Column:
    return F.coalesce(let(c, lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))), F.array().cast("array<string>"))


def _finite(c: Column) -> Column:
    read = let(c, lambda c: F.coalesce(c.try_cast("double"), strip(c).try_cast("double")))  # most need no stripping
    return let(read, lambda n: F.when(~F.isnan(n) & (F.abs(n) < 9e15), n))


def seconds_ms(c: Column) -> Column:
    """Seconds as milliseconds, rounded half to even; NULL if it is no finite number."""
    return F.rint(_finite(c) * 1000).cast("bigint")


def plain_ms(c: Column) -> Column:
    return F.rint(_finite(c)).cast("bigint")


def google_ms(c: Column) -> Column:
    """`1.500s`, bare seconds, or {seconds, nanos}."""
    proto = F.rint(F.coalesce(_finite(_get(c, "seconds")), F.lit(0.0)) * 1000 + F.coalesce(_finite(_get(c, "nanos")), F.lit(0.0)) / 1e6).cast("bigint")
    return F.when(F.ltrim(c).startswith("{"), proto).otherwise(seconds_ms(F.regexp_replace(strip(c), "s$", "")))


def speaker_label(c: Column) -> Column:
    """Whole numbers become SPEAKER_00 labels; blank and boolean ones NULL."""
    number = lambda n: F.concat(F.lit("SPEAKER_"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))
    return let(strip(c), lambda t: F.when(t.rlike(r"^\d+$"), number(F.regexp_replace(t, r"^0+(?=\d)", ""))).when((t != "") & ~t.isin("true", "false"), t))


def _cue(text: Column, speaker: Column, start: Column, end: Column, punct: Column | None = None) -> Column:
    bare = let(text, lambda t: F.when(t.rlike(r"(?s)\A[!-~](?:.*[!-~])?\z"), t).otherwise(strip(t)))  # most have no white space around
    return F.struct(bare.alias("text"), speaker_label(speaker).alias("speaker"), start.alias("start_ms"), end.alias("end_ms"), (F.lit(False) if punct is None else F.coalesce(punct, F.lit(False))).alias("is_punct"))


def _first(c: Column, path: str) -> Column:
    return F.get(_list(_get(c, path)), F.lit(0))


def _some(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _cues(t: Column) -> dict[str, Column]:
    whisper = F.transform(_list(_get(t, "segments")), lambda s: _cue(_get(s, "text"), _get(s, "speaker"), seconds_ms(_get(s, "start")), seconds_ms(_get(s, "end"))))
    assembly = F.transform(_list(_get(t, "utterances")), lambda s: _cue(_get(s, "text"), _get(s, "speaker"), plain_ms(_get(s, "start")), plain_ms(_get(s, "end"))))
    utterances = F.transform(_list(_get(t, "results.utterances")), lambda s: _cue(_get(s, "transcript"), _get(s, "speaker"), seconds_ms(_get(s, "start")), seconds_ms(_get(s, "end"))))

    def paragraph(p: Column) -> Column:
        sentences = _list(_get(p, "sentences"))
        time = lambda key, at: F.coalesce(F.nullif(seconds_ms(_get(p, key)), F.lit(0)), seconds_ms(_get(F.element_at(sentences, at), key)))
        some = F.size(sentences) > 0
        return F.when(some, _cue(F.array_join(F.transform(sentences, lambda s: strip(_get(s, "text"))), " "), _get(p, "speaker"), time("start", 1), time("end", -1)))

    best = _first(F.get(_list(_get(t, "results.channels")), F.lit(0)), "alternatives")
    paragraphs = F.filter(F.transform(_list(_get(best, "paragraphs.paragraphs")), paragraph), lambda c: c.isNotNull())

    def monologue(m: Column) -> Column:
        elements = _list(_get(m, "elements"))
        timed = F.filter(elements, lambda e: _get(e, "ts").isNotNull())
        ends = lambda at, key: F.when(F.size(timed) > 0, seconds_ms(_get(F.element_at(timed, at), key)))
        return _cue(F.array_join(F.transform(elements, lambda e: F.coalesce(_get(e, "value"), F.lit(""))), ""), _get(m, "speaker"), ends(1, "ts"), ends(-1, "end_ts"))

    def phrase(p: Column) -> Column:
        ticks = lambda c: F.rint(c / 10_000).cast("bigint")
        begin, long = _finite(_get(p, "offsetInTicks")), F.coalesce(_finite(_get(p, "durationInTicks")), F.lit(0.0))
        n = _first(p, "nBest")
        return _cue(_some(_get(n, "display"), _get(n, "lexical")), _get(p, "speaker"), ticks(begin), ticks(begin + long))

    items = F.coalesce(*[F.nullif(_list(x), F.array().cast("array<string>")) for x in (F.when(t.startswith("["), t), *[_get(t, k) for k in ("turns", "transcript", "items", "entries", "utterances")])], F.array().cast("array<string>"))
    pick = lambda d, keys: _some(*[_get(d, k) for k in keys])

    def guess(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda d: _finite(pick(d, START_KEYS))), lambda n: n.isNotNull())
        whole = let(starts, lambda n: (F.array_max(n) > 10_000) & F.forall(n, lambda x: x == F.floor(x)))
        unit = lambda c, ms: F.when(ms, plain_ms(c)).otherwise(seconds_ms(c))
        return let(F.coalesce(whole, F.lit(False)), lambda ms: F.transform(all_, lambda d: _cue(pick(d, TEXT_KEYS), pick(d, SPEAKER_KEYS), unit(pick(d, START_KEYS), ms), unit(pick(d, END_KEYS), ms))))

    generic = let(items, guess)
    return {
        "whisper": whisper, "assemblyai": assembly, "deepgram": F.when(F.size(utterances) > 0, utterances).otherwise(paragraphs), "rev": F.transform(_list(_get(t, "monologues")), monologue),
        "azure": F.transform(_list(_get(t, "recognizedPhrases")), phrase), "generic_list": generic, "generic_dict": generic,
    }


def _words(t: Column) -> dict[str, Column]:
    word = lambda key, *text: lambda w: _cue(_some(*[_get(w, k) for k in text]), _get(w, "speaker"), key(_get(w, "start")), key(_get(w, "end")))
    deep = _list(_get(_first(F.get(_list(_get(t, "results.channels")), F.lit(0)), "alternatives"), "words"))
    segments = F.transform(_list(_get(t, "results.speaker_labels.segments")), lambda s: F.struct(seconds_ms(_get(s, "start_time")).alias("lo"), seconds_ms(_get(s, "end_time")).alias("hi"), _get(s, "speaker_label").alias("who")))

    def aws(i: Column, known: Column) -> Column:
        def cue(w: Column) -> Column:
            at = seconds_ms(w["start_time"])
            inside = let(at, lambda ms: F.get(F.filter(known, lambda s: (s["lo"] <= ms) & (ms <= s["hi"])), F.lit(0))["who"])
            return _cue(F.get_json_object(w["alternatives"], "$[0].content"), _some(w["speaker_label"], inside), at, seconds_ms(w["end_time"]), w["type"] == "punctuation")

        return let(F.from_json(i, "type string, start_time string, end_time string, speaker_label string, alternatives string"), cue)  # each item is read once

    best = lambda r: _first(r, "alternatives")
    spoken = F.try_element_at(F.filter(F.transform(_list(_get(t, "results")), lambda r: _list(_get(best(r), "words"))), lambda a: F.size(a) > 0), F.lit(-1))
    google = lambda w: _cue(_get(w, "word"), _some(F.nullif(_get(w, "speakerTag"), F.lit("0")), F.nullif(_get(w, "speaker_tag"), F.lit("0"))), google_ms(_some(_get(w, "startTime"), _get(w, "start_time"))), google_ms(_some(_get(w, "endTime"), _get(w, "end_time"))))
    speech = lambda i: _cue(_get(_first(i, "alternatives"), "content"), _get(_first(i, "alternatives"), "speaker"), seconds_ms(_get(i, "start_time")), seconds_ms(_get(i, "end_time")), _get(i, "type") == "punctuation")
    return {
        "assemblyai": F.transform(_list(_get(t, "words")), word(plain_ms, "text")), "deepgram": F.transform(deep, word(seconds_ms, "punctuated_word", "word")),
        "speechmatics": F.transform(_list(_get(t, "results")), speech), "aws": let(segments, lambda known: F.transform(_list(_get(t, "results.items")), lambda i: aws(i, known))), "google": F.transform(spoken, google),
    }


def _parse_vendor(texts: DataFrame, vendor: str, parted: bool) -> DataFrame:
    """Cues of the texts (transcript_id, _part, _t) of one vendor; `_t` is clean JSON. Words of all parts are numbered and grouped together."""
    t = F.col("_t")
    cues, words = _cues(t).get(vendor), _words(t).get(vendor)
    none = F.array().cast("array<struct<text:string,speaker:string,start_ms:bigint,end_ms:bigint,is_punct:boolean>>")
    untimed = F.transform(F.filter(F.transform(_list(_get(t, "results")), lambda r: _get(_first(r, "alternatives"), "transcript")), lambda s: s.isNotNull()), lambda s: _cue(s, F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    filled = lambda c: none if c is None else F.coalesce(c, none)
    exploded = lambda y, c, before: y.select("transcript_id", before.alias("_before"), F.posexplode(c).alias("index", "_c")).select("transcript_id", (F.col("_before") + F.col("index")).alias("index"), "_c.*")
    at = F.shiftleft(F.col("_part"), 32)
    if cues is None and vendor != "google":  # nothing but words; as a generator, for a filter would carry a copy of them down
        return group_words(exploded(texts.select("transcript_id", "_part", F.inline(F.array(F.struct(filled(words).alias("_words"))))), "_words", at))
    x = texts.select("transcript_id", "_part", filled(cues).alias("_cues"), filled(words).alias("_words"), (untimed if vendor == "google" else none).alias("_untimed"))
    whole = F.when(F.size("_cues") > 0, F.col("_cues")).when(F.size("_words") == 0, F.col("_untimed")).otherwise(none)
    y = x.select("transcript_id", "_part", whole.alias("_whole"))
    w = Window.partitionBy("transcript_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("_whole")).over(w), F.lit(0)) if parted else F.lit(0).cast("bigint")
    out = exploded(y.withColumn("_n", before), "_whole", F.col("_n")).where("text <> ''").drop("is_punct")
    if words is None:
        return out
    single = x.where((F.size("_cues") == 0) & (F.size("_words") > 0))
    return out.unionByName(group_words(exploded(single, "_words", at)))


def parse_asr(texts: DataFrame, text: str = "text", vendor: str | None = None, part: str | None = None) -> DataFrame:
    """Cues of speech-to-text JSON; `vendor` overrides the one told from the content. A `vendor` column is taken as told. Unrecognised texts have none.

    Vendors are told once and written out; each that occurs then has a projection of its own, which keeps plans small.
    With `part`, a transcript may come in several responses of one vendor and kind, in the order of that whole number; cues
    count on, and words group, from one to the next, so that a long recording need not be one value.
    """
    columns = ["transcript_id", (F.col(part) if part else F.lit(0)).cast("bigint").alias("_part"), F.col(text).alias("_t")]
    if vendor:
        x = texts.select(*columns, F.lit(vendor).alias("vendor"))
    elif "vendor" in texts.columns:
        x = texts.select(*columns, "vendor")
    else:
        x = cut(texts.select(*columns, F.inline(F.array(F.struct(detect_vendor(F.col(text)).alias("vendor"))))))
    clean = x.select("transcript_id", "_part", "vendor", F.inline(F.array(F.struct(finite_json(unblank(F.col("_t"))).alias("_t")))))  # cleaned once
    found = [vendor] if vendor else sorted(r[0] for r in x.select("vendor").where("vendor IS NOT NULL").distinct().collect())  # ten at most
    out = texts.sparkSession.createDataFrame([], T.StructType([texts.schema["transcript_id"], *_CUE.fields]))
    for v in found:
        out = out.unionByName(_parse_vendor(clean.where(F.col("vendor") == v), v, part is not None))
    return out.withColumn("raw_speaker", F.lit(None).cast("string")).withColumn("rolling_duplicate_cues", F.lit(0).cast("bigint"))


_CUE = T.StructType([T.StructField("index", T.LongType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
