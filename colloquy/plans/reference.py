"""Queries over the test tables for the transcript operators, each with its SQL where SQL can express it.

The turn table is `turns` with repeated rows counted once. Nothing is filtered out to keep a check cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as fx
from colloquy.operators import chunker, diagnostics, reports, sentences, speakers
from colloquy.operators.turns import group_words, merge_turns, transcript_attributes, turn_duration
from colloquy.schema import as_turns
from colloquy.session import spread, table
from colloquy.sources.captions import parse_plain, parse_srt, parse_vtt
from colloquy.sources.detect import detect_format
from colloquy.sources.readers import parse_transcripts, with_format

TARGET = 2000  # above the longest turn of the test tables, so that packing alone is seen
SMALL = 400
RESPONSE = 4096  # turn indices of one response; longer transcripts come in several


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_turns(_once(table(spark, sf_dir, "turns")), order="turn_index").withColumn("text", F.coalesce("text", F.lit("")))


def _once(turns: DataFrame, *more: str) -> DataFrame:
    """Every turn once; `more` are columns told by its key."""
    t = turns.where("transcript_id IS NOT NULL AND turn_index IS NOT NULL")
    return t.groupBy("transcript_id", *more, "turn_index").agg(*[F.min(c).alias(c) for c in ("text", "speaker", "raw_speaker", "start_ms", "end_ms")])


T = """t AS (SELECT transcript_id, turn_index::BIGINT AS idx, coalesce(min(text), '') AS text, min(speaker) AS speaker, min(raw_speaker) AS raw_speaker,
  min(start_ms) AS start_ms, min(end_ms) AS end_ms FROM turns WHERE transcript_id IS NOT NULL AND turn_index IS NOT NULL GROUP BY transcript_id, turn_index)"""
RENDERED = "coalesce(speaker, 'UNKNOWN') || ': ' || text"


def _pack_sql(target: int, overlap: int, ratio: float, size: str = "length(r)", gap: int = 1) -> str:
    """CTEs `u` (numbered units), `g` (final groups: transcript_id, no, s, e, carried) for the greedy packing with overlap and tail merge."""
    cap = min(overlap, target // 2)
    return f"""WITH RECURSIVE {T},
u AS (SELECT transcript_id, idx, text, speaker, start_ms, end_ms, r, z, row_number() OVER w - 1 AS i, sum(z) OVER w AS p, count(*) OVER (PARTITION BY transcript_id) AS n
  FROM (SELECT *, {size} AS z FROM (SELECT *, {RENDERED} AS r FROM t)) WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
k(transcript_id, no, s, e, carried) AS (
  SELECT a.transcript_id, 0::BIGINT, 0::BIGINT, coalesce((SELECT min(b.i) - 1 FROM u b WHERE b.transcript_id = a.transcript_id AND b.i > 0 AND b.p + {gap} * b.i > {target}), a.n - 1), 0::BIGINT FROM u a WHERE a.i = 0
  UNION ALL
  SELECT q.transcript_id, q.no + 1, q.s2,
    coalesce((SELECT min(b.i) - 1 FROM u b WHERE b.transcript_id = q.transcript_id AND b.i > q.e + 1 AND b.p - q.before + {gap} * (b.i - q.s2) > {target}), q.n - 1), q.e + 1 - q.s2
  FROM (SELECT c.transcript_id, c.no, c.e, c.n, c.s2, coalesce((SELECT b.p FROM u b WHERE b.transcript_id = c.transcript_id AND b.i = c.s2 - 1), 0) AS before FROM (
    SELECT k.transcript_id, k.no, k.e, l.n, CASE WHEN {overlap} = 0 OR k.s = k.e THEN k.e + 1 ELSE
      coalesce((SELECT min(j.i) FROM u j WHERE j.transcript_id = k.transcript_id AND j.i > k.s AND j.i <= k.e AND l.p - j.p + j.z + {gap} * (k.e - j.i) <= {cap}), k.e) END AS s2
    FROM k JOIN u l ON l.transcript_id = k.transcript_id AND l.i = k.e WHERE k.e < l.n - 1) c) q),
own AS (SELECT k.*, lead(no) OVER w IS NULL AS is_last, (SELECT sum(u.z) + {gap} * (count(*) - 1) FROM u WHERE u.transcript_id = k.transcript_id AND u.i BETWEEN k.s + k.carried AND k.e) AS own_size,
  lag(s) OVER w AS ps, lag(carried) OVER w AS pc FROM k WINDOW w AS (PARTITION BY transcript_id ORDER BY no)),
m AS (SELECT *, is_last AND no > 0 AND own_size < {target} * ({ratio}) AND
  (SELECT sum(u.z) + {gap} * (count(*) - 1) FROM u WHERE u.transcript_id = own.transcript_id AND u.i BETWEEN own.ps AND own.e) <= {target} * 1.5 AS tail FROM own),
g AS (SELECT transcript_id, no, s, CASE WHEN lead(tail) OVER w THEN lead(e) OVER w ELSE e END AS e, carried, tail FROM m WINDOW w AS (PARTITION BY transcript_id ORDER BY no) QUALIFY NOT tail)"""


_SPANS = "SELECT g.transcript_id, g.no AS chunk_no, a.idx AS turn_start, b.idx AS turn_end, g.carried AS overlap_count FROM g JOIN u a ON a.transcript_id = g.transcript_id AND a.i = g.s JOIN u b ON b.transcript_id = g.transcript_id AND b.i = g.e"
_MEMBERS = "SELECT g.transcript_id, g.no, g.carried, g.s, u.* EXCLUDE (transcript_id) FROM g JOIN u ON u.transcript_id = g.transcript_id AND u.i BETWEEN g.s AND g.e"


def _spans(c: DataFrame) -> DataFrame:
    return c.select("transcript_id", "chunk_no", "turn_start", "turn_end", F.col("overlap_count").cast("bigint").alias("overlap_count"))


def _chunks(spark, d, **options) -> DataFrame:
    return chunker.chunk(base(spark, d), **({"target": TARGET, "min_tail_ratio": 0.0} | options))


def render_turns(spark, d):
    return base(spark, d).select("transcript_id", F.col("index").alias("turn_index"), chunker.render_turn().alias("rendered"))


def transcript_stats(spark, d):
    return transcript_attributes(base(spark, d)).select("transcript_id", "n_turns", "n_chars", "duration_ms", "has_timestamps")


def transcript_speakers(spark, d):
    return transcript_attributes(base(spark, d)).select("transcript_id", F.array_join("speakers", "|").alias("speakers"))


def turn_durations(spark, d):
    return turn_duration(base(spark, d)).select("transcript_id", F.col("index").alias("turn_index"), "duration_ms")


def pack_basic(spark, d):
    return _spans(_chunks(spark, d))


def pack_tail_merge(spark, d):
    return _spans(_chunks(spark, d, min_tail_ratio=0.5))


def pack_overlap(spark, d):
    return _spans(_chunks(spark, d, overlap=500))


def pack_overlap_tail(spark, d):
    return _spans(_chunks(spark, d, overlap=1500, min_tail_ratio=0.5))


def pack_words(spark, d):
    return _spans(_chunks(spark, d, target=500, size=chunker.words))


def chunk_ids(spark, d):
    return _chunks(spark, d, source="turns").select("transcript_id", "chunk_no", "id", F.length("text").cast("bigint").alias("n_chars"))


def chunk_speakers(spark, d):
    return _chunks(spark, d, overlap=500).select("transcript_id", "chunk_no", F.array_join("speakers", "|").alias("speakers"))


def chunk_primary_speaker(spark, d):
    return _chunks(spark, d, overlap=500).select("transcript_id", "chunk_no", "primary_speaker")


def chunk_times(spark, d):
    return _chunks(spark, d).select("transcript_id", "chunk_no", "start_ms", "end_ms")


def split_oversized(spark, d):
    c = chunker.chunk(base(spark, d), target=SMALL, overlap=100)
    m = c.select("transcript_id", "chunk_no", "id", F.posexplode("members").alias("member", "m"))
    return m.select("transcript_id", "chunk_no", "id", "member", F.col("m.index").alias("turn_index"), "m.part_no", "m.part_count", "m.estimated", "m.start_ms", "m.end_ms", "m.text")


def split_lossless(spark, d):
    """Letters and digits of every turn survive cutting and packing."""
    c = chunker.chunk(base(spark, d), target=SMALL, min_tail_ratio=0.0)
    m = c.select("transcript_id", F.explode("members").alias("m"))
    return m.groupBy("transcript_id", F.col("m.index").alias("turn_index")).agg(F.sum(F.length(F.regexp_replace("m.text", r"[^A-Za-z0-9]", ""))).alias("n_letters"))


def sentence_candidates(spark, d):
    x = spread(table(spark, d, "documents").where("doc_id IS NOT NULL"))
    return x.select("doc_id", F.size(sentences.candidates(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_segments"))


def split_sentences(spark, d):
    x = spread(table(spark, d, "documents")).select("doc_id", sentences.split_sentences("text").alias("s"))
    return x.select("doc_id", F.posexplode("s").alias("n", "sentence"))


def sentence_lossless(spark, d):
    x = spread(table(spark, d, "documents")).select("doc_id", "text", sentences.split_sentences("text").alias("s"))
    return x.select("doc_id", F.md5(F.array_join("s", "")).alias("digest"))


def uncapitalised_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", sentences.uncapitalised_flag(F.coalesce("text", F.lit(""))).alias("uncapitalised"))


def parse_timestamps(spark, d):
    v = table(spark, d, "vendor_times").groupBy("time_id").agg(F.min("start_raw").alias("raw"))
    return v.select("time_id", fx.parse_timestamp(F.col("raw")).alias("ms"))


def format_timestamps(spark, d):
    return base(spark, d).select("transcript_id", F.col("index").alias("turn_index"), fx.format_timestamp(F.col("start_ms")).alias("shown"), fx.format_timestamp(F.col("end_ms"), True).alias("shown_end"))


def inline_speakers(spark, d):
    return base(spark, d).select("transcript_id", F.col("index").alias("turn_index"), fx.inline_speaker(F.col("text")).alias("label"))


def strip_tags_documents(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(fx.strip_tags(F.coalesce("text", F.lit("")))).alias("digest"))


def rolling_dedupe(spark, d):
    x = base(spark, d).select("transcript_id", "index", F.split("text", " ").alias("lines"))
    w = Window.partitionBy("transcript_id").orderBy("index")
    return x.select("transcript_id", F.col("index").alias("turn_index"), F.array_join(fx.without_rolling(F.lag("lines").over(w), F.col("lines")), " ").alias("kept"))


def _merged(x: DataFrame) -> DataFrame:
    return x.select("transcript_id", F.col("index").alias("turn_no"), "text", "speaker", "start_ms", "end_ms")


def merge_turns_all(spark, d):
    return _merged(merge_turns(base(spark, d)))


def merge_turns_gap(spark, d):
    return _merged(merge_turns(base(spark, d), max_gap_ms=1500))


def _event_words(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint")
    return e.select(F.col("user_id").alias("transcript_id"), n.alias("index"), F.col("event_id").cast("string").alias("text"), F.col("event_type").alias("speaker"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"), F.unix_millis(F.col("ts").cast("timestamp")).alias("end_ms"), (F.col("value") < 10).alias("is_punct"))


def group_words_events(spark, d):
    return group_words(_event_words(spark, d)).select("transcript_id", F.col("index").alias("turn_no"), "text", "speaker", "start_ms", "end_ms")


def locf_speaker(spark, d):
    w = Window.partitionBy("transcript_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return base(spark, d).select("transcript_id", F.col("index").alias("turn_index"), F.last("raw_speaker", ignorenulls=True).over(w).alias("pending"))


def range_speaker(spark, d):
    """The first window (least id) of the transcript that holds a turn's start: an interval join keyed by transcript."""
    f = table(spark, d, "findings").where("finding_id IS NOT NULL").groupBy("finding_id").agg(*[F.min(c).alias(c) for c in ("transcript_id", "start_ms", "end_ms")])
    f = f.select(F.col("transcript_id").alias("_t"), "finding_id", F.col("start_ms").alias("_lo"), F.col("end_ms").alias("_hi"))
    t = base(spark, d).where("start_ms IS NOT NULL")
    x = t.join(f, (F.col("transcript_id") == F.col("_t")) & F.col("start_ms").between(F.col("_lo"), F.col("_hi")))
    return x.groupBy("transcript_id", F.col("index").alias("turn_index")).agg(F.min("finding_id").alias("finding_id"))


def _stamp(ms: Column, mark: str) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    s = F.floor(ms / 1000)
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def _written(spark, d) -> DataFrame:
    """Every turn with plain words, a plain label and known times, ready to be written in any format."""
    b = base(spark, d)
    words = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z0-9]", " "), " +", " "))
    who = F.concat(F.lit("Voice"), (F.length(F.coalesce("speaker", F.lit(""))) % 7).cast("string"))
    start = F.abs(F.coalesce("start_ms", F.col("index") * 1000)) % 360_000_000
    return b.select("transcript_id", F.col("index").alias("i"), F.trim(F.concat(F.lit("t"), F.col("index").cast("string"), F.lit(" "), words)).alias("words"), who.alias("who"), start.alias("a"), (start + 500).alias("b"))


WRITTEN = f"""WITH {T} SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY idx) - 1 AS cue_no,
 trim('t' || idx || ' ' || trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g'), ' +', ' ', 'g'))) AS text, 'Voice' || (length(coalesce(speaker, '')) % 7) AS speaker,
 """
_START = "abs(coalesce(start_ms, idx * 1000)) % 360000000"


def _texts(spark, d, line: Column, head: str = "", between: str = "\n\n", tail: str = "") -> DataFrame:
    x = _written(spark, d).select("transcript_id", "i", line.alias("line"))
    x = x.groupBy("transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), between).alias("text"))
    return x.withColumn("text", F.concat(F.lit(head), "text", F.lit(tail)))


def _cue_rows(x: DataFrame) -> DataFrame:
    return x.select("transcript_id", F.col("index").alias("cue_no"), "text", "speaker", "start_ms", "end_ms")


def vtt_texts(spark, d):
    return _texts(spark, d, F.concat(_stamp(F.col("a"), "."), F.lit(" --> "), _stamp(F.col("b"), "."), F.lit(" align:start\n<v "), "who", F.lit(">"), "words", F.lit("</v>")), "WEBVTT\n\n")


def srt_texts(spark, d):
    return _texts(spark, d, F.concat((F.col("i") + 1).cast("string"), F.lit("\n"), _stamp(F.col("a"), ","), F.lit(" --> "), _stamp(F.col("b"), ","), F.lit("\n"), "who", F.lit(": "), "words"))


def plain_texts(spark, d):
    return _texts(spark, d, F.concat(F.lit("["), _stamp(F.col("a"), "."), F.lit("] "), "who", F.lit(": "), "words"), between="\n")


def json_texts(spark, d):
    return _texts(spark, d, F.to_json(F.struct(F.col("words").alias("text"), F.col("who").alias("speaker"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))), "[", ",", "]")


def roundtrip_vtt(spark, d):
    return _cue_rows(parse_vtt(vtt_texts(spark, d)))


def roundtrip_srt(spark, d):
    return _cue_rows(parse_srt(srt_texts(spark, d)))


def roundtrip_plain(spark, d):
    return _cue_rows(parse_plain(plain_texts(spark, d)))


def roundtrip_json(spark, d):
    x = parse_transcripts(json_texts(spark, d), merge=False)
    return x.select("transcript_id", F.col("index").alias("cue_no"), "text", "speaker")


def _vendor_texts(spark, d, item: Column, head: str, tail: str, per: int | None = None) -> DataFrame:
    """Every transcript with its turns' whole texts, labels and times (missing where NULL) as one vendor writes them, in one response or one for every `per` indices."""
    if per:  # turns are brought together by response, and counted once there
        t = _once(table(spark, d, "turns").withColumn("part", F.floor(F.col("turn_index") / per)).repartition("transcript_id", "part"), "part")
        x = t.select("transcript_id", "part", F.col("turn_index").alias("index"), F.coalesce("text", F.lit("")).alias("text"), "raw_speaker", "start_ms", "end_ms")
    else:
        x = base(spark, d).withColumn("part", F.lit(0))
    x = x.select("transcript_id", "part", "index", F.to_json(item).alias("item"))
    x = x.groupBy("transcript_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "item"))), lambda r: r["item"]), ",").alias("text"))
    return x.withColumn("text", F.concat(F.lit(head), "text", F.lit(tail)))


def _vendor(item, head: str, tail: str, name: str, per: int | None = None):
    def query(spark, d):
        return _cue_rows(parse_transcripts(_vendor_texts(spark, d, item(), head, tail, per), merge=False, part=per and "part"))

    query.__name__ = f"vendor_{name}"
    return query


def _fields(text: str, speaker: str, start: str, end: str, unit, *more: Column) -> Column:
    return F.struct(*more, F.col("text").alias(text), F.col("raw_speaker").alias(speaker), unit("start_ms").alias(start), unit("end_ms").alias(end))


def _item(*more: Column, speaker: str = "speaker") -> Column:
    """One word-level item whose text stands under its first alternative."""
    return F.struct(*more, _s("start_ms").alias("start_time"), _s("end_ms").alias("end_time"), F.col("raw_speaker").alias(speaker), F.array(F.struct(F.col("text").alias("content"), F.col("raw_speaker").alias("speaker"))).alias("alternatives"))


_s = lambda c: F.col(c) / 1000
_ticks = lambda c: F.col(c) * 10_000
VENDORS = [
    _vendor(lambda: _fields("text", "speaker", "start", "end", _s), '{"segments":[', "]}", "whisper"),
    _vendor(lambda: _fields("text", "speaker", "start", "end", F.col), '{"id":"x","utterances":[', "]}", "assemblyai"),
    _vendor(lambda: _fields("transcript", "speaker", "start", "end", _s), '{"results":{"utterances":[', "]}}", "deepgram"),
    _vendor(lambda: F.struct("raw_speaker", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("value"), _s("start_ms").alias("ts"), _s("end_ms").alias("end_ts"))).alias("elements")).cast("struct<speaker:string,elements:array<struct<type:string,value:string,ts:double,end_ts:double>>>"), '{"monologues":[', "]}", "rev"),
    _vendor(lambda: F.struct(F.col("raw_speaker").alias("speaker"), _ticks("start_ms").alias("offsetInTicks"), (_ticks("end_ms") - _ticks("start_ms")).alias("durationInTicks"), F.array(F.struct(F.col("text").alias("display"))).alias("nBest")), '{"recognizedPhrases":[', "]}", "azure"),
    _vendor(lambda: _item(F.lit("word").alias("type"), speaker="unused"), '{"results":[', "]}", "speechmatics"),
    _vendor(lambda: _item(F.lit("pronunciation").alias("type"), speaker="speaker_label"), '{"results":{"items":[', "]}}", "aws", RESPONSE),
    _vendor(lambda: F.struct(F.col("text").alias("word"), F.col("raw_speaker").alias("speakerTag"), F.concat(_s("start_ms").cast("string"), F.lit("s")).alias("startTime"), F.concat(_s("end_ms").cast("string"), F.lit("s")).alias("endTime")), '{"results":[{"alternatives":[{"words":[', "]}]}]}", "google"),
]


def detect_formats(spark, d):
    of = lambda x, n: x.select("transcript_id", F.lit(n).alias("written"), detect_format(F.col("text")).alias("detected"))
    return of(vtt_texts(spark, d), "vtt").unionByName(of(srt_texts(spark, d), "srt")).unionByName(of(json_texts(spark, d), "json"))


def detect_documents(spark, d):
    x = spread(table(spark, d, "documents")).select("doc_id", "layout", F.coalesce("text", F.lit("")).alias("text"))
    return with_format(x).select("doc_id", "layout", "format")


def parse_documents(spark, d):
    x = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("transcript_id"), "text")
    return _merged(parse_transcripts(x))


def canonical_keys(spark, d):
    return table(spark, d, "speaker_labels").select("label_id", fx.canonical_key("raw_speaker").alias("key"))


def strip_roles(spark, d):
    return table(spark, d, "speaker_labels").select("label_id", fx.strip_role(F.col("raw_speaker")).alias("name"))


def generic_labels(spark, d):
    return table(spark, d, "speaker_labels").select("label_id", fx.is_generic_label(F.col("raw_speaker")).alias("generic"))


def speaker_map(spark, d):
    return speakers.build_speaker_map(speakers.label_counts(base(spark, d)))


def resolve_speakers(spark, d):
    return speakers.resolve_speakers(base(spark, d))[0].select("transcript_id", F.col("index").alias("turn_index"), "speaker", "raw_speaker")


def speaker_variants(spark, d):
    return reports.speaker_variants(speaker_map(spark, d)).withColumn("variants", F.array_join("variants", "|"))


def flips(spark, d):
    return diagnostics.flips(base(spark, d)).select("transcript_id", "start_index", "end_index", "confidence", "start_ms", "end_ms")


def flapping(spark, d):
    return diagnostics.flapping(base(spark, d)).select("transcript_id", "start_index", "end_index", F.array_join("speakers", "|").alias("speakers"))


def ghosts(spark, d):
    return diagnostics.ghosts(base(spark, d)).select("transcript_id", "start_index", "end_index", F.array_join("speakers", "|").alias("speakers"))


def lint(spark, d):
    return diagnostics.at_least(diagnostics.diarization_warnings(base(spark, d)), "medium").withColumn("speakers", F.array_join("speakers", "|"))


def talk_share(spark, d):
    return reports.talk_share(base(spark, d))


def render_context(spark, d):
    return _chunks(spark, d, source="turns").select("transcript_id", "chunk_no", reports.to_context().alias("context"))


def turns_cut(spark, d):
    b = base(spark, d).select("transcript_id", "index", "text", "speaker")
    return reports.turns_cut(b, chunker.chunk(as_turns(b), target=SMALL)).withColumnRenamed("index", "turn_index")  # times don't tell where a turn is cut


def report_quality(spark, d):
    b = base(spark, d)
    return reports.report(b, chunker.chunk(b, target=TARGET, min_tail_ratio=0.0), TARGET).select("transcript_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_turns", "n_chunks", "n_stubs", "n_mid_sentence", "n_cut")])


def recursive_split(spark, d):
    x = reports.recursive_split(spread(table(spark, d, "documents")).select("doc_id", "text"), target=600)
    return x.select("doc_id", F.posexplode("pieces").alias("n", "piece"))


def unattributed_pieces(spark, d):
    """How many pieces of the blind splitter don't show who speaks."""
    x = recursive_split(spark, d)
    return x.groupBy("doc_id").agg(F.sum(reports.attributed_speaker(F.col("piece")).isNull().cast("bigint")).alias("n_unattributed"), F.count(F.lit(1)).alias("n_pieces"))


def documents_metadata(spark, d):
    x = reports.to_documents(_chunks(spark, d, source="turns"), {"collection": "test"})
    return x.select("transcript_id", "chunk_no", "metadata.chunk_id", "metadata.speaker", "metadata.turn_start", "metadata.turn_end", "metadata.source", "metadata.collection")


QUERIES = {f.__name__: f for f in (
    render_turns, transcript_stats, transcript_speakers, turn_durations, pack_basic, pack_tail_merge, pack_overlap, pack_overlap_tail, pack_words, chunk_ids, chunk_speakers, chunk_primary_speaker, chunk_times,
    split_oversized, split_lossless, sentence_candidates, split_sentences, sentence_lossless, uncapitalised_flag, parse_timestamps, format_timestamps, inline_speakers, strip_tags_documents, rolling_dedupe,
    merge_turns_all, merge_turns_gap, group_words_events, locf_speaker, range_speaker, roundtrip_vtt, roundtrip_srt, roundtrip_plain, roundtrip_json, detect_formats, detect_documents, parse_documents,
    canonical_keys, strip_roles, generic_labels, speaker_map, resolve_speakers, speaker_variants, flips, flapping, ghosts, lint, talk_share, render_context, turns_cut, report_quality, recursive_split, unattributed_pieces, documents_metadata, *VENDORS,
)}

_FMT = "CASE WHEN {x} IS NULL THEN '--:--' WHEN {h} OR greatest({x}, 0) >= 3600000 THEN (greatest({x}, 0) // 3600000)::VARCHAR || ':' || lpad((greatest({x}, 0) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((greatest({x}, 0) // 1000 % 60)::VARCHAR, 2, '0') ELSE lpad((greatest({x}, 0) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((greatest({x}, 0) // 1000 % 60)::VARCHAR, 2, '0') END"
_fmt = lambda x, hours="false": _FMT.format(x=x, h=hours)
_LABEL = "CASE WHEN regexp_full_match({x}, '\\d+') THEN 'SPEAKER_' || CASE WHEN length(ltrim({x}, '0')) < 2 THEN lpad(ltrim({x}, '0'), 2, '0') ELSE ltrim({x}, '0') END ELSE nullif({x}, '') END"

_PACK = _pack_sql(TARGET, 0, 0.0)
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_ISLANDS = """SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY min(idx)) - 1 AS turn_no, string_agg(text, ' ' ORDER BY idx) AS text, min(speaker) AS speaker,
  arg_min(start_ms, idx) FILTER (start_ms IS NOT NULL) AS start_ms, arg_max(end_ms, idx) FILTER (end_ms IS NOT NULL) AS end_ms FROM j GROUP BY transcript_id, island"""
_TRIMMED = "c AS (SELECT transcript_id, idx, speaker, start_ms, end_ms, " + _STRIP.format("text") + " AS text FROM t WHERE " + _STRIP.format("text") + " <> '')"
_NAME_OK = """length(n) <= 48 AND len(regexp_split_to_array(n, '\\s+')) <= 6 AND NOT regexp_matches(n, '(?i)[,;!?]|\\bhttps?\\b') AND n NOT LIKE '%.' AND regexp_matches(n, '[\\p{L}\\p{Nd}]')
  AND lower(regexp_replace(n, '^[.]+|[.]+$', '', 'g')) NOT IN (""" + ", ".join(f"'{w}'" for w in fx.NO_SPEAKER) + """)
  AND (len(regexp_split_to_array(n, '\\s+')) = 1 OR NOT regexp_matches(n, '(^|\\s)[^\\p{Lu}\\p{Nd}_\\s]'))"""
_KEY = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\w\\s]', ' ', 'g')), '\\s+', ' ', 'g'))"
_ROLE = "coalesce(nullif(" + _STRIP.format("regexp_replace({0}, '\\s*[(\\[{{].*?[)\\]}}]\\s*$|\\s+[-–—]\\s+.*$', '', 'g')") + ", ''), {0})"
_GENERIC = "regexp_matches(" + _STRIP + ", '(?i)^(speaker|spk|s)[\\s_\\-]*\\d+$')"
_SPEAKER_MAP = f"""WITH RECURSIVE {T}, l AS (SELECT transcript_id, coalesce(nullif(raw_speaker, ''), speaker) AS raw, count(*) AS n, min(idx) AS f FROM t GROUP BY 1, 2),
x AS (SELECT *, {_KEY.format('shown')} AS key FROM (SELECT *, {_ROLE.format('raw')} AS shown FROM l WHERE raw IS NOT NULL)),
g AS (SELECT transcript_id, key, max(struct_pack(m := lower(shown) <> shown AND upper(shown) <> shown, n := n, c := length(shown), f := -f, w := shown)).w AS shown, bool_or({_GENERIC.format('raw')}) AS generic FROM x GROUP BY 1, 2),
k AS (SELECT *, string_split(key, ' ') AS z FROM g WHERE NOT generic AND key <> '' AND transcript_id IN (SELECT transcript_id FROM g GROUP BY 1 HAVING count(*) <= 1000)),
p AS (SELECT a.transcript_id, a.key, b.key AS up FROM k a JOIN k b ON a.transcript_id = b.transcript_id AND a.key <> b.key AND len(a.z) <= len(b.z) AND list_has_any(a.z, b.z)
  AND ((len(a.z) < len(b.z) AND list_has_all(b.z, a.z)) OR (len(a.z) = len(b.z) AND len(list_filter(range(1, len(a.z) + 1), lambda i: NOT (a.z[i] = b.z[i] OR (length(a.z[i]) = 1 AND starts_with(b.z[i], a.z[i]))))) = 0))),
o AS (SELECT transcript_id, key, min(up) AS up FROM p GROUP BY 1, 2 HAVING count(DISTINCT up) = 1),
c(transcript_id, key, goal, d) AS (SELECT transcript_id, key, key, 0 FROM g UNION ALL SELECT c.transcript_id, c.key, o.up, c.d + 1 FROM c JOIN o ON o.transcript_id = c.transcript_id AND o.key = c.goal),
e AS (SELECT transcript_id, key, arg_max(goal, d) AS goal FROM c GROUP BY 1, 2),
m AS (SELECT x.transcript_id, x.raw, g.shown AS resolved, x.n FROM x JOIN e ON e.transcript_id = x.transcript_id AND e.key = x.key JOIN g ON g.transcript_id = e.transcript_id AND g.key = e.goal)"""
_FLAP = f"""x AS (SELECT *, row_number() OVER w AS pos, speaker IS NOT NULL AND {_STRIP.format('text')} <> '' AND len(regexp_split_to_array({_STRIP.format('text')}, '\\s+')) <= 4 OR (speaker IS NOT NULL AND {_STRIP.format('text')} = '') AS ok FROM t WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
y AS (SELECT *, coalesce(ok AND lag(ok) OVER w AND speaker <> lag(speaker) OVER w, false) AS edge, lag(speaker, 2) OVER w AS s2 FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY pos)),
z AS (SELECT *, edge AND coalesce(lag(edge) OVER w, false) AND speaker IS NOT DISTINCT FROM s2 AS goes FROM y WINDOW w AS (PARTITION BY transcript_id ORDER BY pos)),
v AS (SELECT *, sum((edge AND NOT goes)::INT) OVER (PARTITION BY transcript_id ORDER BY pos) AS run FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY s) AS n FROM (SELECT transcript_id, run, min(pos) - 1 AS s, max(pos) AS e FROM v WHERE edge GROUP BY 1, 2)),
f(transcript_id, n, s, e, good) AS (SELECT transcript_id, n, s, e, e - s + 1 >= 4 FROM r WHERE n = 1 UNION ALL
  SELECT r.transcript_id, r.n, r.s + (f.good AND f.e = r.s)::INT, r.e, r.e - r.s - (f.good AND f.e = r.s)::INT + 1 >= 4 FROM f JOIN r ON r.transcript_id = f.transcript_id AND r.n = f.n + 1),
flap AS (SELECT f.transcript_id, a.idx AS start_index, b.idx AS end_index, a.speaker || '|' || c.speaker AS speakers, format('{{}} and {{}} alternate over {{}} short turns', a.speaker, c.speaker, f.e - f.s + 1) AS reason, a.start_ms, b.end_ms FROM f JOIN x a ON a.transcript_id = f.transcript_id AND a.pos = f.s JOIN x b ON b.transcript_id = f.transcript_id AND b.pos = f.e
 JOIN x c ON c.transcript_id = f.transcript_id AND c.pos = f.s + 1 WHERE good)"""
_FLIP = f"""fp AS (SELECT *, lag(text) OVER w AS pt, lag(speaker) OVER w AS ps, lag(start_ms) OVER w AS pa, lag(end_ms) OVER w AS pe, lag(idx) OVER w AS pi FROM t WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
fo AS (SELECT *, regexp_replace(regexp_replace(pt, '\\s+$', ''), '["''’”)\\]}}」』]+$', '') AS bare FROM fp WHERE speaker <> ps AND start_ms - pe <= 300),
fu AS (SELECT transcript_id, sum(regexp_matches(f, '\\p{{L}}')::INT) AS n, sum(regexp_matches(f, '\\p{{Lu}}')::INT) AS c FROM (SELECT transcript_id, substr({_STRIP.format('text')}, 1, 1) AS f FROM t) GROUP BY 1),
flip AS (SELECT fo.transcript_id, pi AS start_index, idx AS end_index, ps || '|' || speaker AS speakers, format('{{}} stops mid-sentence and {{}} goes on {{}} ms later', ps, speaker, start_ms - pe) AS reason,
  CASE WHEN n >= 2 AND c * 2 >= n AND regexp_matches(regexp_extract(text, '^[^\\p{{L}}\\p{{Nd}}]*([\\p{{L}}\\p{{Nd}}])', 1), '\\p{{Ll}}') THEN 'high' ELSE 'medium' END AS confidence, pa AS start_ms, end_ms
  FROM fo JOIN fu USING (transcript_id) WHERE bare <> '' AND NOT regexp_matches(bare, '[.!?…。！？]$'))"""
SQL = {
    "speaker_map": f"{_SPEAKER_MAP} SELECT * FROM m",
    "speaker_variants": f"{_SPEAKER_MAP} SELECT transcript_id, resolved, string_agg(raw, '|' ORDER BY raw) AS variants, sum(n)::BIGINT AS n FROM m GROUP BY 1, 2",
    "resolve_speakers": f"{_SPEAKER_MAP} SELECT t.transcript_id, t.idx AS turn_index, coalesce(m.resolved, t.speaker) AS speaker, coalesce(nullif(t.raw_speaker, ''), t.speaker) AS raw_speaker FROM t LEFT JOIN m ON m.transcript_id = t.transcript_id AND m.raw = coalesce(nullif(t.raw_speaker, ''), t.speaker)",
    "flapping": f"WITH RECURSIVE {T}, {_FLAP} SELECT transcript_id, start_index, end_index, speakers FROM flap",
    "lint": f"""WITH RECURSIVE {T}, {_FLAP}, {_FLIP} SELECT transcript_id, 'flapping' AS kind, start_index, end_index, speakers, reason, 'medium' AS confidence, start_ms, end_ms FROM flap
UNION ALL SELECT transcript_id, 'mid_utterance_flip', start_index, end_index, speakers, reason, confidence, start_ms, end_ms FROM flip""",
    "render_turns": f"WITH {T} SELECT transcript_id, idx AS turn_index, {RENDERED} AS rendered FROM t",
    "transcript_stats": f"WITH {T} SELECT transcript_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, max(end_ms) AS duration_ms, bool_or(start_ms IS NOT NULL) AS has_timestamps FROM t GROUP BY transcript_id",
    "transcript_speakers": f"WITH {T}, s AS (SELECT transcript_id, speaker, min(idx) AS f FROM t GROUP BY 1, 2) SELECT transcript_id, coalesce(string_agg(speaker, '|' ORDER BY f), '') AS speakers FROM s GROUP BY 1",
    "turn_durations": f"WITH {T} SELECT transcript_id, idx AS turn_index, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN NULL ELSE greatest(end_ms - start_ms, 0) END AS duration_ms FROM t",
    "pack_basic": f"{_PACK} {_SPANS}",
    "pack_tail_merge": f"{_pack_sql(TARGET, 0, 0.5)} {_SPANS}",
    "pack_overlap": f"{_pack_sql(TARGET, 500, 0.0)} {_SPANS}",
    "pack_overlap_tail": f"{_pack_sql(TARGET, 1500, 0.5)} {_SPANS}",
    "pack_words": _pack_sql(500, 0, 0.0, "len(list_filter(regexp_split_to_array(r, '[\\s\\p{Z}]+'), lambda x: x <> ''))", 0) + " " + _SPANS,
    "chunk_ids": f"""{_PACK}, x AS ({_MEMBERS}), y AS (SELECT transcript_id, no, string_agg(r, chr(10) ORDER BY i) AS body, min(idx) AS a, max(idx) AS b FROM x GROUP BY 1, 2)
SELECT transcript_id, no AS chunk_no, substr(sha256('turns' || chr(0) || a || ':' || b || chr(0) || body), 1, 16) AS id, length(body)::BIGINT AS n_chars FROM y""",
    "chunk_speakers": f"""{_pack_sql(TARGET, 500, 0.0)}, x AS ({_MEMBERS}), y AS (SELECT transcript_id, no, speaker, min(i) AS f FROM x GROUP BY 1, 2, 3)
SELECT transcript_id, no AS chunk_no, coalesce(string_agg(speaker, '|' ORDER BY f), '') AS speakers FROM y GROUP BY 1, 2""",
    "chunk_primary_speaker": f"""{_pack_sql(TARGET, 500, 0.0)}, x AS ({_MEMBERS}), y AS (SELECT transcript_id, no, speaker, sum(length(text)) AS n FROM x WHERE i >= s + carried AND speaker IS NOT NULL GROUP BY 1, 2, 3),
z AS (SELECT transcript_id, no, max(struct_pack(n := n, w := speaker)).w AS w FROM y GROUP BY 1, 2)
SELECT x.transcript_id, x.no AS chunk_no, coalesce(z.w, x.speaker) AS primary_speaker FROM x LEFT JOIN z USING (transcript_id, no) WHERE x.i = x.s""",
    "chunk_times": f"""{_PACK}, x AS ({_MEMBERS}) SELECT transcript_id, no AS chunk_no, arg_min(start_ms, i) FILTER (start_ms IS NOT NULL) AS start_ms, arg_max(end_ms, i) FILTER (end_ms IS NOT NULL) AS end_ms FROM x GROUP BY 1, 2""",
    "split_lossless": f"WITH {T} SELECT transcript_id, idx AS turn_index, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))::BIGINT AS n_letters FROM t",
    "sentence_candidates": """SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?…。！？]+["''’”)\\]}」』]*[ \\t\\n\\r\\f\\v]*)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::BIGINT AS n_segments FROM documents WHERE doc_id IS NOT NULL""",
    "sentence_lossless": "SELECT doc_id, md5(text) AS digest FROM documents",
    "split_sentences": """WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?…。！？]+["''’”)\\]}」』]*[\\s\\x1c-\\x1f\\x{85}\\p{Z}]*)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text <> ''),
u AS (SELECT doc_id, substr(text, 1, 20000) AS h FROM d), low AS (SELECT doc_id, length(regexp_replace(h, '[^\\p{L}]', '', 'g')) >= 40 AND length(regexp_replace(h, '[^\\p{Lu}]', '', 'g')) < length(regexp_replace(h, '[^\\p{L}]', '', 'g')) * 0.01 AS low FROM u),
s AS (SELECT doc_id, text, unnest(l) AS seg, generate_subscripts(l, 1) AS k FROM d), e AS (SELECT *, sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS fin FROM s WHERE seg <> ''),
c AS (SELECT doc_id, k, seg, fin < length(text) AS inner_, substr(text, fin + 1, 1) AS nxt, regexp_extract(seg, '([.!?…。！？]+)["''’”)\\]}」』]*[\\s\\x1c-\\x1f\\x{85}\\p{Z}]*$', 1) AS mark, regexp_matches(seg, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]$') AS gap,
  ltrim(lower(regexp_extract(substr(text, greatest(1, fin - 99), least(100, fin)), '([A-Za-z.]*)\\.["''’”)\\]}」』]*[\\s\\x1c-\\x1f\\x{85}\\p{Z}]*$', 1)), '.') AS w FROM e),
o AS (SELECT doc_id, k, seg, (inner_ AND mark <> '' AND CASE WHEN NOT gap THEN regexp_matches(mark, '[。！？]') WHEN mark <> '.' THEN true WHEN length(w) = 1 OR w IN (""" + ", ".join(f"'{w}'" for w in sorted(sentences.ABBREVIATIONS)) + """) THEN false ELSE low OR regexp_matches(nxt, '[\\p{Lu}\\p{Nd}\\p{Lo}"''“‘(\\[{「『]') END)::INT AS ends FROM c JOIN low USING (doc_id)),
g AS (SELECT doc_id, k, seg, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS n FROM o)
SELECT doc_id, n, string_agg(seg, '' ORDER BY k) AS sentence FROM g GROUP BY 1, 2""",
    "uncapitalised_flag": """WITH h AS (SELECT doc_id, substr(coalesce(text, ''), 1, 20000) AS h FROM documents)
SELECT doc_id, length(regexp_replace(h, '[^\\p{L}]', '', 'g')) >= 40 AND length(regexp_replace(h, '[^\\p{Lu}]', '', 'g')) < length(regexp_replace(h, '[^\\p{L}]', '', 'g')) * 0.01 AS uncapitalised FROM h""",
    "parse_timestamps": """WITH v AS (SELECT time_id, min(start_raw) AS raw FROM vendor_times GROUP BY 1)
SELECT time_id, CASE WHEN regexp_full_match(raw, '(?:(\\d{1,3}):)?(\\d{1,2}):(\\d{1,2})(?:[.,](\\d{1,3}))?') THEN
 (coalesce(try_cast(regexp_extract(raw, '^(?:(\\d{1,3}):)?(\\d{1,2}):(\\d{1,2})', 1) AS BIGINT), 0) * 3600 + try_cast(regexp_extract(raw, '^(?:(\\d{1,3}):)?(\\d{1,2}):(\\d{1,2})', 2) AS BIGINT) * 60
  + try_cast(regexp_extract(raw, '^(?:(\\d{1,3}):)?(\\d{1,2}):(\\d{1,2})', 3) AS BIGINT)) * 1000 + coalesce(try_cast(rpad(nullif(regexp_extract(raw, '[.,](\\d{1,3})$', 1), ''), 3, '0') AS BIGINT), 0) END AS ms FROM v""",
    "format_timestamps": f"WITH {T} SELECT transcript_id, idx AS turn_index, {_fmt('start_ms')} AS shown, {_fmt('end_ms', 'true')} AS shown_end FROM t",
    "inline_speakers": f"""WITH {T}, m AS (SELECT transcript_id, idx, {_STRIP.format("regexp_extract(text, '(?s)^\\s*([^\\s:][^:\\n]{0,48}?)\\s*:\\s+(\\S.*)$', 1)")} AS n FROM t)
SELECT transcript_id, idx AS turn_index, CASE WHEN n <> '' AND {_NAME_OK} THEN n END AS label FROM m""".replace("{{", "{").replace("}}", "}"),
    "strip_tags_documents": """SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '</?[a-zA-Z][^>]*>|<\\d{1,3}:\\d{2}:\\d{2}[.,]\\d{1,3}>', '', 'g').replace('&#46;', '.').replace('&#44;', ',').replace('&lt;', '<').replace('&gt;', '>').replace('&quot;', '"').replace('&amp;', '&'), '(?i)</?(?:i|b|u|c|v|em|strong|ruby|rt|lang|font|br)\\b[^>]*/?>', '', 'g')) AS digest FROM documents""",
    "rolling_dedupe": f"""WITH {T}, l AS (SELECT transcript_id, idx, string_split(text, ' ') AS c, lag(string_split(text, ' ')) OVER (PARTITION BY transcript_id ORDER BY idx) AS p FROM t),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(c), len(p)) + 1), lambda n: p[len(p) - n + 1:] = c[1:n])), 0) AS k FROM l)
SELECT transcript_id, idx AS turn_index, array_to_string(c[k + 1:], ' ') AS kept FROM k""",
    "merge_turns_all": f"""WITH {T}, {_TRIMMED}, b AS (SELECT *, lag(idx) OVER w IS NULL OR speaker IS DISTINCT FROM lag(speaker) OVER w AS brk FROM c WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
j AS (SELECT *, sum(brk::INT) OVER (PARTITION BY transcript_id ORDER BY idx) AS island FROM b) {_ISLANDS}""",
    "merge_turns_gap": f"""WITH {T}, {_TRIMMED}, b AS (SELECT *, lag(idx) OVER w IS NULL OR speaker IS DISTINCT FROM lag(speaker) OVER w AS brk FROM c WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
r AS (SELECT *, sum(brk::INT) OVER (PARTITION BY transcript_id ORDER BY idx) AS run FROM b),
q AS (SELECT *, last_value(CASE WHEN end_ms IS NOT NULL THEN struct_pack(e := end_ms, i := idx) END IGNORE NULLS) OVER (PARTITION BY transcript_id, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM r),
l AS (SELECT transcript_id, k.i AS ki, min(idx) AS idx FROM q WHERE start_ms - k.e > 1500 GROUP BY 1, 2),
e AS (SELECT q.*, brk OR l.idx IS NOT NULL AS brk2 FROM q LEFT JOIN l ON l.transcript_id = q.transcript_id AND l.idx = q.idx),
j AS (SELECT *, sum(brk2::INT) OVER (PARTITION BY transcript_id ORDER BY idx) AS island FROM e) {_ISLANDS}""",
    "group_words_events": """WITH e AS (SELECT user_id AS transcript_id, row_number() OVER w - 1 AS idx, event_id::VARCHAR AS text, event_type AS speaker, epoch_us(ts) // 1000 AS ms, value < 10 AS punct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, last_value(CASE WHEN NOT punct OR idx = 0 THEN struct_pack(s := speaker) END IGNORE NULLS) OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).s AS held FROM e),
b AS (SELECT *, idx = 0 OR (NOT punct AND speaker IS DISTINCT FROM held) AS brk FROM h), j AS (SELECT *, sum(brk::INT) OVER (PARTITION BY transcript_id ORDER BY idx) - 1 AS turn_no FROM b)
SELECT transcript_id, turn_no::BIGINT AS turn_no, string_agg(CASE WHEN punct OR brk THEN '' ELSE ' ' END || text, '' ORDER BY idx) AS text, arg_min(speaker, idx) AS speaker, arg_min(ms, idx) AS start_ms, arg_max(ms, idx) AS end_ms FROM j GROUP BY 1, 2""",
    "locf_speaker": f"WITH {T} SELECT transcript_id, idx AS turn_index, last_value(raw_speaker IGNORE NULLS) OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending FROM t",
    "range_speaker": f"""WITH {T}, f AS (SELECT finding_id, min(transcript_id) AS transcript_id, min(start_ms) AS lo, min(end_ms) AS hi FROM findings WHERE finding_id IS NOT NULL GROUP BY 1)
SELECT t.transcript_id, t.idx AS turn_index, min(finding_id) AS finding_id FROM t JOIN f ON t.transcript_id = f.transcript_id AND t.start_ms BETWEEN lo AND hi GROUP BY 1, 2""",
    "roundtrip_vtt": f"{WRITTEN} {_START} AS start_ms, {_START} + 500 AS end_ms FROM t",
    "roundtrip_srt": f"{WRITTEN} {_START} AS start_ms, {_START} + 500 AS end_ms FROM t",
    "roundtrip_plain": f"{WRITTEN} {_START} AS start_ms, NULL::BIGINT AS end_ms FROM t",
    "roundtrip_json": f"SELECT transcript_id, cue_no, text, speaker FROM ({WRITTEN} 0 AS z FROM t)",
    "detect_formats": "SELECT DISTINCT transcript_id, w AS written, w AS detected FROM turns, (VALUES ('vtt'), ('srt'), ('json')) v(w) WHERE transcript_id IS NOT NULL AND turn_index IS NOT NULL",
    "canonical_keys": "SELECT label_id, trim(regexp_replace(lower(regexp_replace(strip_accents(raw_speaker), '[^\\w\\s]', ' ', 'g')), '\\s+', ' ', 'g')) AS key FROM speaker_labels",
    "strip_roles": "SELECT label_id, coalesce(nullif(" + _STRIP.format("regexp_replace(raw_speaker, '\\s*[(\\[{].*?[)\\]}]\\s*$|\\s+[-–—]\\s+.*$', '', 'g')") + ", ''), raw_speaker) AS name FROM speaker_labels",
    "generic_labels": "SELECT label_id, regexp_matches(" + _STRIP.format("raw_speaker") + ", '(?i)^(speaker|spk|s)[\\s_\\-]*\\d+$') AS generic FROM speaker_labels",
    "flips": f"WITH {T}, {_FLIP} SELECT transcript_id, start_index, end_index, confidence, start_ms, end_ms FROM flip",
    "ghosts": f"""WITH {T}, b AS (SELECT transcript_id, speaker, count(*) AS n, sum(length(text)) AS chars, min(idx) AS start_index, max(idx) AS end_index FROM t GROUP BY 1, 2),
a AS (SELECT transcript_id, sum(chars) AS total, count(speaker) AS voices FROM b GROUP BY 1)
SELECT transcript_id, start_index, end_index, speaker AS speakers FROM b JOIN a USING (transcript_id) WHERE voices >= 2 AND regexp_matches({_STRIP.format('speaker')}, '(?i)^(speaker|spk|s)[\\s_\\-]*\\d+$') AND n <= 2 AND chars <= 0.005 * total""",
    "talk_share": f"WITH {T}, b AS (SELECT transcript_id, speaker, count(*) AS n_turns, sum(length(text))::BIGINT AS chars FROM t GROUP BY 1, 2) SELECT *, (sum(chars) OVER (PARTITION BY transcript_id))::BIGINT AS total_chars FROM b",
    "render_context": f"""{_PACK}, x AS ({_MEMBERS}), y AS (SELECT transcript_id, no, arg_min(start_ms, i) FILTER (start_ms IS NOT NULL) AS a, arg_max(end_ms, i) FILTER (end_ms IS NOT NULL) AS b,
 string_agg(CASE WHEN start_ms IS NULL THEN '' ELSE '(' || {_fmt('start_ms')} || ') ' END || coalesce(nullif(speaker, ''), 'UNKNOWN') || ': ' || text, chr(10) ORDER BY i) AS body FROM x GROUP BY 1, 2)
SELECT transcript_id, no AS chunk_no, '[turns' || CASE WHEN a IS NULL THEN '' ELSE ' ' || {_fmt('a')} || '–' || {_fmt('b')} END || ']' || chr(10) || body AS context FROM y""",
    "turns_cut": f"WITH {T} SELECT transcript_id, idx AS turn_index FROM t WHERE length({RENDERED}) > {SMALL} AND length(text) >= 8",
    "report_quality": f"""{_PACK}, x AS ({_MEMBERS}), y AS (SELECT transcript_id, no, sum(z) + count(*) - 1 AS n, arg_min(text, i) AS f FROM x GROUP BY 1, 2),
q AS (SELECT transcript_id, count(*) AS n_chunks, sum((n < {TARGET} / 3.0)::INT)::BIGINT AS n_stubs, sum((regexp_matches(substr(f, 1, 1), '\\p{{L}}') AND NOT regexp_matches(substr(f, 1, 1), '\\p{{Lu}}'))::INT)::BIGINT AS n_mid_sentence FROM y GROUP BY 1)
SELECT transcript_id, (SELECT count(*) FROM t WHERE t.transcript_id = q.transcript_id) AS n_turns, n_chunks, n_stubs, n_mid_sentence, 0::BIGINT AS n_cut FROM q""",
    "documents_metadata": f"""{_PACK}, x AS ({_MEMBERS}), y AS (SELECT transcript_id, no, string_agg(r, chr(10) ORDER BY i) AS body, min(idx) AS a, max(idx) AS b FROM x GROUP BY 1, 2),
v AS (SELECT transcript_id, no, speaker, sum(length(text)) AS n FROM x WHERE speaker IS NOT NULL GROUP BY 1, 2, 3), z AS (SELECT transcript_id, no, max(struct_pack(n := n, w := speaker)).w AS w FROM v GROUP BY 1, 2)
SELECT transcript_id, no AS chunk_no, substr(sha256('turns' || chr(0) || a || ':' || b || chr(0) || body), 1, 16) AS chunk_id, w AS speaker, a::BIGINT AS turn_start, b::BIGINT AS turn_end, 'turns' AS source, 'test' AS collection FROM y LEFT JOIN z USING (transcript_id, no)""",
}
_SAID = f"""WITH {T}, c AS (SELECT transcript_id, idx, row_number() OVER (PARTITION BY transcript_id ORDER BY idx) - 1 AS cue_no, {_STRIP.format("text")} AS text, {_STRIP.format("raw_speaker")} AS raw, start_ms, end_ms FROM t),
v AS (SELECT transcript_id, idx, cue_no, text, {_LABEL.format(x="raw")} AS speaker, start_ms, end_ms FROM c WHERE text <> '')"""
_UTTERED = _SAID + " SELECT transcript_id, cue_no, text, speaker, start_ms, {end} AS end_ms FROM v"
_GROUPED = _SAID + """, b AS (SELECT *, row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w AS new FROM v WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY transcript_id ORDER BY idx) - 1 AS no FROM b)
SELECT transcript_id, no::BIGINT AS cue_no, string_agg(text, ' ' ORDER BY idx) AS text, min(speaker) AS speaker, first(start_ms ORDER BY idx) AS start_ms, arg_max(end_ms, idx) FILTER (end_ms IS NOT NULL) AS end_ms FROM k GROUP BY 1, 2"""
SQL |= {f"vendor_{n}": _UTTERED.format(end="end_ms") for n in ("whisper", "assemblyai", "deepgram")}
SQL |= {"vendor_rev": _UTTERED.format(end="CASE WHEN start_ms IS NOT NULL THEN end_ms END"), "vendor_azure": _UTTERED.format(end="coalesce(start_ms + (end_ms - start_ms), start_ms)")}
SQL |= {f"vendor_{n}": _GROUPED for n in ("speechmatics", "aws", "google")}
