"""Sources, text helpers, turns, speakers, diagnostics, rendering."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import text as fx
from colloquy.operators import chunker, diagnostics, reports, sentences, speakers
from colloquy.operators.turns import merge_turns
from colloquy.schema import as_turns
from colloquy.sources import sinks
from colloquy.sources.readers import parse_transcripts, quarantine, with_format

TEXTS = {
    "voice.vtt": "WEBVTT\n\nNOTE made up\nnot a cue\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\n<v Ann Lee>Hello <i>there</i>.</v>\n\n2\n00:00:02.500 --> 00:00:04.000\n<v Ann Lee>Again &amp; again.</v>\n\n00:00:04.000 --> 00:00:05.000\nBo: Yes.\n",
    "rolling.vtt": "WEBVTT\n\n00:00.000 --> 00:02.000\none two\n\n00:02.000 --> 00:04.000\none two\nthree\n\n00:04.000 --> 00:06.000\nthree\n",
    "a.srt": "1\n00:00:01,000 --> 00:00:02,000\nAnn: It <b>renews</b>.\n\n2\n00:00:02,000 --> 00:00:03,500\nBo: Only\nif asked.\n",
    "otter.txt": "Ann Lee  0:01\nFirst line.\nSecond line.\n\nBo Ray  0:09\nDone.\n",
    "bracket.txt": "[00:01] Ann: One.\n[00:04] Bo: Two.\nand more\n",
    "whisper.json": json.dumps({"segments": [{"start": 0.5, "end": 1.2345, "text": " Hi. ", "speaker": 0}, {"start": None, "end": None, "text": "Yes.", "speaker": "Bo"}]}).replace("null", "NaN"),
    "aws.json": json.dumps({"results": {"speaker_labels": {"segments": [{"start_time": "0.0", "end_time": "1.0", "speaker_label": "spk_0"}, {"start_time": "1.5", "end_time": "3.0", "speaker_label": "spk_1"}]}, "items": [{"type": "pronunciation", "start_time": "0.5", "end_time": "0.7", "alternatives": [{"content": "Hi"}]}, {"type": "punctuation", "alternatives": [{"content": "."}]}, {"type": "pronunciation", "start_time": "2.0", "end_time": "2.2", "alternatives": [{"content": "Bye"}]}]}}),
    "google.json": json.dumps({"results": [{"alternatives": [{"words": [{"word": "early", "startTime": "0.1s"}]}]}, {"alternatives": [{"words": [{"word": "Hi", "startTime": "0.500s", "endTime": {"seconds": "1", "nanos": 500000000}, "speakerTag": 1}, {"word": "you", "startTime": "2s", "endTime": "2.5s", "speakerTag": 2}]}]}]}),
    "azure.json": json.dumps({"recognizedPhrases": [{"speaker": 1, "offsetInTicks": 5000000, "durationInTicks": 9000000, "nBest": [{"display": "Hi."}]}]}),
    "rev.json": json.dumps({"monologues": [{"speaker": 7, "elements": [{"value": "Go", "ts": 1.02, "end_ts": 1.4}, {"value": "!"}]}]}),
    "assembly.json": json.dumps({"id": "x", "utterances": [{"start": 2100, "end": 5400, "text": "Well.", "speaker": "A"}]}),
    "deepgram.json": json.dumps({"results": {"channels": [{"alternatives": [{"words": [{"word": "hi", "punctuated_word": "Hi", "start": 0.5, "end": 0.9, "speaker": 0}, {"word": "yo", "start": 2, "end": 2.5, "speaker": 1}]}]}]}}),
    "speechmatics.json": json.dumps({"results": [{"start_time": 0, "end_time": 1, "type": "word", "alternatives": [{"content": "Hi", "speaker": "S1"}]}, {"type": "punctuation", "start_time": 1, "end_time": 1, "alternatives": [{"content": "!", "speaker": "S1"}]}]}),
    "generic.json": json.dumps([{"text": "a", "speaker": "X", "start": 20000, "end": 21000}, {"content": "b", "spk": "Y", "begin": 22000}]),
    "nothing.txt": "just words\nwithout any sign", "broken.json": '{"results": [', "empty": "", "null": None,
}
TURNS = {
    "voice.vtt": [("Ann Lee", 1000, 4000, "Hello there. Again & again."), ("Bo", 4000, 5000, "Yes.")], "rolling.vtt": [(None, 0, 4000, "one two three")], "a.srt": [("Ann", 1000, 2000, "It renews."), ("Bo", 2000, 3500, "Only if asked.")],
    "otter.txt": [("Ann Lee", 1000, None, "First line. Second line."), ("Bo Ray", 9000, None, "Done.")], "bracket.txt": [("Ann", 1000, None, "One."), ("Bo", 4000, None, "Two. and more")], "whisper.json": [("SPEAKER_00", 500, 1234, "Hi."), ("Bo", None, None, "Yes.")],
    "aws.json": [("spk_0", 500, 700, "Hi."), ("spk_1", 2000, 2200, "Bye")], "google.json": [("SPEAKER_01", 500, 1500, "Hi"), ("SPEAKER_02", 2000, 2500, "you")], "azure.json": [("SPEAKER_01", 500, 1400, "Hi.")], "rev.json": [("SPEAKER_07", 1020, 1400, "Go!")],
    "assembly.json": [("A", 2100, 5400, "Well.")], "deepgram.json": [("SPEAKER_00", 500, 900, "Hi"), ("SPEAKER_01", 2000, 2500, "yo")], "speechmatics.json": [("S1", 0, 1000, "Hi!")], "generic.json": [("X", 20000, 21000, "a"), ("Y", 22000, None, "b")],
}


def table(spark, rows):
    x = spark.createDataFrame([(t, i, w, s, s, a, b) for t, i, w, s, a, b in rows], "transcript_id string, index bigint, text string, speaker string, raw_speaker string, start_ms bigint, end_ms bigint")
    return as_turns(x)


def test_every_format(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "transcript_id string, text string").withColumn("index", F.lit("clash")).withColumn("speaker", F.lit(1))
    got = {}
    for r in parse_transcripts(df).orderBy("transcript_id", "index").collect():
        got.setdefault(r.transcript_id, []).append((r.speaker, r.start_ms, r.end_ms, r.text))
    assert got == TURNS
    assert {r.transcript_id for r in quarantine(df).collect()} == {"nothing.txt", "broken.json", "empty", "null"}
    f = {r.transcript_id: r.format for r in with_format(df).collect()}
    assert (f["rolling.vtt"], f["a.srt"], f["otter.txt"], f["rev.json"], f["nothing.txt"]) == ("vtt", "srt", "plain", "json", None)
    with pytest.raises(Exception, match="no known format|JSON"):
        quarantine(df, mode="FAILFAST").collect()


def test_stream(spark, tmp_path):
    from colloquy.streaming.files import stream_turns

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vtt").write_text(TEXTS["voice.vtt"])
    (tmp_path / "in" / "b.txt").write_text(TEXTS["nothing.txt"])
    for _ in range(2):  # the second run finds nothing new
        stream_turns(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/turns")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1


def test_merge_keeps_unknown_times(spark):
    rows = [("t", 0, " a ", None, None, None), ("t", 1, "b", None, 5, None), ("t", 2, "  ", "X", 6, 7), ("t", 3, "c", "X", 100, 200), ("t", 4, "d", "X", 900, None), ("u", 0, "", None, None, None)]
    got = lambda **o: [tuple(r) for r in merge_turns(table(spark, rows), **o).select("index", "text", "speaker", "start_ms", "end_ms").orderBy("index").collect()]
    assert got() == [(0, "a b", None, 5, None), (1, "c d", "X", 100, 200)]
    assert got(max_gap_ms=300)[1:] == [(1, "c", "X", 100, 200), (2, "d", "X", 900, None)]


@pytest.mark.parametrize("block", [3, 4096])
def test_merge_across_blocks_equals_a_plain_loop(spark, block, monkeypatch):
    from colloquy.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", block)
    r = random.Random(block)
    rows = [(f"t{k}", i, r.choice(["a", "b", " "]), r.choice(["X", "Y", None]), r.choice([None, 100 * i]), r.choice([None, 100 * i + 50])) for k in range(5) for i in range(40)]
    for gap in (None, 120):
        want = []
        for k in range(5):
            n, now = -1, None
            for _, _, text, who, s, e in [x for x in rows if x[0] == f"t{k}" and x[2].strip()]:
                if now is None or now[2] != who or (gap is not None and now[4] is not None and s is not None and s - now[4] > gap):
                    n += 1
                    now = [f"t{k}", n, who, s, e, [text]]
                    want.append(now)
                else:
                    now[3] = now[3] if now[3] is not None else s
                    now[4] = e if e is not None else now[4]
                    now[5].append(text)
        got = merge_turns(table(spark, rows), max_gap_ms=gap).collect()
        assert sorted((x["transcript_id"], x["index"], x["speaker"] or "", x["start_ms"] or -1, x["end_ms"] or -1, x["text"]) for x in got) == sorted((t, n, w or "", s or -1, e or -1, " ".join(x)) for t, n, w, s, e, x in want)


def test_helpers(spark):
    one = lambda c, *v: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x string").orderBy("i").select(c(F.col("x"))).collect()]
    assert one(fx.parse_timestamp, "1:02:03.5", "1:99", "12:34,05", "1:2:3:4", "x", None) == [3723500, 159000, 754050, None, None, None]
    assert one(fx.inline_speaker, "Ann Lee: hi", "So here's the thing: no", "Note: x", "Dr. Smith: x", "http://x: y", "a:b", None) == ["Ann Lee", None, None, "Dr. Smith", None, None, None]
    assert one(fx.strip_role, "Ann (Host)", "Ann - Acme", "(Host)", "Ann-Lee") == ["Ann", "Ann", "(Host)", "Ann-Lee"]
    assert one(fx.is_generic_label, "SPEAKER_00", "spk 1", "S1", "Sam 1") == [True, True, True, False]
    assert one(lambda c: fx.canonical_key(c), "José  O'Neil!", None) == ["jose o neil", None]
    assert one(lambda c: fx.strip_tags(c), "<b>a</b> &lt;i&gt;b&lt;/i&gt; &lt;div&gt;", "1 < 2") == ["a b <div>", "1 < 2"]
    assert one(lambda c: fx.format_timestamp(c.cast("bigint")), "61000", "3661000", "-5", None) == ["01:01", "1:01:01", "00:00", "--:--"]
    assert one(fx.starts_lower, "a", "(b", "1 c", "É", "", None) == [True, True, False, False, False, None]
    assert one(fx.ends_open, "and so", 'done."', "", "wait…") == [True, False, False, False]


@pytest.mark.parametrize(("text", "n"), [("Dr. Smith paid 3.5 percent. He left.", 2), ("One. two. three.", 1), ("Really?! Yes... no.", 3), ("これはペンです。それも。", 2), ("See example.com now. Ok.", 2), ("", 0), ("No end", 1), ("J. Doe came. Then J. Roe.", 2)])
def test_sentences(text, n):
    got = sentences.split_text(text)
    assert len(got) == n and "".join(got) == text


def test_uncapitalised_stream_of_words():
    text = "we went there and came back again. then we sat down for a while. nobody spoke."
    assert len(sentences.split_text(text)) == 3 and sentences.uncapitalised(text)


def test_speakers_never_guess(spark):
    names = ["Ann Lee", "ANN LEE", "Ann", "A. Lee", "Bo Ray", "Bo Kay", "Bo", "Speaker 1", "José", "Jose (Host)"]
    t = table(spark, [("t", i, "x", n, None, None) for i, n in enumerate(names)])
    m = {r.raw: r.resolved for r in speakers.resolve_speakers(t)[1].collect()}
    assert {m[n] for n in ("Ann Lee", "ANN LEE", "Ann", "A. Lee")} == {"Ann Lee"}
    assert (m["Bo"], m["Bo Ray"], m["Speaker 1"]) == ("Bo", "Bo Ray", "Speaker 1") and m["José"] == m["Jose (Host)"]
    named = speakers.resolve_speakers(t, rename={"Bo": "Bo Ray"})[0]
    assert {r.speaker for r in named.where("raw_speaker = 'Bo'").collect()} == {"Bo Ray"}


def test_flapping_equals_the_greedy_scan(spark):
    r = random.Random(2)
    rows = [(f"t{k}", i, r.choice(["yes", "no no", "one two three four five"]), r.choice(["A", "B", "B", "C", None]), i, i) for k in range(60) for i in range(25)]
    want = set()
    for k in range(60):
        seq = [x for x in rows if x[0] == f"t{k}"]
        i = 0
        while i < len(seq):
            ok = lambda x: x[3] is not None and len(x[2].split()) <= 4
            j = i
            while j + 1 < len(seq) and ok(seq[j]) and ok(seq[j + 1]) and seq[j + 1][3] != seq[j][3] and (j == i or seq[j + 1][3] == seq[j - 1][3]):
                j += 1
            if j - i + 1 >= 4:
                want.add((f"t{k}", i, j))
                i = j + 1
            else:
                i += 1
    got = {(x.transcript_id, x.start_index, x.end_index) for x in diagnostics.flapping(table(spark, rows)).collect()}
    assert got == want and want


def test_flips_and_ghosts(spark):
    rows = [("t", 0, "We should look at", "A", 0, 1000), ("t", 1, "the contract first.", "B", 1100, 2000), ("t", 2, "Fine. " * 300, "A", 9000, 9500), ("t", 3, "Ok", "Speaker 3", None, None)]
    f = diagnostics.diarization_warnings(table(spark, rows)).orderBy("start_index", "kind").collect()
    assert [(x.kind, x.start_index, x.end_index, x.confidence) for x in f] == [("mid_utterance_flip", 0, 1, "high"), ("ghost_speaker", 3, 3, "low")]
    assert diagnostics.at_least(diagnostics.diarization_warnings(table(spark, rows)), "medium").count() == 1
    assert diagnostics.diarization_warnings(table(spark, rows).limit(0)).count() == 0


def test_context_report_and_documents(spark):
    t = table(spark, [("t", 0, "Hello there.", "A", 61_000, 62_000), ("t", 1, "b" * 300, None, None, None)])
    c = chunker.chunk(t, target=200, source="x.vtt", min_tail_ratio=0.0)
    first = c.orderBy("chunk_no").select(reports.to_context().alias("c"), reports.to_context(timestamps=False, header=False).alias("d")).first()
    assert (first.c, first.d) == ("[x.vtt 01:01–01:02]\n(01:01) A: Hello there.", "A: Hello there.")
    r = reports.report(t, c, 200).first()
    assert (r.n_turns, r.n_cut) == (2, 1)
    d = reports.to_documents(c, {"lang": "en", "source": "no"}).orderBy("chunk_no").first()
    assert d.metadata["lang"] == "en" and d.metadata["source"] == "x.vtt" and d.metadata["speakers"] == ["A"] and d.metadata["speaker"] == "A"
    assert reports.to_nodes(c).first().id_ == d.id and sinks.chunk_records(c).columns == "id text speakers primary_speaker start_ms end_ms turn_start turn_end overlap_indices source meta".split()
    assert reports.recursive_pieces("aaa bbb. ccc\n\nddd", 8, reports.SEPARATORS) == ["aaa bbb", "ccc", "ddd"]
    assert reports.to_context_all(c).count() == 1


def test_turns_cut_meets_chunks_by_hash(spark):
    r = random.Random(5)
    word = lambda n: " ".join("".join(r.choices("abé", k=3)) for _ in range(n))
    t = [("ab"[i % 2], i, word(r.choice([3, 4, 5, 9, 12, 40])), None, None, None) for i in range(300)]
    said = {(k, i): x for k, i, x, *_ in t}
    part = T.StructType([T.StructField("index", T.LongType()), T.StructField("part_no", T.IntegerType())])
    held = [(k, n, f"{word(n % 3)} {x} {word(2)}" if n % 4 else x[1:], [(i, 0)] if n % 5 else [(i, None)]) for n, ((k, i), x) in enumerate(said.items()) if n % 3]
    chunks = spark.createDataFrame(held, T.StructType([T.StructField("transcript_id", T.StringType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("members", T.ArrayType(part))]))
    whole = {(k, i) for k, _, _, m in held for i, p in m if p is None}
    want = {key for key, x in said.items() if key not in whole and not any(k == key[0] and x in c for k, _, c, _ in held)}
    cut = reports.turns_cut(table(spark, t), chunks)
    assert {(x["transcript_id"], x["index"]) for x in cut.collect()} == want and 0 < len(want) < len(t)
    # no join compares each turn with each chunk of its transcript
    met = cut._jdf.queryExecution().optimizedPlan().toString()
    assert all("chunk_no" in line for line in met.splitlines() if "Join" in line and "Contains" in line)


def test_json_in_several_responses(spark):
    aws = lambda part: {"results": {"items": [{"type": "pronunciation", "start_time": i, "end_time": i + 0.5, "speaker_label": w, "alternatives": [{"content": f"w{i}"}]} for i, w in part]}}
    whisper = lambda part: {"segments": [{"text": "" if i % 3 == 0 else f"w{i}", "speaker": w, "start": i, "end": i + 0.5} for i, w in part]}
    said = [(i, "AB"[i // 4 % 2]) for i in range(19)]
    rows = [(f.__name__, n, json.dumps(f(part))) for name, f in (("aws", aws), ("whisper", whisper)) for per in (5, 19) if not setattr(f, "__name__", f"{name} {per}") for n, part in enumerate([said[i : i + per] for i in range(0, 19, per)])]
    cues = parse_transcripts(spark.createDataFrame(rows, "transcript_id string, n int, text string"), merge=False, part="n").orderBy("transcript_id", "index").collect()
    by = {}
    for c in cues:
        by.setdefault(c.transcript_id, []).append((c["index"], c.text, c.speaker, c.start_ms, c.end_ms))
    assert by["aws 5"] == by["aws 19"] and [x[0] for x in by["aws 5"]] == list(range(5)) and by["aws 5"][1] == (1, "w4 w5 w6 w7", "B", 4000, 7500)
    assert by["whisper 5"] == by["whisper 19"] and [x[0] for x in by["whisper 5"]] == [i for i in range(19) if i % 3]
    with pytest.raises(ValueError):
        parse_transcripts(spark.createDataFrame([("t", 0, TEXTS["a.srt"])], "transcript_id string, n int, text string"), part="n")
