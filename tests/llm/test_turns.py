import random

import pytest
import regex
from pyspark.sql import functions as F

from colloquy.llm import names, spoken
from colloquy.llm import turns as T
from colloquy.llm.noise import HEAD, LABEL, NOTES, TIME, base_language, is_sound
from colloquy.llm.repeats import _events, _may_be_the_same, repeated_events, same_statement

TURN = "transcript_id bigint, turn_index int, text string, speaker string, raw_speaker string, start_ms bigint, end_ms bigint, words string"
REC = "transcript_id bigint, workspace_id string, lang string, speaker string"


def offset_ms(text):
    whole, _, part = text.replace(",", ".").partition(".")
    n = 0
    for x in whole.split(":"):
        n = n * 60 + int(x)
    return n * 1000 + int((part + "000")[:3])


def somebody(label):
    """A numbered machine label, or a word of two letters or more that says who it is."""
    bare = regex.sub(r"\s*(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})", " ", label)
    for w in regex.split(r"[\s,;/&+_]+", (bare if regex.search(r"[\p{L}\p{Nd}]", bare) else label).lower()):
        t = regex.sub(r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "", w)
        cut = w.endswith(("…", "...")) or (w.endswith(".") and len(t) >= 3)
        if len(t) >= 2 and t not in [*names.FILLERS, *names.LEGAL, *names.TITLES] and (not cut or t in names.ORGANISATIONS):
            return True
    return bool(regex.match(names.MACHINE, label, regex.I))


def plain_read(text, labelled, lang):
    """What the SQL expressions must give, as a plain loop: time at the head, label, words."""
    text, head, label = text or "", None, None
    for _ in range(2):
        if head is None and (m := regex.match(HEAD, text)):
            head, text = offset_ms(regex.search(TIME, m[0])[0]), text[m.end() :]
        if not labelled and label is None and (m := regex.match(LABEL, text)) and len(m[1].split()) <= 6 and somebody(m[1]):
            label, text = m[1], text[m.end() :]
        else:
            break
    words = regex.findall(r"[\p{L}\p{M}\p{Nd}]+", regex.sub(NOTES, " ", text, flags=regex.I))
    return head, label, [w for w in words if not is_sound(w, base_language(lang))]


def frames(spark, rows, recordings=((1, "w", "en", "x"),)):
    t = spark.createDataFrame([(a, b, c, "?", d, e, None, "clash") for a, b, c, d, e in rows], TURN)
    return t, spark.createDataFrame(list(recordings), REC)


def clean(spark, *a):
    return [tuple(r) for r in T.clean_turns(*frames(spark, *a)).select("transcript_id", "first_turn_index", "last_turn_index", "words").orderBy("transcript_id", "first_turn_index").collect()]


@pytest.mark.parametrize(("text", "labelled", "lang", "want"), [
    ("[00:00:42] Ann Lee: Um, well [laughter] 5 p.m.", False, "en", (42_000, "Ann Lee", ["well", "5", "p", "m"])), ("00:00:34.425 - er was, you know", True, "de", (34_425, None, ["er", "was", "you", "know"])), ("<00:01:53.592>We close", True, "en", (113_592, None, ["We", "close"])),
    ("(the auditor, i.e. the new one) (applause)", True, "en", (None, None, ["the", "auditor", "i", "e", "the", "new", "one"])), ("#unclear# ♪ soft music ♪ {noise} <sighs> *coughs*", True, None, (None, None, [])), ("ดร.มีนา", True, "th", (None, None, ["ดร", "มีนา"])), ("15 children", True, "en", (None, None, ["15", "children"])), (None, True, None, (None, None, [])),
])
def test_read_fields(spark, text, labelled, lang, want):
    assert plain_read(text, labelled, lang) == want
    row = T.read_fields(spark.createDataFrame([(text, "x" if labelled else None, lang)], "text string, raw string, lang string")).first()
    assert (row.head_ms, row.label, row.words.split()) == want


def test_random_texts_are_read_as_by_a_plain_loop(spark):
    r = random.Random(5)
    bits = ["[00:01:02]", "(1:02)", "00:00:34.425 - ", "Ann Lee: ", "the: ", ">> Bo Ray: ", "well", "um,", "uhm", "[laughter]", "(applause)", "(the auditor)", "♪ la ♪", "#noise#", "*coughs*", "<b>", "5.30", "Zoë's", "嗯", "患者は", "ดร.มีนา", "äh", "euh", "00:01:02", "\n", "12:", "  ", "we saw it", "Mm-hm", "{x}", "!", "a*b"]
    rows = [("".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(8))), r.choice(["x", None]), r.choice(["en", "de-AT", "fr", "zh", None])) for _ in range(3000)]
    got = T.read_fields(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, text string, raw string, lang string")).orderBy("i").collect()
    for x, (text, raw, lang) in zip(got, rows):
        assert (x.head_ms, x.label, x.words.split()) == plain_read(text, raw is not None, lang), text


def test_java_compiles_every_method_that_reads_fields(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = T.read_fields(spark.createDataFrame([("um, yes", None, "en")], "text string, raw string, lang string"))._jdf.queryExecution().debug().codegenToSeq()
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000  # larger ones are interpreted


def test_clock_times(spark):
    x = spark.createDataFrame([("1:02",), ("00:01:02,5",), ("1:00:00.007",), ("",)], "c string")
    assert [r[0] for r in x.select(T.clock_ms(F.col("c"))).collect()] == [62_000, 62_500, 3_600_007, None]


def test_spoken_order_labels_and_noise(spark):
    rows = [
        (1, 0, "late", "Ann Lee", 9000), (1, 1, "follows it", "Ann Lee", None), (1, 2, "(00:01) early", "Bo Ray", None), (1, 3, "uhm...", "Cy Kay", None), (1, 4, "Bo Ray: again", None, 1500), (1, 5, "who?", None, 1600), (1, 5, "who?", None, 1600), (1, 6, "me", None, 1600),
        (None, 1, "x", None, 1), (1, None, "x", None, 1), (1, 7, None, "Ann Lee", 9001), (1, 8, "ANN", "ANN LEE", 9002), (9, 1, "no such recording", None, None), (9, 0, "b", None, None),
    ]
    assert clean(spark, rows) == [(1, 0, 8, "late follows it ann"), (1, 2, 4, "early again"), (1, 5, 6, "who me"), (9, 0, 1, "b no such recording")]


def test_empty_tables(spark):
    t, r = frames(spark, [(1, 0, "x", None, None)])
    assert T.clean_turns(t.limit(0), r).count() == 0 and T.clean_turns(t, r.limit(0)).count() == 1 and repeated_events(t.limit(0), r).count() == 0


@pytest.mark.parametrize(("partitions", "block"), [("1", 50_000), ("4", 16)])
def test_equals_a_plain_loop_however_it_is_cut(spark, monkeypatch, partitions, block):
    monkeypatch.setattr(spoken, "BLOCK", block)
    monkeypatch.setattr(spoken, "SLICE", 2000)
    r = random.Random(7)
    rows = []
    for t in (1, 2, 3):
        for i in range(40 if t > 1 else 400):
            rows.append((t, i, r.choice(["yes", "um", "we saw the new plan today", "we saw the nwe plan today", "ticket 5 is closed now", ""]), r.choice(["Ann Lee", "Bo Ray"]), r.choice([None, 100 * i, 100 * r.randrange(400)])))
    order = {}
    for t in (1, 2, 3):
        at, seq = -1, []
        for x in (x for x in rows if x[0] == t):
            at = x[4] if x[4] is not None else at
            seq.append((at, x[1], x[3], " ".join(plain_read(x[2], True, "en")[2])))
        order[t] = [x for x in sorted(seq) if x[3]]
    joined, repeats = [], []
    for t, seq in order.items():
        k = 0
        while k < len(seq):
            n = k
            while n + 1 < len(seq) and seq[n + 1][2] == seq[k][2]:
                n += 1
            joined.append((t, seq[k][1], seq[n][1], " ".join(x[3] for x in seq[k : n + 1]).lower()))
            k = n + 1
        k = 0
        while k < len(seq):
            n = k
            while n + 1 < len(seq) and seq[n + 1][2] == seq[k][2] and same_statement(seq[n][3], seq[n + 1][3]):
                n += 1
            if n > k:
                repeats.append((t, seq[k][1], seq[n][1], n - k + 1))
            k = n + 1
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        tt, rr = frames(spark, rows + rows[:50], [(i, "w", None, "x") for i in (1, 2, 3)])
        got = sorted(tuple(x) for x in T.clean_turns(tt, rr).select("transcript_id", "first_turn_index", "last_turn_index", "words").collect())
        rep = sorted(tuple(x) for x in repeated_events(tt, rr).select("transcript_id", "first_turn_index", "last_turn_index", "n_turns").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(joined) and rep == sorted(repeats)


@pytest.mark.parametrize(("partitions", "block"), [("1", 50_000), ("4", 50_000), ("97", 50_000), ("4", 3)])
def test_runs_whose_turns_differ_in_several_spots_stay_whole(spark, monkeypatch, partitions, block):
    monkeypatch.setattr(spoken, "BLOCK", block)
    monkeypatch.setattr(spoken, "SLICE", 500)
    run = ["we will meet at the office again next week", "we will gather at the office again next week", "we will meet at the office again some day", "we will meet at the office again next week"]
    alone = ["the trains were late this morning", "nobody told us about it", "coffee is ready in the kitchen"]
    rows, want = [], set()
    for t in range(40):
        texts = alone[: t % 4] + run + alone[::-1][: t % 3] + run[:2] + [alone[1]] + run[2:3]
        rows += [(t, i, None if t % 5 == 0 else 100 * i, None, None, "ann", x) for i, x in enumerate(texts)]
        a = min(t % 4, 3)
        b = a + 4 + t % 3
        want |= {(t, a, a + 3, 4), (t, b, b + 1, 2)} if b > a + 4 else {(t, a, a + 5, 6)}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        read = spark.createDataFrame(rows, "transcript_id bigint, turn_index bigint, at bigint, start_ms bigint, end_ms bigint, entity string, words string")
        got = {tuple(x) for x in spoken.in_spoken_order(read, read, _events).select("transcript_id", "first_turn_index", "last_turn_index", "n_turns").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


@pytest.mark.parametrize("block", [50_000, 1])
def test_last_known_time_goes_on_into_the_next_block(spark, monkeypatch, block):
    monkeypatch.setattr(spoken, "BLOCK", block)
    monkeypatch.setattr(spoken, "SLICE", 500)
    rows = [(1, 0, 0, 0, 100, "ann", "yes"), (1, 1, 600, None, None, "ann", "Yes"), (1, 2, 1200, None, None, "ann", "yes")]
    read = spark.createDataFrame(rows, "transcript_id bigint, turn_index bigint, at bigint, start_ms bigint, end_ms bigint, entity string, words string")
    assert [tuple(x) for x in spoken.in_spoken_order(read, read, _events).collect()] == [(1, 0, 2, 3, 0, 100, "yes")]


def test_texts_that_say_the_same_are_asked_for(spark):
    r = random.Random(11)
    bits = ["we", "saw", "the", "plan", "today", "meeting", "I", "office", "again", "Berlin", "27", "ok", "患者は", "it"]
    slips = lambda w: r.choice([w, w, w[:-1], w + "x", w[1:2] + w[:1] + w[2:], w.upper()]) or w
    pairs = []
    for _ in range(4000):
        a = [r.choice(bits) for _ in range(r.randrange(1, 9))]
        at, n = r.randrange(len(a)), r.randrange(3)
        b = a[:at] + [r.choice(bits) for _ in range(r.randrange(3))] + a[at + n :]
        pairs.append((" ".join(a), " ".join(map(slips, b)) or "it"))
    same = [p for p in pairs if same_statement(*p)]
    assert len(same) > 300
    x = spark.createDataFrame(same, "a string, b string")
    assert x.where(~_may_be_the_same(F.col("a"), F.col("b"))).count() == 0


@pytest.mark.parametrize(("a", "b", "same"), [
    ("It feels like a long week already", "it feels like a lengthy week already", True), ("page 642 looks fine to me", "page 650 looks fine to me", False), ("My worry is the kitchen pass not the culture", "My worry is the kotchen pass not the culture", True), ("The pasture needs another look before Monday", "The pasture needs one more look by Monday", False),
    ("The pasture needs another look before Monday", "The pasture needs one more look before Monday", True), ("I went through every plan on Friday", "I went through every plan on Monday", False), ("We saw the ewe and left early", "We saw the barn and left early", False), ("Yes", "Sure", False), ("患者は27回目です", "患者は28回目です", False), ("Konrad said the sauce rose", "Konrad said the sauec rose", True),
])
def test_same_statement(a, b, same):
    assert same_statement(a, b) is same and same_statement(b, a) is same
