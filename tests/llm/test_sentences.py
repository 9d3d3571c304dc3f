from colloquy.llm import sentences as S

EN = ["Dr. {} said the grade rose by 46.5 percent.", "We close at 5 p.m. and stop.", "We met at 4 p.m. People underestimate it.", "It is late, p.m. or not.", "No. 43 on the sheet is {}.", "Where were we?", "The U.K. team, e.g. {}, still uses v2.51.1 of it.", "She wrote \"Stop.\" on the hearing.", "I have 29 notes on the appeal alone.", "People went home.", "That makes sense to me.", "{} went home!"]
NAMES = ["Ann", "Bo", "Cy", "Dee"]


def train(spark):
    rows = [(i, " ".join(x.format(NAMES[(i + k) % 4]) for k, x in enumerate(EN[i % 12 :] + EN[: i % 12])), "en") for i in range(120)]
    rows += [(200 + i, EN[i % 12].format(NAMES[i % 4]), "en") for i in range(200)] + [(900, None, None), (901, "", "en")]
    return spark.createDataFrame(rows, "doc bigint, text string, lang string")


def cut(spark, model, texts):
    df = spark.createDataFrame([(i, t, g, 0) for i, (t, g) in enumerate(texts)], "k int, text string, lang string, end_pos int")
    out = {}
    for r in S.sentence_ends(df, model, ["k"]).orderBy("k", "end_pos").collect():
        out.setdefault(r.k, []).append(r.end_pos)
    parts = []
    for i, (t, _) in enumerate(texts):
        a, one = 0, []
        for e in out.get(i, []):
            one.append(t[a:e].strip())
            a = e
        parts.append(one)
    return parts


def test_learned_and_fixed_rules(spark):
    m = S.learn(train(spark))
    learned = {r.a for r in m.where("kind = 'abbreviation'").collect()}
    assert {"dr", "p.m", "no", "e.g", "u.k"} <= learned and not {"alone", "me", "home"} & learned
    got = cut(spark, m, [
        ("Dr. Ann said it. We close at 5 p.m. People went home. No. 43 is late.", "en"), ('She wrote "Stop." on it. "Is it ready?" asked Bo. Wait... is that so?', "en"), ("we close at 5 p.m. people went home? that makes sense to me. no", "en"), ("彼は「もう無理。」と言って帰りました。試料は3.2パーセント増えました！はい", "ja"), ("她说“够了！”然后走了。“好了吗？”顾岑问道。", "zh"),
        ("क्या पाठ तैयार है?क्या फसल तैयार है? \"क्या खेत ठीक है?\" मीरव ने पूछा। ठीक है।", "hi"), ("ขออีกครั้ง ครั้งนี้เป็นครั้งที่9 ดร.มีนา", "th"), ("Tout le monde m'entend ? « Où sont les buts ? », demanda Zoé. Voilà", "fr"), ("", "en"), ("   ", "en"), ("no mark at all", None),
    ])
    assert got == [
        ["Dr. Ann said it.", "We close at 5 p.m.", "People went home.", "No. 43 is late."], ['She wrote "Stop." on it.', '"Is it ready?" asked Bo.', "Wait... is that so?"], ["we close at 5 p.m.", "people went home?", "that makes sense to me.", "no"], ["彼は「もう無理。」と言って帰りました。", "試料は3.2パーセント増えました！", "はい"], ["她说“够了！”然后走了。", "“好了吗？”顾岑问道。"],
        ["क्या पाठ तैयार है?", "क्या फसल तैयार है?", "\"क्या खेत ठीक है?\" मीरव ने पूछा।", "ठीक है।"], ["ขออีกครั้ง", "ครั้งนี้เป็นครั้งที่9", "ดร.มีนา"], ["Tout le monde m'entend ?", "« Où sont les buts ? », demanda Zoé.", "Voilà"], [], [], ["no mark at all"],
    ]


def test_only_json_recordings_and_repeated_rows(spark):
    t = spark.createDataFrame([(1, 0, "One. Two.", "x"), (1, 0, "One. Two.", "x"), (2, 0, "Three.", "x"), (None, 0, "x.", "x"), (3, 0, None, "x")], "transcript_id bigint, turn_index int, text string, lang string")
    r = spark.createDataFrame([(1, "json:aws", None, None), (1, "json:aws", None, None), (2, "vtt", "en", None), (3, "json:aws", "en", None)], "transcript_id bigint, src_format string, lang string, workspace_id string")
    assert sorted(tuple(x) for x in S.turn_sentences(t, r).collect()) == [(1, 0, 4), (1, 0, 9)]
    assert S.turn_sentences(t.limit(0), r).count() == 0
