import random

import numpy as np
import pytest

from colloquy.llm import leaks, mixing, subjects

PASSAGE = "A ribbon, violet and torn, was tied by Amara Kelborand around the copper kite. Under a teal lamp Dimitri Stovagren measured the copper kite at 211 spans. Nobody in the room believed Amara Kelborand when the kite fell behind the frozen mill."
OTHER = PASSAGE.replace("Amara Kelborand", "Konrad Wespestad").replace("copper kite", "linen drum").replace("Dimitri Stovagren", "Zoe Marlotti").replace("211", "87").replace("frozen mill", "upper hall")
FILL = "We still have time. " * 30


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    x = spark.createDataFrame([(i, t, "a") for i, t in items], "item_id bigint, item_text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, x).collect()}


def test_whole_cut_and_edited_passages(spark):
    w = PASSAGE.split()
    cues = "\n\n".join(f"{k + 1}\n00:00:0{k},000 --> 00:00:0{k + 1},000\nAnn Lee: {' '.join(w[k * 7 : k * 7 + 7])}" for k in range(6))
    docs = [
        (1, FILL + PASSAGE + FILL), (2, FILL + " ".join(w[8:30]) + FILL), (3, cues), (4, FILL + PASSAGE.upper()), (5, FILL + PASSAGE.replace("violet", "pink").replace("measured", "mesured").replace("room", "ro​om") + FILL), (6, "<i>" + PASSAGE.replace(" the ", " <b>the</b> ").replace(".", "&#46;") + "</i>"),
        (7, FILL + OTHER), (8, FILL + " ".join(w[:7])), (9, FILL), (10, None), (11, ""), (None, PASSAGE), (1, FILL + PASSAGE + FILL), (12, FILL + " ".join(w[6:14]) + FILL),
    ]
    filler = [(50 + i, OTHER.replace("Konrad Wespestad", f"Kim Bel{c}son").replace("linen", f"tin{c}").replace("87", str(300 + i)).replace("Marlotti", f"Gar{c}ti").replace("upper", f"old{c}")) for i, c in enumerate("abcdefghijklmnopqrst")]
    assert found(spark, docs, [(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, PASSAGE), *filler]) == {(i, 1) for i in (1, 2, 3, 4, 5, 6)}
    assert found(spark, docs[:1], []) == set() and found(spark, [], [(1, PASSAGE)]) == set()


def test_a_passage_under_several_ids_leaks_under_all(spark):
    other = [(50 + i, OTHER.replace("Konrad Wespestad", f"Kim Bel{c}son").replace("linen", f"tin{c}")) for i, c in enumerate("abcdefghi")]
    near = PASSAGE.replace("211", "212")
    assert found(spark, [(1, FILL + PASSAGE + FILL), (2, FILL)], [(1, PASSAGE), (2, PASSAGE), (3, PASSAGE.upper()), (4, near), *other]) == {(1, i) for i in (1, 2, 3, 4)}


def test_every_random_leak_is_found(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("bdfgklmnprstv", k=1) + r.choices("aeiou", k=1) + r.choices("lnrst", k=1) + r.choices("aeiou", k=1) + r.choices("kmnprt", k=1))
    items = [(i, " ".join(word() for _ in range(60))) for i in range(30)]
    docs, want = [], set()
    for i in range(200):
        body = [word() for _ in range(r.randrange(50, 300))]
        if r.random() < 0.4:
            k = r.randrange(30)
            a = r.randrange(0, 30)
            part = items[k][1].split()[a : a + 30]
            at = r.randrange(len(body))
            body[at:at] = part
            want.add((i, k))
        docs.append((i, " ".join(body)))
    assert found(spark, docs, items) == want


def test_without_leaks_and_limit(spark, monkeypatch):
    d = spark.createDataFrame([(1, PASSAGE), (2, FILL)], "doc_id bigint, text string")
    x = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, item_text string")
    assert [r.doc_id for r in leaks.without_leaks(d, leaks.leaked_items(d, x)).collect()] == [2]
    monkeypatch.setattr(leaks, "ITEMS_LIMIT", 5)
    with pytest.raises(ValueError):
        leaks.leaked_items(d, x)


def test_water_filling():
    got = mixing.water_fill({"a": 100.0, "b": 1000.0, "c": 1000.0}, {"a": (0.5, 2), "b": (0.25, 1), "c": (0.25, 3), "d": (0.1, 5)}, 1000)
    assert got == {"a": 200.0, "b": 400.0, "c": 400.0, "d": 0.0}
    assert mixing.water_fill({"a": 10.0}, {"a": (1.0, 2)}, 1000) == {"a": 20.0} and mixing.water_fill({}, {"a": (1.0, 2)}) == {"a": 0.0}


def test_mix(spark):
    rows = [(i, "some words here " * (1 + i % 5), ["Big", "big ", "small", None][i % 4] if i % 4 != 2 or i % 8 == 2 else "other", "en") for i in range(2000)] + [(5000, None, "big", "en"), (5001, "", "small", "en"), (0, "some words here ", "Big", "en")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    rec, shares = mixing.mix_sources(d, t)
    got = rec.collect()
    s = {r.source: r for r in shares.collect()}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= {"big": 1, "small": 3}[r.source] for r in got)
    for k in ("big", "small"):
        assert s[k].mixed_tokens == sum(r.copies * r.n_tokens for r in got if r.source == k) and s[k].n_records == len({i for i, x, c, _ in rows if x and c and c.strip().lower() == k})
    assert abs(s["big"].reached_share - max(0.6, 1 - 3 * s["small"].available_tokens / (s["big"].mixed_tokens + s["small"].mixed_tokens))) < 0.02 and s["none"].reached_share == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(d, t)[0].collect()))
    assert mixing.mix_sources(d.limit(0), t)[0].count() == 0 and mixing.mix_sources(d, t.limit(0))[0].count() == 0


def test_token_counts_are_those_of_the_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = ["Hello, world! It's 3.5 percent.", "試料は3.2パーセント", "<|endoftext|> x\n\n  y", "", None, "a" * 3000]
    got = mixing.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", mixing.VOCABULARY).orderBy("i").collect()
    assert [r.n_tokens for r in got] == [len(tok.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


def test_subjects_on_held_out_documents(spark):
    r = random.Random(9)
    vocabulary = {"law": "court verdict lease appeal statute hearing witness plaintiff".split(), "sport": "goal striker league coach penalty match referee pitch".split(), "cooking": "dough sauce oven recipe broth pastry garlic menu".split()}
    chat = "we can pick that up later and move on to the next point with everyone here today please".split()
    rows, truth = [], {}
    for i in range(600):
        s = [] if i % 5 == 0 else r.sample(sorted(vocabulary), 2 if i % 4 == 0 else 1)
        body = [w for _ in range(12) for w in (r.choices(chat, k=6) + [x for k in s for x in r.choices(vocabulary[k], k=2)])]
        if i % 7 == 0:  # a passing mention
            body.append(r.choice(vocabulary["cooking"]))
        rows.append((i, " ".join(body), "en", "x"))
        truth[i] = set(s)
    labels = [(i, k, "a") for i in range(0, 600, 6) for k in (truth[i] or [None])] + [(0, "unheard of", "b")]
    d = spark.createDataFrame(rows + [(900, None, "en", "x"), (901, "", None, "x"), (902, "we can pick that up", "en", "x"), rows[1]], "doc_id bigint, text string, lang string, subject string")
    areas = spark.createDataFrame([(k, f"About {v[0]}.", 1) for k, v in vocabulary.items()], "subject string, description string, share int")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    got = {}
    for x in subjects.document_subjects(d, areas, lab).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    held = [i for i in truth if i % 6]
    hit = sum(len(truth[i] & got.get(i, set())) for i in held)
    assert hit >= 0.95 * sum(len(truth[i]) for i in held) and hit >= 0.95 * sum(len(got.get(i, ())) for i in held)
    assert not {900, 901, 902} & set(got)
    assert subjects.document_subjects(d.limit(0), areas, lab).count() == 0 and subjects.document_subjects(d, areas.limit(0), lab).count() == 0
    subjects.document_subjects(d, areas, lab.limit(0)).count()


def test_mixture_never_raises_the_divergence():
    r = np.random.default_rng(0)
    common = r.random((1, 30))
    f = subjects.Factors(r.random((2, 30)), common / common.sum(), np.ones((1, 30)), np.ones(30, dtype=bool), np.ones((1, 2)))
    col, row, n = np.tile(np.arange(30), 4), np.repeat(np.arange(4), 30), r.integers(1, 9, 120).astype(np.float32)
    last = np.inf
    for steps in (1, 2, 4, 8, 16):
        w, _, g = f.mixture(col, n, row, 4, steps)
        h = np.concatenate([f.h * f.scale[0][:, None], f.common[:1]])
        fit = (w @ h)[row, col]
        now = float((n * np.log(n / fit) - n + fit).sum())
        assert now <= last * (1 + 1e-4) + 1e-3
        last = now


def test_one_label_opens_a_subject_in_a_language(spark):
    r = random.Random(5)
    made = lambda end: ["".join(r.choices("bdfgklmnprst")) + r.choice("aeiou") + "".join(r.choices("lnrst")) + r.choice("aeiou") + end for _ in range(8)]
    subject = ["law", "sport", "cooking", "farming", "travel", "finance"]
    vocabulary = {(g, s): made(g + "mk"[i % 2] + str("aeiouy"[i])) for g in ("en", "de") for i, s in enumerate(subject)}
    chat = {g: made(g + "zz") + made(g + "xx") for g in ("en", "de")}
    rows, truth = [], {}
    for i in range(900):
        g, s = "en" if i < 600 else "de", subject[i % 6] if i % 5 else None
        rows.append((i, " ".join(w for _ in range(12) for w in r.choices(chat[g], k=6) + (r.choices(vocabulary[g, s], k=2) if s else [])), g))
        truth[i] = s
    one = {truth[i]: i for i in range(600, 900) if truth[i]}
    labels = [(i, truth[i]) for i in range(0, 600, 4)] + [(i, s) for s, i in one.items()]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    areas = spark.createDataFrame([(s, f"All of {s}.") for s in subject], "subject string, description string")
    got = {(x.doc_id, x.subject) for x in subjects.document_subjects(d, areas, spark.createDataFrame(labels, "doc_id bigint, subject string")).collect()}
    want = {(i, s) for i, s in truth.items() if s and i >= 600 and i not in one.values()}
    there = {x for x in got if x[0] >= 600 and x[0] not in one.values()}
    assert len(want & there) >= 0.95 * len(want) and len(want & there) >= 0.95 * len(there)


def test_ten_times_the_labels_give_the_same_subjects(spark):
    r = random.Random(11)
    made = lambda end, n: ["".join(r.choices("bdfgklmnprst")) + r.choice("aeiou") + "".join(r.choices("lnrst")) + r.choice("aeiou") + end + "aeiou"[i % 5] + "krst"[i // 5 % 4] for i in range(n)]
    subject = ["law", "sport", "cooking", "farming", "travel", "finance"]
    vocabulary = {(g, s): made(g + "mk"[i % 2] + "aeiouy"[i], 20) for g in ("en", "de", "fr") for i, s in enumerate(subject)}
    chat, names = {g: made(g + "zz", 20) for g in ("en", "de", "fr")}, made("nn", 20)
    rows, truth = [], {}
    for i in range(2000):
        g = "en" if i % 10 < 7 else "de" if i % 10 < 9 else "fr"
        s = r.sample(subject, r.choice([0, 1, 1, 1, 2]))
        body = [w for _ in range(10) for w in r.choices(chat[g], k=6) + r.choices(names, k=1) + [x for k in s for x in r.choices(vocabulary[g, k], k=2)]]
        body += r.choices(chat["en"], k=2) if i % 9 == 0 else []  # words of the large language strewn into the small ones
        rows.append((i, " ".join(body), g))
        truth[i] = set(s)
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    areas = spark.createDataFrame([(k, f"About {k}.") for k in subject], "subject string, description string")
    sizes = []
    for n in (150, 1500):
        labels = [(i, k if r.random() > 0.1 else r.choice(subject)) for i in r.sample(range(2000), n) for k in (truth[i] or [None])]
        got = [(x.doc_id, x.subject) for x in subjects.document_subjects(d, areas, spark.createDataFrame(labels, "doc_id bigint, subject string")).collect()]
        right = sum(s in truth[i] for i, s in got)
        assert right >= 0.9 * len(got) and right >= 0.9 * sum(map(len, truth.values()))
        sizes.append(len(got))
    assert abs(sizes[1] - sizes[0]) <= 0.1 * sizes[0]


def test_rare_languages_have_subjects_too(spark, monkeypatch):
    r = random.Random(4)
    languages = [chr(97 + i) * 2 for i in range(15)]
    rows, truth = [], {}
    subject = ["law", "sport", "cooking", "farming", "travel"]
    for i in range(1800):
        g, s = languages[i % 15], [None, *subject][i // 15 % 6]
        rows.append((i, " ".join(w for _ in range(10) for w in [f"{g}chat{r.randrange(9)}x" for _ in range(5)] + ([f"{g}{s}{'abcdefghijkl'[r.randrange(12)]}" for _ in range(2)] if s else [])), g))
        truth[i] = s
    labels = [(i, truth[i]) for i in range(1800) if i // 90 % 2]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    areas = spark.createDataFrame([(k, "") for k in subject], "subject string, description string")
    want = {(i, s) for i, s in truth.items() if s}
    for own, least in ((32, 0.9), (12, 0.7)):  # the last three languages share a component
        monkeypatch.setattr(subjects, "LANGUAGES", own)
        got = {(x.doc_id, x.subject) for x in subjects.document_subjects(d, areas, spark.createDataFrame(labels, "doc_id bigint, subject string")).collect()}
        assert len(got & want) >= 0.9 * len(got)
        for g in range(15):
            mine = {x for x in want if x[0] % 15 == g}
            assert len(got & mine) >= (0.9 if g < 12 else least) * len(mine), languages[g]
