import random

import pytest

from colloquy.llm import names
from colloquy.llm.graph import components

SAME = [
    ["Dimitri Belsternen", "Belsternen, D", "Dimitri Be1sternen", "BELSTERNEN Dimitri", "d.belsternen", "DimitriBelsternen", ">> DIMITRI BELSTERNEN", "Dimitri Belsternen (Host)", "Dimitri Belsternen - Solvik", 'Dimitri "Dima" Belsternen', "Dima Belsternen", "Dr. Dimitri Belsternen:", "Dimitri Belst…", "Dimitri Besternen", "Dimitri K. Belsternen"],
    ["Zoë Pelcidane", "Zoe Plecidane", "Pelcidane Z."], ["Ferncrag Robotics Association", "The Ferncrag Robotics Assoc.", "Robotics Association, Ferncrag", "Ferncrag Robo. Association", "Ferncrag Robotics", "FRA", "Ferncrag & Robotics Association Ltd."],
]
ALONE = ["Konrad Wynnegren", "Konrad Kashangren", "Konrad", "Speaker 1", "spk_1", "???", ""]


def linked(spark, rows):
    df = spark.createDataFrame([(i, w, x, "s") for i, (w, x) in enumerate(rows)], "label_id bigint, workspace_id string, raw_speaker string, entity string")
    return {(rows[a][1], rows[b][1]) for a, b in names.linked_pairs(df).collect()}


def test_variants_link_and_others_do_not(spark):
    labels = [x for group in SAME for x in group] + ALONE
    rows = [("w", x) for x in labels] + [(None, "Zoë Pelcidane"), ("v", "Zoë Pelcidane"), ("w", None)]
    got = linked(spark, rows)
    want = {(a, b) for g in SAME for i, a in enumerate(g) for b in g[i + 1 :]}
    assert got == want


def test_given_name_joins_only_without_a_rival(spark):
    assert linked(spark, [("w", "Ann Lee"), ("w", "Ann")]) == {("Ann Lee", "Ann")}
    assert linked(spark, [("w", "Ann Lee"), ("w", "Ann"), ("w", "ANN"), ("w", "Ann Mor")]) == set()
    assert linked(spark, [("w", "Pelpehall S."), ("w", "Sam")]) == {("Pelpehall S.", "Sam")}


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "w", "Ann Lee", "x"), (1, "w", "Ann Lee", "x"), (2, "w", "ann lee", "x"), (None, "w", "Ann Lee", "y")], "label_id bigint, workspace_id string, raw_speaker string, kind string")
    assert [tuple(r) for r in names.linked_pairs(df).collect()] == [(1, 2)]
    assert names.linked_pairs(df.limit(0)).count() == 0


def test_blocking_finds_every_pair_that_would_be_accepted(spark):
    r = random.Random(4)
    base = [f"{g} {a}{b}{c}" for g in ("amara", "konrad", "ingrid", "robert") for a in ("bel", "cra", "sto") for b in ("thi", "mo", "ni") for c in ("son", "gren", "wick")]

    def typo(w):
        i = r.randrange(1, len(w) - 1)
        return r.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :], w[:i] + r.choice("aeiostrn") + w[i + 1 :]])

    forms = sorted({" ".join(typo(t) if r.random() < 0.5 else t for t in n.split()) for n in base for _ in range(3)} | set(base))
    token = {f: sorted(f.split()) for f in forms}
    keys = {f: set(names.block_keys(token[f])) for f in forms}
    pairs = [(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if names.same_name(token[a], token[b])]
    missed = [p for p in pairs if not keys[p[0]] & keys[p[1]]]
    assert len(pairs) > 200 and len(missed) <= 0.02 * len(pairs)


@pytest.mark.parametrize(("a", "b", "least"), [("martha", "marhta", 0.961), ("dixon", "dicksonx", 0.813), ("a", "a", 1.0), ("", "a", 0.0)])
def test_jaro_winkler(a, b, least):
    assert abs(names.jaro_winkler(a, b) - least) < 0.001


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_partial_labels_join_a_name_one_slip_apart(spark):
    rows = [("a", "M. Belgomore"), ("a", "Belgomore"), ("a", "Mei-ing Belgomoe"), ("b", "K. Mardorgren"), ("b", "Konrad Mardorgten"), ("c", "S Stogoford [Host]"), ("c", "Stogoford"), ("c", "Ssmuel Stpgoford")]
    assert linked(spark, rows) == {(rows[i][1], rows[j][1]) for i, j in ((0, 1), (0, 2), (1, 2), (3, 4), (5, 6), (5, 7), (6, 7))}
    # another initial, or two names that fit equally: no link
    assert linked(spark, [("a", "T. Mardorgren"), ("a", "Konrad Mardorgten")]) == set()
    assert linked(spark, [("a", "Mardorgren"), ("a", "Konrad Mardorgten"), ("a", "Amara Mardorgsen")]) == set()


def test_long_labels_are_matched_not_permuted():
    many = [f"token{c}{c}" for c in "abcdefghijklmnop"]
    assert names.same_name(many, many[::-1]) and not names.same_name(many, [*many[:-1], "another"]) and not names.same_name(many, many[:-1])
    assert names.same_name(["robert", "anna"], ["anna", "bob"]) and not names.same_name(["ann", "ann"], ["ann", "bob"])
