import random

from colloquy.operators.intervals import periods_and_gaps

SCHEMA = "k string, start_ms bigint, end_ms bigint, kind string, note string"


def brute(spans):
    out, by = set(), {}
    for k, s, e in spans:
        if k is not None and s is not None and e is not None and e >= s:
            by.setdefault(k, set()).add((s, e))
    for k, v in by.items():
        a = b = None
        for s, e in sorted(v):
            if b is None:
                a, b = s, e
            elif s <= b:
                b = max(b, e)
            else:
                out |= {(k, "period", a, b), (k, "gap", b, s)}
                a, b = s, e
        out.add((k, "period", a, b))
    return out


def test_random_spans_across_slices(spark):
    r = random.Random(5)
    rows = []
    for k in "abcd":
        for _ in range(150):
            s = r.randrange(-3_000, 40_000)
            rows.append((k, s, s + r.choice([0, 5, 50, 400, 9_000 if k == "d" else 90]), "x", None))
    rows += rows[:40] + [(None, 1, 2, None, None), ("a", None, 5, None, None), ("b", 9, None, None, None), ("c", 10, 3, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for width in (100, 7_000, 3_600_000):
        assert {tuple(x) for x in periods_and_gaps(df, ["k"], slice_width=width).collect()} == brute([x[:3] for x in rows])


def test_touching_nested_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 5, None, None), ("a", 5, 9, None, None), ("a", 1, 2, None, None), ("a", 20, 20, None, None)], SCHEMA)
    assert {tuple(x) for x in periods_and_gaps(df, ["k"]).collect()} == {("a", "period", 0, 9), ("a", "gap", 9, 20), ("a", "period", 20, 20)}
    assert periods_and_gaps(df.limit(0), ["k"]).count() == 0
