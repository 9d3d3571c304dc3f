import json

from colloquy.operators.nested import flatten_payloads

REV = {"monologues": [{"speaker": 0, "elements": [{"type": "text", "value": "Hi"}, None, {"type": "punct", "value": " "}, {"value": 3.50}]}, {"elements": {"value": "alone"}}]}
AWS = {"results": {"items": [{"alternatives": [{"content": "a"}, {"content": "b"}]}, {"alternatives": []}, {"alternatives": {"content": "c"}}]}}
GOOGLE = {"results": [{"channelTag": 1}, {"alternatives": [{"words": [{"word": ""}, {"word": "x"}]}, {"words": [{"word": "no"}]}]}]}


def tokens(spark, bodies):
    df = spark.createDataFrame([(i, b, "?") for i, b in bodies], "payload_id bigint, body string, token string")
    return {tuple(r) for r in flatten_payloads(df)["tokens"].select("payload_id", "record_pos", "parent_pos", "child_pos", "token").collect()}


def test_shapes(spark):
    rev = json.dumps(REV).replace("3.5", "3.50")
    bodies = [(1, rev), (1, rev), (2, json.dumps([None, AWS, GOOGLE])), (3, json.dumps(json.dumps({"job": {"id": 1, "data": AWS}}))), (4, "﻿" + json.dumps({"output": GOOGLE, "status": "done"})), (5, rev[:-9]), (6, "<html>"), (7, ""), (8, None), (9, "null"), (10, "{}"), (None, rev)]
    assert tokens(spark, bodies) == {
        (1, 0, 0, 0, "Hi"), (1, 0, 0, 3, "3.50"), (1, 0, 1, 0, "alone"), (2, 1, 0, 0, "a"), (2, 1, 0, 2, "c"), (2, 2, 1, 1, "x"),
        (3, 0, 0, 0, "a"), (3, 0, 0, 2, "c"), (4, 0, 1, 1, "x"),
    }


def test_wrapping_has_no_bound(spark):
    deep = AWS
    for i in range(9):
        deep = {"job": {"data": [deep]}} if i % 3 else {"note": "[not JSON", "inner": json.dumps(deep)}
    assert tokens(spark, [(1, json.dumps(deep)), (2, json.dumps(AWS))]) == {(k, 0, 0, i, t) for k in (1, 2) for i, t in ((0, "a"), (2, "c"))}


def test_parents_and_records(spark):
    df = spark.createDataFrame([(1, json.dumps(REV))], "payload_id bigint, body string")
    t = flatten_payloads(df)
    assert [tuple(r) for r in t["parents"].orderBy("parent_pos").collect()] == [(1, 0, 0, "0", 4), (1, 0, 1, None, 1)]
    assert [tuple(r) for r in t["records"].collect()] == [(1, 0, "rev")]
    assert flatten_payloads(df.limit(0))["tokens"].count() == 0
