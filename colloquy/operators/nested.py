"""Deeply nested vendor responses into flat tables with parent-child links.

Bodies stay raw JSON text until a level is needed: each level is read as an array or map of raw texts, so optional
fields, lone objects in place of arrays, and numbers as written all survive. Nested transforms attach the positions of
the ancestors, flatten joins the arrays, and one inline per target table emits its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut

#: Levels of wrapping (objects, arrays, JSON inside a string) that one pass searches for responses; passes go on while any body is deeper.
LEVELS = 6


def _array(text: Column) -> Column:
    """Raw texts of the elements; a lone value stands for an array of one; NULL: empty."""
    t = F.ltrim(text)
    many = F.from_json(text, "array<string>")
    return F.when(t.startswith("["), F.coalesce(many, F.array().cast("array<string>"))).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def _object(text: Column) -> Column:
    """The fields as raw texts; NULL if it is no object."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def _raw(text: Column, name: str) -> Column:
    """A field as raw text; NULL if it is no object."""
    return F.from_json(text, f"{name} string")[name]


def _unquoted(text: Column) -> Column:
    """The content of a JSON string; other texts as they are."""
    return F.when(F.ltrim(text).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))).otherwise(text)


def _numbers_as_text(text: Column) -> Column:
    """JSON with its numbers in quotation marks, so that no reader writes 3.50 anew as 3.5; strings are passed over whole."""
    marked = F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(?<![\w.+-])(-?\d[\d.eE+-]*+)', "$1\u0001$2\u0001")
    return F.replace(F.replace(marked, F.lit("\u0001\u0001"), F.lit("")), F.lit("\u0001"), F.lit('"'))


def _is_response(text: Column) -> Column:
    return F.ltrim(text).startswith("{") & (F.get_json_object(text, "$.monologues").isNotNull() | F.get_json_object(text, "$.results").isNotNull())


def _level(candidates: Column) -> Column:
    """One level down from every candidate that is no response yet; positions come from the arrays on the way."""

    def down(c: Column) -> Column:
        text = _unquoted(c["text"])
        text = F.when(F.ltrim(c["text"]).startswith('"'), _numbers_as_text(text)).otherwise(text)
        t = F.ltrim(text)
        at = lambda x, i: F.struct(i.cast("bigint").alias("pos"), x.alias("text"))
        same = lambda x: F.struct(c["pos"].alias("pos"), x.alias("text"))
        return (
            F.when(_is_response(text), F.array(same(text)))
            .when(t.startswith("["), F.transform(F.from_json(text, "array<string>"), at))
            .when(t.startswith("{"), F.transform(F.map_values(F.from_json(text, "map<string,string>")), same))
            .otherwise(F.array(same(text)))
        )

    return F.flatten(F.filter(F.transform(candidates, down), lambda x: x.isNotNull()))


def _goes_deeper(c: Column) -> Column:
    """Whether a candidate is no response but an array or object, also one inside a string."""
    t = F.ltrim(_unquoted(c["text"]))
    return ~F.coalesce(_is_response(c["text"]), F.lit(False)) & F.coalesce(t.startswith("[") | t.startswith("{"), F.lit(False))


def responses(payloads: DataFrame, key: str = "payload_id", body: str = "body") -> DataFrame:
    """One row per vendor response: key, `record_pos`, `vendor` as the structure shows it, `root` (raw text).

    Repeated payloads (same key) count once. A response is an object with `monologues` or `results`, alone, in an array
    (its position there), wrapped in other objects, or written as JSON inside a string. NULL, empty, broken or cut
    bodies and bodies without a response give no row.
    """
    x = payloads.select(F.col(key).alias("_key"), F.regexp_replace(F.col(body), "^﻿", "").alias("_body")).where(F.col("_key").isNotNull()).dropDuplicates(["_key"])
    x = x.where(F.try_parse_json("_body").isNotNull())
    plain = F.when(F.ltrim("_body").startswith('"'), F.col("_body")).otherwise(_numbers_as_text(F.col("_body")))
    c = F.array(F.struct(F.lit(0).cast("bigint").alias("pos"), plain.alias("text")))
    x = x.select("_key", c.alias("_c"))
    out = None
    while True:
        for _ in range(LEVELS):
            x = x.select("_key", _level(F.col("_c")).alias("_c"))
        x = x.withColumn("_deeper", F.exists("_c", _goes_deeper))
        x = cut(x.withColumn("_c", F.when(F.col("_deeper"), F.col("_c")).otherwise(F.filter("_c", lambda r: _is_response(r["text"])))))
        done = x.where("NOT _deeper").select("_key", "_c")
        out = done if out is None else out.unionByName(done)
        x = x.where("_deeper").select("_key", "_c")
        if x.isEmpty():
            break
    x = out.select("_key", F.inline(F.filter("_c", lambda r: _is_response(r["text"]))))
    x = x.select("_key", "pos", _raw(F.col("text"), "monologues").alias("_m"), _raw(F.col("text"), "results").alias("_r"))
    vendor = F.when(F.col("_m").isNotNull(), "rev").when(F.get_json_object("_r", "$.items").isNotNull(), "aws_transcribe").otherwise("google_stt")
    return x.select(F.col("_key").alias(key), F.col("pos").alias("record_pos"), vendor.alias("vendor"), F.coalesce("_m", "_r").alias("root"))


def _first_alternative(text: Column) -> Column:
    return F.get(_array(_raw(text, "alternatives")), F.lit(0))


def _nodes(x: DataFrame, key: str) -> DataFrame:
    """One row per response with its parents (monologues, results, or the one AWS result) as raw texts of their children."""
    children = lambda parent: (
        F.when(F.col("vendor") == "rev", _raw(parent, "elements"))
        .when(F.col("vendor") == "aws_transcribe", _raw(parent, "items"))
        .otherwise(_raw(_first_alternative(parent), "words"))
    )
    parents = F.when(F.col("vendor") == "aws_transcribe", F.array("root")).otherwise(_array(F.col("root")))
    return x.select(key, "record_pos", "vendor", F.transform(parents, lambda p, i: F.struct(i.cast("bigint").alias("parent_pos"), p.alias("parent"), _array(children(p)).alias("children"))).alias("_parents"))


def flatten_payloads(payloads: DataFrame, key: str = "payload_id", body: str = "body") -> dict[str, DataFrame]:
    """The tables `records`, `parents` and `tokens`, linked by key, `record_pos` and `parent_pos` (all 0-based).

    tokens: one row per element with a non-blank token - Rev element `value`, AWS item `content` and Google `word`, the
    latter two from the first alternative - with `kind`, `start` and `end` as written. NULL and empty elements count for
    the positions but give no row. See `responses` for bodies that give none.
    """
    r = responses(payloads, key, body)
    n = _nodes(r, key)
    token = lambda c: (
        F.when(F.col("vendor") == "rev", _raw(c, "value"))
        .when(F.col("vendor") == "aws_transcribe", _raw(_first_alternative(c), "content"))
        .otherwise(_raw(c, "word"))
    )
    either = lambda c, *names: F.coalesce(*[F.get_json_object(c, f"$.{x}") for x in names])
    child = lambda p: lambda c, i: F.struct(
        p["parent_pos"].alias("parent_pos"), i.cast("bigint").alias("child_pos"), token(c).alias("token"), either(c, "type").alias("kind"), either(c, "ts", "start_time", "startTime").alias("start"), either(c, "end_ts", "end_time", "endTime").alias("end")
    )
    rows = F.flatten(F.transform("_parents", lambda p: F.transform(p["children"], child(p))))
    return {
        "records": r.select(key, "record_pos", "vendor"),
        "parents": n.select(key, "record_pos", F.inline("_parents")).select(key, "record_pos", "parent_pos", F.get_json_object("parent", "$.speaker").alias("speaker"), F.size("children").cast("bigint").alias("n_children")),
        "tokens": n.select(key, "record_pos", F.inline(F.filter(rows, lambda t: t["token"].isNotNull() & t["token"].rlike(r"(?U)\S")))),
    }
