"""Mixed time notations to one UTC instant.

An ordered cascade of anchored patterns; the first pattern that matches decides, and a value that then fails strict
parsing (month 13, second 75) has no instant. Everything stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Zone abbreviations and their offset from UTC in minutes.
ZONE_MINUTES = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "BRST": -120,
}
#: Month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"\s?(Z|z|[A-Z]{2,4}|[+-]\d{2}(?::?\d{2})?)?"
_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?"
#: name, pattern, template `name|year|month|day|hour|minute|second|fraction|half of day|zone`; `slashed` has month and day by locale.
CLOCK_FORMATS = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_CLOCK}{_ZONE}$", "iso|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", "basic|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK}{_ZONE}$", "dotted|$3|$2|$1|$4|$5|$6|$7||$8"),
    ("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK}(?: ?([AaPp][Mm]))?{_ZONE}$", "slashed|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("day_month", rf"^(\d{{1,2}})\.? ([A-Za-z]{{3}})[a-z]*\.? (\d{{4}}),? {_CLOCK}(?: ?([AaPp][Mm]))?{_ZONE}$", "day_month|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_day", rf"^([A-Za-z]{{3}})[a-z]*\.? (\d{{1,2}}), (\d{{4}}),? {_CLOCK}(?: ?([AaPp][Mm]))?{_ZONE}$", "month_day|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)
_NUMBER = r"^\+?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d{1,2})?$"
#: name, pattern, template `name|hours|minutes|seconds` (`ms|milliseconds`).
OFFSET_FORMATS = (
    ("ms", r"^\+?(\d+(?:\.\d*)?|\.\d+)\s?ms$", "ms|$1"),
    ("seconds", r"^\+?(\d+(?:\.\d*)?|\.\d+)\s?(?:s|sec|secs|seconds)$", "seconds|||$1"),
    ("duration", r"^PT(?=\d)(?:(\d{1,6})H)?(?:(\d{1,8})M)?(?:(\d{1,10}(?:[.,]\d{1,9})?)S)?$", "duration|$1|$2|$3"),
    ("letters", r"^(?=\d)(?:(\d{1,6})h)?\s?(?:(\d{1,8})m)?\s?(?:(\d{1,10}(?:\.\d{1,9})?)s)?$", "letters|$1|$2|$3"),
    ("colons", r"^(?:(\d{1,3}):)?(\d{1,3}):(\d{2}(?:[.,]\d{1,9})?)$", "colons|$1|$2|$3"),
)
#: A bare number from here on counts from 1970, not from the start of a recording: 10^9 seconds are 31 years.
EPOCH_SECONDS_FROM, EPOCH_MILLIS_FROM = 1.0e9, 1.0e11


def known_zones(spark: SparkSession) -> list[str]:
    """Zone ids that the JVM can resolve; a `tz` outside this list counts as absent instead of failing the job."""
    return sorted(str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _fields(raw: Column, formats: tuple) -> Column:
    """The first pattern of `formats` that matches, rewritten as its template: one string of fields joined by `|`; NULL: none matches."""
    out = F.lit(None).cast("string")
    for _, pattern, template in reversed(formats):
        out = F.when(raw.rlike(pattern), F.regexp_replace(raw, pattern, template)).otherwise(out)
    return out


def _field(k: int, of: str) -> Column:
    return F.nullif(F.get(F.col(of), F.lit(k)), F.lit(""))


def _offset_ms(raw: Column, vendor: Column) -> Column:
    """Milliseconds from the start of the recording; needs `_number`, `_o` (fields of OFFSET_FORMATS)."""
    part = lambda k: F.coalesce(F.replace(_field(k, "_o"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    kind = _field(0, "_o")
    in_range = (kind != "colons") | ((part(3) < 60) & (_field(1, "_o").isNull() | (part(2) < 60)))
    proto = F.coalesce(F.get_json_object(raw, "$.seconds").try_cast("double"), F.lit(0.0)) * 1000 + F.coalesce(F.get_json_object(raw, "$.nanos").try_cast("double"), F.lit(0.0)) / 1e6
    return (
        F.when(F.col("_number").isNotNull(), F.when(F.col("_number") < EPOCH_SECONDS_FROM, F.col("_number") * F.when(vendor == "assemblyai", 1.0).otherwise(1000.0)))
        .when(kind == "ms", part(1))
        .when(kind.isNotNull() & in_range, (part(1) * 3600 + part(2) * 60 + part(3)) * 1000)
        .when(raw.rlike(r'^\{.*"(seconds|nanos)".*\}$'), proto)
    )


def _epoch_ms() -> Column:
    n = F.col("_number")
    return F.when(n >= EPOCH_MILLIS_FROM, n).when(n >= EPOCH_SECONDS_FROM, n * 1000)


def _wall(locale: Column) -> Column:
    """Wall-clock microseconds as if in UTC; needs `_c` (fields of CLOCK_FORMATS)."""
    named = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(_field(2, "_c"), 1, 3))).cast("int"), F.lit(0))
    first, second_ = F.coalesce(named, _field(2, "_c").try_cast("int")), _field(3, "_c").try_cast("int")
    day_first = (_field(0, "_c") == "slashed") & (F.coalesce(locale, F.lit("")) != "en-US")
    month, day = F.when(day_first, second_).otherwise(first), F.when(day_first, first).otherwise(second_)
    h, half = _field(4, "_c").try_cast("int"), F.lower(_field(8, "_c"))
    hour = F.when(half.isNull(), h).when(h.between(1, 12), h % 12 + F.when(half == "pm", 12).otherwise(0))
    second = F.when(_field(6, "_c").try_cast("int") < 60, F.concat(_field(6, "_c"), F.lit("."), F.rpad(F.substring(F.coalesce(_field(7, "_c"), F.lit("0")), 1, 6), 6, "0")).try_cast("decimal(16,6)"))
    return F.unix_micros(F.try_make_timestamp(_field(1, "_c").try_cast("int"), month, day, hour, _field(5, "_c").try_cast("int"), second, F.lit("UTC")))


def _written_offset_min(zone: Column) -> Column:
    """Minutes east of UTC of a written zone; NULL if it is none that is known."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv]), F.upper(zone))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1))
    return F.when(zone.rlike("^[+-]"), numeric).otherwise(named).cast("bigint")


def to_utc(values: DataFrame, recordings: DataFrame, key: str = "time_id", raw: str = "start_raw") -> DataFrame:
    """One row per `key` of `values` whose `raw` names one instant: the key and `start_utc_ms`.

    `values` needs `key`, `transcript_id`, `vendor`, `raw`; `recordings` needs `transcript_id`, `recorded_at`, `tz`,
    `locale`, `duration_ms`; further columns are ignored, repeated rows (same key) count once.
    Policies: a bare number is an offset in the vendor's unit (assemblyai milliseconds, any other or NULL vendor seconds)
    unless it is so large that it counts from 1970; a local time that never occurred has no row; of a local time that
    occurred twice the instant nearest to the recording counts (inside it: distance 0), the earlier one in a tie; without
    `recorded_at` such a time has no row. NULL, empty, sentinel and broken values, unknown zones: no row.
    """
    spark = values.sparkSession
    v = values.select(F.col(key).alias("_key"), F.col("transcript_id").alias("_t"), F.lower(F.trim("vendor")).alias("_vendor"), F.trim(F.col(raw)).alias("_raw")).dropDuplicates(["_key"]).where(F.col("_key").isNotNull() & (F.col("_raw") != ""))
    raw = F.col("_raw")
    v = v.select("*", F.when(raw.rlike(_NUMBER), raw.try_cast("double")).alias("_number"), F.split(_fields(raw, OFFSET_FORMATS), r"\|").alias("_o"), F.split(_fields(raw, CLOCK_FORMATS), r"\|").alias("_c"))
    r = recordings.select(
        F.col("transcript_id").alias("_t"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("_rec"), F.when(F.col("tz").isin(known_zones(spark)), F.col("tz")).alias("_tz"), F.col("locale").alias("_locale"), (F.greatest(F.col("duration_ms"), F.lit(0)) * 1000).alias("_dur")
    ).dropDuplicates(["_t"])
    x = v.join(r, "_t", "left")
    x = x.select("_key", "_rec", "_tz", "_dur", F.round(_offset_ms(raw, F.col("_vendor"))).cast("bigint").alias("_offset"), F.round(_epoch_ms()).cast("bigint").alias("_epoch"), _wall(F.col("_locale")).alias("_wall"), F.when(F.col("_c").isNotNull(), F.get("_c", F.lit(9))).alias("_zone"))
    day = 86_400_000_000
    shift = lambda at: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), F.col("_tz"))) - at
    local = (F.col("_zone") == "") & F.col("_tz").isNotNull()
    for name, at in (("_a", F.col("_wall") - day), ("_b", F.col("_wall") + day)):  # the offsets in force on either side of a change
        x = x.withColumn(name, F.when(local, F.col("_wall") - shift(at)))
        x = x.withColumn(name, F.when(F.col(name) + shift(F.col(name)) == F.col("_wall"), F.col(name)))
    away = lambda u: F.greatest(F.col("_rec") - u, u - F.col("_rec") - F.coalesce("_dur", F.lit(0)), F.lit(0))
    one, two = F.least("_a", "_b"), F.greatest("_a", "_b")
    chosen = F.when(one == two, one).when(F.col("_rec").isNotNull(), F.when(away(two) < away(one), two).otherwise(one))
    written = F.col("_wall") - _written_offset_min(F.nullif(F.col("_zone"), F.lit(""))) * 60_000_000
    ms = F.coalesce(F.floor(F.col("_rec") / 1000) + F.col("_offset"), F.col("_epoch"), F.floor(F.coalesce(written, chosen) / 1000))
    # a generator, not a filter: a filter would be pushed down with the whole cascade substituted into it
    return x.select(F.col("_key").alias(key), F.explode(F.array_compact(F.array(ms.cast("bigint")))).alias("start_utc_ms"))
