from datetime import datetime, timezone

import pytest

from colloquy.operators.times import to_utc

REC = datetime(2024, 11, 3, 8, 30, tzinfo=timezone.utc)  # 01:30 PDT, the hour that comes twice
CASES = [
    ("12.5", "deepgram", "UTC", 12_500), ("12500", "AssemblyAI", "UTC", 12_500), ("1.19228000e+02", "deepgram", "UTC", 119_228), ("50.992000s", "google_stt", "UTC", 50_992), ("250ms", "deepgram", "UTC", 250),
    ('{"seconds":"11","nanos":626000000}', "google_stt", "UTC", 11_626), ('{"nanos": 5000000}', "google_stt", "UTC", 5), ("PT1M3.5S", "deepgram", "UTC", 63_500), ("0h00m11.977s", "deepgram", "UTC", 11_977), ("0:24.106", "deepgram", "UTC", 24_106), ("00:05:32,564", "deepgram", "UTC", 332_564),
]
CLOCKS = [
    ("2024-05-18 02:36:08.085 +03:00", "UTC", "en-GB", "2024-05-17T23:36:08.085"), ("20240725T092204", "America/Sao_Paulo", "en-US", "2024-07-25T12:22:04"), ("05/06/2023 07:51:07 PM", "UTC", "en-US", "2023-05-06T19:51:07"),
    ("05/06/2023 19:51:07", "UTC", "en-GB", "2023-06-05T19:51:07"), ("01.03.2025 04:50:55", "Europe/Berlin", "de-DE", "2025-03-01T03:50:55"), ("Jun 03, 2024 12:51:47 AM", "UTC", "en-US", "2024-06-03T00:51:47"), ("16 Jul 2024 14:30:51 AEST", "UTC", "en-GB", "2024-07-16T04:30:51"),
    ("2023-02-07T03:50:04.610000000Z", "UTC", "en-US", "2023-02-07T03:50:04.610"), ("1707400663.067", "UTC", "en-US", "2024-02-08T13:57:43.067"), ("1676229034717", "UTC", "en-US", "2023-02-12T19:10:34.717"),
]
NOTHING = ["-1", "NaN", "Infinity", "1e999s", "", "null", "n/a", "--:--:--", "00:7x:12", "2024-13-40T09:00:00Z", "2024-02-30 01:00:00", "0:75", None, "2024-03-10 02:30:59"]


def run(spark, values, recordings):
    v = spark.createDataFrame(values, "time_id bigint, transcript_id bigint, vendor string, start_raw string, tz string")
    r = spark.createDataFrame(recordings, "transcript_id bigint, recorded_at timestamp, tz string, locale string, duration_ms bigint, vendor string")
    return {x.time_id: x.start_utc_ms for x in to_utc(v, r).collect()}


def ms(text):
    return round(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


def test_offsets_and_clocks(spark):
    values = [(i, 1, v, raw, None) for i, (raw, v, _, _) in enumerate(CASES)]
    values += [(100 + i, 10 + i, "deepgram", raw, None) for i, (raw, *_) in enumerate(CLOCKS)]
    recordings = [(1, REC, "UTC", "en-US", 9_000_000, None)] + [(10 + i, REC, tz, loc, 1000, None) for i, (_, tz, loc, _) in enumerate(CLOCKS)]
    got = run(spark, values + values[:5], recordings + recordings[:2])
    for i, (_, _, _, off) in enumerate(CASES):
        assert got[i] == round(REC.timestamp() * 1000) + off
    for i, (raw, _, _, want) in enumerate(CLOCKS):
        assert got[100 + i] == ms(want), raw


def test_no_case(spark):
    rec = [(1, REC, "America/Los_Angeles", "en-US", 1000, None), (2, None, None, None, None, None), (3, REC, "Mars/Base", None, None, None)]
    values = [(i, 1, "deepgram", raw, None) for i, raw in enumerate(NOTHING)] + [(90, 2, "deepgram", "1.5", None), (91, 3, None, "2024-05-05 10:00:00", None), (92, 9, "x", "2.0", None), (None, 1, "x", "2.0", None)]
    assert run(spark, values, rec) == {}
    assert run(spark, [(1, 2, None, "2024-05-05T10:00:00Z", None)], rec) == {1: ms("2024-05-05T10:00:00")}
    assert run(spark, values[:0], rec) == {}


@pytest.mark.parametrize(("start", "want"), [(datetime(2024, 11, 3, 8, 0, tzinfo=timezone.utc), "2024-11-03T08:30:00"), (datetime(2024, 11, 3, 9, 10, tzinfo=timezone.utc), "2024-11-03T09:30:00")])
def test_hour_that_comes_twice(spark, start, want):
    got = run(spark, [(1, 1, "deepgram", "2024-11-03 01:30:00", None)], [(1, start, "America/Los_Angeles", "en-US", 2_400_000, None)])
    assert got == {1: ms(want)}
