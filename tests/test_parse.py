from datetime import datetime

import pytest
from helpers import parsed, rows_of

D = datetime


def test_plain_lines_of_all_shapes(spark):
    lines = [
        "2026-06-03T09:15:27Z INFO cache warm, ERROR budget untouched",
        "nightly export ended status=ok",
        '203.0.113.9 - - [03/Jun/2026:09:15:27 +0000] "PUT /cart HTTP/2" 204 0',
        '203.0.113.9 - - [03/Jun/2026:21:40:00 -0530] "PUT /cart HTTP/2" 204 0',
        "Nov 30 06:07:08 gate cron[77]: rotated",
        "W0603 09:15:27.654321      42 disk.cc:88] nearly full",
        "1780000000 DEBUG tick",
        '2026-06-03 09:15:27 WARN {"code":17,"queue":"mail"}',
        'Jun  3 09:15:28 gate billing: level=warning msg="card declined" shop=north',
        '2026-06-03 09:15:29 INFO {"ts":"2026-06-03T09:15:11Z","level":"fatal","msg":"clock moved"}',
        '2026-06-03 09:15:30 INFO {"half":',
        "2026-06-03 09:15:31 INFO one pair only size=3 here",
        "02-11 07:08:09.250  1042   511   640 V Radio: scanning 7 bands",
        "02-11 07:08:09.250 u0_a31   511   640 V Radio: scanning",
        "02-11 07:08:09.250   511 20417 E Camera: no frame",
        "02-11 07:08:09.250   511 20417 S Muted: x",
        '02-11 07:08:09.250   511 20417 D Net: level=error peer=b msg="late reply"',
        "02-11 07:08:09.250   511 20417 D",
        r'2026-06-03T09:15:27Z {"msg":"level=debug msg=\"nested\" peer=b"}',
        "2026-06-03T09:15:27Z FETCH http://z took=9ms code=200 query={k v} reply={h}",
        "2026/06/03 09:15:27 [ERROR] stuck",
        "2026-06-03T09:15:27Z <28> fan",
        "<28>Jun  3 09:15:27 gate x",
        "2026-06-03T09:15:27+0530 INFO y",
        "2026-06-03T09:15:27,750 WARN y",
        "2026-02-29T01:00:00Z [2026-03-02T01:00:00Z] INFO past a day that is none",
        "9999999999999999999 2026-03-02T01:00:00Z INFO past a number that is no epoch",
        "Feb 30 01:00:00 [2026-03-02T01:00:00Z] INFO x",
    ]
    r = rows_of(spark, lines)
    assert len(r) == len(lines)
    at = [x["timestamp"] for x in r]
    assert at[0] == D(2026, 6, 3, 9, 15, 27) and r[0]["level"] == "INFO" and r[0]["message"] == "cache warm, ERROR budget untouched"
    assert at[1] is None and r[1]["level"] is None and r[1]["message"] == lines[1]
    assert at[2] == D(2026, 6, 3, 9, 15, 27) and r[2]["level"] is None and r[2]["message"] == '203.0.113.9 - - "PUT /cart HTTP/2" 204 0' and not r[2]["timestamp_used_default_tz"]
    assert at[3] == D(2026, 6, 4, 3, 10)
    assert at[4] == D(2025, 11, 30, 6, 7, 8) and r[4]["timestamp_year_inferred"] and r[4]["timestamp_used_default_tz"] and r[4]["message"] == "gate cron[77]: rotated"
    assert at[5] == D(2026, 6, 3, 9, 15, 27, 654321) and r[5]["level"] == "WARN" and r[5]["message"] == "42 disk.cc:88] nearly full"
    assert at[6] == D(2026, 5, 28, 20, 26, 40) and not r[6]["timestamp_year_inferred"] and r[6]["message"] == "tick"
    assert r[7]["message"] == "" and r[7]["level"] == "WARN" and r[7]["fields"] == {"code": {"kind": "number", "value": "17"}, "queue": {"kind": "string", "value": "mail"}}
    assert r[8]["level"] == "WARN" and r[8]["message"] == "card declined" and r[8]["fields"] == {"shop": {"kind": "string", "value": "north"}}
    assert at[9] == D(2026, 6, 3, 9, 15, 11) and r[9]["level"] == "FATAL" and r[9]["message"] == "clock moved"
    assert r[9]["fields"]["prefix_ts"]["value"] == "2026-06-03T09:15:29+00:00"
    assert r[10]["message"] == '{"half":' and r[10]["fields"] == {}
    assert r[11]["message"].endswith("size=3 here") and r[11]["fields"] == {}
    assert r[12]["level"] == "TRACE" and r[12]["message"] == "scanning 7 bands" and r[12]["timestamp_year_inferred"]
    assert {k: (v["kind"], v["value"]) for k, v in r[12]["fields"].items()} == {"tag": ("string", "Radio"), "pid": ("number", "511"), "tid": ("number", "640"), "uid": ("number", "1042")}
    assert r[13]["fields"]["uid"] == {"kind": "string", "value": "u0_a31"}
    assert r[14]["level"] == "ERROR" and "uid" not in r[14]["fields"] and r[14]["message"] == "no frame"
    assert r[15]["level"] is None and at[15] is not None
    assert r[16]["level"] == "ERROR" and r[16]["message"] == "late reply" and {"tag", "peer"} <= set(r[16]["fields"])
    assert at[17] is None and r[17]["message"] == lines[17] and r[17]["fields"] == {}
    assert r[18]["level"] is None and r[18]["message"] == 'level=debug msg="nested" peer=b'
    assert r[19]["level"] is None and set(r[19]["fields"]) == {"took", "code", "query", "reply"} and r[19]["message"] == "FETCH http://z"
    assert r[20]["level"] == "ERROR" and r[20]["message"] == "stuck"
    assert r[21]["level"] == "WARN" and r[21]["message"] == "fan"
    assert at[22] is None and at[23] is None
    assert at[24] == D(2026, 6, 3, 9, 15, 27) and r[24]["level"] == "WARN" and r[24]["message"] == ",750 WARN y"
    assert at[25:28] == [D(2026, 3, 2, 1)] * 3 and all(x["level"] == "INFO" for x in r[25:28])
    assert r[25]["message"] == "2026-02-29T01:00:00Z past a day that is none"


def test_leap_days(spark):
    lines = ["2024-02-29T01:00:00Z a", "1900-02-29T01:00:00Z a", "2000/02/29 01:00:00 a", "29/Feb/2023:01:00:00 a"]
    assert [x["timestamp"] for x in rows_of(spark, lines)] == [D(2024, 2, 29, 1), None, D(2000, 2, 29, 1), None]
    yearless = ["Feb 29 01:00:00 a", "0229 01:00:00 a"]
    assert [x["timestamp"] for x in rows_of(spark, yearless, reference=D(2025, 1, 5))] == [D(2024, 2, 29, 1)] * 2
    assert [x["timestamp"] for x in rows_of(spark, yearless)] == [None, None]


def test_yearless_shapes_need_a_reference(spark):
    assert rows_of(spark, ["Jun  3 09:15:28 gate x"], reference=None)[0]["timestamp"] is None


def test_json_lines(spark):
    lines = [
        '{"timestamp":"2026-06-03T09:15:27Z","level":"warning","message":"m","service":"api","port":8080}',
        "not json",
        "[1, 2]",
        '{"ts":"yesterday","level":"30","t":"2026-06-03T09:15:27Z"}',
        '{"log":"2026-06-03T09:15:27Z ERROR boom\\n","stream":"stdout","time":"2026-06-03T09:15:28Z"}',
        '{"log":"hi","level":"info","service":"api"}',
        '{"log":"hi","stream":"stderr","time":"2026-06-03T09:15:28Z"}',
        "",
        '{"msg":"an ERROR","a":null,"b":[1, {"z":1,"y":2}],"c":false}',
    ]
    result = parsed(spark, lines, "json")
    r = {x["ordinal"]: x.asDict(recursive=True) for x in result.entries.collect()}
    assert sorted(r) == [1, 4, 5, 6, 7, 9]
    assert r[1]["level"] == "WARN" and r[1]["message"] == "m" and r[1]["fields"]["port"] == {"kind": "number", "value": "8080"}
    # the first timestamp key decides, an unknown level is taken
    assert r[4]["timestamp"] is None and set(r[4]["fields"]) == {"ts", "t"} and r[4]["level"] is None
    assert r[5]["level"] == "ERROR" and r[5]["message"] == "boom" and r[5]["fields"] == {"stream": {"kind": "string", "value": "stdout"}}
    assert r[6]["message"] == "" and set(r[6]["fields"]) == {"log", "service"} and r[6]["level"] == "INFO"
    assert r[7]["timestamp"] == D(2026, 6, 3, 9, 15, 28) and r[7]["message"] == "hi"
    assert r[9]["level"] is None and r[9]["fields"]["a"] == {"kind": "null", "value": "null"} and r[9]["fields"]["b"] == {"kind": "json", "value": '[1,{"y":2,"z":1}]'}
    assert {(d["ordinal"], d["reason"]) for d in result.diagnostics.collect()} == {(2, "invalid_json"), (3, "non_object_json"), (4, "unparsable_timestamp")}


def test_logfmt_lines(spark):
    r = rows_of(spark, ['ts=2026-06-03T09:15:27Z level=err msg="a \\"b\\" c" n=42 n=43 x=', "just some words a=1"], "logfmt")
    assert r[0]["level"] == "ERROR" and r[0]["message"] == 'a "b" c' and r[0]["fields"] == {"n": {"kind": "string", "value": "43"}, "x": {"kind": "string", "value": ""}}
    assert r[1]["message"] == "just some words" and r[1]["level"] is None


def test_offset_of_naive_timestamps(spark):
    r = rows_of(spark, ["2026-06-03 09:15:27 INFO x"], tz_offset_minutes=180)[0]
    assert r["timestamp"] == D(2026, 6, 3, 6, 15, 27) and r["timestamp_used_default_tz"]


def test_detection(spark):
    from helpers import REFERENCE, lines_of

    from driftwood.operators.detect import detect

    both = (
        lines_of(spark, ['{"a":1}'] * 4 + ["x"], "j")
        .union(lines_of(spark, ["a=1 b=2"] * 4 + ["", "some prose"], "l"))
        .union(lines_of(spark, ["2026-06-03T09:15:27Z a", "Jun  3 09:15:28 b", "Jun  3 09:15:28 c", "d"], "p"))
        .union(lines_of(spark, ["2026-06-03T09:15:27Z a", "x [2026-06-03T09:15:27Z] a"], "q"))
        .union(lines_of(spark, ["", " "], "e"))
    )
    got = {r["source"]: tuple(r)[1:] for r in detect(both, REFERENCE).collect()}
    assert got["j"] == ("json", 0.8, "threshold", None, None)
    assert got["l"] == ("logfmt", 0.8, "threshold", None, None)
    assert got["p"] == ("plain", 0.75, "fallback", "syslog3164", 0)
    assert got["q"] == ("plain", 1.0, "threshold", "iso8601", 3)  # of two alike, the later
    assert got["e"] == ("plain", 0.0, "fallback", None, None)


def test_auto_format_parses_each_source_by_its_own(spark):
    from helpers import lines_of

    from driftwood.operators.parse import parse

    both = lines_of(spark, ['{"msg":"m"}'] * 3, "j").union(lines_of(spark, ["msg=n a=1"] * 2, "l")).union(lines_of(spark, ["prose"], "p"))
    got = sorted((r["source"], r["message"]) for r in parse(both).entries.collect())
    assert got == [("j", "m")] * 3 + [("l", "n")] * 2 + [("p", "prose")]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        parsed(spark, ["x"], "xml")


def test_year_rollover_within_the_reference_second_and_past_february(spark, tmp_path):
    from driftwood.plans.catalogue import QUERIES

    times = {
        D(2024, 1, 14, 23, 59, 59, 999999): D(2024, 1, 14, 23, 59, 59),
        D(2024, 1, 15): D(2024, 1, 15),
        D(2024, 1, 15, 0, 0, 0, 1): D(2023, 1, 15),
        D(2024, 1, 15, 0, 0, 0, 577336): D(2023, 1, 15),
        D(2024, 1, 15, 0, 0, 1): D(2023, 1, 15, 0, 0, 1),
        D(2024, 2, 29, 12): D(2023, 3, 1, 12),
        D(2024, 3, 1): D(2023, 3, 2),
        D(2025, 1, 14): D(2024, 1, 15),
    }
    spark.createDataFrame(list(enumerate(times)), "event_id bigint, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["ordinal"]: r["ts_ms"] for r in QUERIES["year_rollover"](spark, str(tmp_path)).collect()}
    assert got == {i: (at - D(1970, 1, 1)).total_seconds() * 1000 for i, at in enumerate(times.values(), 1)}
