"""Pushed documents: every check, its message, and what is let through."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from helpers import at
from pyspark.sql import functions as F

from tickloom.functions.timestamps import parse_iso
from tickloom.sources import push

AS_OF = datetime(2025, 6, 1)


def split(spark, bodies, mode="atomic"):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id long, body string")
    accepted, rejected = push.split_requests(requests, AS_OF, mode)
    good = [tuple(r) for r in push.accepted_events(accepted).orderBy("event_id").collect()]
    bad = [tuple(r) for r in rejected.orderBy("request_id", "pos").collect()]
    return good, bad


REQUEST_CASES = [
    ("[1, 2]", push.NOT_AN_OBJECT),
    ('"text"', push.NOT_AN_OBJECT),
    ("12", push.NOT_AN_OBJECT),
    ("null", push.NOT_AN_OBJECT),
    ("", push.NOT_AN_OBJECT),
    ('{"events": [', push.NOT_AN_OBJECT),
    ({}, push.NO_EVENTS),
    ({"events": []}, push.NO_EVENTS),
    ({"events": None}, push.NO_EVENTS),
    ({"events": ""}, push.NO_EVENTS),
    ({"events": 0}, push.NO_EVENTS),
    ({"events": 0.0}, push.NO_EVENTS),
    ({"events": False}, push.NO_EVENTS),
    ({"events": {}}, push.NO_EVENTS),
    ({"events": "x"}, push.NOT_AN_ARRAY),
    ({"events": {"name": "a"}}, push.NOT_AN_ARRAY),
    ({"events": 3}, push.NOT_AN_ARRAY),
    ({"events": True}, push.NOT_AN_ARRAY),
]


def test_request_checks(spark):
    good, bad = split(spark, [body for body, _ in REQUEST_CASES])
    assert good == []
    assert [b[1:3] for b in bad] == [(None, error) for _, error in REQUEST_CASES]


EVENT_CASES = [
    (5, "object"),
    ("x", "object"),
    (None, "object"),
    ([], "object"),
    ({}, "name"),
    ({"name": ""}, "name"),
    ({"name": 5}, "name"),
    ({"name": None}, "name"),
    ({"name": "", "value": "x"}, "name"),
    ({"name": "a", "value": "5"}, "value"),
    ({"name": "a", "value": None}, "value"),
    ({"name": "a", "value": [1]}, "value"),
    ({"name": "a", "value": {}}, "value"),
    ({"name": "a", "tag": 5}, "tag"),
    ({"name": "a", "tag": False}, "tag"),
    ({"name": "a", "tag": ["t"]}, "tag"),
    ({"name": "a", "additional_info": 1.5}, "additional_info"),
    ({"name": "a", "additional_info": {"k": 1}}, "additional_info"),
    ({"name": "a", "timestamp": "soon"}, "timestamp"),
    ({"name": "a", "timestamp": 17}, "timestamp"),
    ({"name": "a", "timestamp": "2025-13-01"}, "timestamp"),
    ({"name": "a", "tag": 5, "timestamp": "soon"}, "tag"),
]


def test_event_checks(spark):
    good, bad = split(spark, [{"events": [{"name": "fine"}, event]} for event, _ in EVENT_CASES])
    assert good == []
    assert [b[1:3] for b in bad] == [(1, f"Event at index 1 {push.ITEM_ERRORS[key]}") for _, key in EVENT_CASES]


ACCEPTED_CASES = [
    ({"name": "a"}, ("a", 0.0, None, None, "2025-06-01")),
    ({"name": "a", "value": 2.9}, ("a", 2.0, None, None, "2025-06-01")),
    ({"name": "a", "value": -2.9}, ("a", -2.0, None, None, "2025-06-01")),
    ({"name": "a", "value": 1e3}, ("a", 1000.0, None, None, "2025-06-01")),
    ({"name": "a", "value": True}, ("a", 1.0, None, None, "2025-06-01")),
    ({"name": "a", "tag": None, "additional_info": ""}, ("a", 0.0, None, "", "2025-06-01")),
    ({"name": "a", "tag": "t", "additional_info": "i"}, ("a", 0.0, "t", "i", "2025-06-01")),
    ({"name": "a", "timestamp": ""}, ("a", 0.0, None, None, "2025-06-01")),
    ({"name": "a", "timestamp": 0}, ("a", 0.0, None, None, "2025-06-01")),
    ({"name": "a", "timestamp": False}, ("a", 0.0, None, None, "2025-06-01")),
    ({"name": "a", "timestamp": "2025-01-01T12:00:00Z"}, ("a", 0.0, None, None, "2025-01-01T12:00:00")),
    ({"name": "a", "timestamp": "2025-01-01T12:00:00+02:00"}, ("a", 0.0, None, None, "2025-01-01T10:00:00")),
    ({"name": "a", "other": {"deep": [1, {"x": 2}]}}, ("a", 0.0, None, None, "2025-06-01")),
]


def test_accepted_events(spark):
    good, bad = split(spark, [{"events": [event]} for event, _ in ACCEPTED_CASES])
    assert bad == []
    assert [(*g[1:5], g[5].replace(tzinfo=timezone.utc)) for g in good] == [
        (*row[:4], at(row[4])) for _, row in ACCEPTED_CASES
    ]


def test_one_bad_event_rejects_its_request_only(spark):
    bodies = [{"events": [{"name": "a"}, 1, 2]}, {"events": [{"name": "b"}, {"name": "c"}]}]
    good, bad = split(spark, bodies)
    assert [g[1] for g in good] == ["b", "c"]
    assert [b[:2] for b in bad] == [(0, 1)]
    assert bad[0][3] == json.dumps(bodies[0])


def test_row_mode_keeps_the_rest(spark):
    good, bad = split(spark, [{"events": [{"name": "a"}, 1, {"name": "b"}, {"tag": "x"}]}, "[]"], "row")
    assert [g[1] for g in good] == ["a", "b"]
    assert [(b[0], b[1], b[3]) for b in bad] == [(0, 1, "1"), (0, 3, '{"tag":"x"}'), (1, None, "[]")]
    with pytest.raises(ValueError):
        split(spark, [], "some")


def test_events_without_time_keep_their_order(spark):
    good, _ = split(spark, [{"events": [{"name": f"n{i}"} for i in range(50)]}])
    assert [g[1] for g in good] == [f"n{i}" for i in range(50)]


def test_equal_keys_take_the_last(spark):
    good, bad = split(spark, ['{"events": [{"name": "a", "name": "b"}]}'])
    assert ([g[1] for g in good], bad) == (["b"], [])


def test_requests_from_files(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text('{"events":[{"name":"a"}]}\n{"events":[{"name":"b"}]}\n')
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.json").write_text('{\n "events": [\n  {"name": "a"}\n ]\n}\n')
    lines = push.read_requests(spark, str(tmp_path / "lines"))
    whole = push.read_requests(spark, str(tmp_path / "whole"), one_per_file=True)
    assert push.split_requests(lines, AS_OF)[0].count() == 2
    assert push.split_requests(whole, AS_OF)[0].count() == 1


ISO_TEXTS = """2025-01-02 20250102 2025-01-02T03 2025-01-02T03:04 2025-01-02T03:04:05 2025-01-02T03:04:05.5
2025-01-02T03:04:05.123456 2025-01-02T03:04:05,25 2025-01-02T03:04:05+00:00 2025-01-02T03:04:05.5-03:30
20250102T030405 20250102T0304 20250102T030405+0200 2025-01-02T03+01 2025-02-30 2025-1-2 2025-01-02T25:00
2025-01-02T03:04:61 tomorrow 2025 2025-01 03:04 2025-01-02T 2025-01-02T03:04:05+2 x2025-01-02""".split() + [
    "2025-01-02 03:04:05",
    " 2025-01-02",
    "2025-01-02 03:04:05 extra",
]


def test_iso_times_agree_with_python(spark):
    rows = spark.createDataFrame([(t,) for t in ISO_TEXTS], "text string")
    got = {r.text: r.us for r in rows.select("text", F.unix_micros(parse_iso(F.col("text"))).alias("us")).collect()}
    for text in ISO_TEXTS:
        try:
            moment = datetime.fromisoformat(text)
        except ValueError:
            assert got[text] is None, text
            continue
        moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
        assert got[text] == round(moment.timestamp() * 1_000_000), text
