"""Results that were wrong or fatal once: JSON texts, repeated overrides, exact as-of joins, empty fields."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hydroloom.functions import json_text
from hydroloom.operators import series, spatial
from hydroloom.runner import namelist

TEXTS = {
    r'{"a": "\"x // y\"z", "b": 1}': {"a": '"x // y"z', "b": 1},
    r'{"a": "hi, }\" ,]", "b": [1, 2, ], }': {"a": 'hi, }" ,]', "b": [1, 2]},
    '{"a": 1, // one\n # two\n /* three "*/ "b": "#", }': {"a": 1, "b": "#"},
    '{"a": "\\\\", "b": 2 /* ** / */}': {"a": "\\", "b": 2},
    "[1,\n\n/* ,\n */ ]": [1],
    '"' + "x" * 1_000_000 + '"': "x" * 1_000_000,
    '"' + r"\"" * 500_000 + '"': '"' * 500_000,
    "[" + "1," * 300_000 + "]": [1] * 300_000,
    "[1]" + "/" * 1_000_000 + "\n": [1],
    "[1 /*" + "*" * 1_000_000 + "*/]": [1],
}


def test_plain_json(spark):
    for text, want in TEXTS.items():
        plain = json_text.plain(text)
        assert json.loads(plain) == want and len(plain) == len(text) and plain.count("\n") == text.count("\n")
    frame = spark.createDataFrame([(t,) for t in TEXTS] + [(None,), ("",), ("{",)], "json string")
    assert [json.loads(r[0]) for r in frame.limit(len(TEXTS)).select(json_text.plain_json(F.col("json"))).collect()] == list(TEXTS.values())
    got = json_text.checked_json(frame).collect()
    assert [r["problem"] for r in got] == [None] * len(TEXTS) + ["empty", "empty", "no JSON"] and [r["valid"] for r in got] == [True] * len(TEXTS) + [False] * 3


@pytest.mark.parametrize(
    "text, tolerant, error, line, col, said",
    [
        ('{"a": 1,}', False, "Illegal trailing comma before end of object", 1, 8, "trailing comma"),
        ('{"a": 1,}', True, None, None, None, None),
        ('{"a": 1,\n // one\n "b" 2}', True, "Expecting ':' delimiter", 3, 6, "commas, quotes or brackets"),
        ("{'a': 1}", True, "Expecting property name enclosed in double quotes", 1, 2, "single quotes"),
        ('["' + "x" * 100_000, True, "Unterminated string starting at", 1, 2, "commas, quotes or brackets"),
        ("[" * 200_000, True, "nested too deep", None, None, None),
        ('[1, /* no end ]', True, "Expecting value", 1, 5, "commas, quotes or brackets"),
        ("1" * 10_000, True, "Exceeds the limit (4300 digits) for integer string conversion: value has 10000 digits", None, None, None),
    ],
)
def test_error_places(text, tolerant, error, line, col, said):
    got = json_text.error_of(text, tolerant)
    assert (got[0], got[1], got[2], got[4]) == (error, line, col, said)
    if got[3] is not None:
        assert text[: got[3]].count("\n") + 1 == line and len(got[5]) <= 2 * json_text.EXCERPT


def test_overrides_given_twice(spark):
    template = spark.createDataFrame([("s", 1, "alpha", "default", "0"), ("s", 2, "beta", "mandatory", None), ("s", 3, "gamma", "default", "5")], "section string, ord int, param string, mode string, default_value string")
    given = [("by_value", "alpha", "9", True), ("by_value", "alpha", "10", True), ("by_value", "alpha", "99", False), ("by_pattern", "ta", "p", True), ("by_pattern", "ta", "q", True)]
    frame = spark.createDataFrame(given, "kind string, key string, value string, active boolean")
    values = lambda o: [(r["param"], r["value"]) for r in namelist.build_values(template, o).orderBy("ord").collect()]
    assert values(frame) == [("alpha", "9"), ("beta", "q"), ("gamma", "5")]
    ordered = spark.createDataFrame([(*g, i) for i, g in enumerate(given)], "kind string, key string, value string, active boolean, ord int")
    assert values(ordered) == [("alpha", "10"), ("beta", "q"), ("gamma", "5")]
    assert namelist.validate(template, frame).count() == 0


@pytest.mark.parametrize("nearest", [False, True])
def test_exact_as_of(spark, nearest):
    t = [datetime(2024, 1, 1, 0, 0, s) for s in range(4)]
    data = spark.createDataFrame([("a", t[0], 1.0), ("a", t[1], 2.0), ("a", t[1], 3.0), ("b", t[2], 4.0)], "k string, time timestamp, value double")
    probes = spark.createDataFrame([("a", t[1], 7.0), ("a", t[2], 8.0), ("b", t[2], None), ("a", t[1], 7.0)], "k string, probe_time timestamp, value double")
    out = series.as_of(probes, data, ["k"], 0, nearest=nearest)
    assert out.columns == ["k", "probe_time", "value", "found_time", "value_"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", t[1], 7.0, t[1], 3.0), ("a", t[1], 7.0, t[1], 3.0), ("a", t[2], 8.0, None, None), ("b", t[2], None, t[2], 4.0)], key=repr)
    with pytest.raises(ValueError, match="tolerance"):
        series.as_of(probes, data, ["k"], -1)


def test_warp_of_nothing(spark):
    grid = spark.createDataFrame([], "var string, time timestamp_ntz, row int, col int, lat double, lon double, value double")
    assert spatial.warp(grid, 0.5, spark).count() == 0
