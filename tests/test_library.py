"""Plans beyond their broadcast bounds, ties and repeats, settings that must raise, time rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroloom.functions import times
from hydroloom.operators import masks, series, shaping, spatial
from hydroloom.plans import pipelines
from hydroloom.runner import namelist
from hydroloom.sources import text

GRID = "var string, time timestamp_ntz, row int, col int, lat double, lon double, value double"
T0 = datetime(2024, 1, 1)


def field(spark, values, var="x"):
    return spark.createDataFrame([(var, T0, i // 4, i % 4, 46.0 - 0.1 * (i // 4), 10.0 + 0.1 * (i % 4), v) for i, v in enumerate(values)], GRID)


def terrain(spark, values):
    return spark.createDataFrame([(i // 4, i % 4, 46.0 - 0.1 * (i // 4), 10.0 + 0.1 * (i % 4), v) for i, v in enumerate(values)], "row int, col int, lat double, lon double, ref_value double")


def test_every_pair_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(masks, "BROADCAST_CELLS", 3)
    pairs = masks.every_pair(spark.range(5).toDF("a"), spark.range(11).toDF("b"))
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(5) for b in range(11)]
    assert masks.every_pair(spark.range(2).toDF("a"), spark.range(11).toDF("b")).count() == 22


def test_regridding_beyond_the_bound(spark, monkeypatch):
    grid, ref = field(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0]), terrain(spark, [1.0] * 8)
    rows = lambda: sorted(tuple(r)[2:4] + (round(r["value"], 9),) for r in spatial.interpolate(grid, ref, "idw").collect())
    want = rows()
    monkeypatch.setattr(masks, "BROADCAST_CELLS", 0)
    assert rows() == want and len(want) == 8


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 3000])
def test_exact_percentiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 1), rng.choice([0, 6])) for _ in range(n)]
    frame = spark.createDataFrame([("x", v) for v in values] + [("x", None), ("none", None), ("x", float("nan"))], "var string, value double")
    shares = (0.0, 0.02, 0.5, 0.98, 1.0)
    found = shaping.exact_percentiles(frame, shares).collect()
    assert len(found) == 1 and np.allclose(found[0]["ends"], np.quantile(values, shares))


def test_as_of_repeats_ties_and_names(spark):
    data = spark.createDataFrame([("a", datetime(2024, 1, 1, 0), 1.0), ("a", datetime(2024, 1, 1, 0), 3.0), ("a", datetime(2024, 1, 1, 1), None)], "k string, time timestamp_ntz, value double")
    probes = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 30), 1, 1)] * 3 + [(None, datetime(2024, 1, 1), 2, 2)], "k string, probe_time timestamp_ntz, t int, found int")
    rows = series.as_of(probes, data, ["k"], 3600).collect()
    assert sorted((r["t"], r["value"]) for r in rows if r["t"] == 1) == [(1, 3.0)] * 3 and len(rows) == 4
    assert rows[0].asDict().keys() == {"k", "probe_time", "t", "found", "found_time", "value"}


def test_formats_and_modes(spark):
    grid, ref = field(spark, [1.7, -1.7, None, float("nan")]), terrain(spark, [1.0, 1.0, 1.0, 1.0])
    cut = masks.mask_by_limits(grid, form="integer", no_data=-1.0).orderBy("col")
    assert [r["value"] for r in cut.collect()] == [1, -1, -1, -1]
    for wrong in (lambda: masks.mask_by_ref(grid, ref, form="text"), lambda: masks.mask_by_ref(grid, ref, mode="soft"), lambda: masks.mask_by_ref(grid, ref, no_data=float("nan"), form="integer"), lambda: masks.mask_by_ref(grid, ref, mode="strict")):
        with pytest.raises(ValueError):
            wrong()


def test_process_lists(spark):
    assert len(pipelines.PROCESSES) == 11
    u, v, ref = field(spark, [3.0] * 4, "u"), field(spark, [4.0] * 4, "v"), terrain(spark, [1.0, -9999.0, 1.0, 1.0])
    lists = {"u": [], "v": [], "speed": [{"function": "compute_data_wind_speed", "deps_vars": {"u": "u", "v": "v"}, "return_diag": True}, {"function": "interpolate_data"}, {"function": "mask_data_by_ref", "mask_no_data": None}]}
    rows = pipelines.run_process_lists({"u": u, "v": v}, ref, lists).collect()
    assert {(r["var"], r["col"], r["value"] and round(r["value"], 3)) for r in rows} == {(n, c, None if c == 1 else x) for n, x in (("speed", 5.0), ("speed:direction", 53.13)) for c in range(4)}
    with pytest.raises(KeyError):
        pipelines.run_process_lists({"u": u}, ref, lists)
    with pytest.raises(TypeError):
        pipelines.chain([("interpolate_data", {"radius_of_search": 3})], ref=ref)
    with pytest.raises(ValueError):
        pipelines.PROCESSES["compute_data_incoming_radiation"](kind="x")


def test_shipped_conversion_names_registered_processes():
    steps = [s for chain in pipelines.ICON.values() for s in chain]
    assert {s["function"] for s in steps} <= set(pipelines.PROCESSES) and len(pipelines.ICON) == 9


def test_supported_points(spark):
    points = spark.createDataFrame([(1, 46.0, 10.0, 5.0), (2, 46.0, 10.3, 0.0)], "point long, lat double, lon double, value double")
    ref = terrain(spark, [1.0] * 4)
    value = lambda kernel, half: {r["col"]: r["value"] for r in spatial.resample_supported(points, ref, 20_000, kernel=kernel, half=half).collect()}
    box = value("box", 1)
    assert box[0] == 5 and box[1] is not None and box[2] is None and box[3] is None
    assert all(v is not None for v in value("gaussian", 1).values())
    with pytest.raises(ValueError):
        spatial.resample_supported(points, ref, 1.0, kernel="cone")


def shown(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_time_rules(spark):
    run = times.select_range(at("2024-01-01 05:10:00"), at("2024-01-01 05:40:00"))
    brief = times.select_range(at("2024-01-01 05:10:00"), at("2024-01-01 05:40:00"), ensure=True)
    months = times.expected_times(at("2024-01-31 06:00:00"), 2, "month")
    assert shown(spark, run, brief, months) == [[datetime(2024, 1, 1, 5)], [datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 6)], [datetime(2024, 1, 31, 6), datetime(2024, 2, 29, 6)]]
    with pytest.raises(Exception, match="start is after end"):
        shown(spark, times.select_range(at("2024-01-02"), at("2024-01-01")))
    for wrong in (lambda: times.select_range(), lambda: times.ensure_window(at("2024-01-01"), at("2024-01-01"), "h", "up"), lambda: times.expected_times(at("2024-01-01"), 0), lambda: times.flatten_start(at("2024-01-01"), "hour"), lambda: times.flatten_end(at("2024-01-01"), "time_run"), lambda: times.floor_to(at("2024-01-01"), "7h")):
        with pytest.raises(ValueError):
            wrong()
    leap = at("2024-02-29 10:20:30")
    assert shown(spark, times.time_signature(leap, "%m%d", 10), times.time_signature(leap, "%m%d", 1), times.time_signature(leap, "%Y{%H}"), times.time_signature(leap, "%Y%m%d%H%M%s")) == [datetime(2024, 2, 28), datetime(2024, 2, 29), datetime(2024, 1, 1), datetime(2024, 2, 29, 10, 20, 30)]
    assert shown(spark, times.expected_times(leap)) == [None]


def test_whole_hours(spark):
    """Floors to whole hours and shifts by whole steps read neither minutes nor seconds, before 1970 too."""
    frame = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 59, 999999),), (datetime(2024, 2, 29, 5, 0, 0),), (datetime(2024, 2, 29, 17, 30, 1, 5),)], "t timestamp_ntz")
    made = frame.select("t", times.floor_to(F.col("t"), "h").alias("h"), times.floor_to(F.col("t"), "6h").alias("six"), times.floor_to(F.col("t"), "d").alias("d"), times.shift(F.col("t"), -3, "6h").alias("back"), times.shift(F.col("t"), 2, "15min").alias("on"))
    for r in made.collect():
        t = r["t"]
        assert r["h"] == t.replace(minute=0, second=0, microsecond=0) and r["six"] == r["h"].replace(hour=t.hour // 6 * 6) and r["d"] == r["h"].replace(hour=0)
        assert r["back"] == t - timedelta(hours=18) and r["on"] == t + timedelta(minutes=30)
    assert "minute(" not in made._jdf.queryExecution().analyzed().toString()


def test_namelist_parameters_are_dealt(spark, monkeypatch):
    """Parameters are dealt to tasks by their number and meet the patterns there: nothing made of them is shuffled before each has its own."""
    template = spark.createDataFrame([("A", i, f"par{i}", "default", str(i)) for i in range(300)], "section string, ord int, param string, mode string, default_value string")
    user = spark.createDataFrame([("by_pattern", str(k), f"v{k}", True) for k in (1, 11, 7, 23, 99)] + [("by_value", "par5", "own", True)], "kind string, key string, value string, active boolean")
    monkeypatch.setattr(namelist, "PARAMS", 20)
    want = {i: "own" if i == 5 else next((f"v{k}" for k in sorted(map(str, (1, 11, 7, 23, 99))) if k in f"par{i}"), str(i)) for i in range(300)}
    assert {r["ord"]: r["value"] for r in namelist.build_values(template, user).collect()} == want
    plan = namelist.build_updates(template, user)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(param#" in plan and ", 15), REPARTITION_BY_NUM" in plan
    assert plan.count("Exchange hashpartitioning(param#") == 2


def test_namelist_patterns_and_names(spark):
    template = spark.createDataFrame([("A", 1, "path_in", "default", "1"), ("A", 2, "path_out", "mandatory", None)], "section string, ord int, param string, mode string, default_value string")
    user = spark.createDataFrame([("by_pattern", "out", "y", True, "B"), ("by_pattern", "path_", "x", True, None), ("by_pattern", "longer than any", "z", True, None)], "kind string, key string, value string, active boolean, section string")
    assert {r["param"]: r["value"] for r in namelist.build_values(template, user).collect()} == {"path_in": "x", "path_out": "y"}
    assert [tuple(r) for r in namelist.validate(template, user).collect()] == [("unknown section", "B")]
    long = "S" + "x" * 1500
    lines = spark.createDataFrame([("f", 0, f"&{long}"), ("f", 1, "a = 1, &"), ("f", 2, " 2 ! two"), ("f", 3, "b = 3"), ("f", 4, "/")], "file string, n int, text string")
    assert [(r["section"], r["param"], r["value"]) for r in text.parse_namelist(text.join_continued(lines)).collect()] == [(long, "a", "1,  2"), (long, "b", "3")]
