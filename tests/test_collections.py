"""Collected fields and what is wrong with their geometry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hydroloom.operators import collections


@pytest.fixture
def ref(spark):
    return spark.createDataFrame([(r, c, 46.0 - 0.5 * r, 10.0 + 0.5 * c) for r in range(3) for c in range(4)], "row int, col int, lat double, lon double")


def part(ref, dy=0.0, dx=0.0):
    return ref.select("row", "col", (F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon"), (F.col("row") * 10 + F.col("col")).cast("double").alias("value"))


def test_parts_take_the_references_coordinates(ref):
    out = collections.collect_grids({"a": part(ref), "b": part(ref, 0.2, -0.4).withColumn("time", F.lit("2024-01-01 05:00:00").cast("timestamp")), "c": part(ref, 0.6)}, ref)
    rows = out.collect()
    assert out.columns == ["var", "time", "row", "col", "lat", "lon", "value", "same_box"] and len(rows) == 36
    assert all((r["lat"], r["lon"], r["value"]) == (46.0 - 0.5 * r["row"], 10.0 + 0.5 * r["col"], 10.0 * r["row"] + r["col"]) for r in rows)
    assert {(r["var"], r["same_box"]) for r in rows} == {("a", True), ("b", True), ("c", False)}
    assert {r["time"] is None for r in rows if r["var"] == "b"} == {False} and {r["time"] for r in rows if r["var"] == "a"} == {None}


def test_wrong_geometry_raises(spark, ref):
    with pytest.raises(Exception, match="part b has 2 rows and 4 columns"):
        collections.collect_grids({"a": part(ref), "b": part(ref).filter("row < 2")}, ref).collect()
    with pytest.raises(Exception, match="part b lies elsewhere"):
        collections.collect_grids({"b": part(ref, 0.0, 0.6)}, ref, raise_on_box=True).collect()
    assert collections.collect_grids({"b": part(ref, 0.5)}, ref, raise_on_box=True).count() == 12
    assert collections.collect_grids({"a": part(ref).limit(0)}, ref).count() == 0
    one = ref.filter("row = 0 and col = 0")
    assert collections.collect_grids({"a": part(one)}, one).count() == 1
    with pytest.raises(ValueError, match="no part"):
        collections.collect_grids({}, ref)
