"""Key sets, flat tables, types and formats."""

from __future__ import annotations

from datetime import datetime

import pytest

from hydroloom.operators import shaping
from hydroloom.plans import settings
from hydroloom.sources import binary


def test_reconciled_keys():
    a, b, both = {"x": 1, "y": 2}, {"y": 3, "z": 4}, {"x": 0, "y": 0}
    assert settings.reconcile(a, both) == ["x", "y"] and settings.reconcile(a, b, "lazy") == ["y"]
    assert settings.reconcile({"y": 1}, b, "less_from_data") == ["y"] and settings.reconcile(a, {"y": 1}, "less_from_fx") == ["y"]
    for mode, left, right in (("strict", a, b), ("less_from_data", a, b), ("less_from_fx", a, b), ("lazy", a, {"w": 1}), ("lazy", {}, {})):
        with pytest.raises(KeyError, match=mode):
            settings.reconcile(left, right, mode)
    with pytest.raises(ValueError, match="no mode"):
        settings.reconcile(a, b, "loose")


def test_flat_tables():
    tree = {"a": {"b": {"c": 1}}, "d": {"e": 2}, "f": 3}
    assert settings.flatten_by(tree) == {"a:b:c": 1, "d:e": 2, "f": 3}
    assert settings.flatten_by(tree, "last") == {"c": 1, "e": 2, "f": 3} and settings.flatten_by(tree, "first") == {"a": 1, "d": 2, "f": 3}
    with pytest.raises(KeyError, match="more than once"):
        settings.flatten_by({"a": {"x": 1, "y": 2}}, "first")
    with pytest.raises(ValueError, match="no kind"):
        settings.flatten_by(tree, "middle")


def test_narrow_columns(spark):
    t = datetime(2024, 1, 1)
    values = {"byte": (0.0, 255.0), "short": (-5.0, 300.0), "long": (0.0, 2.0**40), "part": (0.5, None), "none": (None, float("nan"))}
    rows = [(v, t, r, 0, 1.0, 2.0, x) for v, pair in values.items() for r, x in enumerate(pair)]
    grid = spark.createDataFrame(rows, "var string, time timestamp_ntz, row int, col int, lat double, lon double, value double")
    out = shaping.cast_narrow(grid)
    assert dict(out.dtypes[5:]) == {"byte": "smallint", "long": "bigint", "none": "float", "part": "float", "short": "smallint"}
    got = {r["row"]: r for r in out.collect()}
    assert (got[1]["byte"], got[1]["long"], got[0]["short"], got[0]["part"], got[1]["part"]) == (255, 2**40, -5, 0.5, None)
    assert shaping.cast_narrow(grid.limit(0)).count() == 0


def test_formats_take_their_columns(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, [1])], "row int, col int, value double, more array<int>")
    assert binary.check_format(cells, "geotiff") is cells and binary.check_format(cells, "parquet") is cells
    for kind, said in (("netcdf", "time"), ("csv", "more"), ("grib", "not written")):
        with pytest.raises(ValueError, match=said):
            binary.check_format(cells, kind)
