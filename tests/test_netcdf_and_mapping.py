"""Classic NetCDF bytes built by hand, the writer's own files, the tag mapper's odd cases."""

from __future__ import annotations

import struct
from datetime import datetime

import numpy as np
import pytest

from hydroloom.plans import mapping
from hydroloom.runner import namelist
from hydroloom.sources import binary, netcdf


def text(s: str) -> bytes:
    return struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")


def note(name: str, kind: int, raw: bytes, n: int) -> bytes:
    return text(name) + struct.pack(">ii", kind, n) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")


def packed_file(two_axes: bool = False, streamed: bool = False) -> bytes:
    """CDF-1: two records of packed shorts over 2 x 3 cells, and the records' times."""
    lat, lon = np.array([46.0, 45.5]), np.array([10.0, 10.5, 11.0])
    if two_axes:
        lat, lon = np.repeat(lat, 3), np.tile(lon, 2)
    dims = struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0) + text("lat") + struct.pack(">i", 2) + text("lon") + struct.pack(">i", 3)
    notes = struct.pack(">ii", 12, 3) + note("_FillValue", 3, struct.pack(">h", -1), 1) + note("scale_factor", 5, struct.pack(">f", 0.5), 1) + note("add_offset", 6, struct.pack(">d", 100.0), 1)
    units = b"hours since 2024-01-01 06:00:00"

    def head(at: list[int]) -> bytes:
        axis = [1, 2] if two_axes else None
        var = lambda name, ids, about, kind, size, begin: text(name) + struct.pack(f">{len(ids) + 1}i", len(ids), *ids) + about + struct.pack(">iii", kind, size, begin)
        none = struct.pack(">ii", 0, 0)
        records = 2**32 - 1 if streamed else 2
        return (
            b"CDF\x01" + struct.pack(">I", records) + dims + struct.pack(">ii", 12, 1) + note("title", 2, b"test", 4) + struct.pack(">ii", 11, 4)
            + var("lat", axis or [1], none, 6, lat.nbytes, at[0]) + var("lon", axis or [2], none, 6, lon.nbytes, at[1])
            + var("time", [0], struct.pack(">ii", 12, 1) + note("units", 2, units, len(units)), 4, 4, at[2]) + var("T", [0, 1, 2], notes, 3, 12, at[3])
        )

    begin = len(head([0] * 4))
    at = [begin, begin + lat.nbytes, begin + lat.nbytes + lon.nbytes, begin + lat.nbytes + lon.nbytes + 4]
    records = b"".join(struct.pack(">i", hour) + np.array(values, ">i2").tobytes() for hour, values in ((0, [0, 1, 2, 3, 4, -1]), (3, [10, 11, 12, 13, 14, 15])))
    return head(at) + lat.astype(">f8").tobytes() + lon.astype(">f8").tobytes() + records


@pytest.mark.parametrize("two_axes", [False, True])
@pytest.mark.parametrize("streamed", [False, True])
def test_packed_records(spark, tmp_path, two_axes, streamed):
    (tmp_path / "a.nc").write_bytes(packed_file(two_axes, streamed))
    rows = sorted(tuple(r)[1:] for r in binary.read(spark, str(tmp_path / "a.nc")).collect())
    want = []
    for hour, values in ((6, [100.0, 100.5, 101.0, 101.5, 102.0, None]), (9, [105.0, 105.5, 106.0, 106.5, 107.0, 107.5])):
        want += [("T", datetime(2024, 1, 1, hour), i // 3, i % 3, 46.0 - 0.5 * (i // 3), 10.0 + 0.5 * (i % 3), v) for i, v in enumerate(values)]
    assert rows == want


def test_other_files_raise(spark):
    for content in (b"\x89HDF\r\n", b""):
        with pytest.raises(Exception, match="no classic NetCDF"):
            netcdf.decode(spark.createDataFrame([("x.nc", content)], "path string, content binary")).collect()


def test_written_files_read_again(spark):
    fields = "var string, time timestamp_ntz, lat double, lon double, value double"
    data = [("b", datetime(2024, 2, 29, 13, 30), 46.0, 10.0, 1.5), ("a", datetime(2024, 2, 29, 13, 30), 45.0, 11.0, None), ("a", datetime(2024, 3, 1), 45.0, 11.0, -2.0)]
    files = netcdf.encode(spark.createDataFrame(data, fields))
    rows = netcdf.decode(files.selectExpr("cast(time as string) path", "content")).filter("value is not null").collect()
    assert sorted((r["var"], r["time"], r["lat"], r["lon"], r["value"]) for r in rows) == sorted(d for d in data if d[4] is not None)
    assert netcdf.decode(files.selectExpr("cast(time as string) path", "content")).count() == 2 * 4 + 1
    assert netcdf.encode(spark.createDataFrame([], fields)).count() == 0


def test_mapping_without_partners(spark):
    labels = spark.createDataFrame([("c", 0, "T"), ("c", 0, "P"), ("only in", 0, "Z"), ("c", 1, "T")], "collection string, part int, label string")
    items = spark.createDataFrame([("c", 0, "tp", "rain"), ("c", 0, "t2m", "air_t"), ("only in", 0, "z", "z"), ("c", 1, "t2m", "air_t2")], "collection string, part int, item string, value string")
    outs = spark.createDataFrame([("c", 0, "air_t2", "Air")], "collection string, part int, item string, value string")
    out_labels = spark.createDataFrame([("c", 0, "T")], "collection string, part int, label string")
    rows = mapping.mapped_rows((labels, items), (out_labels, outs))
    # labels P, T meet items t2m, tp by order; the second part's t2m belongs to T
    assert sorted(tuple(r)[:4] for r in rows.collect()) == [("P", "t2m", "air_t", None), ("T", "t2m", "air_t2", "Air"), ("T", "tp", "rain", None)]
    assert mapping.pairs(rows, "T", "tag").count() == 2 and mapping.pairs(rows, "T:rain", "reference").count() == 1 and mapping.pairs(rows, "none").count() == 0
    for name, kind in (("T", "kind"), ("T", "reference")):
        with pytest.raises(ValueError):
            mapping.pairs(rows, name, kind)
    assert [r["in"] for r in mapping.by_priority(rows, []).orderBy("rank", "tag").collect()] == ["t2m", "t2m", "tp"]


def test_template_without_mandatory(spark):
    parsed = spark.createDataFrame([("f", "S", 1, "p", "1"), ("f", "S", 2, "p", "2"), ("g", "S", 1, "p", "3")], "file string, section string, ord int, param string, value string")
    versions = spark.createDataFrame([("f", "hmc", "3")], "file string, model string, version string")
    rows = namelist.of_version(namelist.template_of(parsed, versions), "HMC", "3").collect()
    assert [tuple(r) for r in rows] == [("S", 2, "p", "default", "2")]
