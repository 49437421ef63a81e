"""Binary formats read by byte range, and the sink of whole files."""

from __future__ import annotations

import gzip
import os
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull

from hydroloom.sinks import files
from hydroloom.sinks import netcdf as netcdf_sink
from hydroloom.sources import binary, geotiff, grib, netcdf, ranged, shapefile

RNG = np.random.default_rng(1)


def packed_codes(codes: list[int], width: int = 9) -> bytes:
    bits = "".join(format(c, f"0{width}b") for c in codes)
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw_of_the_formats_own_example():
    assert geotiff.unpack_lzw(packed_codes([256, 7, 258, 8, 8, 258, 6, 6, 257])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    # widths grow when 511 codes are known, one early
    codes = [256] + list(range(250)) + [0, 2, 4, 6]
    wide = "".join(format(c, "09b") for c in codes) + "".join(format(c, "010b") for c in (9, 510, 257))
    assert geotiff.unpack_lzw(int(wide.ljust(-(-len(wide) // 8) * 8, "0"), 2).to_bytes(-(-len(wide) // 8), "big")) == bytes([*range(250), 0, 2, 4, 6, 9, 4, 6])
    with pytest.raises(ValueError, match="damaged"):
        geotiff.unpack_lzw(packed_codes([256, 7, 300]))


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 9000, bytes(RNG.integers(0, 256, 20_000, "u1")), bytes(RNG.integers(0, 3, 60_000, "u1"))])
def test_lzw_round_trip(data):
    assert geotiff.unpack_lzw(geotiff.pack_lzw(data)) == data


def test_packbits():
    assert geotiff.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80, 0x03, 1, 2, 3, 4])) == bytes([0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4 + [1, 2, 3, 4])


KINDS = {
    "strips": {"rows_per_strip": 7},
    "one strip": {},
    "tiles": {"tile": (16, 16)},
    "lzw strips": {"compression": geotiff.LZW, "rows_per_strip": 5},
    "lzw tiles, predictor": {"compression": geotiff.LZW, "tile": (16, 32), "predictor": geotiff.HORIZONTAL},
    "deflate, predictor": {"compression": geotiff.DEFLATE, "predictor": geotiff.HORIZONTAL, "rows_per_strip": 9},
    "deflate, float predictor": {"compression": geotiff.DEFLATE, "predictor": geotiff.FLOATING, "tile": (16, 16)},
    "big end first": {"order": ">", "compression": geotiff.DEFLATE, "rows_per_strip": 4},
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("dtype", ["f4", "f8", "i2", "u1", "i4"])
def test_rasters(tmp_path, kind, dtype):
    settings = KINDS[kind]
    if settings.get("predictor") == geotiff.FLOATING and dtype[0] != "f":
        return
    field = (RNG.random((37, 21)) * 200).astype(dtype)
    field[3, 4] = 77
    (tmp_path / "a.tif").write_bytes(geotiff.encode(field, 46.0, 10.0, 0.25, 77, **settings))
    reader = ranged.RangedReader(geotiff.GeoTiff({}), str(tmp_path / "a.tif"), {"partition_bytes": 900})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    got = {(r["row"], r["col"]): (r["lat"], r["lon"], r["value"]) for b in batches for r in b.to_pylist()}
    assert got == {(r, c): (46.0 - 0.25 * r, 10.0 + 0.25 * c, None if field[r, c] == 77 else float(field[r, c])) for r in range(37) for c in range(21)}


def test_geotiff_of_many_files(spark, tmp_path):
    fields = [RNG.random((10 + i, 8)).astype("f4") for i in range(6)]
    for i, field in enumerate(fields):
        field[1, 1] = np.nan
        (tmp_path / f"t{i}.tif").write_bytes(geotiff.encode(field, 1.0, 2.0, 0.5, point=i == 0, compression=geotiff.LZW, rows_per_strip=3))
    (tmp_path / "_hidden").write_bytes(b"no raster")
    # planned by the driver, or file by file in tasks
    for planned in (100, 2):
        rows = binary.read(spark, f"{tmp_path}/t*.tif", planned_files=planned, partition_bytes=200).collect()
        assert len(rows) == sum(f.size for f in fields)
        for r in rows:
            i = int(r["path"][-5])
            want = fields[i][r["row"], r["col"]]
            assert r["value"] == (None if np.isnan(want) else float(want)) and r["lat"] == 1.0 - 0.5 * r["row"] + 0.25 * (i == 0)
    assert geotiff.read_geotiff(spark, str(tmp_path)).filter(F.col("path").endswith("t3.tif")).count() == fields[3].size
    os.mkdir(tmp_path / "none")
    assert geotiff.read_geotiff(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "none" / "x.tif").write_bytes(b"II*\0 no directory")
    with pytest.raises(Exception, match="ends before|x.tif"):
        geotiff.read_geotiff(spark, f"{tmp_path}/none").count()


def test_south_first_and_sparse_blocks(tmp_path):
    field = np.arange(12, dtype="f4").reshape(4, 3)
    content = bytearray(geotiff.encode(field, 40.0, 5.0, 1.0, rows_per_strip=1))
    # a matrix with rising rows instead of the scale; the second strip left out
    directory = struct.unpack_from("<I", content, 4)[0]
    for i in range(struct.unpack_from("<H", content, directory)[0]):
        at = directory + 2 + 12 * i
        tag, _, many, where = struct.unpack_from("<HHII", content, at)
        if tag == geotiff.TAGS["strip_bytes"]:
            struct.pack_into("<I", content, where + 4, 0)
        if tag == geotiff.TAGS["scale"]:
            struct.pack_into("<HHI", content, at, tag, 12, 3)
            struct.pack_into("<3d", content, where, 1.0, -1.0, 0.0)
    (tmp_path / "a.tif").write_bytes(content)
    reader = ranged.RangedReader(geotiff.GeoTiff({}), str(tmp_path), {})
    rows = sorted((r["row"], r["col"], r["lat"], r["value"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())
    want = {3 - i: (40.0 + i, [None] * 3 if i == 1 else field[i].tolist()) for i in range(4)}
    assert rows == [(r, c, want[r][0], want[r][1][c]) for r in range(4) for c in range(3)]


# -- the sink of files


def pieces(spark, rows):
    return spark.createDataFrame([(n, o, bytearray(c)) for n, o, c in rows], files.PIECES)


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_files_of_pieces(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = [("b/x.bin", 3, b"def"), ("a.bin", 0, b""), ("b/x.bin", 0, b"abc"), ("b/x.bin", 6, b"g")]
    files.write_files(pieces(spark, rows).repartition(4), path)
    assert listed(path) == ["a.bin", "b/x.bin"] and (tmp_path / "out/b/x.bin").read_bytes() == b"abcdefg"
    with pytest.raises(Exception, match="FileExists|a.bin"):
        files.write_files(pieces(spark, [("a.bin", 0, b"new"), ("c.bin", 0, b"new")]), path)
    assert listed(path) == ["a.bin", "b/x.bin"] and (tmp_path / "out/a.bin").read_bytes() == b""
    files.write_files(pieces(spark, [("a.bin", 0, b"new")]), path, overwrite=True)
    files.write_files(pieces(spark, [("a.bin", 0, b"new")]), path, packed=True)
    assert (tmp_path / "out/a.bin").read_bytes() == b"new" and gzip.decompress((tmp_path / "out/a.bin.gz").read_bytes()) == b"new"
    files.write_files(pieces(spark, []), path)
    assert listed(path) == ["a.bin", "a.bin.gz", "b/x.bin"]


@pytest.mark.parametrize("rows, said", [([("a", 0, b"ab"), ("a", 3, b"c")], "begins at 3"), ([("../a", 0, b"ab")], "no name"), ([(None, 0, b"ab")], "no name")])
def test_a_failing_task_leaves_no_file(spark, tmp_path, rows, said):
    path = f"{tmp_path}/out"
    sound = [(f"sound{i}", 0, b"x" * 1000) for i in range(20)]
    with pytest.raises(Exception, match=said):
        files.write_files(pieces(spark, sound + rows), path)
    assert listed(path) == [] and not os.path.exists(f"{path}/_temporary")


def test_gaps_are_filled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RUN_BYTES", 8)
    rows = [("a", 0, b"head"), ("a", 30, b"xy"), ("a", 36, b""), ("b", 2, b"cd")]
    files.write_files(pieces(spark, rows), str(tmp_path), fill=b"01", files=2)
    assert (tmp_path / "a").read_bytes() == b"head" + b"01" * 13 + b"xy" + b"01" * 2 and (tmp_path / "b").read_bytes() == b"01cd"
    for bad in ([("c", 0, b"head"), ("c", 5, b"x")], [("c", 0, b"head"), ("c", 2, b"x")]):
        with pytest.raises(Exception, match="begins at"):
            files.write_files(pieces(spark, bad), str(tmp_path), fill=b"01")


# -- NetCDF


def fields(spark, steps=30):
    rows = [(v, datetime(2024, 1, 1 + t // 24, t % 24), r, c, None if (r, c) == (0, 0) else float("nan") if (r, c) == (0, 1) else -20_000.0 if (r, c) == (1, 0) else 10.0 * t + r + c / 10) for v in ("rain", "wind") for t in range(steps) if v == "rain" or t % 2 for r in range(3) for c in range(4) if (r, c) != (2, 3)]
    grid = spark.createDataFrame(rows, "var string, time timestamp_ntz, row int, col int, value double")
    ref = spark.createDataFrame([(r, c, 46.0 - 0.5 * r, 10.0 + 0.5 * c) for r in range(3) for c in range(4)], "row int, col int, lat double, lon double")
    return grid, ref, rows


def day():
    return F.date_format("time", "'f'yyyyMMdd'.nc'")



HMC = {"y": "south_north", "x": "west_east", "lat": "latitude", "lon": "longitude"}
S3M = HMC | {"y": "Y", "x": "X"}


@pytest.mark.parametrize("layout, names", [(netcdf_sink.HMC, HMC), (netcdf_sink.S3M, S3M), (netcdf_sink.GENERIC, {})])
@pytest.mark.parametrize("packed", [False, True])
def test_written_fields_are_read_again(spark, tmp_path, layout, names, packed):
    grid, ref, rows = fields(spark)
    path = f"{tmp_path}/out"
    odd = spark.createDataFrame([("rain", datetime(2024, 1, 1), 9, 0, 1.0), ("rain", None, 0, 0, 1.0), ("rain", datetime(2024, 1, 1), 1, 1, -5.0)], grid.schema)
    netcdf_sink.write_netcdf(grid.unionByName(odd), ref, path, day(), layout, packed=packed)
    assert listed(path) == [f"f2024010{d}.nc{'.gz' * packed}" for d in (1, 2)]
    read = netcdf.read_netcdf(spark, path, **names)
    assert read.count() == 2 * 30 * 12
    got = {(r["var"], r["time"], r["row"], r["col"]): (r["lat"], r["lon"], r["value"]) for r in read.filter("value is not null").collect()}
    flip = (lambda r: 2 - r) if layout.south_first else (lambda r: r)
    stored = np.float32 if layout.kind == ">f4" else float
    assert got == {(v, t, flip(r), c): (46.0 - 0.5 * r, 10.0 + 0.5 * c, float(stored(x))) for v, t, r, c, x in rows if x is not None and x > -9999}


def test_headers_hold_the_models_dimensions(spark, tmp_path):
    grid, ref, _ = fields(spark, 2)
    netcdf_sink.write_netcdf(grid, ref, str(tmp_path), day(), about={"title": "fields"})
    with ranged.RangedFile(f"{tmp_path}/f20240101.nc") as file:
        head = netcdf.Header(file.read, file.size, "f")
        assert dict(head.dims) == {"west_east": 4, "south_north": 3, "time": 2, "nsim": 1, "ntime": 2, "nens": 1} and head.about == {"title": "fields"}
        assert list(head.vars) == ["time", "longitude", "latitude", "crs", "rain", "wind"] and head.vars["rain"]["dims"] == ["time", "south_north", "west_east"]
        assert head.part("latitude")[:, 0].tolist() == [45.0, 45.5, 46.0] and head.vars["rain"]["type"] == np.dtype(">f4")


def test_a_failing_field_leaves_no_file(spark, tmp_path):
    grid, ref, _ = fields(spark)
    bad = grid.withColumn("value", F.when(F.col("time") == datetime(2024, 1, 2, 3), F.raise_error(F.lit("no such value")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no such value"):
        netcdf_sink.write_netcdf(bad, ref, f"{tmp_path}/out", day())
    assert listed(tmp_path) == []
    with pytest.raises(ValueError, match="no regular grid"):
        netcdf_sink.write_netcdf(grid, ref.filter("row != 1"), f"{tmp_path}/out", day())


def test_filters_leave_bytes_unread(spark, tmp_path):
    grid, ref, rows = fields(spark)
    netcdf_sink.write_netcdf(grid, ref, str(tmp_path), day())
    since = datetime(2024, 1, 2, 2)
    reader = ranged.RangedReader(netcdf.NetCdf(HMC), str(tmp_path), {})
    whole = sum(p.bytes for work in reader.partitions() for _, parts in work.files for p in parts)
    filters = [EqualTo(("var",), "rain"), GreaterThanOrEqual(("time",), since)]
    assert reader.pushFilters(filters) == filters
    some = [p for work in reader.partitions() for _, parts in work.files for p in parts]
    assert whole == 60 * 12 * 4 and sum(p.bytes for p in some) == 4 * 12 * 4 and {p.shared["var"] for p in some} == {"rain"}
    read = netcdf.read_netcdf(spark, str(tmp_path), **HMC).filter((F.col("var") == "rain") & (F.col("time") >= F.lit(since)))
    assert read.count() == 4 * 12
    assert read.filter("value is not null").count() == len([r for r in rows if r[0] == "rain" and r[1] >= since and r[4] is not None and r[4] > -9999])
    # a partition a step, when so few bytes are asked for
    assert netcdf.read_netcdf(spark, str(tmp_path), partition_bytes=48, **HMC).rdd.getNumPartitions() == 60


@pytest.mark.parametrize("packed", [False, True])
def test_a_task_holds_a_run_of_rows(spark, tmp_path, packed, monkeypatch):
    """Steps are written and read by runs of rows, their coordinates with them, and rows without a value are left out at the source if they aren't asked for."""
    grid, ref, rows = fields(spark)
    monkeypatch.setattr(netcdf_sink, "CELLS", 4)
    netcdf_sink.write_netcdf(grid, ref, str(tmp_path), day(), packed=packed)
    want = sorted((v, t, 2 - r, c, 46.0 - 0.5 * r, 10.0 + 0.5 * c, float(np.float32(x))) for v, t, r, c, x in rows if x is not None and x > -9999)
    monkeypatch.setattr(ranged, "CELLS", 8)
    for known in (False, True):
        reader = ranged.RangedReader(netcdf.NetCdf(HMC), str(tmp_path), {})
        reader.pushFilters([IsNotNull(("value",))] if known else [])
        works = reader.partitions()
        # what a packed file holds can't be told from its size
        assert len(works) == (2 if packed else 1)
        batches = [b for w in works for b in reader.read(w)]
        assert max(b.num_rows for b in batches) <= 8
        got = [tuple(r[k] for k in ("var", "time", "row", "col", "lat", "lon", "value")) for b in batches for r in b.to_pylist()]
        assert sorted(r for r in got if r[-1] is not None) == want and len(got) == (len(want) if known else 2 * 30 * 12)


def test_long_headers_and_broken_files(spark, tmp_path):
    variables = [(f"v{i:05d}", ["time", "lat", "lon"], ">f4", {"long_name": "x" * 40}) for i in range(400)]
    fixed = [("time", ["time"], ">f8", {"units": "days since 2000-01-01"}), ("lat", ["lat"], ">f8", {}), ("lon", ["lon"], ">f8", {})]
    head, begins = netcdf.header({"time": 2, "lat": 1, "lon": 3}, fixed + variables, {})
    assert len(head) > netcdf.HEAD_BYTES
    body = np.array([0.0, 0.25], ">f8").tobytes() + np.zeros(4, ">f8").tobytes() + np.arange(6 * 400, dtype=">f4").tobytes()
    (tmp_path / "a.nc").write_bytes(head + body)
    read = netcdf.read_netcdf(spark, str(tmp_path)).filter("var = 'v00399'").orderBy("time", "col").collect()
    assert [r["value"] for r in read] == [float(6 * 399 + i) for i in range(6)] and read[3]["time"] == datetime(2000, 1, 1, 6)
    (tmp_path / "a.nc").write_bytes((head + body)[:-5])
    with pytest.raises(Exception, match="ends before"):
        netcdf.read_netcdf(spark, str(tmp_path)).count()
    (tmp_path / "a.nc").write_bytes(head[:500])
    with pytest.raises(Exception, match="damaged header"):
        netcdf.read_netcdf(spark, str(tmp_path)).count()


# -- GRIB

START = datetime(2024, 3, 1, 6)


def read_all(form, path, **options):
    reader = ranged.RangedReader(form, str(path), options)
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def as_field(rows):
    out = np.full((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.mark.parametrize("bits", [0, 1, 3, 8, 11, 16, 24, 32])
def test_numbers_of_any_width(bits):
    numbers = RNG.integers(0, 2**bits, 70_001) if bits else np.zeros(70_001)
    assert (grib.unpack_numbers(grib.pack_numbers(numbers, bits) if bits else b"", bits, len(numbers)) == numbers).all()
    if bits:
        with pytest.raises(ValueError, match="too early"):
            grib.unpack_numbers(b"\1" * 10, bits, 100)


@pytest.mark.parametrize("bits, decimals", [(8, 0), (12, 1), (24, 2), (16, 0)])
@pytest.mark.parametrize("holes", [False, True])
def test_packed_fields(tmp_path, bits, decimals, holes):
    field = np.round(250 + 40 * RNG.random((6, 9)), 2)
    if holes:
        field[RNG.random(field.shape) < 0.3] = np.nan
    (tmp_path / "a.grib").write_bytes(grib.encode(field, 45.5, -3.25, 0.25, 0.25, START, 9, (0, 0, 0), bits, decimals, (103, 2.0)))
    rows = read_all(grib.Grib({}), tmp_path)
    got = as_field(rows)
    room = 40 / (2**bits - 1) + 0.5 * 10.0**-decimals * bool(decimals)
    assert (np.isnan(got) == np.isnan(field)).all() and np.nanmax(np.abs(got - field)) <= room
    assert {(r["var"], r["level_type"], r["level"], r["time_start"], r["time"]) for r in rows} == {("t", 103, 2.0, START, datetime(2024, 3, 1, 15))}
    assert np.allclose([(rows[0]["lat"], rows[0]["lon"]), (rows[-1]["lat"], rows[-1]["lon"])], [(45.5, -3.25), (45.5 - 5 * 0.25, -3.25 + 8 * 0.25)])


def test_fields_of_nothing_and_of_one_value(tmp_path):
    nothing, one = np.full((3, 4), np.nan), np.full((3, 4), -7.5)
    (tmp_path / "a.grib").write_bytes(grib.encode(nothing, 1, 2, 1, 1, START, 0, (0, 1, 8)) + b"\0\0\0between" + grib.encode(one, 1, 2, 1, 1, START, 3, (0, 19, 200), over_hours=3))
    rows = read_all(grib.Grib({}), tmp_path)
    assert np.isnan(as_field(rows[:12])).all() and (as_field(rows[12:]) == -7.5).all() and rows[12]["var"] == "0.19.200" and rows[12]["time"] == datetime(2024, 3, 1, 9)


def turned(content: bytes, mode: int) -> bytes:
    """The message with another scanning mode."""
    at, out = 16, bytearray(content)
    while out[at + 4] != 3:
        at += struct.unpack_from(">I", out, at)[0]
    out[at + 71] = mode
    return bytes(out)


@pytest.mark.parametrize("mode", range(0, 0x100, 0x10))
def test_scanning_modes(tmp_path, mode):
    field = np.arange(12.0).reshape(3, 4)
    stored = field[:, ::-1] if mode & 0x80 else field
    stored = stored[::-1] if mode & 0x40 else stored
    if mode & 0x20:
        stored = stored.T
    if mode & 0x10:
        stored = stored.copy()
        stored[1::2] = stored[1::2, ::-1]
    # the axes in the file's own order
    west, north = 10.0, 50.0
    content = turned(grib.encode(stored.reshape(3, 4), north, west, 1, 1, START, 0, (0, 0, 0), 8), mode)
    (tmp_path / "a.grib").write_bytes(content)
    assert (as_field(read_all(grib.Grib({}), tmp_path)) == field).all()


def test_edition_1(tmp_path):
    """A message built byte by byte."""
    three = lambda n: (abs(n) | (0x800000 if n < 0 else 0)).to_bytes(3, "big")
    pds = three(28) + bytes([2, 98, 0, 255, 0x80 | 0x40, 11, 105]) + struct.pack(">H", 2) + bytes([24, 3, 1, 6, 0, 1, 3, 9, 4]) + struct.pack(">H", 0) + bytes([0, 21, 0]) + struct.pack(">H", 1)
    gds = three(32) + bytes([0, 255, 0]) + struct.pack(">HH", 3, 2) + three(46_000) + three(-1_500) + bytes([0x80]) + three(45_500) + three(-500) + struct.pack(">HH", 500, 500) + bytes([0, 0, 0, 0, 0])
    bms = three(7) + bytes([2]) + struct.pack(">H", 0) + bytes([0b11011100])
    numbers = grib.pack_numbers(np.array([0, 1, 2, 3, 4]), 4)
    # reference 2 * 16: 0x42200000; twice the packed number is added, and a tenth of all is meant
    bds_body = struct.pack(">H", 1) + bytes([0x42, 0x20, 0, 0, 4]) + numbers
    bds = three(11 + len(numbers)) + bytes([4]) + bds_body
    size = 8 + len(pds) + len(gds) + len(bms) + len(bds) + 4
    (tmp_path / "a.grb").write_bytes(b"GRIB" + three(size) + bytes([1]) + pds + gds + bms + bds + b"7777")
    rows = read_all(grib.Grib({}), tmp_path)
    assert np.array_equal(as_field(rows), [[3.2, 3.4, np.nan], [3.6, 3.8, 4.0]], equal_nan=True)
    assert {(r["var"], r["level_type"], r["level"], r["time_start"], r["time"]) for r in rows} == {("t", 105, 2.0, START, datetime(2024, 3, 1, 15))}
    assert [(r["lat"], r["lon"]) for r in rows[::5]] == [(46.0, -1.5), (45.5, -0.5)]


def test_grib_rows_without_a_value(tmp_path, monkeypatch):
    """Cells outside the bitmap have no row if only values are asked for, and count for a task's work."""
    field = np.full((40, 5), np.nan)
    field[3, 2], field[39, 0] = 1.5, 2.5
    (tmp_path / "a.grib").write_bytes(grib.encode(field, 46.0, 10.0, 0.1, 0.1, datetime(2024, 1, 1), 0, (0, 0, 0), 32, 6))
    monkeypatch.setattr(ranged, "CELLS", 16)
    for known in (False, True):
        reader = ranged.RangedReader(grib.Grib({}), str(tmp_path), {})
        reader.pushFilters([IsNotNull(("value",))] if known else [])
        (work,) = reader.partitions()
        assert work.files[0][1][0].bytes == 800
        batches = list(reader.read(work))
        assert max(b.num_rows for b in batches) <= 16 and sum(b.num_rows for b in batches) == (2 if known else 200)
        assert [(r["row"], r["col"], round(r["lat"], 6), round(r["lon"], 6), r["value"]) for b in batches for r in b.to_pylist() if r["value"] is not None] == [(3, 2, 45.7, 10.2, 1.5), (39, 0, 42.1, 10.0, 2.5)]


def test_grib_by_message(spark, tmp_path):
    field = np.round(RNG.random((20, 30)) * 100, 1)
    content = b"".join(grib.encode(field + h, 46, 10, 0.5, 0.5, START, h, key, 24, 1) for h in range(8) for key in ((0, 0, 0), (0, 2, 2), (0, 2, 3)))
    (tmp_path / "a.grib").write_bytes(content)
    (tmp_path / "b.grib.gz").write_bytes(gzip.compress(content))
    read = binary.read(spark, f"{tmp_path}/a.grib", partition_bytes=4_000)
    assert read.rdd.getNumPartitions() > 8 and read.count() == 24 * 600
    want = spark.createDataFrame([(h, float(np.round(field.sum() + 600 * h, 1))) for h in range(8)], "h int, s double")
    for path in ("a.grib", "b.grib.gz"):
        some = grib.read_grib(spark, f"{tmp_path}/{path}").filter((F.col("var") == "u") & (F.col("time") > F.lit(START)))
        sums = some.groupBy((F.hour("time") - 6).alias("h")).agg(F.round(F.sum("value"), 1).alias("s"))
        assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.filter("h > 0").collect()))
    reader = ranged.RangedReader(grib.Grib({}), f"{tmp_path}/a.grib", {})
    reader.pushFilters([EqualTo(("var",), "u"), GreaterThanOrEqual(("time",), datetime(2024, 3, 1, 12))])
    assert len([p for work in reader.partitions() for _, parts in work.files for p in parts]) == 2
    for damaged, said in ((content[:-3], "outside the file"), (content[:7] + b"\3" + content[8:], "edition 3")):
        (tmp_path / "c.grib").write_bytes(damaged)
        with pytest.raises(Exception, match=said):
            grib.read_grib(spark, f"{tmp_path}/c.grib").count()
    other = bytearray(content)
    at = content.index(struct.pack(">IB", 21, 5)) + 9
    other[at : at + 2] = struct.pack(">H", 42)
    (tmp_path / "c.grib").write_bytes(other)
    assert grib.read_grib(spark, f"{tmp_path}/c.grib").filter("var = 'u'").count() == 8 * 600
    with pytest.raises(Exception, match="packing 42"):
        grib.read_grib(spark, f"{tmp_path}/c.grib").count()


# -- shapefiles


def test_shapes_and_attributes(spark, tmp_path):
    ring = lambda x, y, size, clockwise=True: np.array([(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)][:: 1 if clockwise else -1], float)
    polygons = [(5, [ring(0, 0, 10), ring(2, 2, 1, False), ring(20, 0, 5)]), None, (5, [ring(1, 1, 1, False)]), (5, [ring(-3, -3, 1)])]
    rows = [["one", 1, 0.5, datetime(2024, 2, 29), True], [None, None, None, None, None], ["é", -7, 2.25, None, False], ["gone", 0, 0.0, None, None]]
    fields = [("name", "C", 10, 0), ("N", "N", 6, 0), ("share", "N", 10, 3), ("day", "D", 8, 0), ("good", "L", 1, 0)]
    made = shapefile.encode(polygons, shapefile.POLYGON, fields, rows)
    table = bytearray(made[".dbf"])
    table[-1 - 36] = 0x2A  # the last record is marked as deleted
    for end, content in {**made, ".dbf": bytes(table)}.items():
        (tmp_path / f"a{end}").write_bytes(content)
    read = binary.read(spark, f"{tmp_path}/a.shp")
    assert read.dtypes == [("path", "string"), ("record", "int"), ("geometry", "string"), ("name", "string"), ("N", "bigint"), ("share", "double"), ("day", "date"), ("good", "boolean")]
    got = [tuple(r)[1:] for r in read.orderBy("record").collect()]
    assert got == [
        (0, "MULTIPOLYGON (((0.0 0.0, 0.0 10.0, 10.0 10.0, 10.0 0.0, 0.0 0.0), (2.0 2.0, 3.0 2.0, 3.0 3.0, 2.0 3.0, 2.0 2.0)), ((20.0 0.0, 20.0 5.0, 25.0 5.0, 25.0 0.0, 20.0 0.0)))", "one", 1, 0.5, datetime(2024, 2, 29).date(), True),
        (1, None, None, None, None, None, None),
        (2, "POLYGON ((1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 2.0, 1.0 1.0))", "é", -7, 2.25, None, False),
    ]


def test_shapefiles_without_index_or_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "RUN", 7)
    rng = np.random.default_rng(3)
    lines = [(3, [np.round(rng.random((3, 2)), 2), np.round(rng.random((2, 2)), 2)]) for _ in range(20)]
    made = shapefile.encode(lines, shapefile.LINE, [("k", "N", 5, 0)], [[i] for i in range(20)])
    (tmp_path / "a.shp").write_bytes(made[".shp"])
    reader = lambda: ranged.RangedReader(shapefile.Shapefile({}, [("k", "long")]), str(tmp_path), {"partition_bytes": 1})
    rows = lambda: [r for p in reader().partitions() for b in reader().read(p) for r in b.to_pylist()]
    bare = rows()
    assert len(reader().partitions()) == 3 and [r["record"] for r in bare] == list(range(20)) and {r["k"] for r in bare} == {None}
    (tmp_path / "a.shx").write_bytes(made[".shx"])
    (tmp_path / "a.DBF").write_bytes(made[".dbf"])
    whole = rows()
    assert [r["geometry"] for r in whole] == [r["geometry"] for r in bare] and [r["k"] for r in whole] == list(range(20))
    assert whole[0]["geometry"] == "MULTILINESTRING (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in p.tolist()) + ")" for p in lines[0][1]) + ")"
    points = shapefile.encode([(8, [np.array([(1, 2), (3.5, 4)])])], shapefile.POINTS, [], [[]])
    assert shapefile.wkt(points[".shp"][108:]) == "MULTIPOINT (1.0 2.0, 3.5 4.0)"
    assert shapefile.wkt(struct.pack("<i3d", 11, 1, 2, 9)) == "POINT (1.0 2.0)"
    (tmp_path / "b.shp").write_bytes(bytes(200))
    with pytest.raises(Exception, match="no shapefile"):
        shapefile.read_shapefile(spark, str(tmp_path)).count()
