"""Operators against hand-computed constants, small fixtures and brute force."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroloom import model
from hydroloom.functions import strings, times
from hydroloom.operators import masks, physics, series, shaping, spatial
from hydroloom.plans import pipelines, settings
from hydroloom.runner import execution, namelist
from hydroloom.sinks import tables
from hydroloom.sources import binary, text
from hydroloom.streaming import steps

L = lambda v: F.lit(v).cast("double")
T = lambda t: F.lit(t).cast("timestamp_ntz")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: physics.relative_humidity(L(293.15), L(283.15)), 52.511655),
        (lambda: physics.relative_humidity(L(293.15), L(294.15)), 100),
        (lambda: physics.relative_humidity(L(293.15), L(294.15), clip=False), 106.368009),
        (lambda: physics.vapour_mismatch(L(283.15), L(0.008)), -0.697406),
        (lambda: physics.wind_speed(L(3), L(-4)), 5),
        (lambda: physics.wind_direction_to(L(3), L(-4)), 306.869898),
        (lambda: physics.air_pressure(L(500)), 95.527647),
        (lambda: physics.flux(L(1_800_000), 3600), 500),
        (lambda: physics.to_celsius(L(293.15), F.lit("K")), 20),
        (lambda: physics.to_celsius(L(20), F.lit("C")), 20),
        (lambda: physics.to_kelvin(physics.to_celsius(L(280), F.lit("")), F.lit("")), 280),
    ],
)
def test_golden_constants(spark, make, want):
    assert value(spark, make()) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "time, rain, z, ar, k",
    [("2024-06-21 12:00:00", 0, 500, 1187.8763, 846.3618), ("2024-06-21 00:00:00", 0, 500, 0, 0), ("2024-12-21 12:00:00", 4, None, 484.6052, 204.7457)],
)
def test_radiation_of_the_sun(spark, time, rain, z, ar, k):
    assert value(spark, physics.extraterrestrial(L(44), L(12), T(time), 3600)) == pytest.approx(ar, abs=1e-3)
    assert value(spark, physics.clear_sky(L(rain), L(44), L(12), T(time), 3600, None if z is None else L(z))) == pytest.approx(k, abs=1e-3)


@pytest.mark.parametrize("rain, want", [(0, 0.95), (1, 0.75), (3, 0.65), (5, 0.5), (10, 0.15), (-1, 0), (math.nan, None), (None, None)])
def test_cloud_factor(spark, rain, want):
    assert value(spark, physics.cloud_factor(L(rain))) == want


def field(spark, values, rows=None, step=0.1, var="x", time="2024-01-01 00:00:00"):
    a = np.array(values, dtype=object)
    cells = [(var, datetime.fromisoformat(time), r, c, 46 - step * r, 10 + step * c, a[r, c]) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(cells, model.GRID)


def terrain(spark, values, step=0.1, shift=0.0):
    a = np.array(values, float)
    return spark.createDataFrame([(r, c, 46 + shift - step * r, 10 + step * c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], model.REF)


def matrix(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_masks(spark):
    grid, ref = field(spark, [[1.0, 2.0], [None, math.nan]]), terrain(spark, [[5, -9999], [1, math.nan]])
    assert matrix(masks.mask_by_ref(grid, ref, no_data=-1.0))[0, 1] == -1
    once = masks.mask_by_ref(grid.filter("row = 0"), ref)
    assert matrix(once) == matrix(masks.mask_by_ref(once, ref))
    lazy = matrix(masks.mask_by_ref(grid, ref, ref_value=77.0, no_data=-1.0))
    assert lazy[1, 1] == -1 and lazy[0, 1] == 2
    with pytest.raises(ValueError):
        masks.mask_by_ref(grid, ref, ref_value=77.0, mode="strict")
    assert matrix(masks.mask_by_limits(grid, 1.5, 9)) == {(0, 0): -9999, (0, 1): 2, (1, 0): -9999, (1, 1): -9999}


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(1)
    place = lambda n: [(i, 0, rng.uniform(43.9, 44.9), rng.uniform(179.5, 180.5)) for i in range(n)]
    src, tgt = place(60), place(80)
    schema = "row int, col int, lat double, lon double"
    got = {(r["src_row"], r["row"], r["rank"]) for r in spatial.neighbours(spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema), 22_000, 3).collect()}

    def xyz(p):
        lat, lon = math.radians(p[2]), math.radians(p[3])
        return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)]) * spatial.EARTH

    want = set()
    for t in tgt:
        near = sorted((float(((xyz(s) - xyz(t)) ** 2).sum()), s[0]) for s in src)
        want |= {(s, t[0], i + 1) for i, (d, s) in enumerate([x for x in near if x[0] < 22_000**2][:3])}
    assert got == want


def test_interpolation(spark):
    grid, ref = field(spark, [[1.0, 3.0], [5.0, None]]), terrain(spark, [[1, 1], [1, 1]])
    assert matrix(spatial.interpolate(grid, ref))[0, 1] == 3
    idw = matrix(spatial.interpolate(grid, ref, "idw", most=4))
    assert idw[0, 0] == 1 and 1 < idw[1, 1] < 5
    far = terrain(spark, [[1]], shift=3.0)
    assert spatial.interpolate(grid, far).count() == 0
    assert matrix(spatial.complete(spatial.interpolate(grid, far), far)) == {}
    assert matrix(spatial.complete(grid.filter("row = 0"), ref, -1.0))[1, 1] == -1


def test_overlay_of_tiles_and_times(spark):
    a, b, ref = field(spark, [[1.0, 2.0]]), field(spark, [[None, 7.0]]), terrain(spark, [[1, 1]])
    assert matrix(spatial.merge_by_ref([a, b], ref)) == {(0, 0): 1, (0, 1): 7}
    assert matrix(spatial.merge_by_ref([b, a], ref)) == {(0, 0): 1, (0, 1): 2}
    assert matrix(spatial.merge_by_ref([a], ref)) == matrix(spatial.interpolate(a, ref))
    cube = pipelines.multi_time([("2024-01-01 00:00:00", a), ("2024-01-01 01:00:00", b)], ref)
    assert cube.count() == 6 and cube.filter("var = 'terrain' and time is null").count() == 2 and cube.filter("value = -9999").count() == 1
    assert matrix(pipelines.multi_tile([a], terrain(spark, [[-9999, 1]]), {"x": 0.0})) == {(0, 0): 0, (0, 1): 2}


def test_multi_variable_chain(spark):
    u, v, ref = field(spark, [[3.0, 6.0]]), field(spark, [[4.0, 8.0]]), terrain(spark, [[1, -9999]])
    wind = lambda wide: wide.withColumn("value", physics.wind_speed(F.col("u"), F.col("v")))
    out = pipelines.multi_variable({"u": u, "v": v}, ref, {"wind": wind}, [("interpolate_data", {"method": "nn"}), ("mask_data_by_ref", {})])
    assert matrix(out.filter("var = 'wind'")) == {(0, 0): 5, (0, 1): -9999} and out.count() == 6


def test_points_warp_and_samples(spark):
    pts = spark.createDataFrame([(1, 46.0, 10.0, 4.0), (2, 46.01, 10.0, 8.0), (3, 50.0, 10.0, None)], "point long, lat double, lon double, value double")
    ref = terrain(spark, [[1, 1]])
    got = spatial.resample_points(pts, ref, 5_000, least=2).collect()
    assert [(r["row"], r["col"], r["n"], r["value"]) for r in got] == [(0, 0, 2, 4.0)]
    assert spatial.support_mask(spark.createDataFrame([(0, 0)], "row int, col int")).count() == 9
    assert spatial.warp(field(spark, [[1.0, 2.0], [3.0, 4.0]]), 0.05, spark).count() == 9
    at = spark.createDataFrame([(1, 46.0, 10.1), (2, 40.0, 10.0)], "p int, lat double, lon double")
    assert {r["p"]: r["sampled"] for r in spatial.sample_at(at, terrain(spark, [[1, 2]]), 9.95, 46.05, 0.1, 1, 2).collect()} == {1: 2.0, 2: None}


def test_as_of_never_looks_ahead(spark):
    data = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0), 1.0), ("a", datetime(2024, 1, 1, 1, 30), 2.0)], "k string, time timestamp_ntz, value double")
    probes = spark.createDataFrame([("a", datetime(2024, 1, 1, h, m)) for h, m in ((0, 0), (1, 0), (1, 1), (1, 30), (3, 0))] + [("b", datetime(2024, 1, 1))], "k string, probe_time timestamp_ntz")
    shown = lambda df: {(r["k"], r["probe_time"].hour, r["probe_time"].minute): r["value"] for r in df.collect()}
    assert shown(series.as_of(probes, data, ["k"], 3600)) == {("a", 0, 0): 1, ("a", 1, 0): 1, ("a", 1, 1): None, ("a", 1, 30): 2, ("a", 3, 0): None, ("b", 0, 0): None}
    assert shown(series.as_of(probes, data, ["k"], 3600, nearest=True))["a", 1, 1] == 2


def test_registry_join_keeps_names_if_counts_differ(spark):
    data = spark.createDataFrame([(datetime(2024, 1, 1), 0, 1.0, 1), (datetime(2024, 1, 1), 0, 2.0, 2), (None, 0, 3.0, 3)], "time timestamp_ntz, pos int, value double, line int")
    registry = spark.createDataFrame([(0, "a:b")], "pos int, tag string")
    db = spark.createDataFrame([("a:b", 1), ("a:b", 2)], "tag string, thr int")
    assert sorted((r["value"], r["thr"]) for r in series.join_registry(data, registry, db).collect()) == [(2.0, 1), (2.0, 2)]
    assert series.join_registry(data, registry.limit(0), db).count() == 0
    assert series.concat_columns([data.select("time"), data.select("time")]).count() >= 1
    assert value(spark, series.valid_for_table(L(-9998))) is False and value(spark, series.valid_for_chart(L(-5))) is True


def test_times(spark):
    assert times.window_of_run(datetime(2010, 1, 9, 14), 12, "h") == {"start": datetime(2010, 1, 9, 14), "end": datetime(2010, 1, 10, 1), "restart": datetime(2010, 1, 9, 13), "frequency": 3600}
    assert times.window_of_run(datetime(2022, 5, 23, 16), 24, "h")["end"] == datetime(2022, 5, 24, 15)
    assert times.frequency("m") == (1, "month") and times.seconds("15min") == 900
    with pytest.raises(ValueError):
        times.seconds("m")
    assert times.ensure_range(datetime(2024, 1, 1), datetime(2024, 1, 1), timedelta(hours=1)) == (datetime(2024, 1, 1), datetime(2024, 1, 1, 1))
    with pytest.raises(ValueError):
        times.intersect((datetime(2024, 1, 2), datetime(2024, 1, 3)), (datetime(2024, 1, 4), datetime(2024, 1, 5)))
    assert value(spark, times.parse_any(F.lit("202401020304"))) == datetime(2024, 1, 2, 3, 4) and value(spark, times.parse_any(F.lit("x"))) is None
    assert value(spark, times.time_from_name(F.lit("map_v2_202401020304.tif"))) == datetime(2024, 1, 2, 3, 4)
    assert value(spark, times.cf_encode(T("1970-01-02 12:00:00"))) == 1.5
    assert value(spark, times.cf_decode(times.cf_encode(T("2024-05-06 07:08:09"), "1858-11-17"), "1858-11-17")) == datetime(2024, 5, 6, 7, 8, 9)


def test_texts_are_tried_by_fitting_formats_only(spark):
    """What each text gives is as if every format were tried, but no format is tried on a text whose form it can't have."""
    texts = ["202401020304", "20240102", "2024-01-02", "2024-01-02 03:04", "2024-01-02 03:04:05", "2024-13-02", "2024-01-02 03", "20240102030405", "", "x", "2024-01-02\n", " 20240102", "02024-01-02"]
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyyMMddHHmm", "yyyyMMdd", "yyyy-MM-dd")
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    every = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in formats]).cast("timestamp_ntz")
    got = frame.select("t", times.parse_any(F.col("t")).alias("got"), every.alias("want"))
    assert [r for r in got.collect() if r["got"] != r["want"]] == [] and got.filter("got is not null").count() >= 5
    plan = frame.select(times.parse_any(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE(t#") == len(formats)
    # a format with words isn't judged by its form
    assert value(spark, times.parse_any(F.lit("2 Jan 2024"), ("d MMM yyyy",))) == datetime(2024, 1, 2)


def test_strings(spark):
    assert strings.fill("{run:%Y/%m}/{var}_{x}.nc", {"run": datetime(2024, 2, 1), "var": ["a", "b"]}) == ["2024/02/a_{x}.nc", "2024/02/b_{x}.nc"]
    time, tags = strings.date_and_tags(F.lit("in/2024/01/hmc_20240102_po.txt"), "in/%Y/%m/hmc_%Y%m%d_{basin}.txt")
    assert value(spark, time) == datetime(2024, 1, 2) and value(spark, tags["basin"]) == "po"
    assert value(spark, strings.section_tag(F.lit("Po, Ponte Nuovo"))) == "po:ponte_nuovo" and value(spark, strings.section_tag(F.lit("Po"))) == "po"
    kinds = {t: tuple(value(spark, strings.fortran_scalar(F.lit(t)))) for t in ("'a b'", ".true.", "3", "1.5d0", "abc")}
    assert kinds == {"'a b'": ("str", "a b"), ".true.": ("bool", "true"), "3": ("int", "3"), "1.5d0": ("float", "1.5d0"), "abc": ("str", "abc")}


def test_shaping(spark):
    grid = field(spark, [[1.0, 2.0, 300.0]])
    assert {r["var"] for r in shaping.rename_or_drop(grid, {"y": "x"}).collect()} == {"y"} and shaping.rename_or_drop(grid, {"q": "r"}).count() == 0
    assert shaping.narrow_types(grid).first()["kind"] == "uint16"
    assert matrix(shaping.flip_rows(field(spark, [[1.0], [2.0]]), 2)) == {(0, 0): 2, (1, 0): 1}
    assert value(spark, shaping.reset_no_data(L(-9999), -9999, None)) is None
    flat = shaping.percentile_stretch(field(spark, [[2.0, 2.0]])).first()
    assert (flat["vmin"], flat["vmax"], flat["stretched"]) == (2, 2, None)
    assert '"coordinates":[1.0,2.0]' in value(spark, shaping.geojson_point(L(1), L(2)))


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_text_sources(spark, tmp_path):
    asc = write(tmp_path, "dem.asc", "ncols 2\nnrows 2\nxllcorner 10\nyllcorner 45\ncellsize 0.5\nNODATA_value -9999\n1 2 3\n-9999\n")
    cells = {(r["row"], r["col"]): (r["lat"], r["lon"], r["ref_value"]) for r in text.read_ascii_grid(spark, asc).collect()}
    assert cells == {(0, 0): (45.75, 10.25, 1), (0, 1): (45.75, 10.75, 2), (1, 0): (45.25, 10.25, 3), (1, 1): (45.25, 10.75, None)}
    data = text.read_sections_data(spark, write(tmp_path, "q.txt", "202401010000 1.5 x\n202401010000 2 3\n"))
    assert series.keep_last(data, ["time", "pos"], "line").filter("pos = 0").first()["value"] == 2
    reg = text.read_sections_registry(spark, write(tmp_path, "reg.txt", "# c\n1 2 Po Ponte\nbad line\n3 4 Po\n")).collect()
    assert [(r["pos"], r["x"], r["tag"]) for r in reg] == [(0, 1, "po:ponte"), (1, 3, "po:_")]
    db = text.read_sections_db(spark, write(tmp_path, "db.csv", "ID;BACINO;DATI_DA\n1;Po;Po, A\n2;Arno;Arno, B\n"), {"BACINO": "PO"}, {"ID": "id"}).collect()
    assert [(r["id"], r["tag"]) for r in db] == [("1", "po:a")]
    doc = '{"section_domain":"d","section_name":"s","time_run":"r","time_period":"2024-01-01 00:00,2024-01-01 01:00,2024-01-01 02:00","time_series_discharge_observed":"1,,-9999","time_series_discharge_simulated":"5"}'
    hydro = text.read_hydrographs(spark, write(tmp_path, "h.json", doc)).collect()
    assert [(r["kind"], r["value"]) for r in sorted(hydro, key=lambda r: (r["kind"], r["pos"]))] == [("observed", 1), ("observed", None), ("observed", None), ("simulated", 5), ("simulated", None), ("simulated", None)]
    nml = text.read_namelist(spark, write(tmp_path, "a.nml", "&HMC\n a = 1, ! one\n b = 'x'\n/\nc = 3\n")).collect()
    assert [(r["section"], r["param"], r["value"]) for r in nml] == [("hmc", "a", "1"), ("hmc", "b", "'x'")]
    lakes = text.read_points(spark, write(tmp_path, "lake.txt", "1 # n\nGarda # name\n1 2\n3\n4\n5\n"), "lake").collect()
    assert lakes[0]["name"] == "Garda" and lakes[0]["fields"]["constant"] == "5"
    assert text.read_points(spark, write(tmp_path, "joint.txt", "0 # none\n"), "joint").count() == 0
    with pytest.raises(Exception, match="twice"):
        text.read_points(spark, write(tmp_path, "lakes.txt", "2\nA\n1\n1\n1\n1\nA\n1\n1\n1\n1\n"), "lake").count()


def test_int_cube_in_fortran_order(spark, tmp_path):
    cube = np.arange(12).reshape(2, 3, 2)
    (tmp_path / "a.bin").write_bytes(cube.astype("<i4").tobytes(order="F"))
    got = {(r["row"], r["col"], r["t"]): r["value"] for r in binary.read_int_cube(spark, str(tmp_path / "a.bin"), 2, 3).collect()}
    assert got == {(i, j, t): cube[i, j, t] / 10 for i in range(2) for j in range(3) for t in range(2)}
    (tmp_path / "b.bin").write_bytes(cube[:, :, 0].astype("<i4").tobytes(order="F"))
    assert binary.read_int_cube(spark, str(tmp_path / "b.bin"), 2, 3, expected=4).count() == 24
    assert binary.format_of("a/b.TIF") == "geotiff"
    with pytest.raises(ValueError):
        binary.format_of("a.gz")


def test_sinks(spark, tmp_path):
    grid = field(spark, [[1.0, None], [-99999.0, 4.0]])
    out = {(r["south_north"], r["west_east"]): r["value"] for r in tables.hmc_layout(grid, 2).collect()}
    assert out == {(1, 0): 1, (1, 1): -9999, (0, 0): -9999, (0, 1): 4}
    tables.write_grid(grid, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).filter("day = '2024-01-01'").count() == 4
    tables.write(grid, str(tmp_path / "c"), "csv.gz")
    assert binary.read(spark, str(tmp_path / "c"), "csv").count() == 4
    lines = [r["line"] for r in tables.ascii_grid_lines(terrain(spark, [[1, 2], [3, -9999]])).orderBy("row").collect()]
    assert lines == ["1.0 2.0", "3.0 -9999.0"]


def test_namelist_text(spark):
    template = spark.createDataFrame([("S", 1, "sPath", "mandatory", None, "str"), ("S", 2, "iFlag", "default", "1", "int"), ("S", 3, "iFlagX", "default", "2", "int")], "section string, ord int, param string, mode string, default_value string, value_kind string")
    user = spark.createDataFrame([("by_value", "iFlag", "7", True), ("by_pattern", "Flag", "9", True), ("by_value", "nope", "1", None), ("by_pattern", "Path", "no", False)], "kind string, key string, value string, active boolean")
    values = namelist.build_values(template, user)
    assert {r["param"]: r["value"] for r in values.collect()} == {"sPath": None, "iFlag": "7", "iFlagX": "9"}
    assert {(r["problem"], r["param"]) for r in namelist.validate(template, user).collect()} == {("missing mandatory", "sPath"), ("unknown parameter", "nope")}
    assert namelist.to_text(values.fillna({"value": "p"})).first()["text"] == "&S\n    sPath = 'p'\n    iFlag = 7\n    iFlagX = 9\n/"


def test_runs_and_settings(spark):
    ledger = execution.run(spark, "t", ["sh", "-c", "echo hi; echo IEEE_INVALID >&2"])
    assert execution.is_done(ledger, "t") and execution.summary(ledger).first()["runs"] == 1
    assert not execution.is_done(execution.run(spark, "t", ["sh", "-c", "echo bad >&2"]), "t")
    table = settings.resolve(settings.merge_by_priority({"a": "x", "b": None}, {"a": "y", "b": "{a}/z"}))
    assert table == {"a": "x", "b": "x/z"} and settings.override(table, {"A": "3"}, {"a": "int"})["a"] == 3
    assert settings.fill({"p": ["{a}", "{q}"], "n": "{none}"}, {"a": "v", "none": "null"}) == {"p": ["v", "{q}"], "n": None}
    tree = {"a": {"b": 1}, "c": 2}
    assert settings.unflatten(settings.flatten(tree)) == tree
    with pytest.raises(KeyError):
        settings.check_keys({"a": 1}, {"b"})


def test_file_stream_runs_each_step_once(spark, tmp_path):
    field(spark, [[1.0, 2.0]]).write.parquet(str(tmp_path / "in/1"))
    field(spark, [[3.0, 4.0]], time="2024-01-01 01:00:00").write.parquet(str(tmp_path / "in/2"))
    run = lambda: steps.run_steps(steps.stream_grids(spark, str(tmp_path / "in/*")), lambda g: masks.mask_by_limits(g, 2, 3), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [-9999, -9999, 2, 3]
