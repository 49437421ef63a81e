"""Queries on tables repeated with shifted keys, as the driver's larger copies are, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import oracle
from hydroloom.operators import masks, spatial
from hydroloom.plans.queries import ORACLES, QUERIES

#: Keys of cells 3,600 rows (a whole turn of 360 degrees) apart.
TURN = 3600 * 15


@pytest.fixture(scope="module")
def turned(tmp_path_factory):
    """Events of cells a whole turn from each other, over the first parts and the same ten turns on."""
    folder = tmp_path_factory.mktemp("turned")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT u AS event_id, TIMESTAMP '2024-01-01' + (u % 3) * INTERVAL 1 HOUR AS ts, u + s AS user_id, v AS event_type, (u * 37 % 1000) / 10.0::DOUBLE + s % 7 AS value FROM range(900) r(u), (VALUES (0), ({TURN})) t(s), (VALUES ('click'), ('view')) k(v)) TO '{folder}/events.parquet'")
    con.execute(f"COPY (SELECT i + s AS p_partkey, 1 + i % 50 AS p_size, 900.5 + i % 90 AS p_retailprice FROM range(900) r(i), (VALUES (0), ({10 * TURN})) t(s)) TO '{folder}/part.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["weights_table", "interpolate_nn", "interpolate_idw", "interpolate_gauss", "convert_temperature_pipeline", "itwater_updating_pipeline", "multi_variable_fields", "merge_tiles_last_wins", "multi_tile_merge"])
def test_cells_a_whole_turn_apart(spark, turned, name):
    assert oracle.compare(spark, QUERIES[name], ORACLES[name], turned) > 0


@pytest.mark.parametrize("name", ["interpolate_idw", "interpolate_gauss"])
def test_weights_dealt_by_region(spark, turned, name, monkeypatch):
    """The same rows where the weights aren't broadcast, and no shuffle of rows of the finer grid."""
    monkeypatch.setattr(masks, "BROADCAST_CELLS", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert oracle.compare(spark, QUERIES[name], ORACLES[name], turned) > 0
    plan = QUERIES[name](spark, turned)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_tiles_of_one_geometry_merge_before_they_are_placed(spark, turned):
    plan = QUERIES["merge_tiles_last_wins"](spark, turned)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("name", ["resample_points_min_neighbours", "resample_supported_points"])
def test_points_at_one_place(spark, tmp_path, name):
    """Four suppliers at a place, some of them at a cell's centre, seen also from cells a whole turn on."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS s_suppkey, (i * 7919 % 100000) / 100.0::DOUBLE AS s_acctbal FROM range(6000) r(i)) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT i + s AS p_partkey, 1 + i % 50 AS p_size, 900.5 + i % 90 AS p_retailprice FROM range(300) r(i), (VALUES (0), ({TURN})) t(s)) TO '{tmp_path}/part.parquet'")
    assert oracle.compare(spark, QUERIES[name], ORACLES[name], str(tmp_path)) > 0


FORCING = ["icon_forcing_pipeline", "itwater_forcing_pipeline", "iwrn_forcing_pipeline", "s3m_forcing_pipeline", "ifs_forcing_pipeline"]


@pytest.mark.parametrize("bound", [10, None])
@pytest.mark.parametrize("name", FORCING)
def test_forcing_with_the_mask_among_the_weights(spark, turned, name, bound, monkeypatch):
    """The same rows with the weights broadcast and dealt; placed rows meet no mask, and beyond the bound no task holds a whole reference."""
    monkeypatch.setattr(masks, "BROADCAST_CELLS", bound or masks.BROADCAST_CELLS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert oracle.compare(spark, QUERIES[name], ORACLES[name], turned) > 0
        plan = QUERIES[name](spark, turned)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftOuter" not in plan
    assert ("BroadcastExchange" in plan) == (bound is None)
    if bound:
        assert "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_a_reference_of_a_million_cells_is_not_broadcast(spark, turned, monkeypatch):
    """Every task would hold its weights."""
    monkeypatch.setattr(spatial, "counted", lambda df: 1_200_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["itwater_forcing_pipeline"](spark, turned)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" not in plan


def _plan(spark, name, sf_dir) -> list[str]:
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")


@pytest.mark.parametrize("name", ["icon_forcing_pipeline", "ifs_forcing_pipeline"])
def test_computed_variables_are_not_computed_while_exploded(spark, turned, name):
    """There Spark evaluates each repeated part of an expression anew; clear sky has over a hundred."""
    made = [line for line in _plan(spark, name, turned) if "Generate explode(array(struct(kind" in line]
    assert made and not any("CASE" in line or "EXP(" in line or "dayofyear" in line for line in made)


@pytest.mark.parametrize("name", FORCING)
def test_points_of_the_sphere_are_made_of_dealt_cells(spark, turned, name):
    """Not of a field's rows, and not by as few tasks as the files of the targets have."""
    lines = _plan(spark, name, turned)
    places = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line and "_xyz" in line]
    assert places
    for i in places:
        below = next(line for line in lines[i:] if "Exchange" in line or "FileScan" in line)
        assert "Exchange" in below


def _joined_rows(df) -> int:
    """Rows made by the joins of a frame that is run without adaptive execution."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().endswith("Join"):
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.mark.parametrize("most", [1, 3])
def test_cells_of_a_place_do_not_multiply_neighbours(spark, most):
    """Six sources and six targets at each of 100 places, whole turns apart."""
    schema = "row int, col int, lat double, lon double"
    cells = lambda lat, lon: spark.createDataFrame([(i + 3600 * t, j, round(lat - 0.1 * (i + 3600 * t), 6), round(lon + 0.1 * j, 6)) for t in range(6) for i in range(10) for j in range(10)], schema)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # some 13 places are within 22 km: 6 x 6 x 13 x 100 pairs
        assert _joined_rows(spatial.neighbours(cells(46.0, 10.0), cells(46.03, 10.04), 22_000, most)) < 12_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_neighbours_of_mixed_places_as_by_brute_force(spark):
    """Sources alone, in twos a fifth of a millimetre apart, and whole turns apart, against all pairs."""
    con = duckdb.connect()
    lat, lon = "46.0::DOUBLE - 0.1 * (i // 7) - 360.0 * t", "10.0::DOUBLE + 0.1 * (i % 7) + (CASE WHEN i % 3 = 0 THEN 2e-9 * t ELSE 0 END)"
    con.execute(f"CREATE TABLE s AS SELECT (i * 10 + t)::INT AS row, (t % 2)::INT AS col, {lat} AS lat, {lon} AS lon FROM range(49) r(i), range(5) k(t) WHERE i % 4 > 0 OR t = 0")
    con.execute(f"CREATE TABLE t AS SELECT row, col, lat + (row * 7919 % 100) / 1000.0::DOUBLE AS lat, lon + (row % 3) / 100.0::DOUBLE AS lon FROM s")
    xyz = "SELECT row, col, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM "
    schema = "row int, col int, lat double, lon double"
    frame = lambda name: spark.createDataFrame(con.execute(f"SELECT * FROM {name}").fetchall(), schema)
    for most in (1, 4):
        tables = spatial.neighbours_within(frame("s"), frame("t"), (9_000, 22_000), most)
        for radius, table in tables.items():
            pairs = f"SELECT s.row AS a, s.col AS b, t.row, t.col, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 AS d2 FROM ({xyz} s) s, ({xyz} t) t"
            want = con.execute(f"SELECT a, b, row, col, rank FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, a, b) AS rank FROM ({pairs}) WHERE d2 < {radius}::DOUBLE * {radius}) WHERE rank <= {most}").fetchall()
            assert sorted(tuple(r) for r in table.select("src_row", "src_col", "row", "col", "rank").collect()) == sorted(want) != []
