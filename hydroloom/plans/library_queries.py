"""Registered queries of conversions, time rules, run catalogues, sources and sinks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.functions import free_time, json_text, strings, times
from hydroloom.model import NO_DATA
from hydroloom.operators import collections, masks, series, shaping, spatial
from hydroloom.plans import adapters, mapping, pipelines
from hydroloom.plans.adapters import SQL, with_views
from hydroloom.plans.queries import AR, ES, LUT, POINTS, _moved, _overrides, _points, _template, query, r6
from hydroloom.runner import catalog, namelist
from hydroloom.shared import new_path, written
from hydroloom.sinks import tables
from hydroloom.sources import netcdf, text

C = F.col


# conversions through the process lists


def _icon_inputs(spark, sf_dir) -> dict[str, DataFrame]:
    """The click field scaled to the inputs of a conversion."""
    g = adapters.grid(spark, sf_dir).filter("var = 'click'")
    v = C("value")
    kinds = {"AIR_T": 273.15 + v / 20, "DEW_POINT": 273.15 + v / 20 - v / 50, "QV": v / 100_000, "RAIN": v / 25, "WIND_U": v / 30, "WIND_V": (v - 50) / 30}
    return {name: g.withColumn("value", value) for name, value in kinds.items()}


def _wide(names: str = "weights") -> str:
    """The same field, its neighbours within 22 km, and the inputs by name."""
    views = ", ".join([SQL["grid"], SQL["moved"], SQL[names].replace("18000", "22000")])
    return f"""WITH {views}, weather AS (
        SELECT time, row, col, lat, lon, value / 25 AS rain, value / 30 AS u, (value - 50) / 30 AS v, 273.15::DOUBLE + value / 20 AS t, 273.15::DOUBLE + value / 20 - value / 50 AS td,
               value AS base FROM grid WHERE var = 'click')"""


RAD = f"greatest({LUT} * 0.65 * CASE WHEN raw <= 0 THEN 0 ELSE raw END, 0)"
RH = f"least(greatest(100 * {ES.format('td')} / ({ES.format('t')}), 0), 100)"


#: Nearest cells within 25 km, and fields (var, reach, time, row, col, value) placed and masked.
FAR = """, far AS (SELECT * FROM (SELECT s.row AS src_row, s.col AS src_col, t.row, t.col, row_number() OVER (PARTITION BY t.row, t.col ORDER BY (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2, s.row, s.col) AS rank
        FROM xyz_s s JOIN xyz_t t ON (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 < 25000.0 * 25000.0) WHERE rank = 1)"""
MET = """,
    met AS (
        SELECT var, time, w.row, w.col, value FROM fields f JOIN weights w ON f.row = src_row AND f.col = src_col AND rank = 1 WHERE reach = 22
        UNION ALL SELECT var, time, w.row, w.col, value FROM fields f JOIN far w ON f.row = src_row AND f.col = src_col WHERE reach = 25)
    SELECT var, time, b.row, b.col, m.lat, m.lon, round(CASE WHEN ref_value <> -9999 THEN value END, 6) AS value FROM met b JOIN moved m ON m.row = b.row AND m.col = b.col"""
DIRECT = "SELECT 'AIR_T' AS var, 25 AS reach, time, row, col, t - 273.15 AS value FROM weather UNION ALL SELECT 'RAIN', 25, time, row, col, rain FROM weather"
DERIVED = f"SELECT 'WIND_SPEED', 22, time, row, col, sqrt(u * u + v * v) FROM weather UNION ALL SELECT 'RH', 22, time, row, col, {RH} FROM weather"


def _near(spark, sf_dir) -> dict:
    """Nearest cells within both radii of the shipped lists."""
    cells, ref = adapters.grid(spark, sf_dir).select("row", "col", "lat", "lon").distinct(), _moved(spark, sf_dir)
    return {("nn", reach, 7): near for reach, near in spatial.neighbours_within(cells, ref, (22_000, 25_000), 1).items()}


@query(_wide() + FAR + f", fields AS ({DIRECT} UNION ALL {DERIVED} UNION ALL SELECT 'INC_RAD', 22, time, row, col, {RAD} FROM {AR})" + MET)
def icon_forcing_pipeline(spark, sf_dir):
    """The shipped ICON process lists: arguments bound to inputs, regridding, terrain mask, units."""
    return pipelines.icon(_icon_inputs(spark, sf_dir), _moved(spark, sf_dir), tables=_near(spark, sf_dir)).withColumn("value", r6(C("value")))


TILES = """, two AS (
        SELECT 0 AS src, var, time, w.row, w.col, value FROM grid g JOIN weights w ON g.row = src_row AND g.col = src_col AND rank = 1 WHERE value < 60
        UNION ALL SELECT 1, var, time, w.row, w.col, -value FROM grid g JOIN weights w ON g.row = src_row AND g.col = src_col AND rank = 1 WHERE g.col % 2 = 0)
    SELECT var, time, b.row, b.col, m.lat, m.lon, CASE WHEN ref_value <> -9999 THEN arg_max(value, src) WHEN var = 'view' THEN -1.0::DOUBLE ELSE -9999.0::DOUBLE END AS value
    FROM two b JOIN moved m ON m.row = b.row AND m.col = b.col GROUP BY var, time, b.row, b.col, m.lat, m.lon, ref_value"""


@query(with_views("grid", "moved", "weights") + TILES)
def multi_tile_merge(spark, sf_dir):
    """Two tiles on the reference grid through multi_tile; view has a no-data value of its own."""
    g, ref = adapters.grid(spark, sf_dir), _moved(spark, sf_dir)
    near = spatial.neighbours(g.select("row", "col", "lat", "lon").distinct(), ref, 18_000, 1)
    return pipelines.multi_tile([g.filter("value < 60"), g.filter("col % 2 = 0").withColumn("value", -C("value"))], ref, {"view": -1.0}, table=near)


@query(
    with_views("grid", "moved", "weights")
    + """, fields AS (SELECT var, time, row, col, value FROM grid WHERE var IN ('click', 'view') UNION ALL SELECT 'double', time, row, col, value * 2 FROM grid WHERE var = 'click')
    SELECT f.var, time, w.row, w.col, m.lat, m.lon, CASE WHEN ref_value = -9999 THEN -9999.0::DOUBLE ELSE value END AS value
    FROM fields f JOIN weights w ON f.row = src_row AND f.col = src_col AND rank = 1 JOIN moved m ON m.row = w.row AND m.col = w.col"""
)
def multi_variable_fields(spark, sf_dir):
    """Direct and derived variables through multi_variable."""
    g, ref = adapters.grid(spark, sf_dir), _moved(spark, sf_dir)
    near = spatial.neighbours(g.select("row", "col", "lat", "lon").distinct(), ref, 18_000, 1)
    inputs = {v: g.filter(C("var") == v) for v in ("click", "view")}
    double = lambda wide: wide.filter("click is not null").withColumn("value", 2 * C("click"))
    return pipelines.multi_variable(inputs, ref, {"double": double}, [("interpolate_data", {"table": near}), ("mask_data_by_ref", {})])


@query(
    with_views("grid")
    + """SELECT k.kind AS var, time - INTERVAL 30 MINUTE AS time, row, col, lat, lon,
        round(CASE k.kind WHEN 'rad:k' THEN value / 3.6 WHEN 'rad:l' THEN value * 0.7 / 3.6 ELSE value / 3.6 + value * 0.7 / 3.6 END, 6) AS value
    FROM grid, (VALUES ('rad:k'), ('rad:l'), ('rad:r')) k(kind) WHERE var = 'click'"""
)
def incoming_radiation_all(spark, sf_dir):
    """Short wave, long wave and total of accumulated radiation, at the middle of the hour."""
    g = adapters.grid(spark, sf_dir).filter("var = 'click'")
    inputs = {"ssrd": g.withColumn("value", C("value") * 1000), "strd": g.withColumn("value", C("value") * 700)}
    wide = pipelines.bound(inputs, {"ssrd": "ssrd", "strd": "strd"}, "rad")
    return pipelines.PROCESSES["compute_data_incoming_radiation"](kind="all")(wide).withColumn("value", r6(C("value")))


@query(with_views("grid", "ref") + "SELECT g.var, g.time, g.row, g.col, g.lat, g.lon, CASE WHEN ref_value = -9999 THEN -1.0::DOUBLE ELSE trunc(value) END AS value FROM grid g LEFT JOIN ref r ON g.row = r.row AND g.col = r.col")
def mask_integer_format(spark, sf_dir):
    return pipelines.chain([("mask_data_by_ref", {"mask_no_data": -1, "mask_format": "integer"})], ref=adapters.ref(spark, sf_dir))(adapters.grid(spark, sf_dir))


@query(
    with_views("grid")
    + f""", w AS (SELECT time, row, col, lat, lon, 273.15::DOUBLE + value / 20 AS t, 273.15::DOUBLE + value / 20 - value / 50 AS td, value / 100000 AS q FROM grid WHERE var = 'click')
    SELECT 'RH' AS var, time, row, col, lat, lon, round({RH}, 6) AS value FROM w
    UNION ALL SELECT 'RH:mismatch', time, row, col, lat, lon, round({ES.format('td')} - q * 900 / (0.622 + 0.378 * q), 6) FROM w"""
)
def humidity_with_diagnosis(spark, sf_dir):
    wide = pipelines.bound(_icon_inputs(spark, sf_dir), {"t": "AIR_T", "td": "DEW_POINT", "q": "QV"}, "RH")
    return pipelines.PROCESSES["compute_data_rh"](p=90_000, p_units="Pa", return_diag=True)(wide).withColumn("value", r6(C("value")))


@query(
    with_views("ref")
    + POINTS
    + """, s AS (SELECT point, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z, value FROM points),
    t AS (SELECT row, col, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM ref),
    p AS (SELECT row, col, value, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 AS d2, point FROM s JOIN t ON abs(s.x - t.x) < 40000 AND abs(s.y - t.y) < 40000 AND abs(s.z - t.z) < 40000),
    near AS (SELECT DISTINCT (row + i)::INT AS row, (col + j)::INT AS col FROM p, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE d2 < 8000.0 * 8000.0),
    k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, point) AS rank FROM p WHERE d2 < 40000.0 * 40000.0),
    wide AS (SELECT row, col, count(*) AS n, coalesce(max(value) FILTER (WHERE d2 < 1e-6), sum(value / d2) FILTER (WHERE d2 >= 1e-6) / sum(1 / d2) FILTER (WHERE d2 >= 1e-6)) AS value FROM k WHERE rank <= 8 GROUP BY row, col)
    SELECT w.row, w.col, n, round(CASE WHEN near.row IS NOT NULL THEN value END, 3) AS value FROM wide w LEFT JOIN near ON near.row = w.row AND near.col = w.col"""
)
def resample_supported_points(spark, sf_dir):
    """Points on the grid, but only in the box around cells that have a point within a fifth of the radius."""
    return spatial.resample_supported(_points(spark, sf_dir), adapters.ref(spark, sf_dir), 40_000).withColumn("value", F.round("value", 3))


@query(
    with_views("grid", "ref")
    + """, steps AS (SELECT DISTINCT var, time FROM grid WHERE var = 'click' AND hour(time) = 6)
    SELECT s.var, s.time, r.row, r.col, r.lat, r.lon, coalesce(value, 0.0::DOUBLE) AS value FROM steps s CROSS JOIN ref r LEFT JOIN grid g ON g.var = s.var AND g.time = s.time AND g.row = r.row AND g.col = r.col"""
)
def complete_fields(spark, sf_dir):
    """The morning fields made dense: a row for each reference cell."""
    return spatial.complete(adapters.grid(spark, sf_dir).filter("var = 'click' AND hour(time) = 6"), adapters.ref(spark, sf_dir), 0.0)


@query(with_views("grid") + "SELECT var, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.999) AS p999, min(value) AS least, max(value) AS most FROM grid GROUP BY var")
def exact_percentiles(spark, sf_dir):
    ends = shaping.exact_percentiles(adapters.grid(spark, sf_dir), (0.1, 0.5, 0.999))
    return ends.select("var", *[C("ends")[i].alias(n) for i, n in enumerate(("p10", "p50", "p999"))], "least", "most")


# series


@query(
    """WITH data AS (SELECT user_id, date_trunc('hour', ts) AS ts, value FROM events),
    asked AS (SELECT user_id, TIMESTAMP '2024-01-01 00:30:00' + (n // 2) * INTERVAL 12 HOUR AS probe_time FROM (SELECT DISTINCT user_id FROM events), generate_series(0, 41) s(n)),
    probes AS (SELECT DISTINCT user_id, probe_time FROM asked),
    best AS (SELECT p.user_id, p.probe_time, max(ts) AS found_time, arg_max(value, row(ts, value)) AS value FROM probes p LEFT JOIN data d ON d.user_id = p.user_id AND ts <= probe_time AND ts >= probe_time - INTERVAL 6 HOUR GROUP BY ALL)
    SELECT a.user_id, a.probe_time, found_time, value FROM asked a JOIN best b ON b.user_id = a.user_id AND b.probe_time = a.probe_time"""
)
def asof_repeated_probes(spark, sf_dir):
    """Each probe twice, and several data rows at one time, of which the greatest counts."""
    data = adapters.table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value")
    at = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    asked = data.select("user_id").distinct().withColumn("probe_time", F.explode(times.time_range(at, at + F.expr("INTERVAL 240 HOUR"), "12h")))
    return series.as_of(asked.unionByName(asked), data, ["user_id"], 6 * 3600, time="ts")


# time rules


def _order_times(spark, sf_dir) -> DataFrame:
    """(o_orderkey, a, b): a time of the first 200 minutes of a day, and one up to 30 hours later."""
    k = C("o_orderkey")
    at = C("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k * 37 % 1440)
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("a"), (at + F.make_dt_interval(F.lit(0), F.lit(0), k * 53 % 1800)).alias("b"))


WINDOWS = "WITH w AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + (o_orderkey * 37 % 1440) * INTERVAL 1 MINUTE AS a, o_orderdate::TIMESTAMP + (o_orderkey * 37 % 1440 + o_orderkey * 53 % 1800) * INTERVAL 1 MINUTE AS b FROM orders) "
HOURS = "unnest(generate_series({0}, {1}, INTERVAL 3 HOUR))"


@query(
    WINDOWS
    + f"""SELECT o_orderkey, 'both' AS ends, {HOURS.format("date_trunc('hour', CASE WHEN b - a < INTERVAL 3 HOUR THEN b ELSE a END)", "date_trunc('hour', b)")} AS time FROM w
    UNION ALL SELECT o_orderkey, 'ensured', {HOURS.format("date_trunc('hour', a)", "date_trunc('hour', CASE WHEN b - a < INTERVAL 3 HOUR THEN a + INTERVAL 3 HOUR ELSE b END)")} FROM w
    UNION ALL SELECT o_orderkey, 'end', {HOURS.format("date_trunc('hour', b) - INTERVAL 9 HOUR", "date_trunc('hour', b)")} FROM w
    UNION ALL SELECT o_orderkey, 'start', {HOURS.format("date_trunc('hour', a)", "date_trunc('hour', a) + INTERVAL 9 HOUR")} FROM w"""
)
def time_range_anchors(spark, sf_dir):
    w = _order_times(spark, sf_dir)
    a, b = C("a"), C("b")
    ranges = {"both": times.select_range(a, b, freq="3h"), "ensured": times.select_range(a, b, freq="3h", ensure=True), "end": times.select_range(None, b, 4, "3h"), "start": times.select_range(a, None, 4, "3h")}
    # arrays are columns first: what they share is then computed once a row, which it is not inside explode
    made = w.select("o_orderkey", *[r.alias(n) for n, r in ranges.items()])
    every = F.array(*[F.struct(F.lit(n).alias("ends"), C(n).alias("times")) for n in ranges])
    return made.select("o_orderkey", F.explode(every).alias("r")).select("o_orderkey", "r.ends", F.explode("r.times").alias("time"))


SHORT = "CASE WHEN {0} AND s = 'backward' THEN b - INTERVAL 6 HOUR WHEN {0} AND s = 'both' THEN a + (b - a - INTERVAL 6 HOUR) / 2 WHEN {1} AND l = 'shrink-backward' THEN b - INTERVAL 6 HOUR WHEN {1} AND l = 'shrink-both' THEN a + (b - a - INTERVAL 6 HOUR) / 2 ELSE a END".format("b - a < INTERVAL 6 HOUR", "b - a > INTERVAL 6 HOUR")
LONG = "CASE WHEN {0} AND s = 'forward' THEN a + INTERVAL 6 HOUR WHEN {0} AND s = 'both' THEN a + (b - a - INTERVAL 6 HOUR) / 2 + INTERVAL 6 HOUR WHEN {1} AND l = 'shrink-forward' THEN a + INTERVAL 6 HOUR WHEN {1} AND l = 'shrink-both' THEN a + (b - a - INTERVAL 6 HOUR) / 2 + INTERVAL 6 HOUR ELSE b END".format("b - a < INTERVAL 6 HOUR", "b - a > INTERVAL 6 HOUR")
# DuckDB has no division of intervals: halves are taken on seconds
HALF = "to_seconds((epoch_us(b) - epoch_us(a) - 21600000000) / 2000000.0)"


@query(WINDOWS + f"SELECT o_orderkey, s || '/' || l AS modes, {SHORT.replace('(b - a - INTERVAL 6 HOUR) / 2', HALF)} AS low, {LONG.replace('(b - a - INTERVAL 6 HOUR) / 2', HALF)} AS high FROM w, (VALUES ('backward'), ('forward'), ('both'), ('keep')) x(s), (VALUES ('keep'), ('shrink-backward'), ('shrink-forward'), ('shrink-both')) y(l)")
def time_ensure_modes(spark, sf_dir):
    """All 4 x 4 modes."""
    made = []
    for short in times.WHEN_SHORT:
        for long in times.WHEN_LONG:
            low, high = times.ensure_window(C("a"), C("b"), "6h", short, long)
            made.append(F.struct(F.lit(f"{short}/{long}").alias("modes"), low.alias("low"), high.alias("high")))
    return _order_times(spark, sf_dir).select("o_orderkey", F.explode(F.array(*made)).alias("m")).select("o_orderkey", "m.modes", "m.low", "m.high")


@query(
    WINDOWS
    + """SELECT o_orderkey, date_trunc('day', a)::TIMESTAMP AS midnight, date_trunc('day', a - INTERVAL 12 HOUR)::TIMESTAMP + INTERVAL 12 HOUR AS noon, date_trunc('day', a - INTERVAL 5 HOUR)::TIMESTAMP + INTERVAL 5 HOUR AS five,
        date_trunc('hour', b) AS run, TIMESTAMP '2024-03-01 00:00:00' + hour(a) * INTERVAL 1 HOUR AS date, date_trunc('day', b)::TIMESTAMP + INTERVAL 1 DAY AS end_midnight,
        CASE WHEN date_trunc('day', b)::TIMESTAMP + INTERVAL 12 HOUR < b THEN date_trunc('day', b)::TIMESTAMP + INTERVAL 36 HOUR ELSE date_trunc('day', b)::TIMESTAMP + INTERVAL 12 HOUR END AS end_noon,
        b - (a - date_trunc('day', a)::TIMESTAMP) AS moved_end FROM w"""
)
def time_flatten_start_end(spark, sf_dir):
    a, b = C("a"), C("b")
    start, end = times.flatten_start, times.flatten_end
    moved = times.moved_window(a, b, new_start=start(a), keep=False)[1]
    kinds = {"midnight": start(a), "noon": start(a, "noon"), "five": start(a, "hour", 5), "run": start(a, "time_run", run=b, rounding="h"), "date": start(a, "custom_date", date=F.lit("2024-03-01")), "end_midnight": end(b), "end_noon": end(b, "noon"), "moved_end": moved}
    return _order_times(spark, sf_dir).select("o_orderkey", *[c.alias(n) for n, c in kinds.items()])


@query(
    WINDOWS
    + """SELECT o_orderkey, 'forward' AS way, unnest(generate_series(a, a + INTERVAL 4 HOUR, INTERVAL 2 HOUR)) AS time FROM w
    UNION ALL SELECT o_orderkey, 'backward', unnest(generate_series(date_trunc('day', a)::TIMESTAMP - INTERVAL 4 HOUR, date_trunc('day', a)::TIMESTAMP, INTERVAL 2 HOUR)) FROM w
    UNION ALL SELECT o_orderkey, 'single', a FROM w"""
)
def time_expected(spark, sf_dir):
    a = C("a")
    ways = {"forward": times.expected_times(a, 3, "2h"), "backward": times.expected_times(a, 3, "2h", "backward", True), "single": times.expected_times(a, direction="single")}
    every = F.array(*[F.struct(F.lit(n).alias("way"), t.alias("times")) for n, t in ways.items()])
    return _order_times(spark, sf_dir).select("o_orderkey", F.explode(every).alias("w")).select("o_orderkey", "w.way", F.explode("w.times").alias("time"))


@query(
    WINDOWS
    + """SELECT o_orderkey, date_trunc('hour', b)::TIMESTAMP AS hourly, date_trunc('month', b)::TIMESTAMP AS monthly, date_trunc('day', CASE WHEN month(b) = 2 AND day(b) = 29 THEN b - INTERVAL 1 DAY ELSE b END)::TIMESTAMP AS recurring,
        date_trunc('day', b)::TIMESTAMP AS recurring_daily, date_trunc('year', b)::TIMESTAMP AS yearly FROM w"""
)
def time_signature_paths(spark, sf_dir):
    """What a path's pattern shows of a time; 29 February in paths without a year."""
    b = C("b")
    kinds = {"hourly": ("{dir}/%Y/%m/%d/f_%H.nc", 1), "monthly": ("%Y%m.nc", 30), "recurring": ("lai_%m%d.tif", 8), "recurring_daily": ("lai_%m%d.tif", 1), "yearly": ("%Y.nc", 1)}
    return _order_times(spark, sf_dir).select("o_orderkey", *[times.time_signature(b, p, n).alias(k) for k, (p, n) in kinds.items()])


@query(WINDOWS + "SELECT o_orderkey, date_trunc('hour', CASE WHEN o_orderkey % 3 > 0 THEN a ELSE b END) AS run, date_trunc('day', a)::TIMESTAMP + (hour(a) // 6 * 6) * INTERVAL 1 HOUR AS six FROM w")
def time_run_priority(spark, sf_dir):
    """The run's time as given, else from the settings."""
    return _order_times(spark, sf_dir).select("o_orderkey", times.select_run(F.when(C("o_orderkey") % 3 > 0, C("a")), C("b")).alias("run"), times.floor_to(C("a"), "6h").alias("six"))


# run catalogue


def _listing(spark, sf_dir) -> DataFrame:
    """Paths of hydrograph files, one an event."""
    e = adapters.table(spark, sf_dir, "events")
    name = F.format_string("/runs/%s/%s/hydrograph_%s.json", C("event_type"), F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "yyyyMMddHHmm"))
    return e.select(C("event_type").alias("basin"), name.alias("path"))


@query("SELECT DISTINCT event_type AS basin, date_trunc('hour', ts) AS run FROM events WHERE date_trunc('hour', ts) <= TIMESTAMP '2024-01-20 06:00:00' AND date_trunc('hour', ts) > TIMESTAMP '2024-01-17 06:00:00'")
def runs_recent(spark, sf_dir):
    return catalog.recent_runs(_listing(spark, sf_dir), F.lit("2024-01-20 06:20:00").cast("timestamp_ntz"), days=3)


@query("SELECT time, row_number() OVER (ORDER BY time DESC)::INT AS place FROM (SELECT DISTINCT date_trunc('minute', ts) AS time FROM events WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 06:20:00')")
def maps_available(spark, sf_dir):
    now = lambda t: F.lit(t).cast("timestamp_ntz")
    return catalog.maps_runs(_listing(spark, sf_dir), now("2024-01-10 00:00:00"), now("2024-01-20 06:20:00"))


# sources and sinks, by way of the shared folder


def _dense(spark, sf_dir) -> DataFrame:
    """(tile, row, col, ref_value): the terrain as whole tiles of 100 rows of 15 cells; missing cells are NULL."""
    ref = adapters.ref(spark, sf_dir)
    tiles = ref.select(F.floor(C("row") / 100).cast("int").alias("tile")).distinct()
    cells = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1499))))
    cells = cells.select("tile", (C("tile") * 100 + F.floor(C("i") / 15)).cast("int").alias("row"), (C("i") % 15).cast("int").alias("col"))
    return cells.join(ref.select("row", "col", "ref_value"), ["row", "col"], "left")


@query(
    with_views("ref")
    + """, tiles AS (SELECT DISTINCT row // 100 AS tile FROM ref)
    SELECT c.row::INT AS row, c.col::INT AS col, round(46.05::DOUBLE - (c.row + 0.5) * 0.1::DOUBLE, 6) AS lat, round(9.95::DOUBLE + (c.col + 0.5) * 0.1::DOUBLE, 6) AS lon, CASE WHEN ref_value >= 905 AND ref_value <= 1500 THEN ref_value END AS ref_value
    FROM (SELECT tile * 100 + i // 15 AS row, i % 15 AS col FROM tiles, generate_series(0, 1499) s(i)) c LEFT JOIN ref r ON r.row = c.row AND r.col = c.col"""
)
def scan_ascii_grid(spark, sf_dir):
    """The terrain written as ASCII grids, a file a tile of 100 rows, and scanned again within limits."""
    dense = _dense(spark, sf_dir)
    matrix = tables.ascii_grid_lines(dense.select("row", "col", "ref_value")).select(F.floor(C("row") / 100).cast("int").alias("tile"), C("row").alias("at"), "line")
    south = F.round(46.05 - (C("tile") + 1) * 10.0, 6)
    head = F.concat_ws("\n", F.lit("ncols 15"), F.lit("nrows 100"), F.lit("xllcorner 9.95"), F.concat(F.lit("yllcorner "), south.cast("string")), F.lit("cellsize 0.1"), F.lit("NODATA_value -9999"))
    heads = dense.select("tile").distinct().select("tile", F.lit(-1).alias("at"), head.alias("line"))
    path = new_path(spark, "ascii")
    matrix.unionByName(heads).repartition("tile").sortWithinPartitions("tile", "at").select("tile", "line").write.partitionBy("tile").text(path)
    read = text.read_ascii_grid(spark, f"{path}/*/*", least=905.0, most=1500.0)
    tile = F.regexp_extract("path", r"tile=(\d+)", 1).cast("int")
    return read.select((tile * 100 + C("row")).alias("row"), "col", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"), "ref_value")


TAGS = "lower(replace(region, ' ', '_')) || ':' || lower(replace(name, ' ', '_'))"


@query(with_views("sections") + f"SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS pos, pos::INT AS x, (pos * 2)::INT AS y, replace(region, ' ', '_') AS catchment, replace(name, ' ', '_') AS section, {TAGS} AS tag FROM sections WHERE pos % 4 > 0")
def scan_sections_registry(spark, sf_dir):
    """Sections written as a registry with remarks and malformed lines, and scanned again."""
    s = adapters.sections(spark, sf_dir)
    bare = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    line = F.when(C("pos") % 8 == 0, F.concat(F.lit("# "), "name")).when(C("pos") % 4 == 0, "no section here").otherwise(F.format_string("%d  %d %s %s", C("pos"), C("pos") * 2, bare(C("region")), bare(C("name"))))
    path = new_path(spark, "registry")
    s.select("pos", line.alias("value")).coalesce(1).sortWithinPartitions("pos").select("value").write.text(path)
    return text.read_sections_registry(spark, path).select("pos", "x", "y", "catchment", "section", "tag")


@query("SELECT o_orderdate::TIMESTAMP AS time, p.pos::INT AS pos, CASE WHEN p.pos = 0 THEN round(o_totalprice, 2) WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100)::DOUBLE END AS value FROM orders, (VALUES (0), (1)) p(pos)")
def scan_sections_data(spark, sf_dir):
    """Orders written as lines of a discharge series of two sections, some without a number, and scanned again."""
    o = adapters.table(spark, sf_dir, "orders")
    second = F.when(C("o_orderkey") % 5 > 0, (C("o_orderkey") % 100).cast("string")).otherwise("none")
    path = new_path(spark, "discharge")
    o.select(F.format_string("%s  %.2f\t%s", F.date_format("o_orderdate", "yyyyMMddHHmm"), "o_totalprice", second).alias("value")).write.text(path)
    return text.read_sections_data(spark, path).select("time", "pos", "value")


@query("SELECT n_name AS name, lower(replace(r_name, ' ', '_')) || ':' || lower(replace(n_name, ' ', '_')) AS tag FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'a')")
def scan_sections_db(spark, sf_dir):
    """Sections written as a `;` table and scanned again by part of a column."""
    s = adapters.sections(spark, sf_dir)
    path = new_path(spark, "db")
    s.select(C("region").alias("BACINO"), C("name").alias("NOME"), F.concat_ws(", ", "region", "name").alias("DATI_DA")).write.csv(path, header=True, sep=";", encoding="ISO-8859-1")
    return text.read_sections_db(spark, path, {"BACINO": "A"}, {"NOME": "name"})


@query(with_views("grid") + "SELECT var, time, col AS west_east, (999 - row)::INT AS south_north, CASE WHEN value < 20 THEN -9999.0::FLOAT ELSE value::FLOAT END AS value FROM grid")
def sink_hmc_layout(spark, sf_dir):
    return tables.hmc_layout(masks.mask_by_limits(adapters.grid(spark, sf_dir), 20.0, no_data=-12_000.0), 1000)


@query(with_views("grid") + "SELECT var, time, row, col, value FROM grid WHERE time >= TIMESTAMP '2024-01-10 00:00:00' AND time < TIMESTAMP '2024-01-12 00:00:00'")
def sink_grid_by_day(spark, sf_dir):
    """The field written as Parquet by day; two days of it are read again."""
    path = new_path(spark, "fields")
    tables.write_grid(adapters.grid(spark, sf_dir), path)
    days = spark.read.parquet(path).filter(C("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-11").cast("date")))
    return days.select("var", "time", "row", "col", "value")


@query("SELECT p_brand AS section, '&' || p_brand || chr(10) || string_agg('    par' || p_partkey || ' = ' || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '''' || p_size || '''' END, chr(10) ORDER BY p_partkey) || chr(10) || '/' AS text FROM part GROUP BY p_brand")
def sink_namelist_text(spark, sf_dir):
    kind = F.when(C("default_value").cast("int") % 2 == 0, "int").otherwise("str")
    return namelist.to_text(_template(spark, sf_dir).withColumn("value", C("default_value")).withColumn("value_kind", kind))


@query(
    """WITH template AS (SELECT DISTINCT p_brand AS section FROM part), o AS (SELECT DISTINCT CASE WHEN s_suppkey % 7 = 0 THEN 'none' || s_suppkey % 3 ELSE (SELECT min(p_brand) FROM part) END AS section FROM supplier WHERE s_suppkey % 4 <> 0)
    SELECT 'unknown section' AS problem, section AS param FROM o WHERE section NOT IN (SELECT section FROM template)"""
)
def namelist_unknown_sections(spark, sf_dir):
    template = _template(spark, sf_dir)
    brand = F.broadcast(template.agg(F.min("section").alias("first")))
    k = F.expr("cast(substring(value, 2, 20) as long)")
    named = _overrides(spark, sf_dir).join(brand).withColumn("section", F.when(k % 7 == 0, F.concat(F.lit("none"), k % 3)).otherwise(C("first"))).drop("first")
    return namelist.validate(template, named).filter("problem = 'unknown section'")


@query("SELECT r_name AS section, n_name AS param, n_nationkey || ', ' || n_nationkey AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def namelist_parse_continued(spark, sf_dir):
    """Values that go on in the next line; section names as written."""
    s = adapters.sections(spark, sf_dir)
    body = s.select("region", F.explode(F.array(F.struct((C("pos") * 2 + 1).alias("n"), F.concat(F.lit("  "), "name", F.lit(" = "), C("pos"), F.lit(", ! goes on")).alias("text")), F.struct((C("pos") * 2 + 2).alias("n"), F.concat(F.lit("      "), C("pos").cast("string"), F.lit(" ")).alias("text")))).alias("x"))
    ends = s.select("region").distinct().select("region", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), F.concat(F.lit("&"), "region").alias("text")), F.struct(F.lit(10_000).cast("long").alias("n"), F.lit("/").alias("text")))).alias("x"))
    lines = body.unionByName(ends).select(C("region").alias("file"), "x.n", "x.text")
    return text.parse_namelist(text.join_continued(lines)).select("section", "param", "value")


# names, numbers and documents


@query(_wide() + FAR + f", fields AS ({DIRECT} UNION ALL {DERIVED} UNION ALL SELECT 'INC_RAD', 22, time - INTERVAL 30 MINUTE, row, col, base * 1000 / 3600 FROM weather)" + MET)
def ifs_forcing_pipeline(spark, sf_dir):
    """The shipped IFS process lists, all of them: radiation from accumulated fields."""
    base = adapters.grid(spark, sf_dir).filter("var = 'click'")
    inputs = _icon_inputs(spark, sf_dir) | {"SSRD": base.withColumn("value", C("value") * 1000), "STRD": base}
    return pipelines.convert("ifs", inputs, _moved(spark, sf_dir), tables=_near(spark, sf_dir)).withColumn("value", r6(C("value")))


def _placed(wide: str, narrow: str) -> str:
    """SQL of a conversion that places and masks its variables: the click field times the variable's place in the list."""
    reach = [(v, 25) for v in wide.split()] + [(v, 22) for v in narrow.split()]
    return _wide() + FAR + ", fields AS (" + " UNION ALL ".join(f"SELECT '{v}' AS var, {r} AS reach, time, row, col, base * {i} AS value FROM weather" for i, (v, r) in enumerate(reach, 1)) + ")" + MET


def _placing(spark, sf_dir, name: str) -> DataFrame:
    base = adapters.grid(spark, sf_dir).filter("var = 'click'")
    inputs = {v: base.withColumn("value", C("value") * i) for i, v in enumerate(pipelines.CONVERSIONS[name], 1)}
    return pipelines.convert(name, inputs, _moved(spark, sf_dir), tables=_near(spark, sf_dir)).withColumn("value", r6(C("value")))


@query(_placed("LAI AIR_T", "RH SR TP WIND"))
def iwrn_forcing_pipeline(spark, sf_dir):
    """The shipped IWRN list."""
    return _placing(spark, sf_dir, "iwrn")


@query(_placed("rain air_t", "rh inc_rad wind"))
def itwater_forcing_pipeline(spark, sf_dir):
    """The shipped ItWater forcing list."""
    return _placing(spark, sf_dir, "itwater_forcing")


@query(_placed("rain air_t", "rh inc_rad"))
def s3m_forcing_pipeline(spark, sf_dir):
    """The shipped snow model's list."""
    return _placing(spark, sf_dir, "s3m")


@query(
    with_views("grid", "moved", "weights").replace("18000", "22000")
    + """SELECT 'snow_mask' AS var, time AS nt, m.lon, m.lat, CASE WHEN ref_value <> -9999 THEN g.value END AS value
    FROM grid g JOIN weights w ON g.row = src_row AND g.col = src_col AND rank = 1 JOIN moved m ON m.row = w.row AND m.col = w.col WHERE var = 'view'"""
)
def itwater_updating_pipeline(spark, sf_dir):
    """The shipped ItWater updating list, in the layout of its sink."""
    snow = adapters.grid(spark, sf_dir).filter("var = 'view'")
    done = pipelines.convert("itwater_updating", {"snow_mask": snow}, _moved(spark, sf_dir), tables={("nn", 22_000, 7): spatial.neighbours(adapters.grid(spark, sf_dir).select("row", "col", "lat", "lon").distinct(), _moved(spark, sf_dir), 22_000, 1)})
    return tables.itwater_layout(done)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'VIEW' ELSE 'x:' || event_type END AS key, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'x:' || event_type END AS value, event_type AS tagless, CASE WHEN event_type = 'view' THEN 'view' END AS mapped FROM events")
def names_by_template(spark, sf_dir):
    e = C("event_type")
    tagged, names = F.concat(F.lit("x:"), e), {"Click": "a", "VIEW": "b"}
    kinds = {"key": shaping.rename_by_template(tagged, names, case_sensitive=False), "value": shaping.rename_by_template(tagged, names, use_value=True, case_sensitive=False), "tagless": shaping.rename_by_template(e, names, case_sensitive=False, allow_tagless=False), "mapped": shaping.name_by_mapping(e, "rain:view")}
    return adapters.table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in kinds.items()])


@query("SELECT p_partkey, length(floor(p_retailprice)::BIGINT::VARCHAR)::INT AS before, CASE WHEN (p_retailprice * 100)::BIGINT % 100 = 0 THEN 0 WHEN (p_retailprice * 100)::BIGINT % 10 = 0 THEN 1 ELSE 2 END AS scale, printf('%.1f', p_retailprice) AS shown FROM part")
def number_precision(spark, sf_dir):
    p, found = C("p_retailprice"), strings.precision(C("p_retailprice"))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", (found["digits"] - found["scale"]).alias("before"), found["scale"].alias("scale"), F.format_string("%.1f", strings.shown_with(p, 1).cast("double")).alias("shown"))


@query("SELECT s_suppkey, 'Supplier ' || s_suppkey AS text FROM supplier")
def asset_row_text(spark, sf_dir):
    """Lines of asset files: the text before the mark, whichever mark it is."""
    k = C("s_suppkey")
    line = F.concat(F.lit("  Supplier "), k, F.when(k % 3 == 0, " # name").when(k % 3 == 1, " % name").otherwise(" "))
    return adapters.table(spark, sf_dir, "supplier").select("s_suppkey", strings.row_text(line).alias("text"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'no JSON' END AS problem, o_orderkey % 4 > 1 AS valid FROM orders")
def json_documents_checked(spark, sf_dir):
    """Documents with remarks and commas too many are JSON; cut ones are not."""
    k = C("o_orderkey")
    good = F.concat(F.lit('{"a": "// no remark ,}", /* remark */ "b": ['), k.cast("string"), F.lit(", 2, ], // more\n}"))
    doc = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit('{"a": '), k.cast("string"))).otherwise(good)
    return json_text.checked_json(adapters.table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("json"))).drop("json")


@query(
    """WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS kind, length(o_orderkey::VARCHAR) AS n FROM orders)
    SELECT o_orderkey, kind < 2 AS valid, CASE kind WHEN 2 THEN 'Expecting value' WHEN 3 THEN 'Unterminated string starting at' WHEN 4 THEN 'Extra data' WHEN 5 THEN 'Expecting '','' delimiter' END AS error,
        CASE WHEN kind IN (2, 4) THEN 2 WHEN kind IN (3, 5) THEN 1 END::INT AS line, CASE kind WHEN 2 THEN 6 WHEN 3 THEN 9 + n WHEN 4 THEN 1 WHEN 5 THEN 8 + n END::INT AS col,
        CASE kind WHEN 2 THEN 16 + n WHEN 3 THEN 8 + n WHEN 4 THEN 8 + n WHEN 5 THEN 7 + n END::INT AS pos FROM d"""
)
def json_error_places(spark, sf_dir):
    """Documents broken in four ways, and where: places are those of the text with its remarks."""
    k = C("o_orderkey").cast("string")
    forms = [
        (r'{"a": "\"x // y\"z", "b": ', "}"),
        ('{"a": [', ', "#", ], /* , } */ }'),
        ('{"a": ', ', //\n "b":}'),
        ('{"a": ', ', "b: 1}'),
        ('{"a": ', "}\n{}"),
        ('{"a": ', ' "b": 1}'),
    ]
    text_of = F.element_at(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in forms]), (C("o_orderkey") % 6 + 1).cast("int"))
    found = adapters.table(spark, sf_dir, "orders").select("o_orderkey", json_text.json_error(text_of).alias("e"))
    return found.select("o_orderkey", C("e.error").isNull().alias("valid"), "e.error", "e.line", "e.col", "e.pos")


@query(
    """WITH p AS (SELECT user_id, ts + INTERVAL 1 MICROSECOND * (event_id % 2) AS probe_time, value FROM events), e AS (SELECT user_id, ts, max(value) AS best FROM events GROUP BY user_id, ts)
    SELECT p.user_id, probe_time, value, ts AS found_time, best AS value_ FROM p LEFT JOIN e ON p.user_id = e.user_id AND ts = probe_time"""
)
def asof_exact(spark, sf_dir):
    """Events asked for at their own times, or a microsecond later, with no tolerance; probes have values of their own."""
    e = adapters.table(spark, sf_dir, "events")
    later = C("ts") + F.when(C("event_id") % 2 == 1, F.expr("INTERVAL '0.000001' SECOND")).otherwise(F.expr("INTERVAL '0' SECOND"))
    return series.as_of(e.select("user_id", later.alias("probe_time"), "value"), e, ["user_id"], 0, time="ts")


@query(
    """WITH template AS (SELECT p_brand AS section, p_partkey AS ord, 'par' || p_partkey AS param, 'default' AS mode, p_size::VARCHAR AS default_value FROM part),
    o AS (SELECT 'par' || o_orderkey % 5000 AS param, arg_max(o_orderkey::VARCHAR, o_orderkey) AS value FROM orders GROUP BY ALL)
    SELECT section, ord, t.param, mode, default_value, coalesce(value, default_value) AS value FROM template t LEFT JOIN o USING (param)"""
)
def namelist_overrides_repeated(spark, sf_dir):
    """Parameters overridden many times: the last one counts, and each template row stays one."""
    part, orders = adapters.table(spark, sf_dir, "part"), adapters.table(spark, sf_dir, "orders")
    template = part.select(C("p_brand").alias("section"), C("p_partkey").alias("ord"), F.concat(F.lit("par"), "p_partkey").alias("param"), F.lit("default").alias("mode"), C("p_size").cast("string").alias("default_value"))
    k = C("o_orderkey")
    overrides = orders.select(F.lit("by_value").alias("kind"), F.concat(F.lit("par"), k % 5000).alias("key"), k.cast("string").alias("value"), F.lit(True).alias("active"), k.alias("ord"))
    return namelist.build_values(template, overrides)


@query(
    with_views("ref")
    + """SELECT v.var, row, col, lat, lon, CASE v.var WHEN 'size' THEN p_size::DOUBLE WHEN 'far' THEN ref_value * 2 ELSE ref_value END AS value, v.var <> 'far' AS same_box
    FROM ref JOIN part ON p_partkey = row * 15 + col, (VALUES ('dem'), ('size'), ('far')) v(var)"""
)
def collected_grids_checked(spark, sf_dir):
    """Three fields collected on the terrain's grid: one a third of a cell off is taken as it is, one further off is told."""
    ref = adapters.ref(spark, sf_dir)
    shifted = adapters.ref(spark, sf_dir, (0.03, 0.04))
    far = adapters.ref(spark, sf_dir, (0.5, 0.0))
    size = adapters.table(spark, sf_dir, "part").select(*adapters.cells("p_partkey", (0.03, -0.03)), C("p_size").cast("double").alias("value"))
    parts = {"dem": shifted.withColumnRenamed("ref_value", "value"), "size": size, "far": far.select("row", "col", "lat", "lon", (C("ref_value") * 2).alias("value"))}
    return collections.collect_grids(parts, ref).drop("time")


FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMddHHmm", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d yyyy HH:mm", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEEE d MMMM yyyy", "MM/dd/yyyy", "MM/dd/yy", "MM-dd-yyyy h:mm a", "dd-MMM-yyyy HH'h'", "yyyy MMM d", "'run of' yyyy-MM-dd 'at' h a", "d'th of' MMMM, yyyy 'at' h:mm a")
#: Of each form the parts of the time of day that it shows: hours, minutes, seconds.
SHOWN = (0, 0, 0, 0, 2, 3, 2, 0, 0, 0, 2, 3, 0, 0, 0, 2, 1, 0, 1, 2)


@query(
    f"""WITH t AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 1 SECOND * (o_orderkey % 86400) AS time, (o_orderkey % {len(FORMS) + 1})::INT AS form FROM orders)
    SELECT o_orderkey, form, CASE WHEN form = {len(FORMS)} THEN NULL ELSE CASE [{', '.join(map(str, SHOWN))}][form + 1] WHEN 0 THEN date_trunc('day', time)::TIMESTAMP WHEN 1 THEN date_trunc('hour', time) WHEN 2 THEN date_trunc('minute', time) ELSE time END END AS time FROM t"""
)
def times_of_free_text(spark, sf_dir):
    """Order dates in twenty written forms, and texts without a time."""
    time = C("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=C("o_orderkey") % 86_400)
    said = F.array(*[F.date_format(time, f) for f in FORMS], F.concat(F.lit("order "), C("o_orderkey") % 97))
    form = (C("o_orderkey") % (len(FORMS) + 1)).cast("int")
    texts = adapters.table(spark, sf_dir, "orders").select("o_orderkey", form.alias("form"), F.get(said, form).alias("said"))
    return texts.select("o_orderkey", "form", free_time.parse_free(C("said")).alias("time"))


@query(
    """SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS time, (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon,
        max(length(o_orderpriority))::SMALLINT AS priority, max(o_totalprice)::FLOAT AS price, max(-(o_orderkey % 100))::TINYINT AS small FROM orders GROUP BY ALL"""
)
def fields_cast_narrow(spark, sf_dir):
    """Orders as fields of their own cells, each in the smallest type that holds it."""
    o, k = adapters.table(spark, sf_dir, "orders"), C("o_orderkey")
    values = {"priority": F.length("o_orderpriority"), "price": C("o_totalprice"), "small": -(k % 100)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("var"), v.cast("double").alias("value")) for n, v in values.items()]))
    cells = o.select(C("o_orderdate").cast("timestamp_ntz").alias("time"), F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), each.alias("x"))
    return shaping.cast_narrow(cells.select("time", "row", "col", "lat", "lon", "x.var", "x.value"))


@query("SELECT DISTINCT o_orderdate::TIMESTAMP AS time FROM orders WHERE o_orderkey % 5 > 0")
def time_index_of_texts(spark, sf_dir):
    """Times written in four forms, and texts that are none."""
    k, t = C("o_orderkey"), C("o_orderdate").cast("timestamp_ntz")
    shown = F.when(k % 5 == 0, "no time").when(k % 5 == 1, F.date_format(t, "yyyy-MM-dd HH:mm")).when(k % 5 == 2, F.date_format(t, "yyyyMMddHHmm")).when(k % 5 == 3, F.date_format(t, "yyyy-MM-dd")).otherwise(F.floor(F.unix_micros(t.cast("timestamp")) / 1_000_000).cast("string"))
    return times.time_index(adapters.table(spark, sf_dir, "orders").select(shown.alias("time")))


@query("SELECT DISTINCT r_name AS basin FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 > 0")
def basins_of_database(spark, sf_dir):
    s = adapters.sections(spark, sf_dir)
    return text.basins_of(s.select(F.when(C("pos") % 3 > 0, C("region")).otherwise("").alias("BASIN")))


@query(with_views("grid") + "SELECT DISTINCT row, col, lat, lon FROM grid")
def regular_axes(spark, sf_dir):
    return shaping.flat_axes(adapters.grid(spark, sf_dir))


# classic NetCDF, sections with samples, the tag mapper, templates by version


@query(with_views("grid") + "SELECT var, time, lat, lon, value FROM grid WHERE value IS NOT NULL")
def scan_netcdf_classic(spark, sf_dir):
    """The field encoded as a classic NetCDF file a step, and decoded again; cells between are no-data."""
    files = written(netcdf.encode(adapters.grid(spark, sf_dir)), "netcdf").select(C("time").cast("string").alias("path"), "content")
    return netcdf.decode(files).filter("value is not null").select("var", "time", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"), "value")


@query(
    with_views("ref")
    + """, p AS (SELECT c_custkey AS id, 10.0::DOUBLE + (c_custkey % 149) / 100.0::DOUBLE AS lon, 46.0::DOUBLE - (c_custkey % 977) / 100.0::DOUBLE AS lat, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS basin,
        CASE WHEN c_custkey % 5 = 0 THEN 'Section ' || c_custkey ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0)
    SELECT id::INT AS id, p.lon, p.lat, basin, name, CASE WHEN ref_value <> -9999 THEN ref_value END AS dem_z, CASE WHEN ref_value <> -9999 THEN (r.row % 3)::DOUBLE END AS river_code
    FROM p LEFT JOIN ref r ON r.row = floor((46.05::DOUBLE - p.lat) / 0.1)::INT AND r.col = floor((p.lon - 9.95) / 0.1)::INT AND r.row BETWEEN 0 AND 99 AND r.col BETWEEN 0 AND 14"""
)
def sections_sampled_twice(spark, sf_dir):
    """Sections of a database, some with a bad number, with the terrain and the river code of their cells."""
    k, ref = C("c_custkey"), adapters.ref(spark, sf_dir)
    db = adapters.table(spark, sf_dir, "customer").select(F.when(k % 7 == 0, "none").otherwise(k.cast("string")).alias("ID"), (10.0 + (k % 149) / 100.0).alias("LON"), (46.0 - (k % 977) / 100.0).alias("LAT"), F.when(k % 3 != 0, C("c_mktsegment")).alias("BASIN"), F.when(k % 5 != 0, C("c_name")).alias("SEC_NAME"))
    river = ref.withColumn("ref_value", F.when(C("ref_value") == NO_DATA, NO_DATA).otherwise((C("row") % 3).cast("double")))
    return spatial.sections_with_samples(db, {"dem_z": ref, "river_code": river}, 9.95, 46.05, 0.1, 100, 15)


def _sides(spark, sf_dir):
    """Customers as labels of collections by nation, in parts of a few; the out side lacks every fifth nation."""
    k, c = C("c_custkey"), adapters.table(spark, sf_dir, "customer")
    base = c.select(C("c_nationkey").alias("collection"), F.floor(k / 50).alias("part"), C("c_name").alias("label"), k.alias("k"))
    items = base.filter("k % 4 <> 0").select("collection", "part", F.concat(F.lit("in"), C("k")).alias("item"), F.concat(F.lit("w"), C("k") % 3).alias("value"))
    shown = base.filter("collection % 5 <> 0")
    return (base.select("collection", "part", "label"), items), (shown.select("collection", "part", "label"), shown.select("collection", "part", F.concat(F.lit("w"), C("k") % 4).alias("item"), F.concat(F.lit("out"), C("k")).alias("value")))


MAPPED = """WITH base AS (SELECT c_nationkey AS collection, c_custkey // 50 AS part, c_name AS label, c_custkey AS k FROM customer),
    labels AS (SELECT collection, part, label, row_number() OVER (PARTITION BY collection, part ORDER BY label) AS place FROM base WHERE collection % 5 <> 0),
    ins AS (SELECT collection, part, 'in' || k AS item, 'w' || k % 3 AS workflow, row_number() OVER (PARTITION BY collection, part ORDER BY 'in' || k) AS place FROM base WHERE k % 4 <> 0),
    outs AS (SELECT collection, part, 'w' || k % 4 AS workflow, 'out' || k AS out, row_number() OVER (PARTITION BY collection, part ORDER BY 'w' || k % 4, 'out' || k) AS place FROM base),
    source AS (SELECT label, item, workflow FROM labels JOIN ins USING (collection, part, place)), target AS (SELECT label, workflow, out FROM labels JOIN outs USING (collection, part, place)),
    mapped AS (SELECT s.label AS tag, item AS "in", s.workflow, out, s.label || ':' || s.workflow AS reference FROM source s LEFT JOIN target t ON s.label = t.label AND s.workflow = t.workflow)
    """


@query(MAPPED + "SELECT * FROM mapped")
def tag_mapping_rows(spark, sf_dir):
    return mapping.mapped_rows(*_sides(spark, sf_dir))


@query(MAPPED + """SELECT *, (dense_rank() OVER (ORDER BY CASE "in" WHEN 'in9' THEN 1 WHEN 'in5' THEN 2 ELSE 3 END, "in"))::INT AS rank FROM mapped WHERE workflow = 'w1'""")
def tag_mapping_by_priority(spark, sf_dir):
    return mapping.by_priority(mapping.pairs(mapping.mapped_rows(*_sides(spark, sf_dir)), "w1"), ["in9", "in5"])


@query(
    """WITH l AS (SELECT p_partkey, 'par' || p_partkey AS variable FROM part)
    SELECT variable, 'paired' AS state, variable || ':' || CASE WHEN p_partkey % 5 = 0 THEN variable ELSE 'w' || p_partkey % 9 END AS pair FROM l WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0
    UNION ALL SELECT variable, 'missing in dataset', NULL FROM l WHERE p_partkey % 2 = 0 AND p_partkey % 5 = 0
    UNION ALL SELECT variable, 'missing in process', NULL FROM l WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0
    UNION ALL SELECT variable, 'extra in process', NULL FROM l WHERE p_partkey % 2 <> 0 AND p_partkey % 3 = 0"""
)
def process_pairs_checked(spark, sf_dir):
    """Variables, processes and workflows by name: what pairs, and what is missing where."""
    v = adapters.table(spark, sf_dir, "part").select(C("p_partkey").alias("k"), F.concat(F.lit("par"), C("p_partkey")).alias("variable"))
    return mapping.process_pairs(v.filter("k % 2 = 0"), v.filter("k % 3 = 0"), v.filter("k % 5 <> 0").withColumn("workflow", F.concat(F.lit("w"), C("k") % 9)))


@query("SELECT p_brand AS section, (p_partkey * 2 + 1)::BIGINT AS ord, 'par' || p_partkey AS param, CASE WHEN p_partkey % 6 = 0 THEN 'mandatory' ELSE 'default' END AS mode, CASE WHEN p_partkey % 6 <> 0 THEN p_size::VARCHAR END AS default_value FROM part WHERE p_partkey % 2 = 0")
def namelist_template_of_version(spark, sf_dir):
    """Templates from namelists of two versions, parameters standing twice; one version's."""
    p = adapters.table(spark, sf_dir, "part").select(C("p_partkey").cast("long").alias("k"), C("p_brand").alias("section"), F.concat(F.lit("par"), C("p_partkey")).alias("param"), "p_size")
    file = F.when(C("k") % 2 == 0, "a.nml").otherwise("b.nml")
    line = lambda n, value: F.struct((C("k") * 2 + n).alias("ord"), value.cast("string").alias("value"))
    parsed = p.select(file.alias("file"), "section", "param", F.explode(F.array(line(0, F.lit(0)), line(1, C("p_size")))).alias("l")).select("file", "section", "param", "l.*")
    versions = spark.createDataFrame([("a.nml", "M", "1.0"), ("b.nml", "M", "2.0")], "file string, model string, version string")
    return namelist.of_version(namelist.template_of(parsed, versions, p.filter("k % 6 = 0")), "m", "1.0")
