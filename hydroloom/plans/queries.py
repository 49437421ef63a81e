"""Registered queries of the grid and series operators, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.functions import strings, times
from hydroloom.model import NO_DATA
from hydroloom.operators import masks, physics, series, shaping, spatial
from hydroloom.plans import adapters, pipelines
from hydroloom.plans.adapters import with_views
from hydroloom.runner import catalog, namelist
from hydroloom.sources import text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return keep


def r6(column):
    return F.round(column, 6)


# physics

@query(
    with_views("grid", "ref")
    + """, wide AS (SELECT time, row, col, max(value) FILTER (WHERE var = 'click') / 30 AS u, (max(value) FILTER (WHERE var = 'view') - 50) / 30 AS v FROM grid GROUP BY time, row, col)
    SELECT time, w.row, w.col, CASE WHEN ref_value = -9999 THEN -9999.0::DOUBLE ELSE round(sqrt(u * u + v * v), 6) END AS value
    FROM wide w LEFT JOIN ref r ON w.row = r.row AND w.col = r.col WHERE u IS NOT NULL AND v IS NOT NULL"""
)
def wind_speed_masked(spark, sf_dir):
    """Flagship: hourly wind speed on the grid, masked by terrain."""
    g = adapters.grid(spark, sf_dir).filter(F.col("var").isin("click", "view"))
    wide = g.groupBy("time", "row", "col").agg(*[F.max(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in ("click", "view")])
    wind = wide.select("time", "row", "col", r6(physics.wind_speed(F.col("click") / 30, (F.col("view") - 50) / 30)).alias("value")).filter("value is not null")
    return masks.mask_by_ref(wind, adapters.ref(spark, sf_dir))


def _weather(name: str, column, sql: str, extra=(), extra_sql: str = ""):
    def make(spark, sf_dir):
        return adapters.weather(spark, sf_dir).select("event_id", column().alias("value"), *[c().alias(n) for n, c in extra])

    make.__name__ = name
    query(with_views("weather") + f"SELECT event_id, {sql} AS value{extra_sql} FROM weather")(make)


C = F.col
ES = "6.112 * exp(17.67 * ({0} - 273.15) / ({0} - 273.15 + 243.5))"
LUT = "CASE WHEN rain >= 0 AND rain < 1 THEN 0.95::DOUBLE WHEN rain >= 1 AND rain < 3 THEN 0.75::DOUBLE WHEN rain >= 3 AND rain < 5 THEN 0.65::DOUBLE WHEN rain >= 5 AND rain < 10 THEN 0.5::DOUBLE WHEN rain >= 10 THEN 0.15::DOUBLE ELSE 0::DOUBLE END"
_weather("wind_direction_to", lambda: r6(physics.wind_direction_to(C("u"), C("v"))), "round((degrees(atan2(v, u)) + 360) % 360, 6)")
_weather("relative_humidity", lambda: r6(physics.relative_humidity(C("t"), C("td"))), f"round(least(greatest(100 * {ES.format('td')} / ({ES.format('t')}), 0), 100), 6)")
_weather("vapor_mismatch", lambda: r6(physics.vapour_mismatch(C("td"), C("u") / 1000)), f"round({ES.format('td')} - (u / 1000) * 1013.25 / (0.622 + 0.378 * (u / 1000)), 6)")
_weather("temperature_to_celsius", lambda: r6(physics.to_celsius(C("t"), F.when(C("event_id") % 3 == 0, "C").when(C("event_id") % 3 == 1, "K").otherwise(""))), "round(CASE WHEN event_id % 3 = 0 THEN t ELSE t - 273.15 END, 6)")
_weather("temperature_to_kelvin", lambda: r6(physics.to_kelvin(C("t"), F.when(C("event_id") % 3 == 0, "K").otherwise("celsius"))), "round(CASE WHEN event_id % 3 = 0 THEN t ELSE t + 273.15 END, 6)")
_weather("incoming_radiation_k", lambda: r6(physics.flux(C("joules"), 3600, 0.0)), "round(greatest(joules / 3600, 0), 6)", [("time", lambda: physics.middle_of(C("time"), 3600))], ", time - INTERVAL 30 MINUTE AS time")
_weather("incoming_radiation_l", lambda: r6(physics.flux(C("joules") * 0.7, 3600)), "round(joules * 0.7 / 3600, 6)")
_weather("incoming_radiation_total", lambda: r6(physics.flux(C("joules"), 3600, 0.0) + physics.flux(C("joules") * 0.7, 3600)), "round(greatest(joules / 3600, 0) + joules * 0.7 / 3600, 6)")
_weather("cloud_factor_lut", lambda: physics.cloud_factor(C("rain")), LUT)
_weather("air_pressure_from_terrain", lambda: r6(physics.air_pressure(C("z"))), "round(101.3 * pow((293 - 0.0065 * z) / 293, 5.26), 6)")
AR = """(SELECT *, 12 * 60.0 / pi() * (118.08 / 1440) * (1 + 0.033 * cos(2 * pi() / 365 * j)) *
        ((w2 - w1) * sin(phi) * sin(delta) + cos(phi) * cos(delta) * (sin(w2) - sin(w1))) * 1e6 / 3600 AS raw FROM (
        SELECT *, w - pi() / 24 AS w1, w + pi() / 24 AS w2 FROM (
        SELECT *, pi() / 12 * (h + 0.06667 * (round_even(lon / 15, 0) * 15 - (360 - lon)) + 0.1645 * sin(2 * b) - 0.1255 * cos(b) - 0.025 * sin(b) - 12) AS w FROM (
        SELECT *, hour(m) + minute(m) / 60 + second(m) / 3600 AS h, dayofyear(m) AS j, 2 * pi() * (dayofyear(m) - 81) / 364 AS b, radians(lat) AS phi,
               0.4093 * sin(2 * pi() / 365 * dayofyear(m) - 1.405) AS delta FROM (SELECT *, time - INTERVAL 30 MINUTE AS m FROM weather)))))"""


@query(with_views("weather") + f"SELECT event_id, round(CASE WHEN raw <= 0 THEN 0 ELSE raw END, 6) AS ar, round(greatest({LUT} * (0.65 + 0.0002 * z) * CASE WHEN raw <= 0 THEN 0 ELSE raw END, 0), 6) AS k FROM {AR}")
def astronomic_radiation(spark, sf_dir):
    w = adapters.weather(spark, sf_dir)
    return w.select("event_id", r6(physics.extraterrestrial(C("lat"), C("lon"), C("time"), 3600)).alias("ar"), r6(physics.clear_sky(C("rain"), C("lat"), C("lon"), C("time"), 3600, C("z"))).alias("k"))


# scans and masks

@query(with_views("grid") + "SELECT * FROM grid")
def grid_from_events(spark, sf_dir):
    return adapters.grid(spark, sf_dir)


MASK = "SELECT g.var, g.time, g.row, g.col, g.lat, g.lon, {} AS value FROM grid g LEFT JOIN ref r ON g.row = r.row AND g.col = r.col"


@query(with_views("grid", "ref") + MASK.format("CASE WHEN ref_value = -9999 THEN -9999.0::DOUBLE ELSE value END"))
def mask_by_ref_value(spark, sf_dir):
    return masks.mask_by_ref(adapters.grid(spark, sf_dir), adapters.ref(spark, sf_dir))


@query(with_views("grid", "ref") + MASK.format("CASE WHEN r.row IS NOT NULL AND ref_value = -9999 THEN -1.0::DOUBLE ELSE value END"))
def mask_by_ref_lazy_nan(spark, sf_dir):
    """The mask's value does not occur, so cells without terrain are masked."""
    ref = adapters.ref(spark, sf_dir).withColumn("ref_value", F.when(C("ref_value") != NO_DATA, C("ref_value")))
    return masks.mask_by_ref(adapters.grid(spark, sf_dir), ref, -12345.0, -1.0)


@query(with_views("grid") + "SELECT var, time, row, col, lat, lon, CASE WHEN value >= 20 AND value <= 200 THEN value ELSE -9999.0::DOUBLE END AS value FROM grid")
def mask_by_limits(spark, sf_dir):
    return masks.mask_by_limits(adapters.grid(spark, sf_dir), 20.0, 200.0)


# regridding

def _moved(spark, sf_dir) -> DataFrame:
    return adapters.ref(spark, sf_dir, (0.03, 0.04))


@query(with_views("grid", "moved", "weights") + "SELECT src_row, src_col, row, col, round(sqrt(d2), 3) AS dist, rank FROM weights")
def weights_table(spark, sf_dir):
    sources = adapters.grid(spark, sf_dir).select("row", "col", "lat", "lon").distinct()
    return spatial.neighbours(sources, _moved(spark, sf_dir), 18_000, 7).withColumn("dist", F.round("dist", 3))


REGRID = with_views("grid", "moved", "weights") + "SELECT g.var, g.time, w.row, w.col, m.lat, m.lon, {} AS value FROM grid g JOIN weights w ON g.row = src_row AND g.col = src_col JOIN moved m ON m.row = w.row AND m.col = w.col {}"


@query(REGRID.format("g.value", "WHERE rank = 1"))
def interpolate_nn(spark, sf_dir):
    return spatial.interpolate(adapters.grid(spark, sf_dir), _moved(spark, sf_dir), "nn", 18_000, 7)


@query(REGRID.format("round(sum(g.value / d2) / sum(1 / d2), 6)", "GROUP BY ALL"))
def interpolate_idw(spark, sf_dir):
    return spatial.interpolate(adapters.grid(spark, sf_dir), _moved(spark, sf_dir), "idw", 18_000, 7).withColumn("value", r6(C("value")))


@query(REGRID.format("round(sum(g.value * exp(-d2 / 62500000000.0)) / sum(exp(-d2 / 62500000000.0)), 6)", "GROUP BY ALL"))
def interpolate_gauss(spark, sf_dir):
    return spatial.interpolate(adapters.grid(spark, sf_dir), _moved(spark, sf_dir), "gauss", 18_000, 7).withColumn("value", r6(C("value")))


@query(
    with_views("grid", "moved", "weights")
    + """, two AS (
        SELECT 0 AS src, time, w.row, w.col, value FROM grid g JOIN weights w ON g.row = src_row AND g.col = src_col AND rank = 1 WHERE var = 'click'
        UNION ALL SELECT 1, time, w.row, w.col, value * 2 FROM grid g JOIN weights w ON g.row = src_row AND g.col = src_col AND rank = 1 WHERE var = 'view')
    SELECT 'field' AS var, time, b.row, b.col, m.lat, m.lon, CASE WHEN ref_value = -9999 THEN -9999.0::DOUBLE ELSE arg_max(value, src) END AS value
    FROM two b JOIN moved m ON m.row = b.row AND m.col = b.col GROUP BY time, b.row, b.col, m.lat, m.lon, ref_value"""
)
def merge_tiles_last_wins(spark, sf_dir):
    g, ref = adapters.grid(spark, sf_dir), _moved(spark, sf_dir)
    # both tiles share the whole grid's geometry
    tables = spatial.neighbours(g.select("row", "col", "lat", "lon").distinct(), ref, 18_000, 1)
    tiles = [g.filter(C("var") == v).withColumn("var", F.lit("field")).withColumn("value", C("value") * k) for v, k in (("click", 1), ("view", 2))]
    return spatial.merge_by_ref(tiles, ref, table=tables)


@query(with_views("grid") + "SELECT var, time, row, col, lat, lon, coalesce(value, -9999) AS value FROM grid")
def merge_time_stack(spark, sf_dir):
    """The grid stacked from its even and its odd hours."""
    g = adapters.grid(spark, sf_dir)
    return pipelines.multi_time([(None, g.filter(F.hour("time") % 2 == odd)) for odd in (0, 1)])


@query(with_views("grid", "ref") + "SELECT var, time, row, col, lat, lon, coalesce(value, -9999) AS value FROM grid WHERE var = 'click' UNION ALL SELECT 'terrain', NULL, row, col, lat, lon, ref_value FROM ref")
def merge_time_with_terrain(spark, sf_dir):
    """All steps of one variable and the terrain."""
    return pipelines.multi_time([(None, adapters.grid(spark, sf_dir).filter("var = 'click'"))], adapters.ref(spark, sf_dir))


@query(with_views("grid") + "SELECT var, time, row, col, lat, lon, coalesce(value, -9999) AS value FROM grid")
def merge_time_every_step(spark, sf_dir):
    """All steps of the grid."""
    return pipelines.multi_time([(None, adapters.grid(spark, sf_dir))])


@query(with_views("grid", "ref") + "SELECT var, time, row, col, lat, lon, coalesce(value, -9999) AS value FROM grid UNION ALL SELECT 'terrain', NULL, row, col, lat, lon, ref_value FROM ref")
def merge_time_every_step_with_terrain(spark, sf_dir):
    """All steps of the grid and the terrain."""
    return pipelines.multi_time([(None, adapters.grid(spark, sf_dir))], adapters.ref(spark, sf_dir))


POINTS = ", points AS (SELECT s_suppkey AS point, 46.0::DOUBLE - (s_suppkey * 37 % 200) / 100.0::DOUBLE AS lat, 10.0::DOUBLE + (s_suppkey * 53 % 140) / 100.0::DOUBLE AS lon, s_acctbal AS value FROM supplier)"


def _points(spark, sf_dir) -> DataFrame:
    k = C("s_suppkey")
    return adapters.table(spark, sf_dir, "supplier").select(k.alias("point"), (46.0 - (k * 37 % 200) / 100.0).alias("lat"), (10.0 + (k * 53 % 140) / 100.0).alias("lon"), C("s_acctbal").alias("value"))


@query(
    with_views("ref")
    + POINTS
    + """, s AS (SELECT point, value, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM points),
    t AS (SELECT row, col, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM ref),
    p AS (SELECT row, col, value, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 AS d2, point FROM s JOIN t ON abs(s.x - t.x) < 40000 AND abs(s.y - t.y) < 40000 AND abs(s.z - t.z) < 40000),
    k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, point) AS rank FROM p WHERE d2 < 40000.0 * 40000.0)
    SELECT row, col, count(*) AS n, round(coalesce(max(value) FILTER (WHERE d2 < 1e-6), sum(value / d2) FILTER (WHERE d2 >= 1e-6) / sum(1 / d2) FILTER (WHERE d2 >= 1e-6)), 3) AS value FROM k WHERE rank <= 8 GROUP BY row, col HAVING count(*) >= 3"""
)
def resample_points_min_neighbours(spark, sf_dir):
    return spatial.resample_points(_points(spark, sf_dir).withColumn("lat", C("lat")), adapters.ref(spark, sf_dir), 40_000, least=3).withColumn("value", F.round("value", 3))


@query(with_views("ref") + "SELECT DISTINCT (row + i)::INT AS row, (col + j)::INT AS col FROM ref, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE ref_value > 1000")
def resample_support_mask(spark, sf_dir):
    return spatial.support_mask(adapters.ref(spark, sf_dir).filter("ref_value > 1000").select("row", "col"))


@query(with_views("ref") + ", p AS (SELECT c_custkey, floor((46.05::DOUBLE - (46.0::DOUBLE - (c_custkey % 977) / 100.0::DOUBLE)) / 0.1)::INT AS row, floor((10.0::DOUBLE + (c_custkey % 149) / 100.0::DOUBLE - 9.95) / 0.1)::INT AS col FROM customer) SELECT c_custkey, CASE WHEN ref_value <> -9999 THEN ref_value END AS sampled FROM p LEFT JOIN ref r ON p.row = r.row AND p.col = r.col AND p.row BETWEEN 0 AND 99 AND p.col BETWEEN 0 AND 14")
def sample_grid_at_points(spark, sf_dir):
    k = C("c_custkey")
    points = adapters.table(spark, sf_dir, "customer").select("c_custkey", (46.0 - (k % 977) / 100.0).alias("lat"), (10.0 + (k % 149) / 100.0).alias("lon"))
    return spatial.sample_at(points, adapters.ref(spark, sf_dir), 9.95, 46.05, 0.1, 100, 15).select("c_custkey", "sampled")


@query(with_views("grid", "ref") + "SELECT var, time, g.row, g.col, r.lat, r.lon, value, g.row % 2 = 0 AS moved FROM grid g JOIN ref r ON g.row = r.row AND g.col = r.col")
def match_coords_snap(spark, sf_dir):
    g = adapters.grid(spark, sf_dir).withColumn("lat", C("lat") + F.when(C("row") % 2 == 0, 0.02).otherwise(0.001))
    return spatial.snap_to_ref(g, adapters.ref(spark, sf_dir))


# time

PROBES = ", probes AS (SELECT user_id, TIMESTAMP '2024-01-01 00:30:00' + n * INTERVAL 12 HOUR AS probe_time FROM (SELECT DISTINCT user_id FROM events), generate_series(0, 50) s(n))"


def _probes(spark, sf_dir) -> DataFrame:
    users = adapters.table(spark, sf_dir, "events").select("user_id").distinct()
    at = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    return users.withColumn("probe_time", F.explode(times.time_range(at, at + F.expr("INTERVAL 600 HOUR"), "12h")))


@query("WITH x AS (SELECT 1)" + PROBES + ", hits AS (SELECT p.user_id, probe_time, ts, value FROM probes p LEFT JOIN events e ON e.user_id = p.user_id AND ts <= probe_time AND ts >= probe_time - INTERVAL 1 HOUR) SELECT user_id, probe_time, max(ts) AS found_time, arg_max(value, ts) AS value FROM hits GROUP BY user_id, probe_time")
def asof_previous_1h(spark, sf_dir):
    return series.as_of(_probes(spark, sf_dir), adapters.table(spark, sf_dir, "events"), ["user_id"], 3600, time="ts")


@query("WITH x AS (SELECT 1)" + PROBES + ", hits AS (SELECT p.user_id, probe_time, ts, value, abs(epoch_us(ts) - epoch_us(probe_time)) AS d FROM probes p LEFT JOIN events e ON e.user_id = p.user_id AND ts <= probe_time + INTERVAL 1 HOUR AND ts >= probe_time - INTERVAL 1 HOUR) SELECT user_id, probe_time, arg_min(ts, row(d, ts)) AS found_time, arg_min(value, row(d, ts)) AS value FROM hits GROUP BY user_id, probe_time")
def asof_nearest_1h(spark, sf_dir):
    return series.as_of(_probes(spark, sf_dir), adapters.table(spark, sf_dir, "events"), ["user_id"], 3600, time="ts", nearest=True)


@query("SELECT event_type, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS time FROM events GROUP BY event_type")
def time_range_hours(spark, sf_dir):
    box = adapters.table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return box.select("event_type", F.explode(times.time_range(times.floor_time(C("a"), "hour"), times.floor_time(C("b"), "hour"), "1h")).alias("time"))


@query("SELECT DISTINCT o_orderdate, date_trunc('month', o_orderdate)::TIMESTAMP + (o_orderdate - date_trunc('day', o_orderdate)) AS month_start, date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS month_end FROM orders")
def time_bounds_month(spark, sf_dir):
    start, end = times.bounds(C("o_orderdate"), "month")
    return adapters.table(spark, sf_dir, "orders").select("o_orderdate").distinct().select("o_orderdate", start.alias("month_start"), end.alias("month_end"))


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS month, (epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH) - epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP)) // 3600000000 AS hours FROM orders")
def time_length_month(spark, sf_dir):
    months = adapters.table(spark, sf_dir, "orders").select(times.floor_time(C("o_orderdate"), "month").alias("month")).distinct()
    return months.select("month", times.length(C("month"), "m", "1h").alias("hours"))


@query("SELECT l_orderkey, l_linenumber, TIMESTAMP '2024-01-01 00:00:00' + l_linenumber * INTERVAL 3 HOUR AS time FROM lineitem")
def time_axis_from_ordinal(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.axis_from_ordinal(start, C("l_linenumber"), "3h").alias("time"))


# series and registries

@query(with_views("lines") + "SELECT time, pos, arg_max(value, line) AS value FROM lines GROUP BY time, pos")
def ts_keep_last(spark, sf_dir):
    return series.keep_last(adapters.lines(spark, sf_dir), ["time", "pos"], "line")


TAG = "lower(replace(region, ' ', '_')) || ':' || lower(replace(name, ' ', '_'))"


def _registry(spark, sf_dir) -> DataFrame:
    return adapters.sections(spark, sf_dir).select("pos", strings.section_tag(F.concat_ws(", ", "region", "name")).alias("tag"), "region")


@query(
    with_views("lines", "sections")
    + f""", last AS (SELECT time, pos, arg_max(value, line) AS value FROM lines WHERE time IS NOT NULL GROUP BY time, pos),
    fits AS (SELECT (SELECT count(DISTINCT pos) FROM lines) = (SELECT count(*) FROM sections) AS fits)
    SELECT {TAG} AS tag, l.pos, time, value, region FROM last l JOIN sections s ON l.pos = s.pos, fits WHERE fits AND region <> 'AFRICA'"""
)
def ts_join_registry(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    return pipelines.time_series(adapters.lines(spark, sf_dir), registry, registry.filter("region <> 'AFRICA'").select("tag", "region"))


@query(with_views("sections") + f"SELECT {TAG} AS tag, pos FROM sections WHERE pos NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def ts_missing_tags(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    rich = adapters.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(C("s_nationkey").alias("pos")).distinct()
    return series.missing_tags(registry, registry.join(rich, "pos"))


@query(with_views("lines", "sections") + f", last AS (SELECT time, pos, arg_max(value, line) AS value FROM lines GROUP BY time, pos), t AS (SELECT DISTINCT time FROM last) SELECT t.time, {TAG} AS tag, value FROM t CROSS JOIN sections s LEFT JOIN last l ON l.time = t.time AND l.pos = s.pos")
def ts_union_grid_aligned(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    last = series.keep_last(adapters.lines(spark, sf_dir), ["time", "pos"], "line").join(F.broadcast(registry), "pos")
    return series.align(last, registry)


@query(with_views("sections") + f"SELECT pos, {TAG} AS tag, lower(region) AS plain FROM sections")
def section_tag_parse(spark, sf_dir):
    return adapters.sections(spark, sf_dir).select("pos", strings.section_tag(F.concat_ws(", ", "region", "name")).alias("tag"), strings.section_tag(C("region")).alias("plain"))


@query("SELECT p_partkey, lower(regexp_replace(trim(p_type), '\\s+', '_', 'g')) || ':' || lower(CASE WHEN p_partkey % 5 = 0 THEN '_' ELSE regexp_replace(trim(p_brand), '\\s+', '_', 'g') END) AS tag FROM part")
def registry_tag_build(spark, sf_dir):
    return adapters.table(spark, sf_dir, "part").select("p_partkey", strings.registry_tag(C("p_type"), F.when(C("p_partkey") % 5 != 0, C("p_brand"))).alias("tag"))


# shape, order, ranges

@query(
    with_views("ref")
    + """, g AS (SELECT ref_value AS value, lat, (lon * 17 % 360) AS lon FROM ref), b AS (SELECT max(lon) > 180 AND min(lon) >= 0 AND max(lon) - min(lon) >= 180 AS wraps FROM g),
    w AS (SELECT value, lat, round(CASE WHEN wraps THEN (lon + 180) % 360 - 180 ELSE lon END, 6) AS lon FROM g, b)
    SELECT value, lat, lon, (dense_rank() OVER (ORDER BY lat DESC) - 1)::INT AS row, (dense_rank() OVER (ORDER BY lon) - 1)::INT AS col FROM w"""
)
def lon_wrap_and_orient(spark, sf_dir):
    g = adapters.ref(spark, sf_dir).select(C("ref_value").alias("value"), "lat", (C("lon") * 17 % 360).alias("lon"), "row", "col")
    return shaping.orient(shaping.wrap_longitude(g).withColumn("lon", r6(C("lon"))))


@query(with_views("grid") + ", b AS (SELECT var, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM grid GROUP BY var) SELECT g.var, time, row, col, round((least(greatest(value, lo), hi) - lo) / (hi - lo), 6) AS stretched FROM grid g JOIN b ON g.var = b.var")
def percentile_stretch(spark, sf_dir):
    return shaping.percentile_stretch(adapters.grid(spark, sf_dir)).select("var", "time", "row", "col", r6(C("stretched")).alias("stretched"))


@query("SELECT (p_partkey // 15)::INT AS row, (p_partkey % 15)::INT AS col, round(10.0::DOUBLE + 0.1::DOUBLE * (p_partkey % 15), 6) AS x, round(46.0::DOUBLE - 0.1::DOUBLE * (p_partkey // 15), 6) AS y FROM part WHERE p_size = 1")
def river_cells(spark, sf_dir):
    marks = adapters.table(spark, sf_dir, "part").select(*adapters.cells("p_partkey"), C("p_size").cast("double").alias("ref_value"))
    return shaping.river_cells(marks)


def _ramp(i: int) -> str:
    out = str(float(shaping.TERRAIN[-1][i]))
    for low, high in reversed(list(zip(shaping.TERRAIN, shaping.TERRAIN[1:], strict=False))):
        out = f"CASE WHEN share <= {high[0]} THEN {low[i]} + (share - {low[0]}) / {high[0] - low[0]}::DOUBLE * {high[i] - low[i]} ELSE {out} END"
    return f"floor({out} + 0.5)::INT"


@query(with_views("ref") + f", land AS (SELECT * FROM ref WHERE ref_value <> -9999), s AS (SELECT row, col, (ref_value - min(ref_value) OVER ()) / (max(ref_value) OVER () - min(ref_value) OVER ()) AS share FROM land) SELECT row, col, {_ramp(1)} AS r, {_ramp(2)} AS g, {_ramp(3)} AS b FROM s")
def terrain_ramp(spark, sf_dir):
    return shaping.terrain_ramp(adapters.ref(spark, sf_dir))


NAMES = {"click": "AirTemperature", "view": "Rain", "LAI": "signup"}


@query(with_views("grid") + "SELECT CASE var WHEN 'click' THEN 'AirTemperature' WHEN 'view' THEN 'Rain' ELSE 'LAI' END AS var, time, row, col, lat, lon, value FROM grid WHERE var IN ('click', 'view', 'signup')")
def var_rename_or_drop(spark, sf_dir):
    return shaping.rename_or_drop(adapters.grid(spark, sf_dir), NAMES)


@query("SELECT var, row_number() OVER (ORDER BY CASE var WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, var)::INT AS place FROM (SELECT DISTINCT event_type AS var FROM events)")
def priority_order(spark, sf_dir):
    return shaping.priority_order(adapters.table(spark, sf_dir, "events").select(C("event_type").alias("var")).distinct(), ["view", "error"])


@query("SELECT var, min(v) AS least, max(v) AS most, CASE WHEN var = 'price' THEN 'float32' WHEN var = 'key' AND max(v) > 65535 THEN 'uint32' WHEN var = 'key' AND max(v) > 255 THEN 'uint16' WHEN var = 'shifted' AND max(v) > 127 THEN 'int16' WHEN var = 'shifted' THEN 'int8' ELSE 'uint8' END AS kind FROM (SELECT 'price' AS var, p_retailprice AS v FROM part UNION ALL SELECT 'key', p_partkey FROM part UNION ALL SELECT 'size', p_size FROM part UNION ALL SELECT 'shifted', p_size - 25 FROM part) GROUP BY var")
def narrow_dtype(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part")
    parts = [p.select(F.lit(n).alias("var"), c.cast("double").alias("value")) for n, c in (("price", C("p_retailprice")), ("key", C("p_partkey")), ("size", C("p_size")), ("shifted", C("p_size") - 25))]
    return shaping.narrow_types(reduce(DataFrame.unionByName, parts))


# runs and documents

@query("SELECT event_type AS basin, max(date_trunc('day', ts)::TIMESTAMP) AS run, arg_max(user_id, row(ts, user_id)) AS section FROM events GROUP BY event_type")
def latest_run_per_basin(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    runs = e.select(C("event_type").alias("basin"), times.floor_time(C("ts"), "day").alias("run"), F.struct("ts", "user_id").alias("section"))
    return catalog.latest_runs(runs, last="section").select("basin", "run", C("section.user_id").alias("section"))


@query("WITH runs AS (SELECT DISTINCT event_type AS basin, date_trunc('hour', ts) AS run FROM events) SELECT basin, arg_min(run, row(abs(epoch_us(run) - epoch_us(TIMESTAMP '2024-01-15 06:20:00')), run)) AS run FROM runs GROUP BY basin")
def nearest_run(spark, sf_dir):
    runs = adapters.table(spark, sf_dir, "events").select(C("event_type").alias("basin"), times.floor_time(C("ts"), "hour").alias("run")).distinct()
    return catalog.nearest_runs(runs, F.lit("2024-01-15 06:20:00"))


def _documents(spark, sf_dir) -> DataFrame:
    """Hydrograph documents of users, one a day: flat JSON objects of comma-joined strings; every seventh value is a sentinel, the simulated series lacks its last two."""
    e = adapters.table(spark, sf_dir, "events")
    shown = F.when(C("event_id") % 7 == 0, "-9998").otherwise(F.format_string("%.2f", "value"))
    held = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", shown.alias("v"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("t")))).alias("all"))
    values = F.transform("all", lambda x: x["v"])
    return held.select(F.to_json(F.struct(F.lit("basin").alias("section_domain"), C("user_id").cast("string").alias("section_name"), F.date_format("day", "yyyy-MM-dd HH:mm").alias("time_run"), F.array_join(F.transform("all", lambda x: x["t"]), ",").alias("time_period"), F.array_join(values, ",").alias("time_series_discharge_observed"), F.array_join(F.slice(values, F.lit(1), F.greatest(F.size("all") - 2, F.lit(0))), ",").alias("time_series_discharge_simulated"))).alias("json"))


HYDRO = """WITH e AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id, ts::DATE) AS n FROM events),
    h AS (SELECT user_id::VARCHAR AS section, 'observed' AS kind, pos::INT AS pos, date_trunc('minute', ts) AS time, CASE WHEN event_id % 7 <> 0 THEN round(value, 2) END AS value FROM e
    UNION ALL SELECT user_id::VARCHAR, 'simulated', pos::INT, date_trunc('minute', ts), CASE WHEN event_id % 7 <> 0 AND pos < n - 2 THEN round(value, 2) END FROM e) """


@query(HYDRO + "SELECT section, kind, pos, time, value FROM h")
def hydrograph_explode(spark, sf_dir):
    return text.explode_hydrographs(_documents(spark, sf_dir)).select("section", "kind", "pos", "time", "value")


@query(HYDRO + "SELECT section, count(value) FILTER (WHERE kind = 'observed') AS observed, count(value) FILTER (WHERE kind = 'simulated') AS simulated, max(value) AS peak, max(time) AS last_time FROM h GROUP BY section")
def hydrograph_table(spark, sf_dir):
    h = text.explode_hydrographs(_documents(spark, sf_dir))
    good = F.when(series.valid_for_table(C("value")), C("value"))
    return h.groupBy("section").agg(F.count(F.when(C("kind") == "observed", good)).alias("observed"), F.count(F.when(C("kind") == "simulated", good)).alias("simulated"), F.max(good).alias("peak"), F.max("time").alias("last_time"))


# namelists

def _template(spark, sf_dir) -> DataFrame:
    k = C("p_partkey")
    return adapters.table(spark, sf_dir, "part").select(C("p_brand").alias("section"), k.alias("ord"), F.concat(F.lit("par"), k).alias("param"), F.when(C("p_size") < 5, "mandatory").otherwise("default").alias("mode"), C("p_size").cast("string").alias("default_value"))


def _overrides(spark, sf_dir) -> DataFrame:
    k = C("s_suppkey")
    return adapters.table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, "by_pattern").otherwise("by_value").alias("kind"), F.when(k % 3 == 0, k.cast("string")).when(k % 5 == 0, F.concat(F.lit("no"), k)).otherwise(F.concat(F.lit("par"), k * 2)).alias("key"), F.concat(F.lit("v"), k).alias("value"), (k % 4 != 0).alias("active"))


NAMELIST = """WITH template AS (SELECT p_brand AS section, p_partkey AS ord, 'par' || p_partkey AS param, CASE WHEN p_size < 5 THEN 'mandatory' ELSE 'default' END AS mode, p_size::VARCHAR AS default_value FROM part),
    o AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'by_pattern' ELSE 'by_value' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR WHEN s_suppkey % 5 = 0 THEN 'no' || s_suppkey ELSE 'par' || s_suppkey * 2 END AS key, 'v' || s_suppkey AS value FROM supplier WHERE s_suppkey % 4 <> 0),
    likes AS (SELECT param, arg_min(value, key) AS value FROM template t JOIN o ON kind = 'by_pattern' AND contains(param, key) GROUP BY param),
    built AS (SELECT t.section, t.ord, t.param, t.mode, t.default_value, coalesce(e.value, l.value, CASE WHEN mode = 'default' THEN default_value END) AS value
    FROM template t LEFT JOIN o e ON e.kind = 'by_value' AND e.key = t.param LEFT JOIN likes l ON l.param = t.param) """


@query(NAMELIST + "SELECT * FROM built")
def namelist_build_values(spark, sf_dir):
    return namelist.build_values(_template(spark, sf_dir), _overrides(spark, sf_dir))


@query(NAMELIST + "SELECT 'missing mandatory' AS problem, param FROM built WHERE mode = 'mandatory' AND value IS NULL UNION ALL SELECT 'unknown parameter', key FROM o WHERE kind = 'by_value' AND key NOT IN (SELECT param FROM template)")
def namelist_validate(spark, sf_dir):
    return namelist.validate(_template(spark, sf_dir), _overrides(spark, sf_dir))


@query("SELECT lower(r_name) AS section, n_name AS param, n_nationkey::VARCHAR AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def namelist_parse(spark, sf_dir):
    s = adapters.sections(spark, sf_dir)
    body = s.select("region", (C("pos") + 1).alias("n"), F.concat(F.lit("  "), "name", F.lit(" = "), "pos", F.lit(",  ! key")).alias("text"))
    ends = s.select("region").distinct().select("region", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit("&"), "region").alias("text")), F.struct(F.lit(1000).alias("n"), F.lit("/").alias("text")))).alias("x")).select("region", "x.n", "x.text")
    return text.parse_namelist(body.unionByName(ends).select(F.col("region").alias("file"), "n", "text"), lower=True).select("section", "param", "value")


@query(with_views("grid", "moved", "weights") + "SELECT 'AirTemperature' AS var, time, w.row, w.col, m.lat, m.lon, round(CASE WHEN ref_value = -9999 THEN -9999 ELSE value / 20 END, 6) AS value FROM grid g JOIN weights w ON g.row = src_row AND g.col = src_col AND rank = 1 JOIN moved m ON m.row = w.row AND m.col = w.col WHERE var = 'click'")
def convert_temperature_pipeline(spark, sf_dir):
    """Regrid, mask by terrain, K to °C: the order of the converters for direct variables."""
    g = adapters.grid(spark, sf_dir)
    ref = _moved(spark, sf_dir)
    shared = spatial.neighbours(g.select("row", "col", "lat", "lon").distinct(), ref, 18_000, 1)
    kelvin = g.filter("var = 'click'").withColumn("value", 273.15 + C("value") / 20)
    steps = [("interpolate_data", {"table": shared}), ("mask_data_by_ref", {"mask_no_data": None}), ("convert_temperature_units", {"units": "K"})]
    done = pipelines.multi_variable({"AirTemperature": kelvin}, ref, {}, steps)
    return done.withColumn("value", r6(F.coalesce("value", F.lit(NO_DATA))))


from hydroloom.plans import file_queries, format_queries, library_queries, run_queries  # noqa: E402,F401  registers the queries of the library's other parts
