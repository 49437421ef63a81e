"""Registered queries of binary formats: files are written from the tables by Spark, then scanned by byte range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroloom.plans import adapters
from hydroloom.plans.adapters import with_views
from hydroloom.plans.queries import query, r6
from hydroloom.shared import new_path
from hydroloom.sinks import netcdf as netcdf_sink
from hydroloom.sinks.files import write_files
from hydroloom.sources import geotiff, grib, netcdf, shapefile

C = F.col
PIECE = "name string, offset long, content binary"
#: Rows of terrain in one raster file.
TILE_ROWS = 32


@query(with_views("ref") + f"SELECT (row // {TILE_ROWS})::INT AS tile, (row % {TILE_ROWS})::INT AS row, col, lat, lon, CASE WHEN ref_value >= 0 THEN ref_value END AS value FROM ref")
def scan_geotiff(spark, sf_dir):
    """Terrain written as rasters of 32 rows (tiles and strips, LZW and Deflate, both predictors), and scanned again."""
    path = new_path(spark, "geotiff")
    cells = adapters.ref(spark, sf_dir).withColumn("tile", F.floor(C("row") / TILE_ROWS).cast("int"))

    def file(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low, tile = int(part["row"].min()) // TILE_ROWS * TILE_ROWS, int(key[0])
        # cells that no part stands for hold what is no number
        values = np.full((int(part["row"].max()) - low + 1, 15), np.nan)
        values[part["row"] - low, part["col"]] = part["ref_value"]
        kinds = [{"compression": geotiff.LZW, "tile": (16, 16)}, {"compression": geotiff.DEFLATE, "predictor": geotiff.FLOATING, "rows_per_strip": 5}, {"order": ">", "rows_per_strip": 8}]
        content = geotiff.encode(values, 46.0 - 0.1 * low, 10.0, 0.1, -9999.0, **kinds[tile % 3])
        return pd.DataFrame({"name": [f"terrain_{tile}.tif"], "offset": [0], "content": [content]})

    write_files(cells.select("tile", "row", "col", "ref_value").groupBy("tile").applyInPandas(file, PIECE), path)
    # compared cell by cell: those between that no part stands for are left out again
    known = cells.select("tile", (C("row") % TILE_ROWS).alias("row"), "col")
    read = geotiff.read_geotiff(spark, path).withColumn("tile", F.regexp_extract("path", r"terrain_(\d+)\.tif$", 1).cast("int"))
    return read.select("tile", "row", "col", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"), "value").join(known, ["tile", "row", "col"], "left_semi")


def _days(spark, sf_dir, packed: bool) -> str:
    """Hourly fields as files of a day for the hydrological model."""
    path, day = new_path(spark, "hmc"), F.concat(F.lit("hmc_"), F.date_format("time", "yyyyMMdd"), F.lit(".nc"))
    netcdf_sink.write_netcdf(adapters.grid(spark, sf_dir), adapters.whole_ref(spark, sf_dir), path, day, packed=packed)
    return path


HMC_NAMES = {"y": "south_north", "x": "west_east", "lat": "latitude", "lon": "longitude"}


@query(
    with_views("grid")
    + """, size AS (SELECT max(p_partkey) // 15 AS last FROM part)
    SELECT 'hmc_' || strftime(time, '%Y%m%d') || '.nc.gz' AS file, var, time, col, (last - row)::INT AS row, lat, lon, value::FLOAT::DOUBLE AS value FROM grid, size WHERE row <= last AND value > -9999"""
)
def sink_netcdf_hmc(spark, sf_dir):
    """A file a day in the hydrological model's layout, south first, gzipped, listed and read again."""
    read = netcdf.read_netcdf(spark, _days(spark, sf_dir, True), **HMC_NAMES).filter("value is not null")
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "var", "time", "col", "row", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"), "value")


@query(
    with_views("grid")
    + """, size AS (SELECT max(p_partkey) // 15 AS last FROM part), recent AS (SELECT max(time) - INTERVAL 5 DAY AS since FROM grid)
    SELECT var, time, (last - row)::INT AS row, col, value::FLOAT::DOUBLE AS value FROM grid, size, recent WHERE var = 'click' AND time >= since AND row <= last AND value > -9999"""
)
def scan_netcdf_pruned(spark, sf_dir):
    """One variable's last five days of the model's files: the bytes of all other steps stay unread."""
    path = _days(spark, sf_dir, False)
    since = adapters.grid(spark, sf_dir).agg((F.max("time") - F.expr("INTERVAL 5 DAYS")).alias("since")).first()["since"]
    read = netcdf.read_netcdf(spark, path, **HMC_NAMES)
    return read.filter((C("var") == "click") & (C("time") >= F.lit(since)) & C("value").isNotNull()).select("var", "time", "row", "col", "value")


#: Discipline, category and number of the variables that events stand for.
GRIB_KEYS = {"click": (0, 0, 0), "view": (0, 1, 8), "error": (0, 2, 2)}


@query(
    with_views("grid")
    + """SELECT date_trunc('day', time) AS time_start, time, CASE var WHEN 'click' THEN 't' WHEN 'view' THEN 'tp' WHEN 'error' THEN 'u' ELSE '0.19.0' END AS var, row, col, lat, lon, value FROM grid"""
)
def scan_grib(spark, sf_dir):
    """Hourly fields written as a file a day, a packed message a variable and hour with a bitmap, and scanned by message: time is the day's start plus the step."""
    path = new_path(spark, "grib")

    def message(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        var, time = key
        low, west = int(part["row"].min()), int(part["col"].min())
        values = np.full((int(part["row"].max()) - low + 1, int(part["col"].max()) - west + 1), np.nan)
        values[part["row"] - low, part["col"] - west] = part["value"]
        start = time.normalize()
        content = grib.encode(values, 46.0 - 0.1 * low, 10.0 + 0.1 * west, 0.1, 0.1, start.to_pydatetime(), int((time - start).total_seconds()) // 3600, GRIB_KEYS.get(var, (0, 19, 0)), 32, 6, over_hours=1 if var == "view" and time.hour else None)
        return pd.DataFrame({"day": [start.strftime("%Y%m%d")], "var": [var], "time": [time], "content": [content]})

    packed = adapters.grid(spark, sf_dir).select("var", "time", "row", "col", "value").groupBy("var", "time").applyInPandas(message, "day string, var string, time timestamp_ntz, content binary")
    # a message begins where those before it in its file end; a day's messages are few
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("day").orderBy("time", "var").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    write_files(packed.select(F.concat(F.lit("day_"), "day", F.lit(".grib")).alias("name"), before.cast("long").alias("offset"), "content"), path)
    read = grib.read_grib(spark, path).filter("value is not null")
    place = lambda c, origin: F.round((C(c) - origin) * 10).cast("int")
    return read.select("time_start", "time", "var", (-place("lat", 46.0)).alias("row"), place("lon", 10.0).alias("col"), r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"), r6(C("value")).alias("value"))


SQUARE = "'((' || concat_ws(', ', x || ' ' || y, x || ' ' || (y + 1), (x + 1) || ' ' || (y + 1), (x + 1) || ' ' || y, x || ' ' || y) || ')"


@query(
    f"""WITH n AS (SELECT n_name AS name, n_nationkey AS key, n_regionkey % 3 AS kind, 10.5::DOUBLE + n_nationkey AS x, 45.5::DOUBLE - n_nationkey AS y FROM nation)
    SELECT name, key, key / 4.0::DOUBLE AS quarter, DATE '2024-01-01' + key::INT AS day, key % 2 = 0 AS even,
        CASE WHEN key % 7 = 6 THEN NULL WHEN kind = 0 THEN 'POINT (' || x || ' ' || y || ')' WHEN kind = 1 THEN 'LINESTRING (' || x || ' ' || y || ', ' || (x + 1) || ' ' || y || ')' ELSE 'POLYGON ' || {SQUARE})' END AS geometry FROM n"""
)
def scan_shapefile(spark, sf_dir):
    """Nations as shapes of their regions (points, lines or squares, some without), written as shapefiles with index and attributes, and scanned again."""
    path = new_path(spark, "shapes")

    def files(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n_nationkey")
        kind = (shapefile.POINT, shapefile.LINE, shapefile.POLYGON)[int(key[0]) % 3]
        shapes, rows = [], []
        for nation, name in zip(part["n_nationkey"].tolist(), part["n_name"], strict=True):
            x, y = 10.5 + nation, 45.5 - nation
            square = np.array([(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y), (x, y)])
            points = square[:1] if kind == shapefile.POINT else square[[0, 3]] if kind == shapefile.LINE else square
            shapes.append(None if nation % 7 == 6 else (kind, [points]))
            rows.append([name, nation, nation / 4, pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=nation), nation % 2 == 0])
        made = shapefile.encode(shapes, kind, [("name", "C", 25, 0), ("key", "N", 9, 0), ("quarter", "N", 12, 3), ("day", "D", 8, 0), ("even", "L", 1, 0)], rows)
        return pd.DataFrame({"name": [f"region_{key[0]}{end}" for end in made], "offset": 0, "content": list(made.values())})

    write_files(adapters.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInPandas(files, PIECE), path)
    return shapefile.read_shapefile(spark, path).select("name", "key", "quarter", "day", "even", "geometry")
