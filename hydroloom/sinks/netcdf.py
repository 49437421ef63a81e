"""NetCDF files of models: many steps a file, written in pieces by Spark tasks and published together.

A file's plan (where its variables begin, its steps) is a row.  Cells joined with it know where
their step begins, and those of a run of rows make a piece where they meet; `sinks.files` appends
the pieces in order and fills what no cell is in with no-data.  No task holds more than one run
of rows, and no-data between them is neither made nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.model import NO_DATA
from hydroloom.operators.masks import counted, small
from hydroloom.shared import written
from hydroloom.sinks.files import write_files
from hydroloom.sources.netcdf import header, stored


@dataclass(frozen=True)
class Layout:
    """Names and axes of a model's files."""

    y: str
    x: str
    lat: str
    lon: str
    #: Axes by cell (two dimensions), or one value a row and a column.
    by_cell: bool
    south_first: bool
    #: Dimensions besides, with their sizes.
    more: tuple[tuple[str, int], ...] = ()
    crs: bool = False
    kind: str = ">f4"


#: Dimensions of the models' files, and the time axis.
HMC = Layout("south_north", "west_east", "latitude", "longitude", True, True, (("nsim", 1), ("ntime", 2), ("nens", 1)), True)
S3M = Layout("Y", "X", "latitude", "longitude", True, True, (("nsim", 1), ("ntime", 2), ("nens", 1)), True)
GENERIC = Layout("lat", "lon", "lat", "lon", False, False, kind=">f8")
TIME_UNITS, CALENDAR = "days since 1970-01-01 00:00:00", "gregorian"

PLAN, PIECES = "name string, begins map<string,long>, times array<timestamp_ntz>, size long", "name string, offset long, content binary"
#: Cells of a piece.
CELLS = 1 << 18


def _described(names: list[str], times: list[datetime], rows: int, cols: int, layout: Layout, no_data: float, about: dict) -> tuple[bytes, dict[str, int], np.ndarray]:
    """A file's header, where its variables begin, and its time axis."""
    dims = {layout.x: cols, layout.y: rows, "time": len(times)} | dict(layout.more)
    days = np.array([(t - pd.Timestamp(1970, 1, 1)) / pd.Timedelta(days=1) for t in times])
    axis = [layout.y, layout.x]
    shown = [t.strftime("%Y%m%d%H%M") for t in times]
    notes = {"units": TIME_UNITS, "calendar": CALENDAR, "axis": "T", "time_start": shown[0], "time_end": shown[-1]}
    fixed = [("time", ["time"], ">f8", notes)]
    for own, place, unit in ((layout.lon, axis[1:], "degrees_east"), (layout.lat, axis[:1], "degrees_north")):
        fixed.append((own, axis if layout.by_cell else place, ">f8", {"units": unit}))
    if layout.crs:
        fixed.append(("crs", [], ">i4", {"grid_mapping_name": "latitude_longitude", "epsg_code": "EPSG:4326"}))
    fields = [(v, ["time", *axis], layout.kind, {"_FillValue": np.array([no_data], layout.kind), "scale_factor": np.array([1.0], layout.kind)}) for v in names]
    head, begins = header(dims, fixed + fields, about)
    return head, begins, days


def _plan(files: DataFrame, rows: int, cols: int, layout: Layout, no_data: float, about: dict) -> DataFrame:
    """(name, begins, times, size) of rows (name, vars, times)."""
    width = rows * cols * np.dtype(layout.kind).itemsize

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, names, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, begins, _ = _described(names, times, rows, cols, layout, no_data, about)
                size = max(begins[v] for v in names) + len(times) * width
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([[(v, begins[v]) for v in names]], pa.map_(pa.string(), pa.int64())), pa.array([times], pa.list_(pa.timestamp("us"))), pa.array([size])], names=["name", "begins", "times", "size"])

    return files.select("name", "vars", "times").mapInArrow(plan, PLAN)


def _heads(files: DataFrame, lat: np.ndarray, lon: np.ndarray, layout: Layout, no_data: float, about: dict) -> DataFrame:
    """(name, offset, content) of everything before the fields, of rows (name, vars, times): axes by cell in runs of rows."""
    rows, cols = len(lat), len(lon)
    run = max(1, CELLS // cols)

    def parts(names: list[str], times: list[datetime]) -> Iterator[tuple[int, bytes]]:
        head, begins, days = _described(names, times, rows, cols, layout, no_data, about)
        yield 0, head
        yield begins["time"], stored(days, ">f8")
        for own, values, across in ((layout.lon, lon, False), (layout.lat, lat, True)):
            if not layout.by_cell:
                yield begins[own], stored(values, ">f8")
                continue
            for low in range(0, rows, run):
                n = min(run, rows - low)
                yield begins[own] + low * cols * 8, stored(np.repeat(lat[low : low + n, None], cols, 1) if across else np.tile(lon, (n, 1)), ">f8")
        if layout.crs:
            yield begins["crs"], stored(np.zeros((), "i4"), ">i4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, names, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for offset, content in parts(names, times):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([offset]), pa.array([content], pa.binary())], names=["name", "offset", "content"])

    return files.select("name", "vars", "times").mapInArrow(pieces, PIECES)


def _axis(ref: DataFrame, name: str, number: str) -> np.ndarray:
    """Coordinates of a regular axis, a value a row or column, by number; other numbers between raise."""
    # as many rows as the axis is long
    found = ref.groupBy(number).agg(F.min(name).alias("low"), F.max(name).alias("high")).orderBy(number).toPandas()
    if found[number].tolist() != list(range(len(found))) or (found["low"] != found["high"]).any():
        raise ValueError(f"the reference is no regular grid along {number}")
    return found["low"].to_numpy()


def write_netcdf(grid: DataFrame, ref: DataFrame, path: str, name: Column, layout: Layout = HMC, no_data: float = NO_DATA, packed: bool = False, overwrite: bool = False, about: dict[str, str] | None = None) -> None:
    """Write fields (var, time, row, col, value) as NetCDF files below `path`.

    `name` (an expression of `time`) names the file of a step; a file has the steps and
    variables of its rows, over all cells of `ref` (row, col, lat, lon: a regular grid, row 0
    north).  NULL, NaN, what is `no_data` or less, and cells without a row hold `no_data`; of a
    cell given twice the larger value stands.  Rows outside `ref` or without time go.  Names
    that are there raise unless `overwrite`; a failing task leaves no file.
    """
    lat, lon = _axis(ref, "lat", "row"), _axis(ref, "lon", "col")
    rows, cols = len(lat), len(lon)
    axis = lat[::-1] if layout.south_first else lat
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1) & F.col("time").isNotNull()
    cells = grid.filter(inside).withColumn("name", name).select("name", "var", F.col("time").cast("timestamp_ntz").alias("time"), "row", "col", F.col("value").cast("double").alias("value"))
    files = written(cells.groupBy("name").agg(F.sort_array(F.collect_set("var")).alias("vars"), F.sort_array(F.collect_set("time")).alias("times")), "netcdf-files")
    plan = written(_plan(files, rows, cols, layout, no_data, about or {}), "netcdf-plan")
    kind, south = layout.kind, layout.south_first
    size, run = np.dtype(kind).itemsize, max(1, CELLS // cols)
    # a step's place in its file; steps are few beside their cells
    places = plan.select("name", F.explode("begins").alias("var", "begin"), "times").select("name", "var", "begin", F.posexplode("times").alias("i", "time"))
    places = places.select("name", "var", "time", (F.col("begin") + F.col("i").cast("long") * (rows * cols * size)).alias("begin"))

    def piece(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        name, begin, low = key[0], int(key[1]), int(key[2]) * run
        field = np.full((min(run, rows - low), cols), -np.inf)
        np.maximum.at(field, (part["line"].to_numpy() - low, part["col"].to_numpy()), part["value"].fillna(no_data).to_numpy())
        field = np.where(field <= no_data, no_data, field)
        return pd.DataFrame({"name": [name], "offset": [begin + low * cols * size], "content": [field.astype(kind).tobytes()]})

    line = F.lit(rows - 1) - F.col("row") if south else F.col("row")
    met = cells.join(small(places), ["name", "var", "time"]).select("name", "begin", line.alias("line"), "col", "value")
    fields = met.withColumn("run", F.floor(F.col("line") / run).cast("int")).groupBy("name", "begin", "run").applyInPandas(piece, PIECES)
    # cells between the pieces are no-data, up to the file's end
    ends = plan.select("name", F.col("size").alias("offset"), F.lit(b"").alias("content"))
    heads = _heads(files, axis, lon, layout, no_data, about or {})
    write_files(fields.unionByName(heads).unionByName(ends), path, packed, overwrite, np.array(no_data, kind).tobytes(), counted(plan))
