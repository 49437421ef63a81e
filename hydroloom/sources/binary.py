"""Binary sources: scaled integer cubes, and a dispatcher by format."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.sources import geotiff, grib, netcdf, shapefile, text

#: What file name endings mean.
FORMATS = {"csv": "csv", "tif": "geotiff", "tiff": "geotiff", "nc": "netcdf", "grib": "grib", "grb": "grib", "json": "json", "geojson": "json", "txt": "txt", "asc": "ascii", "shp": "shp", "parquet": "parquet", "tmp": "tmp", "file": "file"}


def format_of(path: str) -> str:
    ending = path.rsplit(".", 1)[-1].lower()
    if "." not in path or ending not in FORMATS:
        raise ValueError(f"no known format: {path}")
    return FORMATS[ending]


def check_format(frame: DataFrame, kind: str) -> DataFrame:
    """`frame`, if its columns are those that a format takes: cells for fields (geotiff, netcdf, ascii), lines for txt; else raises."""
    needs = {"geotiff": {"row", "col", "value"}, "ascii": {"row", "col", "value"}, "netcdf": {"var", "time", "row", "col", "value"}, "txt": {"value"}, "csv": set(), "json": set(), "parquet": set()}
    if kind not in needs:
        raise ValueError(f"{kind} is not written")
    if lacking := needs[kind] - set(frame.columns):
        raise ValueError(f"{kind} needs {sorted(lacking)}")
    if kind == "csv" and (nested := [n for n, t in frame.dtypes if t.startswith(("array", "map", "struct"))]):
        raise ValueError(f"csv can't hold {nested}")
    return frame


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Read by format: rasters and fields as cells, shapefiles as records; of netcdf the classic kinds only. Options are the format's own."""
    kind = kind or format_of(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema="schema" not in options, **options)
    if kind == "json":
        return spark.read.json(path, multiLine=True, **options)
    if kind == "ascii":
        return text.read_ascii_grid(spark, path)
    if kind == "txt":
        return spark.read.text(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "netcdf":
        return netcdf.read_netcdf(spark, path, **options)
    if kind == "geotiff":
        return geotiff.read_geotiff(spark, path, **options)
    if kind == "grib":
        return grib.read_grib(spark, path, **options)
    if kind == "shp":
        return shapefile.read_shapefile(spark, path, **options)
    raise NotImplementedError(f"{kind} has no decoder")


def int_cube(files: DataFrame, rows: int, cols: int, scale: float = 10.0, dtype: str = "<i4", expected: int | None = None) -> DataFrame:
    """(path, row, col, t, value) of integer arrays (path, content) in Fortran order (row, col, t), divided by `scale`.

    Files are cut into steps of rows * cols numbers; one step stands for all `expected` ones.
    """
    cells, width = rows * cols, np.dtype(dtype).itemsize

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if len(content) % (cells * width):
                    raise ValueError(f"{name}: not a whole number of steps")
                n = len(content) // (cells * width)
                i = np.arange(cells)
                for t in range(n):
                    step = np.frombuffer(content, dtype, cells, t * cells * width)
                    yield pd.DataFrame({"path": name, "row": (i % rows).astype("int32"), "col": (i // rows).astype("int32"), "t": np.int32(t), "value": step / scale, "single": n == 1})

    cube = files.select("path", "content").mapInPandas(decode, "path string, row int, col int, t int, value double, single boolean")
    if expected is None or expected == 1:
        return cube.drop("single")
    steps = F.when(F.col("single"), F.sequence(F.lit(0), F.lit(expected - 1))).otherwise(F.array("t"))
    return cube.withColumn("t", F.explode(steps)).drop("single")


def read_int_cube(spark: SparkSession, path: str, rows: int, cols: int, **kind) -> DataFrame:
    """`int_cube` of files."""
    return int_cube(spark.read.format("binaryFile").load(path), rows, cols, **kind)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, time, length) of files; content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")
