"""Sinks: partitioned Parquet as the canonical form, text forms at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.functions.times import cf_encode
from hydroloom.model import NO_DATA, to_sentinel


def hmc_layout(grid: DataFrame, rows: int, no_data: float = NO_DATA) -> DataFrame:
    """A field as the hydrological model reads it: south first, floats, sentinel for no-data and all below it."""
    value = to_sentinel(F.col("value"), no_data)
    value = F.when(value <= no_data, no_data).otherwise(value).cast("float")
    return grid.select("var", "time", F.col("col").alias("west_east"), (F.lit(rows - 1) - F.col("row")).alias("south_north"), value.alias("value"))


def s3m_layout(grid: DataFrame, rows: int, no_data: float = NO_DATA) -> DataFrame:
    return hmc_layout(grid, rows, no_data).withColumnsRenamed({"west_east": "X", "south_north": "Y"})


def itwater_layout(grid: DataFrame) -> DataFrame:
    """Dimensions nt, lon, lat in this order."""
    return grid.select(F.col("time").alias("nt"), "lon", "lat", "var", "value")


def write_grid(grid: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by day, sorted by variable and cell within files: time ranges prune folders, variables row groups."""
    day = grid.withColumn("day", F.to_date("time"))
    day.repartition("day", "var").sortWithinPartitions("var", "time", "row", "col").write.mode(mode).partitionBy("day").parquet(path)


def write_series(series: DataFrame, registry: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Discharge by section and time (days since 1970) with the registry beside it."""
    series.withColumn("days", cf_encode(F.col("time"))).sortWithinPartitions("tag", "time").write.mode(mode).parquet(f"{path}/series")
    registry.write.mode(mode).parquet(f"{path}/registry")


def write(df: DataFrame, path: str, kind: str = "parquet", append: bool = False) -> None:
    """csv (a header unless appended), json (lines), text or parquet; `.gz` in kind compresses."""
    kind, _, codec = kind.partition(".")
    writer = df.write.mode("append" if append else "overwrite")
    if codec == "gz":
        writer = writer.option("compression", "gzip")
    if kind == "csv":
        writer = writer.option("header", not append)
    if kind not in ("csv", "json", "text", "parquet"):
        raise ValueError(kind)
    getattr(writer, kind)(path)


def ascii_grid_lines(ref: DataFrame, no_data: float = NO_DATA) -> DataFrame:
    """(row, line) of the matrix of an ASCII grid, a line a row; a row's cells meet in one task."""
    cells = F.sort_array(F.collect_list(F.struct("col", to_sentinel(F.col("ref_value"), no_data).alias("v"))))
    return ref.groupBy("row").agg(F.concat_ws(" ", F.transform(cells, lambda c: c["v"].cast("string"))).alias("line"))
