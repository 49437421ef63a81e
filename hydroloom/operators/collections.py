"""Fields of several sources brought together on one reference, their geometry checked in the plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.model import GRID
from hydroloom.operators.masks import small

BOX = ("south", "north", "west", "east")


def geometry(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, rows, cols, south, north, west, east), a row a key: numbers of rows and columns, and the box of the cells' coordinates."""
    ends = [f(c).alias(n) for f, c, n in ((F.min, "lat", "south"), (F.max, "lat", "north"), (F.min, "lon", "west"), (F.max, "lon", "east"))]
    return cells.groupBy(*keys).agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"), *ends)


def spacing(ref: DataFrame) -> DataFrame:
    """(step), one row: the larger of the mean steps of a regular reference's rows and columns; 0 of a single cell."""
    shape = geometry(ref)
    step = lambda low, high, n: F.when(F.col(n) > 1, (F.col(high) - F.col(low)) / (F.col(n) - 1)).otherwise(0.0)
    return shape.select(F.greatest(step("south", "north", "rows"), step("west", "east", "cols")).alias("step"))


def checked_geometry(parts: DataFrame, ref: DataFrame, key: str = "var") -> DataFrame:
    """(key, rows, cols, south, north, west, east, same_size, same_box), a row a part.

    same_size: as many rows and columns as the reference; same_box: each side of the box at most
    one cell of the reference away from its own.
    """
    own = geometry(ref).toDF("ref_rows", "ref_cols", *[f"ref_{b}" for b in BOX])
    met = geometry(parts, key).join(F.broadcast(own)).join(F.broadcast(spacing(ref)))  # one row each
    near = F.lit(True)
    for side in BOX:
        near &= F.abs(F.col(side) - F.col(f"ref_{side}")) <= F.col("step") + 1e-9
    same = (F.col("rows") == F.col("ref_rows")) & (F.col("cols") == F.col("ref_cols"))
    return met.select(key, "rows", "cols", *BOX, same.alias("same_size"), near.alias("same_box"))


def collect_grids(parts: Mapping[str, DataFrame], ref: DataFrame, raise_on_box: bool = False) -> DataFrame:
    """(var, time, row, col, lat, lon, value, same_box): the parts' fields, named by the mapping's keys, at the reference's coordinates.

    Cells meet by row and column, nothing is interpolated; cells that the reference lacks have no
    row.  A part of another size raises when its rows are read, and with `raise_on_box` one
    whose box lies more than a cell elsewhere; else `same_box` says so.  Parts need (row, col, lat,
    lon, value) and may have a time.  All parts are read together: once for the geometry,
    once for the cells.
    """
    if not parts:
        raise ValueError("no part to collect")
    rows = None
    for name, part in parts.items():
        time = F.col("time").cast("timestamp_ntz") if "time" in part.columns else F.lit(None).cast("timestamp_ntz")
        own = part.select(F.lit(name).alias("var"), time.alias("time"), *[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in GRID.split(", ")[2:])])
        rows = own if rows is None else rows.unionByName(own)
    # a row a part
    told = F.broadcast(checked_geometry(rows, ref).withColumnRenamed("var", "of"))
    met = rows.join(told, F.col("var") == F.col("of"))
    shape = F.concat(F.lit("part "), "var", F.lit(" has "), "rows", F.lit(" rows and "), "cols", F.lit(" columns, not those of the reference"))
    box = F.concat(F.lit("part "), "var", F.lit(" lies elsewhere: "), *[x for b in BOX for x in (F.lit(f"{b} "), F.col(b), F.lit(" "))])
    bad = F.when(~F.col("same_size"), F.raise_error(shape).cast("double"))
    if raise_on_box:
        bad = bad.when(~F.col("same_box"), F.raise_error(box).cast("double"))
    cells = ref.select("row", "col", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    checked = met.withColumn("value", bad.otherwise(F.col("value")))
    return checked.join(small(cells, ref), ["row", "col"]).select("var", "time", "row", "col", F.col("ref_lat").alias("lat"), F.col("ref_lon").alias("lon"), "value", "same_box")
