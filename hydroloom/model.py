"""Data model: fields in long form.

A grid is rows (var, time, row, col, lat, lon, value); row 0 is north.  Cells join on (row, col),
never on floating coordinates.  No-data is NULL inside; NaN and sentinels stand at sources and
sinks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = "var string, time timestamp_ntz, row int, col int, lat double, lon double, value double"
REF = "row int, col int, lat double, lon double, ref_value double"
SERIES = "time timestamp_ntz, pos int, tag string, value double"
CELL = ["row", "col"]
STEP = ["time", "row", "col"]
#: Fixed value: the sentinel of terrain, variables and masks.
NO_DATA = -9999.0


def nothing(value: Column) -> Column:
    """NULL or NaN."""
    return value.isNull() | F.isnan(value)


def free(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until no column of the frames has it in any case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def from_sentinel(value: Column, no_data: float = NO_DATA, tolerance: float = 0.0) -> Column:
    """NULL for NaN and for the sentinel."""
    return F.when(nothing(value) | (F.abs(value - no_data) <= tolerance), None).otherwise(value)


def to_sentinel(value: Column, no_data: float = NO_DATA) -> Column:
    return F.when(nothing(value), no_data).otherwise(value)
