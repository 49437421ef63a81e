"""Masks by a reference grid and by limits."""

from __future__ import annotations

import math
import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.model import NO_DATA, free, nothing

#: Cells of a reference grid up to which it is sent to every executor.
BROADCAST_CELLS = 2_000_000


#: Counted rows of frames that serve several times.
_COUNTS: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def counted(df: DataFrame) -> int:
    """Rows of `df`, counted once for each frame."""
    if df not in _COUNTS:
        _COUNTS[df] = df.count()
    return _COUNTS[df]


def small(df: DataFrame, of: DataFrame | None = None, each: int = 1) -> DataFrame:
    """Broadcast a frame whose rows are few; else Spark's shuffled join stands.

    of: a frame, counted perhaps before, each of whose rows gives at most `each` rows of `df`.
    """
    return F.broadcast(df) if counted(df if of is None else of) * each <= BROADCAST_CELLS else df


def every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of `left` with all rows of `right`: the smaller side is broadcast if it is small.

    Beyond that both sides are dealt: each row of `right` has one of as many blocks as its rows
    need, and each row of `left` visits them all, so no task holds a whole side.
    """
    a, b = counted(left), counted(right)
    block = free("pair_block", left, right)
    if min(a, b) <= BROADCAST_CELLS:
        one = F.lit(1)
        x, y = left.withColumn(block, one), right.withColumn(block, one)
        return (F.broadcast(x).join(y, block) if a < b else x.join(F.broadcast(y), block)).drop(block)
    blocks = -(-b // BROADCAST_CELLS)
    x = left.withColumn(block, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return x.join(right.withColumn(block, F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int")), block).drop(block)


def as_format(value: Column, name: str | None, no_data: float | None) -> Column:
    """A value in the format `integer` (cut towards zero; NaN and NULL have none and stay NULL) or `float`; others raise."""
    if name not in (None, "integer", "float"):
        raise ValueError(f"no mask format: {name!r}")
    if name != "integer":
        return value
    if no_data is not None and math.isnan(no_data):
        raise ValueError("integers have no NaN")
    return F.when(~nothing(value), value.cast("long").cast("double"))


def hits(ref: DataFrame, ref_value: float = NO_DATA, mode: str = "lazy") -> Column:
    """Whether a cell of `ref` is masked (never NULL), as a column of `ref`.

    A NaN ref_value means cells without terrain (NaN or NULL).  If the value occurs nowhere,
    mode lazy masks those cells too, and strict raises.
    """
    if mode not in ("lazy", "strict"):
        raise ValueError(f"no mask mode: {mode!r}")
    empty = nothing(F.col("ref_value"))
    hit = empty if math.isnan(ref_value) else F.col("ref_value") == ref_value
    if not math.isnan(ref_value):
        # one job tells whether the value occurs and how many cells there are
        seen = ref.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).first()
        _COUNTS[ref] = seen["n"]
        if not seen["hits"]:
            if mode == "strict":
                raise ValueError(f"{ref_value} does not occur in the reference grid")
            hit = empty
    return F.coalesce(hit, F.lit(False))


def blanked(masked: Column, no_data: float | None, form: str | None) -> Column:
    """The column value: `no_data` where masked, else in its format."""
    return F.when(masked, F.lit(no_data).cast("double")).otherwise(as_format(F.col("value"), form, no_data))


def mask_by_ref(grid: DataFrame, ref: DataFrame, ref_value: float = NO_DATA, no_data: float | None = NO_DATA, mode: str = "lazy", form: str | None = "float") -> DataFrame:
    """Values become `no_data` where ref_value stands in `ref`; cells outside `ref` keep their value.

    ref_value and mode: see `hits`; form: see `as_format`.
    """
    hit = hits(ref, ref_value, mode)
    at_row, at_col, masked = (free(n, grid) for n in ("ref_row", "ref_col", "masked"))
    mask = ref.select(F.col("row").alias(at_row), F.col("col").alias(at_col), hit.alias(masked))
    joined = grid.join(small(mask, ref), (F.col("row") == F.col(at_row)) & (F.col("col") == F.col(at_col)), "left")
    return joined.withColumn("value", blanked(F.col(masked), no_data, form)).select(*grid.columns)


def mask_by_limits(grid: DataFrame, least: float | None = None, most: float | None = None, no_data: float | None = NO_DATA, form: str | None = None) -> DataFrame:
    """Values outside least..most, NaN and NULL become `no_data`.  form: see `as_format`."""
    value = F.col("value")
    good = ~nothing(value)
    if least is not None:
        good &= value >= least
    if most is not None:
        good &= value <= most
    return grid.withColumn("value", as_format(F.when(good, value).otherwise(F.lit(no_data).cast("double")), form, no_data))
