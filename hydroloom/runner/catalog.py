"""The runs and maps there are, from listings of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.functions.times import floor_to, shift, time_from_name


def latest_runs(runs: DataFrame, by: str = "basin", time: str = "run", last: str | None = None) -> DataFrame:
    """(by, time) of the last run of each basin; with `last` also that column's value of the run's last row (ties: the greatest)."""
    extra = [F.max_by(last, F.struct(time, last)).alias(last)] if last else []
    return runs.groupBy(by).agg(F.max(time).alias(time), *extra)


def nearest_runs(runs: DataFrame, at: Column, by: str = "basin", time: str = "run") -> DataFrame:
    """(by, time) of the run nearest to a time, without a tolerance; the earlier of two as near."""
    apart = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(at.cast("timestamp")))
    return runs.groupBy(by).agg(F.min_by(time, F.struct(apart, time)).alias(time))


def recent_runs(paths: DataFrame, now: Column, days: int = 1, digits: int = 12, by: str = "basin") -> DataFrame:
    """(by, run) of the hourly runs of the last `days` times 24 hours that a listing (by, path) has, each once."""
    last = floor_to(now, "h")
    run = floor_to(time_from_name(F.col("path"), digits), "h")
    found = paths.select(by, run.alias("run"))
    return found.filter((F.col("run") <= last) & (F.col("run") > shift(last, -24 * days, "h"))).distinct()


def maps_runs(paths: DataFrame, start: Column, now: Column, digits: int = 12) -> DataFrame:
    """(time, place) of the maps from start to now that a listing (path) has, each time once; place 1 is the latest.

    A row a time: times stand in order in one task.
    """
    from pyspark.sql import Window

    times = paths.select(time_from_name(F.col("path"), digits).alias("time")).filter((F.col("time") >= start) & (F.col("time") <= now)).distinct()
    return times.withColumn("place", F.row_number().over(Window.orderBy(F.desc("time"))))
