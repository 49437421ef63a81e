"""Station time series: keep-last, registry joins, as-of selection, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.model import free
from hydroloom.operators.masks import every_pair


def keep_last(series: DataFrame, keys: Sequence[str], order: Column | str, value: str = "value") -> DataFrame:
    """One row a key: the value of the row that comes last in `order`; null keys in time are dropped by the caller."""
    return series.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def ordered_tags(frame: DataFrame, tag: str = "tag", order: str = "pos") -> DataFrame:
    """Distinct tags with the first place at which each stands."""
    return frame.groupBy(tag).agg(F.min(order).alias(order))


def missing_tags(target: DataFrame, known: DataFrame, tag: str = "tag", order: str = "pos") -> DataFrame:
    """Tags of `target` that `known` has not, with their first place."""
    return ordered_tags(target, tag, order).join(known.select(tag).distinct(), tag, "left_anti")


def join_registry(data: DataFrame, registry: DataFrame, database: DataFrame, line: str = "line") -> DataFrame:
    """Text series rows (time, pos, value, line) with the tags and attributes of their sections.

    Rows without a time go; of equal times the last line stays.  Positions become the
    registry's tags (pos, tag) only if both count the same columns; else names `sec_<pos>`
    stay, which the database (tag, ...) does not know.  Only tags in the database are kept;
    tags that it has twice give two rows, and their order is that of the registry.
    """
    last = keep_last(data.filter(F.col("time").isNotNull()), ["time", "pos"], line)
    columns = data.select(F.count_distinct("pos").alias("n"))
    sections = registry.select(F.count("*").alias("m"))
    fits = columns.join(F.broadcast(sections)).select((F.col("n") == F.col("m")).alias("fits"))
    named = registry.select("pos", F.col("tag").alias("registry_tag"))
    tagged = last.join(named, "pos", "left").join(F.broadcast(fits)).withColumn("tag", F.when(F.col("fits"), F.col("registry_tag")).otherwise(F.concat(F.lit("sec_"), F.col("pos"))))
    return tagged.drop("registry_tag", "fits").join(database, "tag")


def as_of(probes: DataFrame, data: DataFrame, keys: Sequence[str], tolerance_s: int, at: str = "probe_time", time: str = "time", value: str = "value", nearest: bool = False) -> DataFrame:
    """`probes` with the value (and its time, `found_time`) at or before each probe, within the tolerance (inclusive).

    With `nearest` the closest on either side counts, the earlier one of two as close.  Of data
    rows at the same time the greatest value counts.  A probe that stands several times is
    asked once and comes back as often.  Time is cut into buckets as wide as the tolerance;
    data stand in the buckets from which they may be found, so probes meet them by an equi-join
    on key and bucket, however many rows a key has.  Tolerance 0 asks for equal times; the
    names `found_time` and `value` are lengthened by `_` where probes have them.
    """
    if tolerance_s < 0:
        raise ValueError("the tolerance is less than nothing")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = tolerance_s * 1_000_000
    reach = [0, 1] if not nearest else [-1, 0, 1]
    names = ("asof_t", "asof_bucket", "asof_time", "asof_value", "asof_p", "asof_own", "asof_times", "asof_best")
    t, bucket, found_time, found, p, own, many, best = (free(n, probes, data) for n in names)
    k_of = {k: free(f"asof_{k}", probes, data) for k in keys}
    rows = data.select(*[F.col(k).alias(n) for k, n in k_of.items()], F.col(time).alias(found_time), F.col(value).alias(found), seconds(time).alias(t))
    span = max(width, 1)
    rows = rows.withColumn(bucket, F.explode(F.array(*[F.floor(F.col(t) / span) + d for d in reach])))
    asked = probes.groupBy(*probes.columns).agg(F.count("*").alias(many)).withColumn(p, seconds(at)).withColumn(own, F.floor(F.col(p) / span))
    near = (F.abs(F.col(p) - F.col(t)) <= width) if nearest else ((F.col(t) <= F.col(p)) & (F.col(p) - F.col(t) <= width))
    same = F.col(bucket) == F.col(own)
    for k, n in k_of.items():
        same &= F.col(n) == F.col(k)
    met = asked.join(rows, same & near, "left")
    order = F.struct(F.negative(F.abs(F.col(p) - F.col(t))), F.negative(F.col(t)), F.col(found))
    chosen = met.groupBy(*probes.columns, many).agg(F.max_by(F.struct(F.col(found_time).alias("time"), F.col(found).alias("value")), order).alias(best))
    again = chosen.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many))))
    return again.select(*probes.columns, F.col(best)["time"].alias(free("found_time", probes)), F.col(best)["value"].alias(free(value, probes)))


def align(series: DataFrame, sections: DataFrame, tag: str = "tag") -> DataFrame:
    """A row for every section at every time that any section has; NULL where it has none."""
    every = every_pair(series.select("time").distinct(), sections.select(tag).distinct())
    return every.join(series.select("time", tag, "value"), ["time", tag], "left")


def concat_columns(frames: Sequence[DataFrame], on: str = "time") -> DataFrame:
    """Frames side by side on their union of times."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, on, "full")
    return out


def valid_for_table(value: Column) -> Column:
    """The table's rule: neither -9998 nor -9999 nor negative."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0)


def valid_for_chart(value: Column) -> Column:
    """The chart's rule: above -9990."""
    return value.isNotNull() & ~F.isnan(value) & (value > -9990)
