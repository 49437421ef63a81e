"""Names, order, orientation, types and colour ranges of fields."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroloom.model import NO_DATA, nothing
from hydroloom.operators.masks import small
from hydroloom.shared import written


def rename_or_drop(grid: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Variables named by a key get its value, those named by a value its key; others are dropped."""
    new = F.lit(None).cast("string")
    for key, value in reversed(list(names.items())):
        new = F.when(F.col("var") == value, key).otherwise(new)
    for key, value in reversed(list(names.items())):
        new = F.when(F.col("var") == key, value).otherwise(new)
    return grid.withColumn("var", new).filter(F.col("var").isNotNull())


def select_vars(grid: DataFrame, names: Sequence[str]) -> DataFrame:
    return grid.filter(F.col("var").isin(*names))


def rename_by_tag(name: Column, names: Mapping[str, str], sep: str = ":") -> Column:
    """The new name for what follows the last separator of a tag; unknown names stay."""
    tag = F.element_at(F.split(name, sep), -1)
    out = tag
    for key, value in names.items():
        out = F.when(tag == key, value).otherwise(out)
    return out


def rename_by_template(name: Column, names: Mapping[str, str], sep: str = ":", use_value: bool = False, case_sensitive: bool = True, allow_tagless: bool = True) -> Column:
    """A name whose part after the last separator is a key of `names` becomes that key, or with `use_value` the key's value.

    Others stay, and so do names without a separator unless `allow_tagless`.  Without
    `case_sensitive` letters' case does not matter; of keys then alike the last counts.
    """
    norm = (lambda x: x) if case_sensitive else str.lower
    tag = F.element_at(F.split(name, re.escape(sep)), -1)
    tag = tag if case_sensitive else F.lower(tag)
    found = {norm(key): (value if use_value else key) for key, value in names.items()}
    out = name
    for key, new in found.items():
        out = F.when(tag == key, new).otherwise(out)
    return out if allow_tagless else F.when(F.contains(name, F.lit(sep)), out).otherwise(name)


def name_by_mapping(name: Column, mapping: str | None, use: str = "value", sep: str = ":") -> Column:
    """The name that a mapping `key:value` gives a variable: its value, its key, or (auto) the value, else the key.

    A variable with another name does not match and gives NULL; one without a name takes the
    mapping's, and stays without if the mapping has none.  Without a mapping names stay.
    """
    if use not in ("value", "key", "auto"):
        raise ValueError(f"no use of a mapping: {use!r}")
    if mapping is None:
        return name
    key, _, value = (part.strip() for part in mapping.partition(sep))
    wanted = [x for x in {"value": (value,), "key": (key,), "auto": (value, key)}[use] if x]
    out = F.lit(None).cast("string")
    for x in reversed(wanted):
        out = F.when(name.isNull() | (name == x), x).otherwise(out)
    return out


def select_by_mapping(grid: DataFrame, mapping: str | None, use: str = "value") -> DataFrame:
    """The rows whose variable fits the mapping, under its name (see `name_by_mapping`)."""
    named = grid.withColumn("var", name_by_mapping(F.col("var"), mapping, use))
    return named if mapping is None else named.filter(F.col("var").isNotNull())


def flat_axes(grid: DataFrame) -> DataFrame:
    """(row, col, lat, lon) with one latitude a row and one longitude a column, as regular fields have; others raise.

    Sums by row and by column only; NULL coordinates raise too.
    """
    lat = grid.groupBy("row").agg(F.min("lat").alias("lat"), ((F.min("lat") != F.max("lat")) | (F.count("lat") < F.count("*"))).alias("bad"))
    lon = grid.groupBy("col").agg(F.min("lon").alias("lon"), ((F.min("lon") != F.max("lon")) | (F.count("lon") < F.count("*"))).alias("bad"))
    sure = lambda c: F.when(F.coalesce("bad", F.lit(True)), F.raise_error(F.lit("coordinates vary along both axes")).cast("double")).otherwise(F.col(c)).alias(c)
    cells = grid.select("row", "col").distinct()
    rows, cols = lat.select("row", sure("lat")), lon.select("col", sure("lon"))
    return cells.join(small(rows), "row").join(small(cols), "col").select("row", "col", "lat", "lon")


def priority_order(frame: DataFrame, first: Sequence[str], name: str = "var") -> DataFrame:
    """`frame` with `place`: listed names first in the list's order, the others by name (one task: a row a name)."""
    listed = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(name))
    return frame.withColumn("place", F.row_number().over(Window.orderBy(F.when(listed > 0, listed).otherwise(len(first) + 1), name)))


def wrap_longitude(grid: DataFrame) -> DataFrame:
    """0..360 becomes -180..180 if the field says so (largest over 180, none negative, span of 180 or more)."""
    box = grid.agg(F.max("lon").alias("most"), F.min("lon").alias("least"))
    wraps = F.broadcast(box.select(((F.col("most") > 180) & (F.col("least") >= 0) & (F.col("most") - F.col("least") >= 180)).alias("wraps")))
    return grid.join(wraps).withColumn("lon", F.when(F.col("wraps"), F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).otherwise(F.col("lon"))).drop("wraps")


def orient(grid: DataFrame) -> DataFrame:
    """Rows from north to south and columns from west to east, numbered by the distinct coordinates (an axis is sorted in one task)."""
    rows = grid.select("lat").distinct().select("lat", (F.row_number().over(Window.orderBy(F.desc("lat"))) - 1).cast("int").alias("row"))
    cols = grid.select("lon").distinct().select("lon", (F.row_number().over(Window.orderBy("lon")) - 1).cast("int").alias("col"))
    return grid.drop("row", "col").join(small(rows), "lat").join(small(cols), "lon").select(*grid.columns)


def flip_rows(grid: DataFrame, rows: int) -> DataFrame:
    """The other vertical orientation."""
    return grid.withColumn("row", F.lit(rows - 1) - F.col("row"))


def reset_no_data(value: Column, old: float, new: float | None, tolerance: float = 0.0) -> Column:
    return F.when(nothing(value) | (F.abs(value - old) <= tolerance), F.lit(new).cast("double")).otherwise(value)


def narrow_types(grid: DataFrame) -> DataFrame:
    """(var, least, most, kind): the smallest type that holds each variable's values."""
    whole = F.min(F.when(~nothing(F.col("value")), F.col("value") == F.floor("value")))
    box = grid.groupBy("var").agg(F.min("value").alias("least"), F.max("value").alias("most"), whole.alias("whole"))
    kind = F.when(~F.col("whole"), F.when((F.col("least") > -(2**31)) & (F.col("most") < 2**31), "float32").otherwise("float64"))
    for name, low, high in (("uint8", 0, 255), ("uint16", 0, 65535), ("uint32", 0, 2**32 - 1), ("int8", -128, 127), ("int16", -(2**15), 2**15 - 1), ("int32", -(2**31), 2**31 - 1)):
        kind = kind.when((F.col("least") >= low) & (F.col("most") <= high), name)
    return box.select("var", "least", "most", kind.otherwise("int64").alias("kind"))


#: Spark's smallest type for each kind; unsigned numbers go to the next signed one.
SPARK_KINDS = {"float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint"}


def cast_narrow(grid: DataFrame) -> DataFrame:
    """Rows one column a variable (time, row, col, lat, lon, then the variables by name), each in the smallest type that holds it.

    A variable without a value is a float.  Of a cell given twice the larger value stands.
    """
    grid = grid.withColumn("value", F.when(~nothing(F.col("value")), F.col("value")))
    # a row a variable comes to the driver, since column types are part of the plan
    kinds = {r["var"]: SPARK_KINDS[r["kind"]] if r["least"] is not None else "float" for r in narrow_types(grid).collect()}
    wide = grid.groupBy("time", "row", "col", "lat", "lon").pivot("var", sorted(kinds)).agg(F.max("value")) if kinds else grid.select("time", "row", "col", "lat", "lon").limit(0)
    return wide.select("time", "row", "col", "lat", "lon", *[F.col(f"`{v}`").cast(kinds[v]).alias(v) for v in sorted(kinds)])


def exact_percentiles(grid: DataFrame, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(var, ends, least, most): each variable's interpolated percentiles, none for a variable without values.

    Two passes: a sketch of bounded size gives values between which a percentile lies; then the
    rows below are counted, and only the counts of the distinct values between (some 4 in
    `accuracy` of the rows, if they all differ) are put in order.  The values are written once,
    so that no pass makes them again.
    """
    values = written(grid.filter(~nothing(F.col("value"))).select(F.col("var").alias("of"), F.col("value").alias("v")), "values")
    wide = 2 / accuracy
    marks = [x for s in shares for x in (max(0.0, s - wide), min(1.0, s + wide))]
    first = values.groupBy("of").agg(F.percentile_approx("v", marks, accuracy).alias("marks"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))
    # a row a variable
    first = F.broadcast(written(first.select(F.col("of").alias("name"), "marks", "least", "most", "n"), "marks"))
    met = values.join(first, F.col("of") == F.col("name"))
    low, high = (lambda i: F.col("marks")[2 * i]), (lambda i: F.col("marks")[2 * i + 1])
    around = [x for i in range(len(shares)) for x in (F.count_if(F.col("v") < low(i)).alias(f"below{i}"), F.max(F.when(F.col("v") < low(i), F.col("v"))).alias(f"before{i}"), F.min(F.when(F.col("v") > high(i), F.col("v"))).alias(f"after{i}"))]
    sides = written(met.groupBy("of", "least", "most", "n").agg(*around), "sides")
    inside = F.filter(F.array(*[F.when(F.col("v").between(low(i), high(i)), F.lit(i)) for i in range(len(shares))]), lambda x: x.isNotNull())
    counts = met.select("of", "v", F.explode(inside).alias("i")).groupBy("of", "i", "v").agg(F.count("*").alias("held"))
    until = counts.withColumn("until", F.sum("held").over(Window.partitionBy("of", "i").orderBy("v")))
    ranked = until.join(F.broadcast(sides), "of")
    below = F.coalesce(*[F.when(F.col("i") == i, F.col(f"below{i}")) for i in range(len(shares))])
    at = F.coalesce(*[F.when(F.col("i") == i, F.lit(float(s))) for i, s in enumerate(shares)]) * (F.col("n") - 1)
    picks = []
    for name, rank in (("lower", F.floor(at)), ("upper", F.ceil(at))):
        picks.append(F.min(F.when(F.col("below") + F.col("until") > rank, F.col("v"))).alias(name))
    ranked = ranked.withColumn("below", below).withColumn("at", at)
    sums = ranked.groupBy("of", "i", "at", "below").agg(*picks)
    ends = sums.join(F.broadcast(sides.drop("n", "least", "most")), "of")
    side = lambda kind: F.coalesce(*[F.when(F.col("i") == i, F.col(f"{kind}{i}")) for i in range(len(shares))])
    low_value = F.when(F.floor("at") < F.col("below"), side("before")).otherwise(F.coalesce("lower", side("after")))
    high_value = F.when(F.ceil("at") < F.col("below"), side("before")).otherwise(F.coalesce("upper", side("after")))
    end = low_value + (high_value - low_value) * (F.col("at") - F.floor("at"))
    listed = ends.select("of", "i", end.alias("end")).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("i", "end"))).alias("ends"))
    return listed.join(sides.select("of", "least", "most"), "of").select(F.col("of").alias("var"), F.col("ends.end").alias("ends"), "least", "most")


def percentile_stretch(grid: DataFrame, low: float = 0.02, high: float = 0.98, accuracy: int | None = None) -> DataFrame:
    """Values clipped to each variable's percentiles and scaled to 0..1; a variable of one value uses its ends.

    Percentiles are exact and interpolated (see `exact_percentiles`); with `accuracy` Spark's
    sketch is used alone.  The field is written once and read for the percentiles and for the
    result.
    """
    grid = written(grid, "field")
    if accuracy is None:
        box = exact_percentiles(grid, (low, high)).withColumnRenamed("var", "of")
    else:
        value = F.when(~nothing(F.col("value")), F.col("value"))
        box = grid.groupBy(F.col("var").alias("of")).agg(F.percentile_approx(value, [low, high], accuracy).alias("ends"), F.min(value).alias("least"), F.max(value).alias("most"))
    flat = F.col("ends")[0] >= F.col("ends")[1]
    box = box.select("of", F.when(flat, F.col("least")).otherwise(F.col("ends")[0]).alias("vmin"), F.when(flat, F.col("most")).otherwise(F.col("ends")[1]).alias("vmax"))
    clipped = F.when(~nothing(F.col("value")), F.least(F.greatest("value", "vmin"), F.col("vmax")))
    return grid.join(F.broadcast(box), F.col("var") == F.col("of"), "left").withColumn("stretched", F.try_divide(clipped - F.col("vmin"), F.col("vmax") - F.col("vmin"))).drop("of")


def river_cells(ref: DataFrame, mark: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """Cells that hold the mark, as centre points."""
    return ref.filter(F.abs(F.col("ref_value") - mark) <= tolerance).select("row", "col", F.col("lon").alias("x"), F.col("lat").alias("y"))


def geojson_point(x: Column, y: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry")))


#: Ends of the terrain ramp's segments and their colours.
TERRAIN = ((0.0, 0, 97, 71), (0.25, 16, 122, 47), (0.5, 232, 215, 125), (0.75, 161, 67, 0), (1.0, 255, 255, 255))


def terrain_ramp(ref: DataFrame, stops: Sequence[tuple[float, int, int, int]] = TERRAIN) -> DataFrame:
    """(row, col, r, g, b): heights scaled to 0..1 over the grid, colours linear between the stops; no-data has no row."""
    land = ref.filter(~nothing(F.col("ref_value")) & (F.col("ref_value") != NO_DATA))
    box = F.broadcast(land.agg(F.min("ref_value").alias("least"), F.max("ref_value").alias("most")))
    share = F.coalesce(F.try_divide(F.col("ref_value") - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0))
    scaled = land.join(box).withColumn("share", share)

    def colour(i: int) -> Column:
        out = F.lit(float(stops[-1][i]))
        for (a, *low), (b, *high) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(F.col("share") <= b, low[i - 1] + (F.col("share") - a) / (b - a) * (high[i - 1] - low[i - 1])).otherwise(out)
        return F.floor(out + 0.5).cast("int")

    return scaled.select("row", "col", colour(1).alias("r"), colour(2).alias("g"), colour(3).alias("b"))
