"""Regridding by a table of neighbour weights, overlays of tiles, resampling of points, point samples.

Neighbours: cells become points on a sphere and are put into cubes as wide as the search radius;
each source stands in the 27 cubes around it, so a target meets all sources within the radius
by an equi-join on its own cube.  Geometry is joined once and serves all variables and times.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hydroloom.model import NO_DATA, nothing
from hydroloom.operators import masks
from hydroloom.operators.masks import counted, every_pair, mask_by_ref, small
from hydroloom.shared import written

#: Fixed value: radius of the sphere in m; distances are chords, the search radius is exclusive.
EARTH = 6_370_997.0
SIGMA = 250_000.0
#: Squared distance in m² below which a point is at a cell's centre.
HIT = 1e-6
#: Rows and columns of sources that make a region, and weights a task of a field that is dealt by region.
BLOCK = 4
WEIGHTS = 20_000
#: Targets of a task that makes them points of the sphere.
POINTS = 50_000


#: Edge in m of the cubes whose cells count as one spot until their distances are computed exactly.
SPOT = 1e-3
#: Targets up to which their cells and nearest sources are sent to every executor (about 35 MB each in every task).
BROADCAST_TARGETS = 200_000


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in "xyz"]))
def _xyz(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
    """Points of the sphere, by the C library's functions.

    Java's and the C library's sines differ in the last bit now and then, which decides between
    cells that lie a whole turn from each other.
    """
    of = lambda f, angle: np.fromiter((f(a) if math.isfinite(a) else math.nan for a in (angle.to_numpy("double") * (math.pi / 180)).tolist()), "double", len(angle))
    across = of(math.cos, lat)
    return pd.DataFrame({"x": across * of(math.cos, lon) * EARTH, "y": across * of(math.sin, lon) * EARTH, "z": of(math.sin, lat) * EARTH})


#: Else Spark would ask for points that aren't NULL below the `distinct` of the cells, in each row of a field.
_xyz = _xyz.asNondeterministic()


@F.pandas_udf(DoubleType())
def _squared(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """x ** 2 + y ** 2 + z ** 2, by the C library's power."""
    a, b, c = (np.fromiter(map(math.pow, d.tolist(), repeat(2.0)), "double", len(d)) for d in (x, y, z))
    return pd.Series(a + b + c)


def neighbours(sources: DataFrame, targets: DataFrame, radius: float = 18_000.0, most: int = 8) -> DataFrame:
    """(src_row, src_col, row, col, dist, rank): for each target cell its nearest sources.

    Rank 1 is the nearest; ties go by source row and column.  Targets without a source within
    the radius have no row.

    Cells of one place to a millimetre (those a whole turn apart, say) are one spot.  Spots find
    the spots that may hold their nearest sources, and only the cells of these meet, so what
    is within the radius but not among the nearest is not multiplied by the cells of a place.
    """
    return neighbours_within(sources, targets, (radius,), most)[radius]


def neighbours_within(sources: DataFrame, targets: DataFrame, radii: Sequence[float], most: int = 8) -> dict[float, DataFrame]:
    """`neighbours` by radius, found once, within the largest."""
    radius = max(radii)
    a, b, p, q, cube = ([f"{n}{i}" for i in range(3)] for n in ("s", "t", "p", "q", "cube"))
    there = lambda names: [F.col(f"at.{m}").alias(n) for m, n in zip("xyz", names, strict=True)]
    spots = lambda names, at: [F.floor(F.col(n) / SPOT).alias(m) for n, m in zip(at, names, strict=True)]
    src = sources.select("row", "col", _xyz("lat", "lon").alias("at")).select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), *there(a)).dropna(subset=a).select("*", *spots(p, a))
    # a file of few bytes may hold many targets
    tgt = targets.select("row", "col", "lat", "lon").repartition(-(-counted(targets) // POINTS) or 1, "row", "col").select("row", "col", _xyz("lat", "lon").alias("at")).select("row", "col", *there(b)).dropna(subset=b).select("*", *spots(q, b))
    # a spot's cells are within 0.87 SPOT of its centre, so distances of cells and of their spots differ by less than 2 SPOT
    width = radius + 2 * SPOT
    centre = lambda n: (F.col(n) + 0.5) * SPOT
    around = F.array(*[F.array(*[F.lit(d // 3**i % 3 - 1) for i in range(3)]) for d in range(27)])
    held = src.groupBy(*p).agg(F.count("*").alias("n")).withColumn("step", F.explode(around))
    held = held.select(*p, "n", *[(F.floor(centre(n) / width) + F.col("step")[i]).alias(cube[i]) for i, n in enumerate(p)])
    asked = tgt.select(*q).distinct().select("*", *[F.floor(centre(n) / width).alias(cube[i]) for i, n in enumerate(q)])
    apart = [centre(m) - centre(n) for m, n in zip(p, q, strict=True)]
    met = held.hint("merge").join(asked, cube).withColumn("apart", F.sqrt(sum((d * d for d in apart), F.lit(0.0)))).filter(F.col("apart") < width)
    spot = Window.partitionBy(*q)
    nearer = F.coalesce(F.sum("n").over(spot.orderBy("apart").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.withColumn("nearer", nearer).withColumn("last", F.max(F.when(F.col("nearer") < most, F.col("apart"))).over(spot))
    near = met.filter(F.col("apart") <= F.col("last") + 4 * SPOT).select(*p, *q).join(src, p).select(*q, "src_row", "src_col", *a)
    # cells of a spot meet many times, so tasks follow the weights to be made
    tasks = _tasks(targets, most)
    between = [F.col(m) - F.col(n) for m, n in zip(a, b, strict=True)]
    pairs = near.repartition(tasks, *q).join(tgt.repartition(tasks, *q), q)
    pairs = pairs.select("src_row", "src_col", "row", "col", _squared(*between).alias("d2")).filter(F.col("d2") < radius * radius)
    nearest = Window.partitionBy("row", "col").orderBy("d2", "src_row", "src_col")
    ranked = pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= most)
    return {r: ranked.filter(F.col("d2") < r * r).select("src_row", "src_col", "row", "col", F.sqrt("d2").alias("dist"), "rank") for r in radii}


def _tasks(targets: DataFrame, most: int) -> int:
    """Tasks for the weights of `targets`, not below the session's shuffle partitions."""
    return max(-(-counted(targets) * most // WEIGHTS), int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _met_by_region(values: DataFrame, table: DataFrame, tasks: int) -> DataFrame:
    """`values` with the weights of their cells, dealt by `region`, so that all sources of a target meet in one task.

    A target's region is the block around its nearest source; values visit the regions whose
    targets they serve.  Sums by target and region need no shuffle after it.
    """
    first = lambda c: F.floor(F.min_by(c, "rank").over(Window.partitionBy("row", "col")) / BLOCK)
    table = written(table.withColumn("region", F.xxhash64(first("src_row"), first("src_col"))), "weights")
    served = table.select("src_row", "src_col", "region").distinct()
    values = values.join(small(served), ["src_row", "src_col"])
    # else the join would deal both sides again by all of its columns
    table.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return values.repartition(tasks, "region").join(table.repartition(tasks, "region"), ["region", "src_row", "src_col"])


def interpolate(grid: DataFrame, ref: DataFrame, method: str = "nn", radius: float = 18_000.0, most: int = 8, table: DataFrame | None = None, cells: DataFrame | None = None, more: Mapping[str, Column] | None = None) -> DataFrame:
    """`grid` on the cells of `ref`: nearest value, or means weighted by 1/d² (idw) or exp(-d²/σ²) (gauss).

    Cells without a source within the radius, and with idw or gauss cells all of whose sources
    are NULL, have no row (see `complete`).  A source at distance 0 decides alone in idw.
    table: neighbours found before; cells: the source cells (row, col, lat, lon), if known, so
    that the field is not read for them.  more: further columns, by name, made of those of `ref`.

    The weights go to the field with the targets' coordinates in them, and only sums by target
    and time are shuffled; weights that are too many for it are dealt with the field by source
    (nn) or by region, and then nothing is shuffled on the finer grid.
    """
    if method not in ("nn", "idw", "gauss"):
        raise ValueError(method)
    if table is None:
        cells = grid.select("row", "col", "lat", "lon").distinct() if cells is None else cells
        table = neighbours(cells, ref, radius, 1 if method == "nn" else most)
    if method == "nn":
        table = table.filter("rank = 1")
    own = ["lat", "lon", *(more or {})]
    geometry = ref.select("row", "col", "lat", "lon", *[c.alias(n) for n, c in (more or {}).items()])
    if method == "nn":
        few = counted(ref) <= min(BROADCAST_TARGETS, masks.BROADCAST_CELLS)
        table = table.join(F.broadcast(geometry) if few else geometry, ["row", "col"])
    else:
        # a reference cell has at most `most` weights
        few = counted(ref) * most <= masks.BROADCAST_CELLS
        table = table.join(small(geometry, ref), ["row", "col"])
    values = grid.select("var", "time", F.col("row").alias("src_row"), F.col("col").alias("src_col"), "value")
    place = []
    if few:
        met = values.join(F.broadcast(table), ["src_row", "src_col"])
    elif method == "nn":
        tasks = _tasks(ref, 1)
        met = values.repartition(tasks, "src_row", "src_col").join(table.repartition(tasks, "src_row", "src_col"), ["src_row", "src_col"])
    else:
        place = ["region"]
        met = _met_by_region(values.filter(~nothing(F.col("value"))), table, _tasks(ref, most))
    if method == "nn":
        out = met
    else:
        d2 = F.col("dist") * F.col("dist")
        weight = F.when(d2 > 0, 1 / d2) if method == "idw" else F.exp(-d2 / (SIGMA * SIGMA))
        sums = met.filter(~nothing(F.col("value"))).groupBy(*place, "var", "time", "row", "col", *own).agg(F.max(F.when(d2 == 0, F.col("value"))).alias("hit"), F.sum(weight * F.col("value")).alias("wv"), F.sum(weight).alias("w"))
        mean = F.try_divide("wv", "w")
        out = sums.withColumn("value", F.coalesce("hit", mean) if method == "idw" else mean)
    return out.select("var", "time", "row", "col", *own, "value")


def interpolate_masked(grid: DataFrame, ref: DataFrame, method: str = "nn", radius: float = 18_000.0, most: int = 8, table: DataFrame | None = None, ref_value: float = NO_DATA, no_data: float | None = NO_DATA, mode: str = "lazy", form: str | None = "float") -> DataFrame:
    """`mask_by_ref` of `interpolate`: the mask goes along with the weights, so rows of the finer grid are joined no more."""
    out = interpolate(grid, ref, method, radius, most, table, more={"masked": masks.hits(ref, ref_value, mode)})
    return out.withColumn("value", masks.blanked(F.col("masked"), no_data, form)).drop("masked")


def complete(grid: DataFrame, ref: DataFrame, fill: float | None = None) -> DataFrame:
    """`grid` with a row for every cell of `ref` in each of its (var, time): the dense field, `fill` where there was none."""
    dense = every_pair(grid.select("var", "time").distinct(), ref.select("row", "col", "lat", "lon"))
    return dense.join(grid.drop("lat", "lon"), ["var", "time", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill).cast("double"))).select("var", "time", "row", "col", "lat", "lon", "value")


def merge_by_ref(sources: list[DataFrame], ref: DataFrame, method: str = "nn", radius: float = 18_000.0, most: int = 8, ref_no_data: float = NO_DATA, var_no_data: float | None = NO_DATA, table: DataFrame | None = None) -> DataFrame:
    """Tiles on the reference grid: each is regridded, and of several values the last source's counts; then the terrain's mask.

    table: neighbours found before, for tiles that share their cells; these are regridded together.
    """
    if table is not None and method == "nn":
        # each cell has one source, so the last value counts there already: nothing is shuffled on the finer grid
        told = reduce(DataFrame.unionByName, [s.filter(~nothing(F.col("value"))).withColumn("src", F.lit(i)) for i, s in enumerate(sources)])
        last = told.groupBy("var", "time", "row", "col").agg(F.max_by("value", "src").alias("value"))
        return interpolate_masked(last, ref, method, radius, most, table, ref_no_data, var_no_data)
    if table is not None:
        # the tile's number goes along in the variable's name
        mark = "\x1f"
        told = [s.withColumn("var", F.concat(F.lit(f"{i}{mark}"), "var")) for i, s in enumerate(sources)]
        whole = interpolate(reduce(DataFrame.unionByName, told), ref, method, radius, most, table).filter(~nothing(F.col("value")))
        every = whole.withColumn("src", F.substring_index("var", mark, 1).cast("int")).withColumn("var", F.expr(f"substring(var, locate('{mark}', var) + 1)"))
    else:
        placed = [interpolate(s, ref, method, radius, most).filter(~nothing(F.col("value"))).withColumn("src", F.lit(i)) for i, s in enumerate(sources)]
        every = reduce(DataFrame.unionByName, placed)
    last = every.groupBy("var", "time", "row", "col").agg(F.max_by("value", "src").alias("value"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    return mask_by_ref(last.select("var", "time", "row", "col", "lat", "lon", "value"), ref, ref_no_data, var_no_data)


def merge_by_time(steps: list[tuple[object, DataFrame]], ref: DataFrame | None = None, no_data: float = NO_DATA) -> DataFrame:
    """A cube of fields that share the reference geometry, each at its time; with `ref` its terrain, at no time.

    steps: (time, grid without or with a time column); NaN and NULL become `no_data`.
    """
    stack = [g.withColumn("time", F.lit(t).cast("timestamp_ntz") if t is not None else F.col("time")) for t, g in steps]
    cube = reduce(DataFrame.unionByName, stack).withColumn("value", F.when(nothing(F.col("value")), no_data).otherwise(F.col("value")))
    if ref is not None:
        terrain = ref.select(F.lit("terrain").alias("var"), F.lit(None).cast("timestamp_ntz").alias("time"), "row", "col", "lat", "lon", F.col("ref_value").alias("value"))
        cube = cube.unionByName(terrain.select(*cube.columns))
    return cube


def regular_grid(lat: tuple[float, float], lon: tuple[float, float], step: float, spark) -> DataFrame:
    """Cells of a box, row 0 in the north, centres on the edges given."""
    rows, cols = (int(round(abs(b - a) / step)) + 1 for a, b in (lat, lon))
    cells = spark.range(rows * cols)
    row, col = F.floor(F.col("id") / cols).cast("int"), (F.col("id") % cols).cast("int")
    return cells.select(row.alias("row"), col.alias("col"), (F.lit(max(lat)) - step * row).alias("lat"), (F.lit(min(lon)) + step * col).alias("lon"))


def resample_points(points: DataFrame, target: DataFrame, radius: float, least: int = 1, most: int = 8) -> DataFrame:
    """Points (point, lat, lon, value) on grid cells: mean weighted by 1/d² of at most `most` points, where at least `least` are within the radius.

    Points within a millimetre of the cell's centre (HIT) decide alone: the largest of them counts.
    """
    at = points.filter(~nothing(F.col("value"))).select(F.col("point").alias("row"), F.lit(0).alias("col"), "lat", "lon", "value")
    near = neighbours(at, target, radius, most).join(at.select(F.col("row").alias("src_row"), "value"), "src_row")
    d2 = F.col("dist") * F.col("dist")
    sums = near.groupBy("row", "col").agg(F.count("*").alias("n"), F.max(F.when(d2 < HIT, F.col("value"))).alias("hit"), F.sum(F.when(d2 >= HIT, F.col("value") / d2)).alias("wv"), F.sum(F.when(d2 >= HIT, 1 / d2)).alias("w"))
    return sums.filter(F.col("n") >= least).select("row", "col", "n", F.coalesce("hit", F.try_divide("wv", "w")).alias("value"))


def support_mask(cells: DataFrame, half: int = 1) -> DataFrame:
    """(row, col) of cells with support within a box of `half` cells: each supported cell serves its box."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1)])
    return cells.select(F.explode(steps).alias("d"), "row", "col").select((F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col")).distinct()


def resample_supported(points: DataFrame, target: DataFrame, radius: float, least: int = 1, most: int = 8, kernel: str = "box", half: int = 1) -> DataFrame:
    """`resample_points` with NULL where no point is near: support is where a resample within a fifth of the radius has a value that isn't 0.

    kernel: box spreads support over `half` cells to each side; gaussian (deviation `half`
    cells) over four times as many, beyond which its weights are left out.  Cells whose kernel
    has no support in it have none.
    """
    if kernel not in ("box", "gaussian"):
        raise ValueError(f"no kernel: {kernel!r}")
    near = resample_points(points, target, radius / 5, least, most).filter("value != 0")
    there = support_mask(near.select("row", "col"), half if kernel == "box" else 4 * half).withColumn("supported", F.lit(True))
    wide = resample_points(points, target, radius, least, most)
    return wide.join(there, ["row", "col"], "left").withColumn("value", F.when(F.col("supported"), F.col("value"))).drop("supported")


def warp(grid: DataFrame, step: float, spark) -> DataFrame:
    """`grid` at another resolution over the same box, by nearest cell; no rows of an empty field.

    The box is one row, read while the plan is made.
    """
    box = grid.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if box[0] is None:
        return interpolate(grid, regular_grid((0.0, 0.0), (0.0, 0.0), step, spark), "nn", radius=step * 111_195 * 1.5).limit(0)
    return interpolate(grid, regular_grid((box[0], box[1]), (box[2], box[3]), step, spark), "nn", radius=step * 111_195 * 1.5)


def sample_at(points: DataFrame, ref: DataFrame, west: float, north: float, step: float, rows: int, cols: int) -> DataFrame:
    """`points` (lat, lon) with the value of the cell they fall into; outside and no-data: NULL.

    west and north are the outer edges; the right and lower edge lie beyond the last cell.
    """
    row, col = F.floor((F.lit(north) - F.col("lat")) / step).cast("int"), F.floor((F.col("lon") - west) / step).cast("int")
    inside = row.between(0, rows - 1) & col.between(0, cols - 1)
    at = points.withColumn("row", F.when(inside, row)).withColumn("col", F.when(inside, col))
    cells = ref.select("row", "col", F.when(F.col("ref_value") != NO_DATA, F.col("ref_value")).alias("sampled"))
    return at.join(small(cells, ref), ["row", "col"], "left")


def sections_with_samples(database: DataFrame, fields: Mapping[str, DataFrame], west: float, north: float, step: float, rows: int, cols: int) -> DataFrame:
    """(id, lon, lat, basin, name) and a column for each field, of database rows whose ID, LON and LAT are numbers.

    A row without a name is called `Section` and its id; fields are named by the mapping's
    keys and sampled at the cell of the section.
    """
    name = F.coalesce(*[F.col(c) for c in ("SEC_NAME", "NAME") if c in database.columns], F.concat(F.lit("Section "), F.col("ID").cast("string")))
    basin = F.coalesce("BASIN", F.lit("")) if "BASIN" in database.columns else F.lit("")
    number = lambda c, kind: F.col(c).cast("string").try_cast(kind).alias(c.lower())
    out = database.select(number("ID", "int"), number("LON", "double"), number("LAT", "double"), basin.alias("basin"), name.alias("name")).dropna(subset=["id", "lon", "lat"])
    for field, ref in fields.items():
        out = sample_at(out, ref, west, north, step, rows, cols).drop("row", "col").withColumnRenamed("sampled", field)
    return out


def snap_to_ref(grid: DataFrame, ref: DataFrame) -> DataFrame:
    """`grid` with the coordinates of `ref`'s cells; `moved` says whether they differed by more than a tenth of the spacing.

    The spacing is the larger of the median steps of the reference's latitudes and longitudes
    (an axis is sorted in one task).
    """
    steps = []
    for axis in ("lat", "lon"):
        line = ref.select(axis).distinct()
        steps.append(line.select(F.abs(F.col(axis) - F.lag(axis).over(Window.orderBy(axis))).alias("d")).agg(F.median("d")).first()[0] or 0.0)
    tolerance = max(steps) / 10
    cells = ref.select("row", "col", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    joined = grid.join(small(cells, ref), ["row", "col"])
    moved = (F.abs(F.col("lat") - F.col("ref_lat")) > tolerance) | (F.abs(F.col("lon") - F.col("ref_lon")) > tolerance)
    return joined.withColumn("moved", moved).withColumn("lat", F.col("ref_lat")).withColumn("lon", F.col("ref_lon")).drop("ref_lat", "ref_lon")
