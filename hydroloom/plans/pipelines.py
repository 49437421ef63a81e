"""Shipped compositions: one lazy plan for all variables and times, one write at the end."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.functions import times
from hydroloom.model import NO_DATA
from hydroloom.operators import masks, physics, series, spatial

Process = Callable[[DataFrame], DataFrame]
#: Registered processes: name to a maker of steps.  Most steps take a field; merges take a list
#: of fields, `compute_` steps the wide table of their inputs, the registry join three tables.
PROCESSES: dict[str, Callable[..., Process]] = {}
FIELD = ("var", "time", "row", "col", "lat", "lon", "value")


def process(name: str) -> Callable:
    """Register a maker of steps under a name, for process lists in settings."""

    def keep(make: Callable[..., Process]) -> Callable[..., Process]:
        PROCESSES[name] = make
        return make

    return keep


@process("interpolate_data")
def interpolation(ref: DataFrame, method: str = "nn", max_distance: float = 18_000.0, neighbours: int = 8, fill_value: float | None = None, table: DataFrame | None = None) -> Process:
    """fill_value: what cells without a source hold; with none they have no row."""

    def run(grid: DataFrame) -> DataFrame:
        out = spatial.interpolate(grid, ref, method, max_distance, neighbours, table)
        return out if fill_value is None else spatial.complete(out, ref, fill_value)

    return run


def _masked_interpolation(ref: DataFrame, place: Mapping, mask: Mapping) -> Process:
    """The settings of an interpolation without fill_value and of the mask right after it, as one step."""
    interpolation(ref, **place), ref_mask(ref, **mask)  # settings that they don't know raise
    names = {"max_distance": "radius", "neighbours": "most", "mask_no_data": "no_data", "mask_mode": "mode", "mask_format": "form"}
    settings = {names.get(k, k): v for k, v in {**place, **mask}.items() if k != "fill_value"}
    return lambda grid: spatial.interpolate_masked(grid, ref, **settings)


@process("mask_data_by_ref")
def ref_mask(ref: DataFrame, ref_value: float = NO_DATA, mask_no_data: float | None = NO_DATA, mask_mode: str = "lazy", mask_format: str | None = "float") -> Process:
    return lambda grid: masks.mask_by_ref(grid, ref, ref_value, mask_no_data, mask_mode, mask_format)


@process("mask_data_by_limits")
def limit_mask(ref: DataFrame | None = None, mask_min: float | None = None, mask_max: float | None = None, mask_no_data: float | None = NO_DATA, mask_format: str | None = None) -> Process:
    return lambda grid: masks.mask_by_limits(grid, mask_min, mask_max, mask_no_data, mask_format)


@process("convert_temperature_units")
def temperature(ref: DataFrame | None = None, to_celsius: bool = True, units: str = "") -> Process:
    """units: those of the field; none count as Kelvin to Celsius, and the other way round."""
    change = physics.to_celsius if to_celsius else physics.to_kelvin
    return lambda grid: grid.withColumn("value", change(F.col("value"), F.lit(units)))


def _computed(value: Column, diagnosis: dict[str, Column] | None, mask_format: str | None, mask_no_data: float | None) -> Process:
    """The field of one value, or with diagnosis a field for it and each diagnostic variable, by name."""

    def run(wide: DataFrame) -> DataFrame:
        every = {None: masks.as_format(value, mask_format, mask_no_data), **(diagnosis or {})}
        # values first: explode would evaluate an expression's repeated parts (dates, angles) each time
        at = wide.select("var", "time", "row", "col", "lat", "lon", *[c.cast("double").alias(f"value{i}") for i, c in enumerate(every.values())])
        made = F.explode(F.array(*[F.struct(F.lit(n).cast("string").alias("kind"), F.col(f"value{i}").alias("value")) for i, n in enumerate(every)]))
        rows = at.select("var", "time", "row", "col", "lat", "lon", made.alias("made")).filter("made.value is not null")
        name = F.coalesce(F.concat_ws(":", "var", F.col("made.kind")) if diagnosis else F.col("var"), F.col("var"))
        return rows.select(name.alias("var"), "time", "row", "col", "lat", "lon", F.col("made.value").alias("value"))

    return run


@process("compute_data_rh")
def humidity(ref: DataFrame | None = None, p: float = 1013.25, p_units: str = "hPa", clip: bool = True, return_diag: bool = False, ref_value: float = NO_DATA, mask_no_data: float | None = NO_DATA, mask_format: str | None = "float") -> Process:
    """From columns t, td and q; a diagnosis adds the mismatch of the two vapour pressures (hPa) as `<var>:mismatch`."""
    if p_units not in ("hPa", "Pa"):
        raise ValueError(f"no pressure unit: {p_units!r}")
    own = p / 100 if p_units == "Pa" else p
    more = {"mismatch": physics.vapour_mismatch(F.col("td"), F.col("q"), own)} if return_diag else None
    return _computed(physics.relative_humidity(F.col("t"), F.col("td"), clip), more, mask_format, mask_no_data)


@process("compute_data_wind_speed")
def wind(ref: DataFrame | None = None, clip: bool = True, return_diag: bool = False, ref_value: float = NO_DATA, mask_no_data: float | None = NO_DATA, mask_format: str | None = "float") -> Process:
    """From columns u and v; a diagnosis adds the direction (degrees) as `<var>:direction`."""
    more = {"direction": physics.wind_direction_to(F.col("u"), F.col("v"))} if return_diag else None
    return _computed(physics.wind_speed(F.col("u"), F.col("v")), more, mask_format, mask_no_data)


@process("compute_data_incoming_radiation")
def radiation(ref: DataFrame | None = None, kind: str = "k", time_delta: str = "1h", midpoint: bool = True, clip_sw_min: float | None = 0.0) -> Process:
    """From columns ssrd (short wave, kinds k, r, w, all) and strd (long wave, kinds l, r, w, all), J/m2.

    r and w are the sum; all gives `<var>:k`, `<var>:l` and `<var>:r`.  midpoint: a field's time is the interval's middle.
    """
    if kind not in ("k", "l", "r", "w", "all"):
        raise ValueError(f"no kind of radiation: {kind!r}")
    width = times.seconds(time_delta)
    short = physics.flux(F.col("ssrd"), width, clip_sw_min) if kind != "l" else None
    long = physics.flux(F.col("strd"), width) if kind != "k" else None
    at = physics.middle_of(F.col("time"), width).cast("timestamp_ntz") if midpoint else F.col("time")
    if kind == "all":
        fields = {"k": short, "l": long, "r": short + long}
        every = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("value")) for n, c in fields.items()])).alias("made")
        return lambda wide: wide.select("var", at.alias("time"), "row", "col", "lat", "lon", every).filter("made.value is not null").select(F.concat_ws(":", "var", "made.kind").alias("var"), "time", "row", "col", "lat", "lon", F.col("made.value").alias("value"))
    value = {"k": short, "l": long}.get(kind, None if short is None or long is None else short + long)
    return lambda wide: wide.select("var", at.alias("time"), "row", "col", "lat", "lon", value.alias("value")).filter("value is not null")


@process("compute_data_astronomic_radiation")
def clear_sky(ref: DataFrame | None = None, time_delta: str = "1h", heights: DataFrame | None = None, ref_value: float = NO_DATA, mask_no_data: float | None = NO_DATA, mask_format: str | None = "float") -> Process:
    """From the column rain; heights: cells (row, col, z), if the station's height counts."""

    def run(wide: DataFrame) -> DataFrame:
        at = wide if heights is None else wide.join(masks.small(heights.select("row", "col", "z"), heights), ["row", "col"], "left")
        z = None if heights is None else F.coalesce("z", F.lit(0.0))
        return at.transform(_computed(physics.clear_sky(F.col("rain"), F.col("lat"), F.col("lon"), F.col("time"), times.seconds(time_delta), z), None, mask_format, mask_no_data))

    return run


@process("merge_data_by_ref")
def tiles_merge(ref: DataFrame, ref_value: float = NO_DATA, var_no_data: float | None = NO_DATA, method: str = "nn", max_distance: float = 18_000.0, neighbours: int = 8, table: DataFrame | None = None) -> Callable[[Sequence[DataFrame]], DataFrame]:
    return lambda tiles: spatial.merge_by_ref(list(tiles), ref, method, max_distance, neighbours, ref_value, var_no_data, table)


@process("merge_data_by_time")
def steps_merge(ref: DataFrame | None = None, ref_value: float = NO_DATA) -> Callable[[Sequence[tuple[object, DataFrame]]], DataFrame]:
    return lambda steps: spatial.merge_by_time(list(steps), ref, ref_value)


@process("join_time_series_by_registry")
def registry_join(ref: DataFrame | None = None) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    return series.join_registry


def chain(steps: Sequence[tuple[str, Mapping]], **shared) -> Process:
    """Named steps with their settings, one after another; a setting that a step does not know raises.

    A mask by the reference right after an interpolation on it goes along with its weights.
    """
    made, before = [], None
    for name, settings in steps:
        if before is not None and PROCESSES[name] is ref_mask:
            made[-1] = _masked_interpolation(**shared, place=before, mask=settings)
            before = None
            continue
        made.append(PROCESSES[name](**shared, **settings))
        before = settings if PROCESSES[name] is interpolation and settings.get("fill_value") is None else None
    return lambda grid: reduce(lambda df, step: df.transform(step), made, grid)


def bound(inputs: Mapping[str, DataFrame], needs: Mapping[str, str], var: str) -> DataFrame:
    """The wide table (var, time, row, col, lat, lon, a column for each argument) of the inputs that `needs` names by argument."""
    lacking = set(needs.values()) - set(inputs)
    if lacking:
        raise KeyError(f"{var} needs {sorted(lacking)}")
    fields = [inputs[name].select(F.lit(arg).alias("arg"), *FIELD[1:]) for arg, name in needs.items()]
    wide = reduce(DataFrame.unionByName, fields).groupBy("time", "row", "col", "lat", "lon")
    return wide.agg(*[F.max(F.when(F.col("arg") == arg, F.col("value"))).alias(arg) for arg in needs]).withColumn("var", F.lit(var))


def run_process_lists(inputs: Mapping[str, DataFrame], ref: DataFrame, lists: Mapping[str, Sequence[Mapping]], tables: Mapping[tuple, DataFrame] | None = None) -> DataFrame:
    """The variables of process lists as settings have them: name to steps {"function": ..., settings...}.

    A first step with `deps_vars` (argument to input) computes its variable from inputs on
    their own grid; other variables start from the input of their name.  An empty list is an
    input that serves others only.  Variables whose further steps are the same go through them
    as one field, so each is regridded and masked with the others in one plan.
    tables: neighbours found before, by (method, max_distance, neighbours).
    """
    together: dict[str, tuple[list, list[DataFrame]]] = {}
    for var, steps in lists.items():
        if not steps:
            continue
        steps = [(step["function"], {k: v for k, v in step.items() if k != "function"}) for step in steps]
        field = inputs.get(var)
        if steps[0][1].get("deps_vars"):
            name, settings = steps.pop(0)
            field = chain([(name, {k: v for k, v in settings.items() if k != "deps_vars"})], ref=ref)(bound(inputs, settings["deps_vars"], var))
        elif field is None:
            raise KeyError(f"no input {var}")
        else:
            field = field.withColumn("var", F.lit(var))
        together.setdefault(json.dumps(steps, sort_keys=True), (steps, []))[1].append(field.select(*FIELD))
    done = []
    for steps, fields in together.values():
        for name, settings in steps:
            key = (settings.get("method", "nn"), settings.get("max_distance"), settings.get("neighbours"))
            if name == "interpolate_data" and key in (tables or {}):
                settings["table"] = tables[key]
        done.append(reduce(DataFrame.unionByName, fields).transform(chain(steps, ref=ref)))
    return reduce(DataFrame.unionByName, done).select(*FIELD)


def multi_variable(inputs: Mapping[str, DataFrame], ref: DataFrame, derived: Mapping[str, Callable[[DataFrame], DataFrame]], processes: Sequence[tuple[str, Mapping]], after: Mapping[str, Process] | None = None) -> DataFrame:
    """Direct and derived variables on the reference grid.

    inputs: grids by variable.  derived: makers of further variables from the wide table of
    the inputs (columns by variable), on the source grid; they are regridded like the others.
    """
    direct = [g.withColumn("var", F.lit(name)) for name, g in inputs.items()]
    long = reduce(DataFrame.unionByName, direct)
    wide = long.groupBy("time", "row", "col", "lat", "lon").pivot("var", sorted(inputs)).agg(F.first("value"))
    made = [make(wide).select(F.lit(name).alias("var"), "time", "row", "col", "lat", "lon", "value") for name, make in derived.items()]
    every = reduce(DataFrame.unionByName, [long.select("var", "time", "row", "col", "lat", "lon", "value"), *made])
    done = every.transform(chain(processes, ref=ref))
    for name, step in (after or {}).items():
        done = done.filter(F.col("var") != name).unionByName(done.filter(F.col("var") == name).transform(step))
    return done


def multi_tile(tiles: Sequence[DataFrame], ref: DataFrame, no_data: Mapping[str, float] | None = None, **settings) -> DataFrame:
    """Tiles merged on the reference grid; variables may have no-data values of their own."""
    merged = spatial.merge_by_ref(list(tiles), ref, var_no_data=None, **settings)
    value = F.lit(-9999.0)
    for name, own in (no_data or {}).items():
        value = F.when(F.col("var") == name, float(own)).otherwise(value)
    return merged.withColumn("value", F.coalesce("value", value))


def multi_time(steps: Sequence[tuple[object, DataFrame]], ref: DataFrame | None = None) -> DataFrame:
    return spatial.merge_by_time(list(steps), ref)


def time_series(data: DataFrame, registry: DataFrame, database: DataFrame) -> DataFrame:
    """The analyzer: last values a time, joined to the sections of both registries."""
    return series.join_registry(data, registry, database)


#: The variables of the shipped ICON conversion and their steps (settings as shipped).
_PLACE = ({"function": "interpolate_data", "method": "nn", "max_distance": 22_000, "neighbours": 7, "fill_value": None}, {"function": "mask_data_by_ref", "ref_value": -9999, "mask_no_data": None})
_DIRECT = ({**_PLACE[0], "max_distance": 25_000}, _PLACE[1])
ICON = {
    "AIR_T": [*_DIRECT, {"function": "convert_temperature_units", "to_celsius": True}],
    "RAIN": [*_DIRECT],
    "WIND_U": [],
    "WIND_V": [],
    "WIND_SPEED": [{"function": "compute_data_wind_speed", "ref_value": -9999, "mask_no_data": None, "deps_vars": {"u": "WIND_U", "v": "WIND_V"}}, *_PLACE],
    "QV": [],
    "DEW_POINT": [],
    "RH": [{"function": "compute_data_rh", "ref_value": -9999, "mask_no_data": None, "deps_vars": {"t": "AIR_T", "q": "QV", "td": "DEW_POINT"}}, *_PLACE],
    "INC_RAD": [{"function": "compute_data_astronomic_radiation", "ref_value": -9999, "mask_no_data": None, "deps_vars": {"rain": "RAIN"}}, *_PLACE],
}


IFS = {k: v for k, v in ICON.items() if k != "INC_RAD"} | {
    "SSRD": [],
    "STRD": [],
    "INC_RAD": [{"function": "compute_data_incoming_radiation", "deps_vars": {"ssrd": "SSRD", "strd": "STRD"}}, *_PLACE],
}


def _listed(wide: str, narrow: str = "") -> dict[str, list[dict]]:
    """Variables that are only placed and masked, within 25 km or within 22 km."""
    return {name: [*_DIRECT] for name in wide.split()} | {name: [*_PLACE] for name in narrow.split()}


#: The variables of the other shipped conversions.
CONVERSIONS = {
    "icon": ICON,
    "ifs": IFS,
    "iwrn": _listed("LAI AIR_T", "RH SR TP WIND"),
    "itwater_forcing": _listed("rain air_t", "rh inc_rad wind"),
    "itwater_updating": _listed("", "snow_mask"),
    "s3m": _listed("rain air_t", "rh inc_rad"),
}


def convert(name: str, inputs: Mapping[str, DataFrame], ref: DataFrame, **more) -> DataFrame:
    """A shipped conversion: its variables on the reference grid.  Variables without an input are left out unless others need them."""
    lists = {var: steps for var, steps in CONVERSIONS[name].items() if var in inputs or (steps and steps[0].get("deps_vars"))}
    return run_process_lists(inputs, ref, lists, **more)


def icon(inputs: Mapping[str, DataFrame], ref: DataFrame, **more) -> DataFrame:
    """The ICON conversion: temperature, rain, wind speed, humidity and radiation on the reference grid."""
    return convert("icon", inputs, ref, **more)
