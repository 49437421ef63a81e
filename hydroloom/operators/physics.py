"""Derived meteorological variables as column expressions; all inputs may be NULL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydroloom.model import nothing

# Fixed values of the published formulas.
KELVIN = 273.15
MAGNUS = (6.112, 17.67, 243.5)
SOLAR_CONSTANT = 118.08 / 1440
STATION_SLOPE = 2e-4
#: Rain from (inclusive), to (exclusive), cloud factor; None is open.
CLOUD_FACTORS = ((0.0, 1.0, 0.95), (1.0, 3.0, 0.75), (3.0, 5.0, 0.65), (5.0, 10.0, 0.50), (10.0, None, 0.15))


def to_celsius(value: Column, units: Column) -> Column:
    """Kelvin, or an empty unit, becomes Celsius; other units stay."""
    return F.when(F.lower(F.coalesce(units, F.lit(""))).isin("k", "kelvin", ""), value - KELVIN).otherwise(value)


def to_kelvin(value: Column, units: Column) -> Column:
    return F.when(F.lower(F.coalesce(units, F.lit(""))).isin("c", "°c", "celsius", "degc", ""), value + KELVIN).otherwise(value)


def vapour_pressure(kelvin: Column) -> Column:
    """Magnus: hPa over water."""
    a, b, c = MAGNUS
    x = kelvin - KELVIN
    return a * F.exp(b * x / (x + c))


def relative_humidity(t: Column, td: Column, clip: bool = True) -> Column:
    """Percent from temperature and dew point in K; clipped to 0..100 unless told otherwise."""
    rh = 100 * vapour_pressure(td) / vapour_pressure(t)
    return F.when(rh.isNotNull(), F.least(F.greatest(rh, F.lit(0.0)), F.lit(100.0))) if clip else rh


def vapour_mismatch(td: Column, q: Column, p: float | Column = 1013.25) -> Column:
    """hPa: vapour pressure by dew point less that by specific humidity q (kg/kg)."""
    p = p if isinstance(p, Column) else F.lit(p)
    return vapour_pressure(td) - q * p / (0.622 + 0.378 * q)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction_to(u: Column, v: Column) -> Column:
    """Degrees from east, counter-clockwise, in 0..360."""
    return F.pmod(F.degrees(F.atan2(v, u)), F.lit(360.0))


def flux(joules: Column, seconds: float, least: float | None = None) -> Column:
    """W/m² of J/m² accumulated over `seconds`, not below `least`."""
    watts = joules / seconds
    return watts if least is None else F.when(watts.isNotNull(), F.greatest(watts, F.lit(least)))


def middle_of(end: Column, seconds: float) -> Column:
    return end - F.expr(f"INTERVAL '{seconds / 2:.3f}' SECOND")


def lookup(value: Column, table: Sequence[tuple[float | None, float | None, float]], other: float | None = 0.0) -> Column:
    """A LUT as one CASE: ranges hold their start but not their end; a range open below holds its end; NaN and NULL give NULL."""
    out = F.when(nothing(value), F.lit(None).cast("double"))
    for low, high, result in table:
        fits = F.lit(True)
        if low is not None:
            fits = value >= low
        if high is not None:
            fits &= (value < high) if low is not None else (value <= high)
        out = out.when(fits, F.lit(float(result)))
    return out.otherwise(F.lit(other))


def cloud_factor(rain: Column, table: Sequence[tuple[float | None, float | None, float]] = CLOUD_FACTORS) -> Column:
    """Share of clear-sky radiation by rain; rain in no range gives 0, NaN and NULL give NULL."""
    return lookup(rain, table)


def extraterrestrial(lat: Column, lon: Column, end: Column, seconds: float) -> Column:
    """W/m² on a horizontal plane over the `seconds` before `end`, none below 0."""
    middle = middle_of(end, seconds)
    hour = F.hour(middle) + F.minute(middle) / 60 + F.second(middle) / 3600
    day = F.dayofyear(middle)
    turn = 2 * math.pi / 365 * day
    b = 2 * math.pi * (day - 81) / 364
    correction = 0.1645 * F.sin(2 * b) - 0.1255 * F.cos(b) - 0.025 * F.sin(b)
    declination = 0.4093 * F.sin(turn - 1.405)
    # zone meridian (half-even) east, own meridian west: subtracted as they stand
    meridians = F.rint(lon / 15) * 15 - (360 - lon)
    angle = math.pi / 12 * (hour + 0.06667 * meridians + correction - 12)
    half = math.pi * (seconds / 3600) / 24
    first, last = angle - half, angle + half
    phi = F.radians(lat)
    sky = (last - first) * F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * (F.sin(last) - F.sin(first))
    watts = 12 * (seconds / 60) / math.pi * SOLAR_CONSTANT * (1 + 0.033 * F.cos(turn)) * sky * 1e6 / seconds
    return F.when(watts <= 0, 0.0).otherwise(watts)


def clear_sky(rain: Column, lat: Column, lon: Column, end: Column, seconds: float, z: Column | None = None) -> Column:
    """Incoming radiation under the rain's clouds at height z (m); not below 0."""
    slope = F.lit(0.65) if z is None else 0.65 + STATION_SLOPE * z
    k = cloud_factor(rain) * slope * extraterrestrial(lat, lon, end, seconds)
    return F.when(k.isNotNull(), F.greatest(k, F.lit(0.0)))


def air_pressure(z: Column) -> Column:
    """kPa at height z (m) of a standard atmosphere."""
    return 101.3 * F.pow((293 - 0.0065 * z) / 293, F.lit(5.26))


def constant_on_land(terrain: Column, value: float, no_data: float = -9999.0) -> Column:
    return F.when(terrain >= 0, F.lit(float(value))).otherwise(F.lit(no_data))
