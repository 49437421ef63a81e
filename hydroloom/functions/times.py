"""Time axes: frequencies, ranges, bounds, lengths, restarts, as column expressions or small driver-side rules."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What frequency names mean; `m` is a month, minutes are `min` or `t`.
UNITS = {"s": 1, "sec": 1, "t": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}
CALENDAR = {"m": "month", "month": "month", "ms": "month", "y": "year", "a": "year", "year": "year"}


def frequency(text: str) -> tuple[int, str]:
    """`3h` -> (3, 'h'), `m` -> (1, 'month'): number and unit."""
    found = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", text)
    unit = found and found[2].lower()
    if not found or unit not in UNITS | CALENDAR:
        raise ValueError(f"no frequency: {text!r}")
    return int(found[1] or 1), CALENDAR.get(unit, unit)


def seconds(text: str) -> int:
    n, unit = frequency(text)
    if unit not in UNITS:
        raise ValueError(f"{text!r} has no fixed length")
    return n * UNITS[unit]


def interval(text: str) -> str:
    n, unit = frequency(text)
    return f"INTERVAL {n} {unit.upper()}" if unit in ("month", "year") else f"INTERVAL {n * UNITS[unit]} SECOND"


def time_range(start: Column, end: Column, freq: str) -> Column:
    """Array of times from start to end, both included where the step meets them; empty if start is after end."""
    return F.when(start <= end, F.sequence(start, end, F.expr(interval(freq)))).otherwise(F.array().cast("array<timestamp_ntz>"))


def floor_time(time: Column, unit: str) -> Column:
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def restart_time(run: Column, shift: int, freq: str) -> Column:
    return run - F.expr(f"{shift} * {interval(freq)}")


def bounds(time: Column, unit: str) -> tuple[Column, Column]:
    """First and last moment (last: its final second) of the day, month or year; a month's start keeps the time of day."""
    start = floor_time(time, unit)
    step = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    end = start + F.expr(step) - F.expr("INTERVAL 1 SECOND")
    if unit == "month":
        start = start + (time - floor_time(time, "day"))
    return start, end


def length(start: Column, period: str, step: str) -> Column:
    """Number of steps in the period that begins at start."""
    until = start + F.expr(interval(period))
    return ((F.unix_micros(until.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / (seconds(step) * 1_000_000)).cast("long")


def axis_from_ordinal(start: Column, index: Column, freq: str) -> Column:
    """Times of an axis that only counts its steps."""
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), index.cast("decimal(18,6)") * seconds(freq))


def ensure_range(start: datetime, end: datetime, step: timedelta, reference: str = "start") -> tuple[datetime, datetime]:
    """A window at least a step long: extended forward from start, or backward from end."""
    if start > end:
        raise ValueError("start is after end")
    if end - start >= step:
        return start, end
    return (start, start + step) if reference == "start" else (end - step, end)


def floor_to(time: Column, freq: str) -> Column:
    """The last multiple of a frequency of a day at most, counted from midnight; calendar units and weeks from their start."""
    n, unit = frequency(freq)
    if unit in ("month", "year"):
        return floor_time(time, unit)
    width = n * UNITS[unit]
    if width > 86_400 or 86_400 % width:
        raise ValueError(f"{freq!r} does not divide a day")
    if width % 3600 == 0:
        # whole hours need neither minutes nor decimals
        return floor_time(time, "day") + F.make_dt_interval(F.lit(0), F.hour(time) - F.hour(time) % (width // 3600))
    past = F.hour(time) * 3600 + F.minute(time) * 60 + F.floor(F.second(time))
    return floor_time(time, "day") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (past - past % width).cast("decimal(18,6)"))


def shift(time: Column, steps: Column | int, freq: str) -> Column:
    """`steps` steps later (earlier if negative)."""
    n, unit = frequency(freq)
    count = steps if isinstance(steps, Column) else F.lit(steps)
    if unit in ("month", "year"):
        return F.add_months(time, (count * n * (12 if unit == "year" else 1)).cast("int")).cast("timestamp_ntz") + (time - floor_time(time, "day"))
    if isinstance(steps, int):
        return time + F.expr(f"INTERVAL '{steps * n * UNITS[unit]}' SECOND")
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (count * n * UNITS[unit]).cast("decimal(18,6)"))


def _span(start: Column, end: Column) -> Column:
    """Seconds from start to end."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000.0)


def _later(time: Column, by: Column) -> Column:
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), by.cast("decimal(18,6)"))


#: What is done with a window that is too short, and with one that is too long.
WHEN_SHORT = ("backward", "forward", "both", "keep")
WHEN_LONG = ("keep", "shrink-backward", "shrink-forward", "shrink-both")


def ensure_window(start: Column, end: Column, freq: str, when_short: str = "forward", when_long: str = "keep") -> tuple[Column, Column]:
    """A window made as long as the frequency if it is shorter (when_short) or longer (when_long).

    backward and shrink-backward move the start, forward and shrink-forward the end; both and
    shrink-both move both around the middle; keep leaves the window.
    """
    if when_short not in WHEN_SHORT or when_long not in WHEN_LONG:
        raise ValueError(f"no such mode: {when_short!r}, {when_long!r}")
    width = F.lit(float(seconds(freq)))
    have = _span(start, end)
    early, late = start, end
    for off, mode in ((have < width, when_short), (have > width, when_long.removeprefix("shrink-"))):
        if mode == "backward":
            early = F.when(off, _later(end, -width)).otherwise(early)
        elif mode == "forward":
            late = F.when(off, _later(start, width)).otherwise(late)
        elif mode == "both":
            half = (have - width) / 2
            early = F.when(off, _later(start, half)).otherwise(early)
            late = F.when(off, _later(start, half + width)).otherwise(late)
    return early, late


def select_range(start: Column | None = None, end: Column | None = None, period: int | None = 1, freq: str = "h", rounding: str = "h", ensure: bool = False) -> Column:
    """Array of times by whichever ends are given, each floored to `rounding`.

    Both: from start to end, and only the end if they are less than a step apart (with
    `ensure` the end moves a step from the start instead); a start after the end raises.  One:
    `period` steps up to the end, or on from the start.
    """
    if start is None and end is None:
        raise ValueError("neither start nor end")
    if start is not None and end is not None:
        fine = F.when(start > end, F.raise_error(F.lit("start is after end")).cast("timestamp_ntz")).otherwise(start)
        brief = _span(fine, end) < seconds(freq)
        low, high = ensure_window(fine, end, freq) if ensure else (F.when(brief, end).otherwise(fine), end)
        return time_range(floor_to(low, rounding), floor_to(high, rounding), freq)
    if period is None:
        raise ValueError("no period")
    if start is None:
        high = floor_to(end, rounding)
        return time_range(shift(high, 1 - period, freq), high, freq)
    low = floor_to(start, rounding)
    return time_range(low, shift(low, period - 1, freq), freq)


def expected_times(reference: Column, period: int | None = None, freq: str = "h", direction: str = "forward", normalize: bool = False) -> Column:
    """Array of the times that a reference asks for: `period` steps on from it, back to it, or itself (single); NULL without a period.

    normalize: the first time given (the reference) is set to midnight.
    """
    if direction not in ("forward", "backward", "single"):
        raise ValueError(f"no direction: {direction!r}")
    at = floor_time(reference, "day") if normalize else reference
    if direction == "single":
        return F.array(at)
    if period is None:
        return F.lit(None).cast("array<timestamp_ntz>")
    if period <= 0:
        raise ValueError("the period is not positive")
    ends = (at, shift(at, period - 1, freq)) if direction == "forward" else (shift(at, 1 - period, freq), at)
    return time_range(*ends, freq)


def flatten_start(start: Column, mode: str = "midnight", hour: int | None = None, run: Column | None = None, date: Column | None = None, rounding: str | None = None) -> Column:
    """The start moved back to midnight, noon or an hour; or set to the run (floored to `rounding`), or to a date at the hour (default: its own)."""
    day = floor_time(start, "day")
    if mode == "midnight":
        return day
    if mode in ("noon", "hour"):
        at = shift(day, _hour(mode, hour), "h")
        return F.when(at > start, shift(at, -1, "d")).otherwise(at)
    if mode == "time_run" and run is not None:
        return run if rounding is None else floor_to(run, rounding)
    return _custom(mode, date, start, hour)


def flatten_end(end: Column, mode: str = "midnight", hour: int | None = None, date: Column | None = None) -> Column:
    """The end moved on to the next day's midnight, to noon or an hour at or after it; or set to a date at the hour (default: its own)."""
    day = floor_time(end, "day")
    if mode == "midnight":
        return shift(day, 1, "d")
    if mode in ("noon", "hour"):
        at = shift(day, _hour(mode, hour), "h")
        return F.when(at < end, shift(at, 1, "d")).otherwise(at)
    return _custom(mode, date, end, hour)


def _hour(mode: str, hour: int | None) -> int:
    if mode == "hour" and hour is None:
        raise ValueError("mode hour needs an hour")
    return 12 if mode == "noon" else int(hour)


def _custom(mode: str, date: Column | None, old: Column, hour: int | None) -> Column:
    if mode != "custom_date" or date is None:
        raise ValueError(f"mode {mode!r} is unknown or lacks its date or run")
    return shift(floor_time(date.cast("timestamp_ntz"), "day"), F.hour(old) if hour is None else hour, "h")


def moved_window(start: Column, end: Column, new_start: Column | None = None, new_end: Column | None = None, keep: bool = True) -> tuple[Column, Column]:
    """The window after one end moved: the other is kept, or moves as far, so that the length is kept."""
    if new_start is not None:
        return new_start, end if keep else _later(end, _span(start, new_start))
    return (start if keep else _later(start, _span(end, new_end))), new_end


def time_signature(time: Column, pattern: str, steps: Column | int = 1) -> Column:
    """A time as a path's pattern shows it: units that it does not name (below the first that it names) are at their start.

    A path without a year shows 28 February for the 29th if a step spans more than one
    (parameters that recur each year).  Seconds count only with `%s`.  `{tags}` don't count.
    """
    bare = re.sub(r"\{[^}]*\}", "", pattern)
    count = steps if isinstance(steps, Column) else F.lit(steps)
    if "%Y" not in bare:
        leap = (F.month(time) == 2) & (F.dayofmonth(time) == 29) & (count > 1)
        time = F.when(leap, shift(time, -1, "d")).otherwise(time)
    unit = None
    for mark, name in (("%s", "minute"), ("%M", "hour"), ("%H", "day"), ("%d", "month"), ("%m", "year")):
        if mark in bare:
            break
        unit = name
    return time if unit is None else floor_time(time, unit)


def select_run(given: Column, from_file: Column, rounding: str = "h") -> Column:
    """The run's time: as given, else from the settings, floored."""
    return floor_to(F.coalesce(given, from_file), rounding)


def window_of_run(run: datetime, period: int, freq: str, count_ends: bool = False) -> dict[str, datetime | int]:
    """Start, end, restart and step of a run: `period` steps from the run, its end included only with `count_ends`."""
    step = timedelta(seconds=seconds(freq))
    run = run - (run - datetime.min) % step
    return {"start": run, "end": run + step * (period if count_ends else period - 1), "restart": run - step, "frequency": seconds(freq)}


def intersect(a: tuple[datetime, datetime], b: tuple[datetime, datetime]) -> tuple[datetime, datetime]:
    start, end = max(a[0], b[0]), min(a[1], b[1])
    if start > end:
        raise ValueError("the periods do not meet")
    return start, end


def _shape(form: str) -> str | None:
    """A pattern that all texts of a format fit, of formats of yyyy, MM, dd, HH, mm, ss and signs; None of others."""
    parts = re.findall(r"yyyy|MM|dd|HH|mm|ss|[-:/. ]", form)
    if "".join(parts) != form:
        return None
    return "^" + "".join(r"[+-]?\d{4,}" if p == "yyyy" else r"\d{2}" if p.isalpha() else re.escape(p) for p in parts) + "$"


def parse_any(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyyMMddHHmm", "yyyyMMdd", "yyyy-MM-dd")) -> Column:
    """The time by the first format that fits, else NULL.

    A text that can't fit a format by its form isn't parsed by it: each such trial costs an exception.
    """

    def trial(form: str) -> Column:
        shape = _shape(form)
        parsed = F.try_to_timestamp(text, F.lit(form))
        return parsed if shape is None else F.when(text.rlike(shape), parsed)

    return F.coalesce(*[trial(f) for f in formats]).cast("timestamp_ntz")


def time_from_name(name: Column, digits: int = 12) -> Column:
    """The last digits of a file name as a time."""
    return parse_any(F.right(F.regexp_replace(name, r"\D", ""), F.lit(digits)))


def cf_encode(time: Column, epoch: str = "1970-01-01") -> Column:
    """Days since the epoch."""
    return (F.unix_micros(time.cast("timestamp")) - F.unix_micros(F.lit(f"{epoch} 00:00:00").cast("timestamp"))) / F.lit(86_400_000_000.0)


def cf_decode(days: Column, epoch: str = "1970-01-01") -> Column:
    return F.timestamp_micros((F.round(days * 86_400_000_000)).cast("long") + F.unix_micros(F.lit(f"{epoch} 00:00:00").cast("timestamp"))).cast("timestamp_ntz")


def any_time(text: Column) -> Column:
    """A time from a date in any of parse_any's formats, or from seconds since 1970 (nine or ten digits); else NULL."""
    epoch = F.trim(text).rlike(r"^-?\d{9,10}(\.\d+)?$")
    return F.when(epoch, F.timestamp_seconds(text.try_cast("double")).cast("timestamp_ntz")).otherwise(parse_any(F.trim(text)))


def time_index(frame: DataFrame, column: str = "time") -> DataFrame:
    """(time) of the texts that are times, each once; order is that of a sort by the caller."""
    return frame.select(any_time(F.col(column).cast("string")).alias("time")).filter("time is not null").distinct()
