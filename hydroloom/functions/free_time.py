"""Times in free text, by tokens and their order, as built-in expressions.

The text is first brought to tokens: month names become `m1` to `m12`, ordinal endings, weekday
names and filling words go, separators become blanks; time of day and zone are cut out by their
own forms.  What is left of the date is one of few orders of numbers and month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months by their first three letters, and words that say nothing.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMES = ("january", "february", "march", "april", "june", "july", "august", "sept", "september", "october", "november", "december")
FILLING = r"\b(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|nesday|sday|rsday|urday)?\b|\b(?:of|the|at|on|in|and|run|time|date|day)\b"
#: A time of day; hours alone need `h`, am or pm, or a `t` before them.
CLOCK = r"(?:^|[\st_])(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(am|pm)?(?![\d])"
HOUR = r"(?:^|\s)(\d{1,2})\s*(am|pm|h)\b"
#: Distance from UTC, behind a time of day.
ZONE = r"(?:[:h]\d{2}(?:[.,]\d+)?|\b[ap]m|\d[ap]m)\s*(?:utc|gmt)?\s*([+-])(\d{2}):?(\d{2})(?:\s|$)"


def _let(value: Column, use) -> Column:
    """`use(value)`, the value taken once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(text: Column, pattern: str, *groups: int) -> list[Column]:
    """Groups of the first match as texts, NULL where there is none."""
    return [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups]


def parse_free(text: Column, day_first: bool = False) -> Column:
    """The time that a free text names, as a timestamp without zone, else NULL.

    Dates: year first with separators or without (8, 10, 12 or 14 digits), month by name before
    or behind the day, or three numbers with the year last; of these the month is first unless
    it can't be, or `day_first` says so.  Years of two digits are 2000 to 2068 and 1969 to 1999.
    Times: 7:05, 07:05:09.25, 7h05, 7 am, 19h; missing parts are zero, a missing day of a
    month by name is the first.  With a zone (+02:00, -0530) the time is that of UTC; Z, UTC
    and GMT shift nothing.  Other text around is left out; seconds since 1970 of 9 to 10
    digits, if nothing else is there, count as such.
    """
    return _let(F.lower(F.trim(text)), lambda low: _let(_tokens(low), lambda bare: _let(_date(bare, day_first), lambda date: _made(low, bare, date))))


def _tokens(low: Column) -> Column:
    """What is no time, no zone and no filling: numbers and months `m1` to `m12` between blanks."""
    bare = F.regexp_replace(low, r"(\d)t(?=\d{1,2}[:h])", "$1 ")
    bare = F.regexp_replace(bare, r"(^|[\s_])\d{1,2}[:h]\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:am|pm)?\s*(?:z|utc|gmt)?\s*(?:[+-]\d{2}:?\d{2})?(?=\s|$|[^\d])", "$1 ")
    bare = F.regexp_replace(bare, HOUR, " ")
    bare = F.regexp_replace(bare, r"(\d)(?:st|nd|rd|th)\b", "$1")
    bare = F.regexp_replace(bare, FILLING, " ")
    for i, name in enumerate(MONTHS, 1):
        full = [n for n in NAMES if n.startswith(name)]
        bare = F.regexp_replace(bare, rf"(?<![a-z])(?:{'|'.join([*sorted(full, key=len, reverse=True), name])})\.?(?![a-z])", f" m{i} ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def _date(bare: Column, day_first: bool) -> Column:
    """Struct (y, m, d, h, mi, s) of the first order of tokens that fits; h, mi and s only of packed digits."""
    edge, ends = r"(?:^|.*?\s)", r"(?=\s|$)"
    number = lambda x: x.try_cast("int")
    nothing = F.lit(None).cast("int")

    def when(pattern: str, y: int, m: int, d: int | None) -> Column:
        yy, mm = _at(bare, edge + pattern + ends, y, m)
        dd = number(_at(bare, edge + pattern + ends, d)[0]) if d else F.lit(1)
        year = F.when(F.length(yy) == 4, number(yy)).otherwise(number(yy) + F.when(number(yy) < 69, 2000).otherwise(1900))
        found = F.struct(year.alias("y"), number(mm).alias("m"), dd.alias("d"), nothing.alias("h"), nothing.alias("mi"), nothing.alias("s"))
        return _let(found, lambda f: F.when(f["y"].isNotNull() & f["m"].between(1, 12) & f["d"].between(1, 31), f))

    parts = [number(x) for x in _at(bare, rf"{edge}(\d{{4}})(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:(\d{{2}})(\d{{2}})?)?)?{ends}", 1, 2, 3, 4, 5, 6)]
    packed = _let(F.struct(*[x.alias(n) for x, n in zip(parts, ("y", "m", "d", "h", "mi", "s"), strict=True)]), lambda f: F.when(f["m"].between(1, 12) & f["d"].between(1, 31), f))
    numbers = r"(\d{1,2}) (\d{1,2}) (\d{4}|\d{2})"
    return F.coalesce(
        when(r"(\d{4}) m?(\d{1,2}) (\d{1,2})", 1, 2, 3),
        when(r"(\d{1,2}) m(\d{1,2}) (\d{4}|\d{2})", 3, 2, 1),
        when(r"m(\d{1,2}) (\d{1,2}) (\d{4}|\d{2})", 3, 1, 2),
        when(numbers, 3, *((2, 1) if day_first else (1, 2))),
        when(numbers, 3, *((1, 2) if day_first else (2, 1))),
        packed,
        when(r"m(\d{1,2}) (\d{4})", 2, 1, None),
        when(r"(\d{4}) m?(\d{1,2})", 1, 2, None),
    )


def _made(low: Column, bare: Column, date: Column) -> Column:
    """The date with the time of day of the text, or of the digits, less the zone; or seconds since 1970."""
    number = lambda x: x.try_cast("int")
    clock_h, clock_m, clock_s, clock_us, clock_half = _at(low, CLOCK, 1, 2, 3, 4, 5)
    hour, hour_half = _at(low, HOUR, 1, 2)
    sign, zone_h, zone_m = _at(low, ZONE, 1, 2, 3)
    half = F.coalesce(clock_half, hour_half)
    h = number(F.coalesce(clock_h, hour))
    h = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h)
    fraction = F.coalesce(number(F.rpad(clock_us, 6, "0")), F.lit(0)) / 1_000_000
    time = F.struct(F.coalesce(date["h"], h, F.lit(0)).alias("h"), F.coalesce(date["mi"], number(clock_m), F.lit(0)).alias("m"), F.coalesce(date["s"], number(clock_s), F.lit(0)).alias("s"), fraction.alias("part"))
    apart = (number(zone_h) * 60 + number(zone_m)) * F.when(sign == "-", -1).otherwise(1)

    def whole(t: Column) -> Column:
        made = F.try_make_timestamp_ntz(date["y"], date["m"], date["d"], t["h"], t["m"], (t["s"] + t["part"]).cast("decimal(8,6)"))
        return F.when((t["h"] < 24) & (t["m"] < 60) & (t["s"] < 60), made - F.make_dt_interval(mins=F.coalesce(apart, F.lit(0))))

    since = F.timestamp_seconds(F.when(bare.rlike(r"^\d{9,10}$"), bare.try_cast("long"))).cast("timestamp_ntz")
    return F.coalesce(F.when(date.isNotNull(), _let(time, whole)), since)
