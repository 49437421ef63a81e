"""Tags, templates and namelist scalars."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def section_tag(data_from: Column) -> Column:
    """`Catchment, Section X` -> `catchment:section_x`; without a comma the lower-cased text."""
    parts = F.split(data_from, ",", 2)
    name = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    return F.when(F.size(parts) < 2, F.lower(F.trim(data_from))).otherwise(F.concat_ws(":", name(parts[0]), name(F.get(parts, F.lit(1)))))


def registry_tag(*parts: Column) -> Column:
    """Parts joined by `:`, white space collapsed to `_`, empty parts as `_`."""
    clean = [F.regexp_replace(F.trim(F.coalesce(p, F.lit(""))), r"\s+", "_") for p in parts]
    return F.lower(F.concat_ws(":", *[F.when(c == "", "_").otherwise(c) for c in clean]))


def fill(template: str, values: Mapping[str, object]) -> list[str]:
    """`{key}` and `{key:%Y%m}` filled; lists give every combination; unknown keys stay."""
    keys = list(dict.fromkeys(k for k in re.findall(r"\{(\w+)(?::[^{}]*)?\}", template) if k in values))
    choices = [v if isinstance(v := values[k], list) else [v] for k in keys]
    out = []
    for chosen in product(*choices):
        now = dict(zip(keys, chosen, strict=True))
        put = lambda m, now=now: m[0] if m[1] not in now else (now[m[1]].strftime(m[2]) if isinstance(now[m[1]], datetime) else str(now[m[1]]))
        out.append(re.sub(r"\{(\w+)(?::([^{}]*))?\}", put, template))
    return out


#: Widths of the date fields a path template may have.
FIELDS = {"Y": r"\d{4}", "m": r"\d{2}", "d": r"\d{2}", "H": r"\d{2}", "M": r"\d{2}", "S": r"\d{2}"}


def pattern_of(template: str) -> tuple[str, list[str]]:
    """A regular expression for names made by a template with `%Y` fields and `{tags}`, and its groups' names."""
    out, names, at = "", [], 0
    for found in re.finditer(r"%([YmdHMS])|\{(\w+)(?::[^{}]*)?\}", template):
        name = found[1] or found[2]
        out += re.escape(template[at : found.start()])
        out += rf"(?:{FIELDS[found[1]]})" if name in names and found[1] else ("[^/]+?" if name in names else rf"({FIELDS[found[1]] if found[1] else '[^/]+?'})")
        if name not in names:
            names.append(name)
        at = found.end()
    return out + re.escape(template[at:]), names


def date_and_tags(name: Column, template: str) -> tuple[Column, dict[str, Column]]:
    """Time and tags read from a file name; fields that the template lacks are those of 1900-01-01 00:00:00."""
    pattern, names = pattern_of(template)
    part = lambda n, other: F.when(F.rlike(name, F.lit(pattern)), F.regexp_extract(name, pattern, names.index(n) + 1)) if n in names else F.lit(other)
    fields = [part(n, o).try_cast("int") for n, o in (("Y", "1900"), ("m", "1"), ("d", "1"), ("H", "0"), ("M", "0"))]
    time = F.make_timestamp_ntz(*fields, part("S", "0").try_cast("double"))
    return time, {n: part(n, None) for n in names if n not in FIELDS}


def fortran_scalar(text: Column) -> Column:
    """(kind, value) of a namelist token: bool, int, float or str, quotes taken off."""
    bare = F.trim(text)
    low = F.lower(bare)
    quoted = bare.rlike(r"""^(".*"|'.*')$""")
    number = F.regexp_replace(low, "d", "e").try_cast("double")
    kind = F.when(quoted, "str").when(low.isin(".true.", ".false."), "bool").when(bare.try_cast("long").isNotNull(), "int").when(number.isNotNull(), "float").otherwise("str")
    value = F.when(quoted, F.regexp_replace(bare, r"^.|.$", "")).when(low.isin(".true.", ".false."), F.replace(low, F.lit("."))).otherwise(bare)
    return F.struct(kind.alias("kind"), value.alias("value"))


def fortran_text(kind: Column, value: Column) -> Column:
    """A value as a namelist writes it: strings in single quotes, booleans in dots."""
    return F.when(kind == "str", F.concat(F.lit("'"), value, F.lit("'"))).when(kind == "bool", F.concat(F.lit("."), F.lower(value), F.lit("."))).otherwise(value)


def row_text(line: Column, mark: str = "#") -> Column:
    """What stands before the mark in a line of an asset file, trimmed.

    A line with several marks loses its digits first; one without `#` may have `%` instead.
    """
    many = F.length(line) - F.length(F.replace(line, F.lit(mark))) > len(mark)
    bare = F.when(many, F.regexp_replace(line, "[0-9]", "")).otherwise(line)
    first = F.substring_index(bare, mark, 1)
    other = ~F.contains(bare, F.lit("#")) & F.contains(first, F.lit("%"))
    return F.trim(F.when(other, F.substring_index(bare, "%", 1)).otherwise(first))


#: Fixed value: significant digits that a number is taken to have at most.
MAX_DIGITS = 14


def precision(value: Column) -> Column:
    """(digits, scale): significant digits of a number and those behind its point, MAX_DIGITS together at most."""
    size = F.abs(value)
    whole = F.floor(size)
    before = F.when(whole == 0, 1).otherwise(F.length(whole.cast("string")))
    room = F.greatest(F.lit(MAX_DIGITS) - before, F.lit(0))
    # the fraction as an integer of `room` digits, its zeros at the end taken off
    fraction = F.floor((size - whole) * F.pow(F.lit(10.0), room) + 0.5).cast("long").cast("string")
    digits = F.rtrim(F.lpad(fraction, room.cast("int"), "0"), F.lit("0"))
    scale = F.when(room == 0, 0).otherwise(F.length(digits))
    return F.struct((before + scale).cast("int").alias("digits"), scale.cast("int").alias("scale"))


def shown_with(value: Column, decimals: int = 4) -> Column:
    """A number as it stands if it has no more decimals than asked for, else rounded to them."""
    return F.when(precision(value)["scale"] <= decimals, value.cast("string")).otherwise(F.format_string(f"%.{decimals}f", value))


def series_label(kind: Column, section: Column, unit: str = "m3/s") -> Column:
    return F.concat(F.initcap(kind), F.lit(" "), section, F.lit(f" [{unit}]"))


def shown_value(value: Column) -> Column:
    """Three decimals, or a dash where there is no value."""
    return F.when(value.isNull() | F.isnan(value), "-").otherwise(F.format_string("%.3f", value))


def shortened(text: Column, most: int = 200) -> Column:
    return F.left(text, F.lit(most))
