"""GRIB editions 1 and 2: fields on regular latitudes and longitudes, read by message.

A file is cut at its messages, so many tasks read one file; headers say a message's variable
and times before its numbers are read.  Numbers are simple-packed: value = (reference + packed *
2 ^ binary scale) / 10 ^ decimal scale, with a bitmap of the cells that have one.  Other packings
(complex, JPEG, CCSDS) and other grids raise.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hydroloom.sources.ranged import Format, Part, RangedFile, RangedSource, field_batches, load

#: Short names by discipline, category and number (edition 2) and by number of table 2 (edition 1).
NAMES = {"0.0.0": "t", "0.0.6": "d", "0.1.0": "q", "0.1.8": "tp", "0.2.2": "u", "0.2.3": "v", "0.3.0": "sp", "0.4.7": "ssrd", "0.6.1": "tcc"}
NAMES_1 = {1: "sp", 11: "t", 17: "d", 33: "u", 34: "v", 51: "q", 61: "tp", 71: "tcc"}
#: Seconds in the units of forecast times.
UNITS = {0: 60, 1: 3_600, 2: 86_400, 10: 3 * 3_600, 11: 6 * 3_600, 12: 12 * 3_600, 13: 1, 254: 1}
#: Templates with one time, and with an interval at whose end the field holds.
AT_TIME, OVER_TIME = (0, 1), (8, 11)
#: Bytes read at a message's start; its sections before the numbers mostly fit.
HEAD_BYTES = 1_024


def signed(raw: bytes) -> int:
    """A number whose first bit is its sign."""
    n = int.from_bytes(raw, "big")
    top = 1 << 8 * len(raw) - 1
    return -(n - top) if n & top else n


def unpack_numbers(data: bytes, bits: int, count: int) -> np.ndarray:
    """`count` unsigned numbers of `bits` bits each."""
    if bits == 0:
        return np.zeros(count)
    if len(data) * 8 < bits * count:
        raise ValueError("packed numbers end too early")
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype("f8")
    out = np.empty(count)
    for at in range(0, count, 1 << 16):  # a bit a byte, in blocks that begin at whole bytes
        n = min(1 << 16, count - at)
        each = np.unpackbits(np.frombuffer(data, "u1", -(-n * bits // 8), at * bits // 8), count=n * bits).reshape(n, bits)
        out[at : at + n] = each @ (2.0 ** np.arange(bits - 1, -1, -1))
    return out


def pack_numbers(numbers: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return numbers.astype(np.uint64).astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.packbits((numbers.astype(np.uint64)[:, None] >> shifts & np.uint64(1)).astype("u1")).tobytes()


def ibm_float(raw: bytes) -> float:
    """Edition 1's reference values: sign, exponent of 16, 24 bits."""
    n = int.from_bytes(raw, "big")
    return (-1.0) ** (n >> 31) * (n & 0xFFFFFF) * 16.0 ** ((n >> 24 & 0x7F) - 70)


class Cursor:
    """A message's bytes, its head read at once."""

    def __init__(self, file: RangedFile, at: int, size: int):
        self.file, self.at, self.size = file, at, size
        self.head = file.read(at, min(HEAD_BYTES, size))

    def read(self, start: int, length: int) -> bytes:
        if start + length > self.size:
            raise ValueError(f"{self.file.path}: a section of the message at {self.at} ends outside it")
        return self.head[start : start + length] if start + length <= len(self.head) else self.file.read(self.at + start, length)


def messages(file: RangedFile) -> Iterator[tuple[int, int, int]]:
    """(offset, bytes, edition) of the file's messages; what stands between is skipped up to the next one."""
    at = 0
    while at + 8 <= file.size:
        head = file.read(at, min(16, file.size - at))
        if head[:4] != b"GRIB":
            chunk = file.read(at, min(1 << 16, file.size - at))
            found = chunk.find(b"GRIB", 1)
            at += found if found > 0 else max(1, len(chunk) - 3)
            continue
        edition = head[7]
        if edition not in (1, 2) or len(head) < 16:
            raise ValueError(f"{file.path}: edition {edition}")
        size = int.from_bytes(head[4:7], "big") if edition == 1 else int.from_bytes(head[8:16], "big")
        if size < 16 or at + size > file.size:
            raise ValueError(f"{file.path}: the message at {at} ends outside the file")
        yield at, size, edition
        at += size


def _regular(ni: int, nj: int, first: tuple[float, float], last: tuple[float, float], mode: int) -> dict:
    return {"ni": ni, "nj": nj, "lat": (first[0], last[0]), "lon": (first[1], last[1]), "mode": mode}


def _end(start: datetime, seconds: float) -> datetime:
    return start + timedelta(seconds=seconds)


def fields_2(c: Cursor, discipline: int) -> Iterator[dict]:
    """Fields of an edition 2 message; sections 3 to 7 may repeat, and what isn't repeated stays."""
    at, found = 16, {}
    while at + 4 <= c.size and c.read(at, 4) != b"7777":
        length, number = struct.unpack(">IB", c.read(at, 5))
        if length < 5:
            raise ValueError(f"{c.file.path}: a section of {length} bytes")
        if number == 1:
            s = c.read(at, 21)
            found["start"] = datetime(int.from_bytes(s[12:14], "big"), *s[14:19])
        elif number == 3:
            s = c.read(at, min(length, 72))
            template = int.from_bytes(s[12:14], "big")
            if template != 0:
                raise ValueError(f"{c.file.path}: grid template {template}")
            number_of = lambda i: int.from_bytes(s[i : i + 4], "big")
            basic, parts = number_of(38), number_of(42)
            unit = basic / parts if basic and parts and parts != 0xFFFFFFFF else 1e-6
            found["grid"] = _regular(number_of(30), number_of(34), (signed(s[46:50]) * unit, number_of(50) * unit), (signed(s[55:59]) * unit, number_of(59) * unit), s[71])
        elif number == 4:
            s = c.read(at, length)
            template = int.from_bytes(s[7:9], "big")
            if template not in AT_TIME + OVER_TIME:
                raise ValueError(f"{c.file.path}: product template {template}")
            key = f"{discipline}.{s[9]}.{s[10]}"
            found |= {"var": NAMES.get(key, key), "level_type": s[22], "level": None if s[24:28] == b"\xff" * 4 else signed(s[24:28]) * 10.0 ** -signed(s[23:24])}
            if template in AT_TIME:
                found["end"] = _end(found["start"], int.from_bytes(s[18:22], "big") * UNITS[s[17]])
            else:
                more = 34 if template == 8 else 37  # the member's three bytes stand before
                found["end"] = datetime(int.from_bytes(s[more : more + 2], "big"), *s[more + 2 : more + 7])
        elif number == 5:
            s = c.read(at, length)
            template = int.from_bytes(s[9:11], "big")
            found["pack"] = {"count": int.from_bytes(s[5:9], "big"), "template": template}
            if template == 0:
                found["pack"] |= {"reference": struct.unpack(">f", s[11:15])[0], "binary": signed(s[15:17]), "decimal": signed(s[17:19]), "bits": s[19]}
        elif number == 6:
            kind = c.read(at, 6)[5]
            if kind == 0:
                found["bitmap"] = (at + 6, length - 6)
            elif kind == 255:
                found["bitmap"] = None
            elif kind != 254:
                raise ValueError(f"{c.file.path}: bitmap {kind}")
        elif number == 7:
            yield found | {"data": (at + 5, length - 5)}
        at += length


def fields_1(c: Cursor) -> Iterator[dict]:
    """The field of an edition 1 message."""
    s = c.read(8, int.from_bytes(c.read(8, 3), "big"))
    at = 8 + len(s)
    flags = s[7]
    start = datetime((s[24] - 1) * 100 + s[12], *s[13:17])
    unit, range_kind = UNITS[s[17]], s[20]
    periods = {0: s[18], 1: 0, 10: int.from_bytes(s[18:20], "big")}.get(range_kind, s[19])
    found = {"start": start, "end": _end(start, periods * unit), "var": NAMES_1.get(s[8], f"{s[3]}.{s[8]}"), "level_type": s[9], "level": float(int.from_bytes(s[10:12], "big")), "bitmap": None}
    decimal = signed(s[26:28])
    if not flags & 0x80:
        raise ValueError(f"{c.file.path}: a message without grid")
    g = c.read(at, int.from_bytes(c.read(at, 3), "big"))
    if g[5] != 0:
        raise ValueError(f"{c.file.path}: grid kind {g[5]}")
    two = lambda i: int.from_bytes(g[i : i + 2], "big")
    found["grid"] = _regular(two(6), two(8), (signed(g[10:13]) / 1000, signed(g[13:16]) / 1000), (signed(g[17:20]) / 1000, signed(g[20:23]) / 1000), g[27])
    at += len(g)
    if flags & 0x40:
        length = int.from_bytes(c.read(at, 3), "big")
        if c.read(at + 4, 2) != b"\0\0":
            raise ValueError(f"{c.file.path}: a bitmap by number")
        found["bitmap"] = (at + 6, length - 6)
        at += length
    b = c.read(at, 11)
    length, kind = int.from_bytes(b[:3], "big"), b[3]
    bits = b[10]
    count = ((length - 11) * 8 - (kind & 0x0F)) // bits if bits else 0
    found["pack"] = {"count": count, "template": 0 if not kind & 0xF0 else f"edition 1 flags {kind >> 4}", "reference": ibm_float(b[6:10]), "binary": signed(b[4:6]), "decimal": decimal, "bits": bits}
    yield found | {"data": (at + 11, length - 11)}


def values_of(c: Cursor, f: dict) -> np.ndarray:
    """Numbers of a field as (rows, columns), row 0 north and column 0 west; cells without one NaN."""
    pack, grid = f["pack"], f["grid"]
    if pack["template"] != 0:
        raise ValueError(f"{c.file.path}: packing {pack['template']} has no decoder")
    cells = grid["ni"] * grid["nj"]
    there = None
    if f.get("bitmap"):
        start, length = f["bitmap"]
        there = np.unpackbits(np.frombuffer(c.read(start, length), "u1"), count=cells).astype(bool)
    count = int(there.sum()) if there is not None else cells
    start, length = f["data"]
    packed = unpack_numbers(c.read(start, length), pack["bits"], count)
    value = (pack["reference"] + packed * 2.0 ** pack["binary"]) / 10.0 ** pack["decimal"]
    if there is not None:
        whole = np.full(cells, np.nan)
        whole[there] = value
        value = whole
    mode = grid["mode"]
    field = value.reshape(grid["ni"], grid["nj"]).T if mode & 0x20 else value.reshape(grid["nj"], grid["ni"])
    if mode & 0x10:
        field = field.copy()
        if mode & 0x20:
            field[:, 1::2] = field[::-1, 1::2]
        else:
            field[1::2] = field[1::2, ::-1]
    if mode & 0x40:
        field = field[::-1]
    return field[:, ::-1] if mode & 0x80 else field


def axes_of(grid: dict) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes from north, longitudes from west (-180 to 180 where the first one is beyond 180)."""
    lat = np.linspace(max(grid["lat"]), min(grid["lat"]), grid["nj"])
    west, east = grid["lon"][::-1] if grid["mode"] & 0x80 else grid["lon"]
    if east < west:
        west -= 360
    lon = np.linspace(west, east, grid["ni"])
    return lat, lon - 360 if west >= 180 else lon


class Grib(Format):
    schema = "path string, var string, level_type int, level double, time_start timestamp_ntz, time timestamp_ntz, row int, col int, lat double, lon double, value double"

    def parts(self, file: RangedFile) -> Iterator[Part]:
        for at, size, edition in messages(file):
            cursor = Cursor(file, at, size)
            for f in fields_1(cursor) if edition == 1 else fields_2(cursor, cursor.head[6]):
                shared = {"path": file.path, "var": f["var"], "level_type": f["level_type"], "level": f["level"], "time_start": f["start"], "time": f["end"]}
                # cells outside the bitmap cost rows though not bytes
                yield Part(max(f["data"][1], f["grid"]["ni"] * f["grid"]["nj"] * 4), shared, (at, size, f))

    def batches(self, file: RangedFile, part: Part) -> Iterator[pa.RecordBatch]:
        at, size, f = part.what
        value = values_of(Cursor(file, at, size), f)
        lat, lon = axes_of(f["grid"])
        kinds = {"path": pa.string(), "var": pa.string(), "level_type": pa.int32(), "level": pa.float64(), "time_start": pa.timestamp("us"), "time": pa.timestamp("us")}
        yield from field_batches({k: (part.shared[k], kind) for k, kind in kinds.items()}, value, 0, lambda row, col: (lat[row], lon[col]), self.known)


class GribSource(RangedSource):
    format = Grib

    @classmethod
    def name(cls) -> str:
        return "hydroloom_grib"


def read_grib(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, var, level_type, level, time_start, time, row, col, lat, lon, value) of GRIB files.

    time is the start plus the step, of an accumulated field the end of its interval; var a
    short name, or discipline.category.number (edition 1: table.number).  Row 0 is north,
    column 0 west.  Cells outside the bitmap are NULL.  Filters on path, var, levels and times
    leave other messages' numbers unread.  Files may end in .gz.
    """
    return load(spark, GribSource, path, **options)


def encode(value: np.ndarray, north: float, west: float, step_lat: float, step_lon: float, start: datetime, hours: int, key: tuple[int, int, int], bits: int = 16, decimals: int = 0, level: tuple[int, float] = (1, 0.0), over_hours: int | None = None) -> bytes:
    """An edition 2 message of a field, row 0 at `north`; NaN goes to the bitmap.

    With 2 ^ bits steps that the field's range doesn't need, whole numbers of 10 ^ -decimals are
    kept exactly.  `over_hours`: a field over so many hours up to the step.
    """
    if (over_hours or 0) > hours:
        raise ValueError("the interval begins before the start")
    rows, cols = value.shape
    flat = value.ravel().astype("f8")
    there = ~np.isnan(flat)
    known = np.rint(flat[there] * 10.0**decimals) if decimals else flat[there] * 1.0
    low = known.min() if len(known) else 0.0
    reference = np.float32(low)
    if reference > low:
        reference = np.nextafter(reference, np.float32(-np.inf))
    room = (known.max() - float(reference)) if len(known) else 0.0
    scale = math.ceil(math.log2(room / (2**bits - 1))) if room > 0 else 0
    if decimals:
        scale = max(scale, 0)
    packed = np.rint((known - float(reference)) / 2.0**scale)
    sign = lambda n, size: (abs(n) | (1 << 8 * size - 1 if n < 0 else 0)).to_bytes(size, "big")
    micro = lambda x, size=4: sign(round(x * 1e6), size)
    east, south = west + (cols - 1) * step_lon, north - (rows - 1) * step_lat

    def section(number: int, body: bytes) -> bytes:
        return struct.pack(">IB", len(body) + 5, number) + body

    def stamp(t: datetime) -> bytes:
        return struct.pack(">HBBBBB", t.year, t.month, t.day, t.hour, t.minute, t.second)

    grid = struct.pack(">BIBBH", 0, rows * cols, 0, 0, 0) + bytes([6]) + bytes(15) + struct.pack(">II", cols, rows) + bytes(4) + b"\xff" * 4
    grid += micro(north) + struct.pack(">I", round(west % 360 * 1e6)) + bytes([0x30]) + micro(south) + struct.pack(">I", round(east % 360 * 1e6)) + struct.pack(">II", round(step_lon * 1e6), round(step_lat * 1e6)) + bytes([0])
    digits = 0 if level[1] == int(level[1]) else 2
    begin = hours - (over_hours or 0)
    product = struct.pack(">HH", 0, 8 if over_hours else 0) + bytes([key[1], key[2], 2, 0, 0, 0, 0, 0, 1]) + struct.pack(">I", begin) + bytes([level[0], digits]) + sign(round(level[1] * 10**digits), 4) + b"\xff" * 6
    if over_hours:
        product += stamp(start + timedelta(hours=hours)) + struct.pack(">BIBBBIBI", 1, 0, 1, 2, 1, over_hours, 255, 0)
    body = section(1, struct.pack(">HHBBB", 0, 0, 2, 1, 1) + stamp(start) + bytes([0, 1])) + section(3, grid) + section(4, product)
    body += section(5, struct.pack(">IHf", int(there.sum()), 0, reference) + sign(scale, 2) + sign(decimals, 2) + bytes([bits, 0]))
    body += section(6, bytes([255]) if there.all() else bytes([0]) + np.packbits(there).tobytes())
    body += section(7, pack_numbers(packed, bits)) + b"7777"
    return b"GRIB" + bytes([0, 0, key[0], 2]) + struct.pack(">Q", len(body) + 16) + body
