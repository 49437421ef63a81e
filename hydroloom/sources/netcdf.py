"""Classic NetCDF files (CDF-1 and CDF-2): fields by step, decoded with numpy; NetCDF-4 is HDF5 and raises.

A field's step is one part of a file: its bytes are read alone, and only if no filter on
variable or time rules it out.  A task holds a run of a step's rows and their coordinates, so
its memory doesn't grow with the grid; axes of one dimension are read once a task and file.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hydroloom.model import NO_DATA
from hydroloom.sources import ranged
from hydroloom.sources.ranged import Format, Part, RangedFile, RangedSource, field_batches, load

#: Fixed values of the format: number types in the order of their codes 1 to 6, and list tags.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Seconds in the units of a time axis.
UNITS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}
#: First bytes read for a header; doubled until it fits.
HEAD_BYTES = 1 << 14

Read = Callable[[int, int], bytes]


def _up4(n: int) -> int:
    return -(-n // 4) * 4


class Header:
    """Dimensions, variables and their places in the bytes of one file."""

    def __init__(self, read: Read, size: int, name: str):
        if size < 8 or (start := read(0, 4))[:3] != b"CDF" or start[3] not in (1, 2):
            raise ValueError(f"{name}: no classic NetCDF file")
        self.read = read
        room = HEAD_BYTES
        while True:
            self.content, self.at = read(0, min(room, size)), 4
            try:
                self._parse(size)
                break
            except (struct.error, EOFError):
                if room >= size:
                    raise ValueError(f"{name}: damaged header") from None
                room *= 2
        del self.content

    def _parse(self, size: int) -> None:
        self.offset = ">i" if self.content[3] == 1 else ">q"
        records = self._number(">I")
        self.dims = [(self._text(), self._number()) for _ in range(self._count(DIMENSION))]
        self.about = self._attributes()
        self.vars = {}
        for _ in range(self._count(VARIABLE)):
            var = self._text()
            dims = [self._number() for _ in range(self._number())]
            about, kind, held, begin = self._attributes(), self._number(), self._number(">I"), self._number(self.offset)
            self.vars[var] = {"dims": [self.dims[d][0] for d in dims], "shape": [self.dims[d][1] for d in dims], "about": about, "type": np.dtype(TYPES[kind]), "size": held, "begin": begin}
        grown = [v for v in self.vars.values() if v["shape"][:1] == [0]]
        for v in grown:
            # a lone record variable is not padded; the stored size may be cut off for large ones
            width = math.prod(v["shape"][1:]) * v["type"].itemsize
            v["size"] = width if len(grown) == 1 else _up4(width)
        self.stride = sum(v["size"] for v in grown)
        if records == 2**32 - 1 and grown:
            records = (size - min(v["begin"] for v in grown)) // self.stride
        self.records = records

    def _number(self, kind: str = ">i") -> int:
        (n,) = struct.unpack_from(kind, self.content, self.at)
        self.at += struct.calcsize(kind)
        return n

    def _bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.content):
            raise EOFError
        out = self.content[self.at : self.at + n]
        self.at += _up4(n)
        return out

    def _text(self) -> str:
        return self._bytes(self._number()).decode()

    def _count(self, tag: int) -> int:
        found, n = self._number(), self._number()
        if found not in (0, tag):
            raise ValueError("damaged header")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._count(ATTRIBUTE)):
            name, kind, n = self._text(), np.dtype(TYPES[self._number()]), self._number()
            raw = self._bytes(n * kind.itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind.kind == "S" else np.frombuffer(raw, kind).astype("f8")
        return out

    def length(self, var: str) -> int:
        """Steps along the first dimension."""
        first = self.vars[var]["shape"][0]
        return first or self.records

    def bytes_of(self, var: str, step: bool) -> int:
        v = self.vars[var]
        return math.prod(v["shape"][1:] if step else [n or self.records for n in v["shape"]]) * v["type"].itemsize

    def part(self, var: str, step: int | None = None, rows: tuple[int, int] | None = None) -> np.ndarray:
        """The values of one step along the first dimension, or all; packed numbers scaled, fill values NaN.

        rows: only these of the first dimension that is left.
        """
        v = self.vars[var]
        if step is None and v["shape"][:1] == [0]:
            steps = range(self.records)[slice(*rows)] if rows else range(self.records)
            return np.stack([self.part(var, i) for i in steps]) if steps else np.empty((0, *v["shape"][1:]))
        shape = v["shape"] if step is None else v["shape"][1:]
        begin = v["begin"] + (step or 0) * (self.stride if v["shape"][:1] == [0] else math.prod(shape) * v["type"].itemsize)
        if rows:
            begin += rows[0] * math.prod(shape[1:]) * v["type"].itemsize
            shape = [rows[1] - rows[0], *shape[1:]]
        width = math.prod(shape) * v["type"].itemsize
        raw = np.frombuffer(self.read(begin, width), v["type"]).astype("f8").reshape(shape)
        about = v["about"]
        for mark in ("_FillValue", "missing_value"):
            if mark in about and not isinstance(about[mark], str):
                raw[np.isin(raw, about[mark])] = np.nan
        return raw * about.get("scale_factor", [1.0])[0] + about.get("add_offset", [0.0])[0]

    def times(self, time: str) -> np.ndarray:
        """Times of the axis in microseconds since 1970; not a time where the axis has no units of the form `hours since 2000-01-01 00:00:00`."""
        steps = self.part(time).ravel()
        said = re.match(r"\s*(\w+?)s?\s+since\s+(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2}):(\d{2}))?", str(self.vars[time]["about"].get("units", "")))
        out = np.full(len(steps), np.datetime64("NaT", "us"))
        if said and said[1].lower() in UNITS:
            base = np.datetime64("{:04d}-{:02d}-{:02d}T{:02d}:{:02d}:{:02d}".format(*(int(g or 0) for g in said.groups()[1:])), "us")
            known = ~np.isnan(steps)
            out[known] = base + np.round(steps[known] * UNITS[said[1].lower()] * 1e6).astype("m8[us]")
        return out


class NetCdf(Format):
    """Fields over (time, y, x) or (y, x); options y, x and time name dimensions and their coordinates, which have one dimension or two."""

    schema = "path string, var string, time timestamp_ntz, row int, col int, lat double, lon double, value double"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.time = options.get("time", "time")
        self.y, self.x = options.get("y", "lat"), options.get("x", "lon")
        self.axis_y, self.axis_x = options.get("lat", self.y), options.get("lon", self.x)
        self.last = None

    def head(self, file: RangedFile) -> Header:
        """The file's header and axes, once a task and file."""
        if self.last is None or self.last[0] is not file:
            self.last = (file, Header(file.read, file.size, file.path), {})
        return self.last[1]

    def parts(self, file: RangedFile) -> Iterator[Part]:
        head = self.head(file)
        times = head.times(self.time) if self.time in head.vars else None
        for name, v in head.vars.items():
            if v["dims"] not in ([self.time, self.y, self.x], [self.y, self.x]) or name in (self.axis_y, self.axis_x) or v["type"].kind == "S":
                continue
            timed = v["dims"][0] == self.time
            for i in range(head.length(name)) if timed else [None]:
                when = times[i].item() if timed and times is not None else None
                yield Part(head.bytes_of(name, timed), {"path": file.path, "var": name, "time": when}, (name, i))
        self.last = None

    def batches(self, file: RangedFile, part: Part) -> Iterator[pa.RecordBatch]:
        head, axes = self.head(file), self.last[2]
        name, step = part.what
        rows, cols = [n or head.records for n in head.vars[name]["shape"][-2:]]
        shared = {"path": (file.path, pa.string()), "var": (name, pa.string()), "time": (part.shared["time"], pa.timestamp("us"))}
        run = max(1, ranged.CELLS // max(cols, 1))
        for low in range(0, rows, run):
            high = min(rows, low + run)

            def placed(row: np.ndarray, col: np.ndarray, low: int = low, high: int = high) -> list[np.ndarray]:
                out = []
                for axis, along in ((self.axis_y, row), (self.axis_x, col)):
                    flat = len(head.vars[axis]["dims"]) == 2
                    key = (low, high) if flat else None
                    if axis not in axes or axes[axis][1] != key:
                        axes[axis] = (head.part(axis, None, key), key)
                    held = axes[axis][0]
                    out.append(held[row - low, col] if flat else held[along])
                return out

            yield from field_batches(shared, head.part(name, step, (low, high)), low, placed, self.known)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"last": None}


class NetCdfSource(RangedSource):
    format = NetCdf

    @classmethod
    def name(cls) -> str:
        return "hydroloom_netcdf"


def read_netcdf(spark: SparkSession, path: str, y: str = "lat", x: str = "lon", time: str = "time", **options) -> DataFrame:
    """(path, var, time, row, col, lat, lon, value) of the fields of classic NetCDF files.

    Fields are variables over (time, y, x) or (y, x); others are left out.  y and x name both
    the dimensions and their coordinates (options lat and lon: other names of these).  Missing
    values and NaN are NULL, and so is the time of a field without one.  Filters on path, var
    and time leave the bytes of other steps unread.  Files may end in .gz.
    """
    return load(spark, NetCdfSource, path, y=y, x=x, time=time, **options)


class _Bytes:
    """A file in memory."""

    def __init__(self, path: str, content: bytes):
        self.path, self.content, self.size = path, content, len(content)

    def read(self, start: int, length: int) -> bytes:
        if start + length > self.size:
            raise ValueError(f"{self.path}: ends before byte {start + length}")
        return self.content[start : start + length]


def decode(files: DataFrame, y: str = "lat", x: str = "lon", time: str = "time") -> DataFrame:
    """What `read_netcdf` gives, of files as rows (path, content)."""

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        form = NetCdf({"y": y, "x": x, "time": time})
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = _Bytes(path, content)
                for part in list(form.parts(file)):
                    yield from form.batches(file, part)

    return files.select("path", "content").mapInArrow(fields, NetCdf.schema)


def encode(grid: DataFrame, no_data: float = NO_DATA) -> DataFrame:
    """(time, content): one classic NetCDF file (CDF-2) for each time of a regular field.

    Axes are the step's own latitudes, falling, and longitudes, rising; cells without a value
    hold `no_data`, which is the fill value.  A task holds one step; files of many steps:
    `hydroloom.sinks.netcdf`.
    """

    def file(step: pd.DataFrame) -> pd.DataFrame:
        lat, row = np.unique(-step["lat"].to_numpy(), return_inverse=True)
        lon, col = np.unique(step["lon"].to_numpy(), return_inverse=True)
        names = sorted(step["var"].unique())
        hours = (step["time"].iloc[0] - pd.Timestamp(1970, 1, 1)) / pd.Timedelta(hours=1)
        about = {"time": {"units": "hours since 1970-01-01 00:00:00"}, "lat": {"units": "degrees_north"}, "lon": {"units": "degrees_east"}}
        arrays = [("time", ["time"], np.array([hours])), ("lat", ["lat"], -lat), ("lon", ["lon"], lon)]
        value = step["value"].fillna(no_data).to_numpy()
        for name in names:
            field = np.full((1, len(lat), len(lon)), no_data)
            of = (step["var"] == name).to_numpy()
            field[0, row[of], col[of]] = value[of]
            arrays.append((name, ["time", "lat", "lon"], field))
            about[name] = {"_FillValue": np.array([no_data])}
        head, _ = header({"time": 1, "lat": len(lat), "lon": len(lon)}, [(n, dims, ">f8", about[n]) for n, dims, _ in arrays], {})
        content = head + b"".join(a.astype(">f8").tobytes() for _, _, a in arrays)
        return pd.DataFrame({"time": [step["time"].iloc[0]], "content": [content]})

    return grid.select("var", "time", "lat", "lon", "value").groupBy("time").applyInPandas(file, "time timestamp_ntz, content binary")


def header(dims: dict[str, int], variables: list[tuple[str, list[str], str, dict]], about: dict) -> tuple[bytes, dict[str, int]]:
    """A CDF-2 header and where each variable begins, without record dimension.

    variables: (name, dimensions, number type, attributes) in the order of their bytes; attributes are
    strings or arrays of numbers.
    """
    codes = {np.dtype(t): code for code, t in TYPES.items() if code != 2}
    place = {d: i for i, d in enumerate(dims)}

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw.ljust(_up4(len(raw)), b"\0")

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def note(name: str, value) -> bytes:
        if isinstance(value, str):
            return text(name) + struct.pack(">i", 2) + text(value)
        array = np.atleast_1d(value)
        array = array.astype(array.dtype.newbyteorder(">"))
        raw = array.tobytes()
        return text(name) + struct.pack(">ii", codes[array.dtype], len(array)) + raw.ljust(_up4(len(raw)), b"\0")

    sizes = [math.prod(dims[d] for d in of) * np.dtype(kind).itemsize for _, of, kind, _ in variables]

    def whole(begins: list[int]) -> bytes:
        shown = [
            text(name) + struct.pack(f">{len(of) + 1}i", len(of), *(place[d] for d in of)) + listed(ATTRIBUTE, [note(k, v) for k, v in notes.items()])
            + struct.pack(">iIq", codes[np.dtype(kind)], min(_up4(size), 2**32 - 1), begin)
            for (name, of, kind, notes), size, begin in zip(variables, sizes, begins, strict=True)
        ]
        return b"CDF\x02" + struct.pack(">i", 0) + listed(DIMENSION, [text(d) + struct.pack(">i", n) for d, n in dims.items()]) + listed(ATTRIBUTE, [note(k, v) for k, v in about.items()]) + listed(VARIABLE, shown)

    begins = np.concatenate(([0], np.cumsum([_up4(s) for s in sizes])[:-1])) + len(whole([0] * len(variables))) if variables else []
    begins = [int(b) for b in begins]
    return whole(begins), {name: b for (name, *_), b in zip(variables, begins, strict=True)}


def stored(array: np.ndarray, kind: str) -> bytes:
    """Numbers as a file holds them, to the next fourth byte."""
    raw = array.astype(kind).tobytes()
    return raw.ljust(_up4(len(raw)), b"\0")

