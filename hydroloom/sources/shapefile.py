"""Shapefiles: shapes as WKT with their attributes, read by runs of records.

The index file says where each record lies, so a run of records is one byte range of the main
file and, as attributes have fixed width, one of the table; shape and attributes meet by record
number without a join.  Without an index the main file's record heads are walked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import date
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hydroloom.sources.ranged import Format, Part, RangedFile, RangedReader, RangedSource, list_files, load

#: Fixed values of the format: kinds of shapes; those with Z are 10 more, those with M 20.
NOTHING, POINT, LINE, POLYGON, POINTS = 0, 1, 3, 5, 8
#: Types of a table's fields.
FIELD_TYPES = {"C": "string", "N": "double", "F": "double", "L": "boolean", "D": "date"}
#: Records of one part.
RUN = 10_000


def beside(path: str, ending: str) -> RangedFile | None:
    """The file of the same name with another ending, in small or capital letters."""
    for end in (ending, ending.upper()):
        try:
            return RangedFile(path[: -len(ending)] + end)
        except FileNotFoundError:
            continue
    return None


class Table:
    """Head of an attribute table: where records begin, and (name, type, offset, width) of its fields."""

    def __init__(self, file: RangedFile):
        head = file.read(0, 32)
        self.count, self.start, self.width = struct.unpack("<IHH", head[4:12])
        raw = file.read(32, self.start - 32)
        self.fields, at = [], 1
        for i in range(0, len(raw) - 31, 32):
            if raw[i] == 0x0D:
                break
            kind, width, digits = chr(raw[i + 11]), raw[i + 16], raw[i + 17]
            name = raw[i : i + 11].split(b"\0")[0].decode("utf-8", "replace")
            own = "long" if kind == "N" and not digits and width <= 18 else FIELD_TYPES.get(kind, "string")
            self.fields.append((name, own, at, width))
            at += width

    @staticmethod
    def value(raw: bytes, kind: str, encoding: str) -> Any:
        text = raw.decode(encoding, "replace").strip(" \0")
        if kind == "string":
            return text or None
        if kind == "boolean":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        try:
            if kind == "date":
                return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
            return int(text) if kind == "long" else float(text)
        except ValueError:
            return None


def _ring(points: np.ndarray) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in points.tolist()) + ")"


def _area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    """Whether a ring holds a point, by the edges that a ray to the east crosses."""
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    over = (y0 > point[1]) != (y1 > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((over & (point[0] < x0 + (point[1] - y0) / (y1 - y0) * (x1 - x0))).sum() % 2)


def wkt(content: bytes) -> str | None:
    """A record's shape as text, of Z and M shapes the plane part; clockwise rings are outer ones, others holes in the first that holds them."""
    (kind,) = struct.unpack_from("<i", content)
    kind = kind % 10 if kind > 10 else kind
    if kind == NOTHING:
        return None
    if kind == POINT:
        x, y = struct.unpack_from("<2d", content, 4)
        return f"POINT ({x!r} {y!r})"
    if kind == POINTS:
        (n,) = struct.unpack_from("<i", content, 36)
        return "MULTIPOINT " + _ring(np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2))
    if kind not in (LINE, POLYGON):
        raise ValueError(f"shape kind {kind}")
    parts, n = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", parts, 44)
    points = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2)
    rings = np.split(points, starts[1:])
    if kind == LINE:
        return f"LINESTRING {_ring(rings[0])}" if parts == 1 else f"MULTILINESTRING ({', '.join(map(_ring, rings))})"
    outer = [[r] for r in rings if _area(r) <= 0]
    for hole in (r for r in rings if _area(r) > 0):
        home = next((o for o in outer if _holds(o[0], hole[0])), None)
        if home is None:
            outer.append([hole])  # a ring the wrong way round stands alone
        else:
            home.append(hole)
    shown = ["(" + ", ".join(map(_ring, o)) + ")" for o in outer]
    return f"POLYGON {shown[0]}" if len(shown) == 1 else f"MULTIPOLYGON ({', '.join(shown)})"


class Shapefile(Format):
    ending = ".shp"

    def __init__(self, options: dict[str, str], fields: list[tuple[str, str]]):
        super().__init__(options)
        self.fields, self.encoding = fields, options.get("encoding", "utf-8")

    def parts(self, file: RangedFile) -> Iterator[Part]:
        head = file.read(0, 100)
        if struct.unpack_from(">i", head)[0] != 9994:
            raise ValueError(f"{file.path}: no shapefile")
        end = min(2 * struct.unpack_from(">i", head, 24)[0], file.size)
        index = beside(file.path, ".shx")
        if index is not None:
            with index:
                places = np.frombuffer(index.read(100, (index.size - 100) // 8 * 8), ">i4").reshape(-1, 2).astype("i8") * 2
        else:
            found, at = [], 100
            while at + 8 <= end:
                size = 2 * struct.unpack_from(">i", file.read(at, 8), 4)[0]
                found.append((at, size))
                at += 8 + size
            places = np.array(found, "i8").reshape(-1, 2)
        for first in range(0, len(places), RUN):
            run = places[first : first + RUN]
            yield Part(int(run[:, 1].sum()) + 8 * len(run), {"path": file.path}, (first, run))

    def batches(self, file: RangedFile, part: Part) -> Iterator[pa.RecordBatch]:
        first, run = part.what
        low = int(run[:, 0].min())
        block = file.read(low, int((run[:, 0] + run[:, 1]).max()) + 8 - low)
        shapes = [wkt(block[at - low + 8 : at - low + 8 + size]) for at, size in run.tolist()]
        columns: dict[str, list] = {name: [None] * len(run) for name, _ in self.fields}
        table = beside(file.path, ".dbf")
        gone = np.zeros(len(run), bool)
        if table is not None:
            with table:
                head = Table(table)
                many = max(0, min(len(run), head.count - first))
                raw = table.read(head.start + first * head.width, many * head.width)
                gone[:many] = [raw[i * head.width] == 0x2A for i in range(many)]
                for name, kind, at, width in head.fields:
                    if (name, kind) in self.fields:
                        columns[name][:many] = [Table.value(raw[i * head.width + at : i * head.width + at + width], kind, self.encoding) for i in range(many)]
        kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "date": pa.date32()}
        arrays = [pa.array([file.path] * len(run), pa.string()), pa.array(np.arange(first, first + len(run), dtype="i4")), pa.array(shapes, pa.string()), *[pa.array(columns[n], kinds[k]) for n, k in self.fields]]
        batch = pa.RecordBatch.from_arrays(arrays, names=["path", "record", "geometry", *[n for n, _ in self.fields]])
        yield batch.filter(pa.array(~gone)) if gone.any() else batch


class ShapefileSource(RangedSource):
    @classmethod
    def name(cls) -> str:
        return "hydroloom_shapefile"

    def fields(self) -> list[tuple[str, str]]:
        """Fields of the first file's table; one named like the columns before it is left out."""
        for path, _ in list_files(self.options["path"]):
            if path.lower().endswith(".shp"):
                table = beside(path, ".dbf")
                if table is None:
                    return []
                with table:
                    found = {n.lower(): (n, k) for n, k, *_ in reversed(Table(table).fields)}
                return [f for n, f in reversed(found.items()) if n not in ("path", "record", "geometry")]
        return []

    def schema(self) -> str:
        return ", ".join(["path string", "record int", "geometry string", *[f"`{n}` {k}" for n, k in self.fields()]])

    def reader(self, schema: Any) -> RangedReader:
        options = dict(self.options)
        names = [(f.name, {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in schema.fields[3:]]
        return RangedReader(Shapefile(options, names), options["path"], options)


def read_shapefile(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, record, geometry, attributes ...) of shapefiles; record counts from 0.

    geometry is WKT, NULL for a null shape.  Attributes are those of the first file's table;
    what another file lacks, blanks and what is no number or date are NULL.  Deleted records
    have no row.  Option encoding: that of texts.
    """
    return load(spark, ShapefileSource, path, **options)


def encode(shapes: list[tuple[int, list[np.ndarray]] | None], kind: int, fields: list[tuple[str, str, int, int]], rows: list[list]) -> dict[str, bytes]:
    """The bytes of `.shp`, `.shx` and `.dbf`; shapes as lists of parts (arrays of x, y), None: a null shape.

    fields: (name, type letter, width, digits); rows: a value a field each.
    """
    records, index, at = [], [], 50
    every = np.concatenate([p for s in shapes if s for p in s[1]] or [np.zeros((1, 2))])
    box = struct.pack("<4d", *every.min(0), *every.max(0))
    for i, shape in enumerate(shapes):
        if shape is None:
            content = struct.pack("<i", NOTHING)
        elif kind == POINT:
            content = struct.pack("<i2d", POINT, *shape[1][0][0])
        else:
            points = np.concatenate(shape[1])
            starts = np.cumsum([0, *map(len, shape[1])])[:-1]
            content = struct.pack("<i4d", kind, *points.min(0), *points.max(0))
            content += struct.pack("<i", len(points)) if kind == POINTS else struct.pack("<2i", len(starts), len(points)) + starts.astype("<i4").tobytes()
            content += points.astype("<f8").tobytes()
        records.append(struct.pack(">2i", i + 1, len(content) // 2) + content)
        index.append(struct.pack(">2i", at, len(content) // 2))
        at += len(records[-1]) // 2

    def head(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, kind) + box + bytes(32)

    def cell(value: Any, letter: str, width: int, digits: int) -> bytes:
        shown = "" if value is None else value.strftime("%Y%m%d") if letter == "D" else "T" if value is True else "F" if value is False else f"{value:.{digits}f}" if letter in "NF" else str(value)
        raw = shown.encode()[:width]
        return raw.rjust(width) if letter in "NF" else raw.ljust(width)

    width = 1 + sum(f[2] for f in fields)
    shown = b"".join(n.encode()[:10].ljust(11, b"\0") + t.encode() + bytes(4) + bytes([w, d]) + bytes(14) for n, t, w, d in fields)
    table = struct.pack("<4BIHH", 3, 124, 1, 1, len(rows), 33 + len(shown), width) + bytes(20) + shown + b"\r"
    table += b"".join(b" " + b"".join(cell(v, *f[1:]) for v, f in zip(row, fields, strict=True)) for row in rows) + b"\x1a"
    return {".shp": head(at) + b"".join(records), ".shx": head(50 + 4 * len(index)) + b"".join(index), ".dbf": table}
