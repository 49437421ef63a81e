"""Spark data sources over binary files whose parts can be read alone, by byte range.

A format says how a file's header tells its parts (strips, tiles, messages, runs of steps or
records: where they lie and what they hold) and how one part's bytes become Arrow batches.  The
base does the rest: it lists the files, plans the parts, leaves out those that a filter on
their columns rules out, and gathers them to partitions of about `partition_bytes`.

Headers of up to PLANNED files are read by the driver, a few reads each.  Of more files each is
planned by the task that reads it, so that planning never waits for one machine; parallelism
then comes from the files.

Paths are those of Arrow's file systems: local and shared folders, file://, hdfs://, s3://,
gs://.  A folder means its files, a name may hold * and ?.  A file ending in .gz can't be read
by range: one task streams it into a scratch file of its own, which goes with the task's read.
"""

from __future__ import annotations

import fnmatch
import gzip
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Files whose headers the driver reads, at so many at a time; bytes of one partition.
PLANNED, AT_ONCE, PARTITION_BYTES = 1_000, 32, 16 << 20
#: Bytes of an unpacked file that stay in memory.
SPOOL = 64 << 20
#: Cells of a field that become one batch.
CELLS = 1 << 17


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path means, by name; hidden ones (`.`, `_`) are left out."""
    system, own = place(path)
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    hidden = lambda p: p.rsplit("/", 1)[-1][:1] in ("_", ".")
    if "*" in own or "?" in own:
        at = min(own.find(c) for c in "*?" if c in own)
        base = own[:at].rsplit("/", 1)[0]
        found = system.get_file_info(fs.FileSelector(base or "/", recursive=True))
        levels = own.count("/")
        found = [f for f in found if f.path.count("/") == levels and all(fnmatch.fnmatchcase(a, b) for a, b in zip(f.path.split("/"), own.split("/"), strict=True))]
    else:
        info = system.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


class RangedFile:
    """A file's bytes by range."""

    def __init__(self, path: str):
        self.path = path
        system, own = place(path)
        if path.endswith(".gz"):
            self.held = tempfile.SpooledTemporaryFile(SPOOL)  # noqa: SIM115
            with system.open_input_stream(own, compression=None) as packed, gzip.GzipFile(fileobj=packed) as stream:
                shutil.copyfileobj(stream, self.held, 1 << 20)
            self.size = self.held.tell()
        else:
            self.held = system.open_input_file(own)
            self.size = self.held.size()

    def read(self, start: int, length: int) -> bytes:
        self.held.seek(start)
        got = self.held.read(length)
        if len(got) != length:
            raise ValueError(f"{self.path}: ends before byte {start + length}")
        return got

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_: Any) -> None:
        self.held.close()


@dataclass
class Part:
    """What a task reads: bytes of it, values of columns that all its rows share (for filters), and what the format needs."""

    bytes: int
    shared: dict[str, Any] = field(default_factory=dict)
    what: Any = None


@dataclass
class Work(InputPartition):
    """Parts of files; None: all parts of the file, not yet planned."""

    files: list[tuple[str, list[Part] | None]]

    def __init__(self, files: list[tuple[str, list[Part] | None]]):
        self.files = files


class Format:
    """One file format; instances are sent to tasks."""

    schema = ""
    #: What the names of files end in, or of all.
    ending = ""
    #: Whether only rows with a value are asked for; a format may leave the others out.
    known = False

    def __init__(self, options: dict[str, str]):
        self.options = options

    def parts(self, file: RangedFile) -> Iterable[Part]:
        raise NotImplementedError

    def batches(self, file: RangedFile, part: Part) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def field_batches(shared: dict[str, tuple[Any, pa.DataType]], values: np.ndarray, first: int, axes: Any, known: bool) -> Iterator[pa.RecordBatch]:
    """Rows (shared columns, row, col, lat, lon, value) of a run of a field's rows that begins at row `first`, about CELLS in a batch.

    axes: gives (lat, lon) of cells by (row, col), and is asked only if there are such; NaN is
    NULL, or has no row if only known values are asked for.
    """
    cols = values.shape[1]
    step = max(1, CELLS // max(cols, 1))
    for low in range(0, len(values), step):
        value = values[low : low + step].ravel()
        none = np.isnan(value)
        at = np.flatnonzero(~none) if known else np.arange(len(value))
        if not len(at):
            continue
        row, col = np.divmod(at, cols)
        row = (row + first + low).astype("i4")
        lat, lon = axes(row, col)
        zero = pa.array(np.zeros(len(at), "i4"))
        same = [pa.array([v], kind).take(zero) for v, kind in shared.values()]
        yield pa.RecordBatch.from_arrays([*same, pa.array(row), pa.array(col.astype("i4")), pa.array(lat), pa.array(lon), pa.array(value[at], mask=none[at])], names=[*shared, "row", "col", "lat", "lon", "value"])


_HOLDS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class RangedReader(DataSourceReader):
    """Reads the parts that no filter rules out.

    Filters on a column that a part shares with all its rows leave parts out, and a format may
    leave out rows without a value if the filter is that there is one; Spark still applies them
    to the rows.
    """

    def __init__(self, format: Format, path: str, options: dict[str, str]):
        self.format, self.path, self.filters = format, path, []
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.planned = int(options.get("planned_files", PLANNED))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.filters = [f for f in filters if type(f) in _HOLDS and len(f.attribute) == 1]
        self.format.known = any(isinstance(f, IsNotNull) and f.attribute == ("value",) for f in filters)
        return filters

    def wanted(self, part: Part) -> bool:
        return all(part.shared[f.attribute[0]] is not None and _HOLDS[type(f)](part.shared[f.attribute[0]], f.value) for f in self.filters if f.attribute[0] in part.shared)

    def plan(self, path: str) -> list[Part]:
        with RangedFile(path) as file:
            return [p for p in self.format.parts(file) if self.wanted(p)]

    def partitions(self) -> list[Work]:
        files = [f for f in list_files(self.path) if f[0].lower().endswith(self.format.ending)]
        if len(files) > self.planned:
            plans = [None] * len(files)
        else:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                plans = list(pool.map(lambda f: None if f[0].endswith(".gz") else self.plan(f[0]), files))
        out, held, size = [], [], 0
        for (path, length), parts in zip(files, plans, strict=True):
            # what a packed file holds isn't known from its size: it is a partition, unless files are many
            if path.endswith(".gz") and len(files) <= self.planned:
                length = max(length, self.partition_bytes)
            for one in [None] if parts is None else parts:
                own = length if one is None else one.bytes
                if held and size + own > self.partition_bytes:
                    out.append(Work(held))
                    held, size = [], 0
                if held and held[-1][0] == path:
                    held[-1][1].append(one)
                else:
                    held.append((path, None if one is None else [one]))
                size += own
        return [*out, Work(held)] if held else out or [Work([])]

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        for path, parts in partition.files:
            with RangedFile(path) as file:
                for part in [p for p in self.format.parts(file) if self.wanted(p)] if parts is None else parts:
                    yield from self.format.batches(file, part)


class RangedSource(DataSource):
    """A data source of one format: `spark.read.format(name).option(...).load(path)`."""

    format: type[Format]

    def schema(self) -> str:
        return self.format.schema

    def reader(self, schema: Any) -> RangedReader:
        options = dict(self.options)
        if "path" not in options:
            raise ValueError("no path")
        return RangedReader(self.format(options), options["path"], options)


def load(spark: SparkSession, source: type[RangedSource], path: str, **options) -> DataFrame:
    """The rows of a source; switches Spark's setting of Python filters on in this session, which such readers need."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).options(**options).load(path)
