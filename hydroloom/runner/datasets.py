"""Dataset handles: which files a dataset's times stand in, which of them there are, and frames shared by readers.

A dataset is a path pattern (`%Y %m %d %H %M` and `{tags}`).  Expected times become paths by the
time signature of the pattern, and meet the listing of files by path, an equi-join; many times
may stand in one file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.functions.times import time_signature
from hydroloom.sources import binary, ranged

#: Fields of a pattern as Spark formats them.
FIELDS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "s": "ss"}
LISTING = "path string, length long"


@dataclass(frozen=True)
class Dataset:
    """A name, the pattern of its files' paths, values of the pattern's tags, and how many times one read asks for."""

    name: str
    pattern: str
    tags: Mapping[str, str] = field(default_factory=dict)
    steps: int = 1


def path_of(time: Column, pattern: str, tags: Mapping[str, str | Column]) -> Column:
    """The path that a pattern gives a time; tags without a value raise."""
    pieces, at = [], 0
    for found in re.finditer(r"%([YmdHMs])|\{(\w+)\}", pattern):
        if found.start() > at:
            pieces.append(F.lit(pattern[at : found.start()]))
        if found[1]:
            pieces.append(F.date_format(time, FIELDS[found[1]]))
        elif found[2] not in tags:
            raise KeyError(f"no value of {{{found[2]}}} in {pattern}")
        else:
            value = tags[found[2]]
            pieces.append(value if isinstance(value, Column) else F.lit(value))
        at = found.end()
    return F.concat(*pieces, F.lit(pattern[at:]))


def placed(datasets: Sequence[Dataset], expected: DataFrame) -> DataFrame:
    """(dataset, time, signature, path) of the expected times (dataset, time); names without a dataset raise nothing and have no row."""
    parts = []
    for d in datasets:
        own = expected.filter(F.col("dataset") == d.name).select("dataset", F.col("time").cast("timestamp_ntz").alias("time")).distinct()
        signature = time_signature(F.col("time"), d.pattern, d.steps)
        parts.append(own.withColumn("signature", signature).withColumn("path", path_of(F.col("signature"), d.pattern, {"dataset": d.name} | dict(d.tags))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inventory(datasets: Sequence[Dataset], expected: DataFrame, listing: DataFrame) -> DataFrame:
    """(dataset, signature, path, steps, state, length): a row for each file that the expected times stand in.

    steps: expected times in the file; state: found, empty (a file of no bytes) or missing.
    `listing` has (path, length); a path listed twice counts once, as its longest.
    """
    files = placed(datasets, expected).groupBy("dataset", "path").agg(F.min("signature").alias("signature"), F.count("*").alias("steps"))
    there = listing.groupBy(F.col("path").alias("listed")).agg(F.max("length").alias("length"))
    met = files.join(there, F.col("path") == F.col("listed"), "left")
    state = F.when(F.col("listed").isNull(), "missing").when(F.coalesce("length", F.lit(0)) == 0, "empty").otherwise("found")
    return met.select("dataset", "signature", "path", "steps", state.alias("state"), "length")


def missing_steps(datasets: Sequence[Dataset], expected: DataFrame, listing: DataFrame) -> DataFrame:
    """(dataset, time, path, state) of the expected times whose file is missing or empty."""
    gone = inventory(datasets, expected, listing).filter("state != 'found'").select(F.col("dataset").alias("of"), F.col("path").alias("at"), "state")
    times = placed(datasets, expected)
    return times.join(gone, (F.col("dataset") == F.col("of")) & (F.col("path") == F.col("at"))).select("dataset", "time", "path", "state")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder, without their contents."""
    return spark.createDataFrame(ranged.list_files(path), LISTING)


class Datasets:
    """Datasets of one run: reads what there is, and holds what several steps read.

    `readers` says how many steps will read each name; a frame with more than one is persisted
    at its first read and released after its last.
    """

    def __init__(self, spark: SparkSession, datasets: Sequence[Dataset], readers: Mapping[str, int] | None = None):
        self.spark, self.datasets, self.left = spark, {d.name: d for d in datasets}, dict(readers or {})
        self.held: dict[str, DataFrame] = {}

    def files(self, name: str, times: DataFrame, listing: DataFrame, strict: bool = True) -> list[str]:
        """Paths of the found files that the times (time) stand in, in order; `strict` raises if one is missing or empty.

        A row a file comes to the driver, which names them to the reader.
        """
        found = inventory([self.datasets[name]], times.select(F.lit(name).alias("dataset"), "time"), listing).orderBy("signature", "path").collect()
        gone = [r["path"] for r in found if r["state"] != "found"]
        if strict and gone:
            raise FileNotFoundError(f"{name}: {len(gone)} of {len(found)} files are missing, the first is {gone[0]}")
        return [r["path"] for r in found if r["state"] == "found"]

    def read(self, name: str, times: DataFrame, listing: DataFrame, strict: bool = True, **options) -> DataFrame | None:
        """The frame of a dataset's files for some times; None if there is no file and `strict` is off."""
        paths = self.files(name, times, listing, strict)
        frames = [binary.read(self.spark, p, **options) for p in paths]
        if not frames:
            return None
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    @contextmanager
    def reading(self, name: str, make) -> Iterator[DataFrame]:
        """A reader's frame, made by `make()` when the first one asks; counts down at the end, also of a failed one."""
        if name not in self.held:
            frame = make()
            self.held[name] = frame.persist() if self.left.get(name, 1) > 1 else frame
        try:
            yield self.held[name]
        finally:
            self.left[name] = self.left.get(name, 1) - 1
            if self.left[name] <= 0:
                self.held.pop(name).unpersist()
                self.left.pop(name)

    def waiting(self) -> dict[str, int]:
        """Names that are held and how many readers they wait for."""
        return {n: self.left.get(n, 1) for n in self.held}
