"""Dataset handles on real files, and a matrix of runs of a small script."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroloom.runner import datasets, matrix
from hydroloom.sources import geotiff

HOURS = [datetime(2024, 2, 28, 22) + timedelta(hours=h) for h in range(5)]


def times(spark, hours=HOURS):
    return spark.createDataFrame([(t,) for t in hours], "time timestamp_ntz")


@pytest.fixture
def rasters(spark, tmp_path):
    for i, t in enumerate(HOURS):
        folder = tmp_path / f"{t:%Y%m%d}"
        folder.mkdir(exist_ok=True)
        (folder / f"rain_{t:%H}.tif").write_bytes(b"" if i == 3 else geotiff.encode(np.full((2, 3), float(i)), 1, 2, 1))
    (tmp_path / "20240229" / "rain_02.tif").unlink()
    return datasets.Dataset("rain", f"{tmp_path}/%Y%m%d/{{name}}_%H.tif", {"name": "rain"}), datasets.listed(spark, str(tmp_path))


def test_files_of_a_dataset(spark, rasters):
    dataset, listing = rasters
    expected = times(spark).withColumn("dataset", F.lit("rain"))
    assert [r["state"] for r in datasets.inventory([dataset], expected, listing.unionByName(listing)).orderBy("signature").collect()] == ["found", "found", "found", "empty", "missing"]
    gone = datasets.missing_steps([dataset], expected, listing).orderBy("time").collect()
    assert [(r["time"], r["state"]) for r in gone] == [(HOURS[3], "empty"), (HOURS[4], "missing")]
    held = datasets.Datasets(spark, [dataset])
    rows = held.read("rain", times(spark, HOURS[:3]), listing).groupBy("path").agg(F.sum("value").alias("s")).orderBy("path").collect()
    assert [r["s"] for r in rows] == [0.0, 6.0, 12.0]
    with pytest.raises(FileNotFoundError, match="2 of 5"):
        held.read("rain", times(spark), listing)
    assert held.read("rain", times(spark), listing, strict=False).count() == 18
    assert held.read("rain", times(spark, HOURS[4:]), listing, strict=False) is None
    with pytest.raises(KeyError, match="name"):
        datasets.placed([datasets.Dataset("x", "{name}_%Y.nc")], expected)


def test_files_of_many_steps_and_of_each_year(spark):
    expected = times(spark).withColumn("dataset", F.lit("lai"))
    daily = datasets.Dataset("lai", "lai_%m%d.tif", steps=8)
    rows = datasets.inventory([daily], expected, spark.createDataFrame([("lai_0228.tif", 5)], datasets.LISTING)).collect()
    # 29 February stands in the file of the 28th
    assert [(r["path"], r["steps"], r["state"]) for r in rows] == [("lai_0228.tif", 5, "found")]
    fixed = datasets.Dataset("lai", "terrain.tif")
    assert [tuple(r) for r in datasets.placed([fixed], expected).select("path").distinct().collect()] == [("terrain.tif",)]
    assert datasets.inventory([fixed], expected.limit(0), spark.createDataFrame([], datasets.LISTING)).count() == 0


def test_frames_are_held_until_the_last_reader(spark):
    made = []
    held = datasets.Datasets(spark, [], {"wind": 2})

    def make():
        made.append(1)
        return spark.range(3).toDF("n")

    with held.reading("wind", make) as frame:
        assert frame.storageLevel.useMemory and held.waiting() == {"wind": 2}
    with pytest.raises(ZeroDivisionError), held.reading("wind", make) as same:
        assert same is frame
        1 / 0  # noqa: B018
    assert held.waiting() == {} and not frame.storageLevel.useMemory and len(made) == 1
    with held.reading("once", make) as frame:
        assert not frame.storageLevel.useMemory
    assert held.waiting() == {} and len(made) == 2


SCRIPT = """
name=$(basename $0); echo "$1 $(grep -c steps $2)" >> {log}
echo "Note: IEEE_INVALID_FLAG" >&2
case $1 in
  bad) echo "WARNING: late" >&2; echo "no input" >&2; exit 3;;
  loud) echo "lost a cell" >&2;;
  twice) test $(grep -c twice {log}) -gt 1 || exit 1;;
esac
"""


def test_a_matrix_of_runs(spark, tmp_path):
    log = tmp_path / "log"
    (tmp_path / "model.sh").write_text(SCRIPT.format(log=log))
    names = ["good", "bad", "loud", "twice", "good"]
    runs = spark.createDataFrame([(n, ["sh", str(tmp_path / "model.sh"), n], "&run\n steps = 3\n/\n") for n in names], "run string, command array<string>, namelist string")
    runs = runs.unionByName(spark.createDataFrame([("none", [f"{tmp_path}/no-program"], None)], runs.schema))
    ledger = f"{tmp_path}/ledger"
    first = {r["run"]: r for r in matrix.run_matrix(runs, ledger).collect()}
    assert {n: r["state"] for n, r in first.items()} == {"good": "done", "bad": "failed", "loud": "failed", "twice": "failed", "none": "failed"}
    assert (first["bad"]["last_exit_code"], first["bad"]["warnings"], first["bad"]["errors"], first["bad"]["first_error"]) == (3, 1, 1, "no input")
    assert (first["loud"]["last_exit_code"], first["loud"]["first_error"]) == (0, "lost a cell") and first["none"]["last_exit_code"] == -1
    assert sorted(log.read_text().split("\n")[:-1]) == ["bad 1", "good 1", "loud 1", "twice 1"]
    second = {r["run"]: r for r in matrix.run_matrix(runs, ledger, at_once=1).collect()}
    assert second["twice"]["state"] == "done" and second["good"]["attempts"] == 1 and second["bad"]["attempts"] == 2
    assert log.read_text().count("good") == 1 and log.read_text().count("twice") == 2
    # who has had two tries is given up
    third = {r["run"]: r["attempts"] for r in matrix.run_matrix(runs, ledger, 2).collect()}
    assert third == {"good": 1, "bad": 2, "loud": 2, "twice": 2, "none": 2}
    whole = spark.read.parquet(ledger)
    assert sorted(map(tuple, matrix.report(runs, whole.unionByName(whole)).collect())) == sorted(map(tuple, matrix.report(runs, whole).collect()))
    assert matrix.report(runs, whole.limit(0)).select("state").distinct().collect()[0][0] == "waiting"
