"""Running a model and keeping a ledger of runs; launching is a small driver-side helper."""

from __future__ import annotations

import os
import subprocess
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "tag string, command string, exit_code int, ok boolean, stdout string, stderr string, started double, seconds double"
#: Floating-point notes on stderr that are no errors.
HARMLESS = "IEEE_"


def run(spark: SparkSession, tag: str, command: list[str], libraries: str | None = None, dry_run: bool = False, timeout: float | None = None) -> DataFrame:
    """A ledger row for one run; anything on stderr but floating-point notes makes it fail."""
    began = time.time()
    if dry_run:
        return spark.createDataFrame([(tag, " ".join(command), 0, True, "", "", began, 0.0)], LEDGER)
    paths = [p for p in (libraries, os.environ.get("LD_LIBRARY_PATH")) if p]
    done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, env=os.environ | ({"LD_LIBRARY_PATH": ":".join(paths)} if paths else {}))
    errors = "\n".join(x for x in done.stderr.splitlines() if x.strip() and HARMLESS not in x)
    return spark.createDataFrame([(tag, " ".join(command), done.returncode, done.returncode == 0 and not errors, done.stdout, errors, began, time.time() - began)], LEDGER)


def is_done(ledger: DataFrame, tag: str) -> bool:
    return not ledger.filter((F.col("tag") == tag) & F.col("ok")).isEmpty()


def summary(ledger: DataFrame) -> DataFrame:
    """Runs, failures and seconds by tag."""
    return ledger.groupBy("tag").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"), F.sum("seconds").alias("seconds"), F.max_by("exit_code", "started").alias("last_exit_code"))
