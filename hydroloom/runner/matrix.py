"""A matrix of model runs with a ledger: what is left to run, launching as Spark tasks, and a report.

A run is a row (run, command, namelist).  The ledger is appended, never changed: a row a try, by
run and attempt.  A run's state is folded from its rows, so a ledger that holds a try twice (a task
that Spark tried again, a folder read twice) says the same.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.runner.execution import HARMLESS

LEDGER = "run string, attempt int, exit_code int, stdout string, stderr string, started double, seconds double"


def line_class(line: Column) -> Column:
    """note (floating-point notes), warning, or error: what a line on stderr means; NULL for a blank one."""
    low = F.lower(line)
    return F.when(F.trim(line) == "", None).when(line.contains(HARMLESS), "note").when(low.rlike(r"^\s*(warning|warn)\b"), "warning").otherwise("error")


def stderr_lines(ledger: DataFrame) -> DataFrame:
    """(run, attempt, line_no, line, class) of the lines that tries wrote to stderr, blank ones left out."""
    lines = tries(ledger).select("run", "attempt", F.posexplode(F.split(F.coalesce("stderr", F.lit("")), "\n")).alias("line_no", "line"))
    return lines.withColumn("class", line_class(F.col("line"))).filter("class is not null")


def tries(ledger: DataFrame) -> DataFrame:
    """The ledger with each try once: of a run's rows of one attempt the one that started last."""
    last = F.max_by(F.struct(*[c for c in ledger.columns if c not in ("run", "attempt")]), F.struct("started", "seconds", "exit_code"))
    return ledger.groupBy("run", "attempt").agg(last.alias("last")).select("run", "attempt", "last.*")


def states(ledger: DataFrame) -> DataFrame:
    """(run, attempts, done, last_exit_code, seconds, warnings, errors, first_error), a row a run of the ledger.

    A try succeeds with exit code 0 and no error line; a run is done when a try of it succeeded.
    """
    each = tries(ledger)
    found = stderr_lines(ledger).groupBy(F.col("run").alias("r"), F.col("attempt").alias("a")).agg(
        F.count_if(F.col("class") == "warning").alias("warnings"), F.count_if(F.col("class") == "error").alias("errors"), F.min_by(F.when(F.col("class") == "error", F.col("line")), F.when(F.col("class") == "error", F.col("line_no"))).alias("first_error")
    )
    told = each.join(found, (F.col("run") == F.col("r")) & (F.col("attempt") == F.col("a")), "left").fillna(0, ["warnings", "errors"])
    ok = (F.col("exit_code") == 0) & (F.col("errors") == 0)
    last = F.max_by(F.struct("exit_code", "warnings", "errors", "first_error"), "attempt").alias("last")
    folded = told.groupBy("run").agg(F.count("*").alias("attempts"), F.max(F.coalesce(ok, F.lit(False))).alias("done"), F.sum("seconds").alias("seconds"), last)
    return folded.select("run", "attempts", "done", F.col("last.exit_code").alias("last_exit_code"), "seconds", "last.warnings", "last.errors", "last.first_error")


def pending(runs: DataFrame, ledger: DataFrame, tries_at_most: int | None = None) -> DataFrame:
    """The runs that no try of has succeeded, with `attempt`, the number of their next one; `tries_at_most` gives up on those with as many.

    A run given twice is asked for once.
    """
    known = states(ledger).select(F.col("run").alias("r"), "attempts", "done")
    given_up = F.col("done") | (F.col("attempts") >= tries_at_most) if tries_at_most is not None else F.col("done")
    left = runs.dropDuplicates(["run"]).join(known.filter(given_up).select("r"), F.col("run") == F.col("r"), "left_anti")
    before = known.filter(~given_up).select("r", "attempts")
    return left.join(before, F.col("run") == F.col("r"), "left").withColumn("attempt", (F.coalesce("attempts", F.lit(0)) + 1).cast("int")).drop("r", "attempts")


def launch(runs: DataFrame, timeout: float | None = None, at_once: int | None = None) -> DataFrame:
    """Ledger rows of runs (run, attempt, command: array<string>, namelist), each run by the task that reads it.

    A run's namelist, if it has one, is a file whose name follows the command, in a scratch
    folder that the run starts in.  `at_once`: so many tasks, else one a run.  A command that
    can't start or takes too long has exit code -1 and says why on stderr.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                began = time.time()
                with tempfile.TemporaryDirectory() as folder:
                    command = list(r.command)
                    if r.namelist is not None:
                        with open(os.path.join(folder, "run.namelist"), "w", encoding="utf-8") as file:
                            file.write(r.namelist)
                        command.append(file.name)
                    try:
                        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, cwd=folder)
                        rows.append((r.run, r.attempt, done.returncode, done.stdout, done.stderr, began, time.time() - began))
                    except (OSError, subprocess.TimeoutExpired) as e:
                        rows.append((r.run, r.attempt, -1, "", str(e), began, time.time() - began))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER.split(", ")])

    n = at_once or max(1, runs.count())
    return runs.select("run", "attempt", "command", "namelist").repartition(n, "run").mapInPandas(work, LEDGER)


def run_matrix(runs: DataFrame, ledger_path: str, tries_at_most: int | None = None, **settings) -> DataFrame:
    """Launch what is left to run, append to the ledger, and return the report; called again it runs nothing twice that is done."""
    spark = runs.sparkSession

    def ledger() -> DataFrame:
        try:
            return spark.read.schema(LEDGER).parquet(ledger_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], LEDGER)

    # rows are written by Spark's own commit: a task tried again leaves one row
    launch(pending(runs, ledger(), tries_at_most), **settings).write.mode("append").parquet(ledger_path)
    return report(runs, ledger())


def report(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run, state, attempts, last_exit_code, seconds, warnings, errors, first_error): state is waiting, done or failed."""
    known = states(ledger).withColumnRenamed("run", "r")
    met = runs.dropDuplicates(["run"]).join(known, F.col("run") == F.col("r"), "left")
    state = F.when(F.col("r").isNull(), "waiting").when(F.col("done"), "done").otherwise("failed")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return met.select("run", state.alias("state"), zero("attempts"), "last_exit_code", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), zero("warnings"), zero("errors"), "first_error")
