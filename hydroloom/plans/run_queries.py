"""Registered queries of dataset handles and run matrices, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.functions import times
from hydroloom.plans import adapters
from hydroloom.plans.queries import query
from hydroloom.runner import datasets, matrix

C = F.col


FILES = """WITH box AS (SELECT event_type AS dataset, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS time FROM events GROUP BY event_type),
    hourly AS (SELECT event_type || '/' || strftime(ts, '%Y/%m/%d') || '/f_' || strftime(ts, '%H') || '.nc' AS path, CASE WHEN count(*) % 5 = 0 THEN 0 ELSE count(*) * 100 END AS length FROM events WHERE hour(ts) % 7 > 0 GROUP BY ALL),
    daily AS (SELECT event_type || '/d_' || strftime(ts, '%Y%m%d') || '.tif' AS path, CASE WHEN count(*) % 5 = 0 THEN 0 ELSE count(*) END AS length FROM events WHERE day(ts) % 6 > 0 GROUP BY ALL) """


def _expected(spark, sf_dir) -> DataFrame:
    """Every hour between an event type's first and last."""
    box = adapters.table(spark, sf_dir, "events").groupBy(C("event_type").alias("dataset")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return box.select("dataset", F.explode(times.time_range(times.floor_time(C("a"), "hour"), times.floor_time(C("b"), "hour"), "1h")).alias("time"))


def _specs(spark, sf_dir, pattern: str) -> list[datasets.Dataset]:
    # a row an event type
    kinds = [r[0] for r in adapters.table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    return [datasets.Dataset(k, pattern) for k in kinds]


@query(
    FILES
    + """SELECT dataset, time AS signature, b.path, 1::BIGINT AS steps, CASE WHEN h.path IS NULL THEN 'missing' WHEN length = 0 THEN 'empty' ELSE 'found' END AS state, length
    FROM (SELECT *, dataset || '/' || strftime(time, '%Y/%m/%d') || '/f_' || strftime(time, '%H') || '.nc' AS path FROM box) b LEFT JOIN hourly h USING (path)"""
)
def dataset_inventory(spark, sf_dir):
    """Hourly files of each event type: found, empty or missing."""
    e = adapters.table(spark, sf_dir, "events").filter(F.hour("ts") % 7 > 0)
    path = F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/f_"), F.date_format("ts", "HH"), F.lit(".nc"))
    listing = e.groupBy(path.alias("path")).agg(F.count("*").alias("n")).select("path", F.when(C("n") % 5 == 0, 0).otherwise(C("n") * 100).alias("length"))
    return datasets.inventory(_specs(spark, sf_dir, "{dataset}/%Y/%m/%d/f_%H.nc"), _expected(spark, sf_dir), listing)


@query(
    FILES
    + """SELECT dataset, time, b.path, CASE WHEN d.path IS NULL THEN 'missing' ELSE 'empty' END AS state
    FROM (SELECT *, dataset || '/d_' || strftime(time, '%Y%m%d') || '.tif' AS path FROM box) b LEFT JOIN daily d USING (path) WHERE d.path IS NULL OR length = 0"""
)
def dataset_missing_steps(spark, sf_dir):
    """Hours whose file of the day is missing or empty."""
    e = adapters.table(spark, sf_dir, "events").filter(F.dayofmonth("ts") % 6 > 0)
    path = F.concat("event_type", F.lit("/d_"), F.date_format("ts", "yyyyMMdd"), F.lit(".tif"))
    listing = e.groupBy(path.alias("path")).agg(F.count("*").alias("n")).select("path", F.when(C("n") % 5 == 0, 0).otherwise(C("n")).cast("long").alias("length"))
    return datasets.missing_steps(_specs(spark, sf_dir, "{dataset}/d_%Y%m%d.tif"), _expected(spark, sf_dir), listing)


RUNS = """WITH runs AS (SELECT o_orderkey AS k, 'run' || o_orderkey AS run FROM orders),
    tries AS (SELECT run, k, a::INT AS attempt, CASE WHEN a = 1 AND k % 4 = 1 OR k % 4 = 2 THEN 1 ELSE 0 END AS exit_code, CASE WHEN k % 5 = 0 THEN 2 WHEN k % 5 = 1 THEN 1 ELSE 0 END AS errors, (k % 5 = 2)::INT AS warnings, (a * 2)::DOUBLE AS seconds
        FROM runs, range(1, 3) t(a) WHERE a <= k % 3),
    folded AS (SELECT run, k, count(*) AS attempts, bool_or(exit_code = 0 AND errors = 0) AS done, arg_max(exit_code, attempt) AS last_exit_code, sum(seconds) AS seconds, arg_max(warnings, attempt) AS warnings, arg_max(errors, attempt) AS errors FROM tries GROUP BY ALL) """


def _runs(spark, sf_dir) -> DataFrame:
    k = C("o_orderkey")
    return adapters.table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("run"), k).alias("run"), F.array(F.lit("model"), k.cast("string")).alias("command"), F.lit(None).cast("string").alias("namelist"))


def _ledger(spark, sf_dir) -> DataFrame:
    """Orders as runs with up to two tries; every try of every third run stands twice."""
    k, a = C("k"), C("attempt")
    each = _runs(spark, sf_dir).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(2)))).filter(a <= k % 3)
    code = F.when(((a == 1) & (k % 4 == 1)) | (k % 4 == 2), 1).otherwise(0)
    notes = F.lit("Note: IEEE_UNDERFLOW_FLAG is signalling\n\n")
    said = F.when(k % 5 == 0, F.concat(notes, F.lit("first\nsecond"))).when(k % 5 == 1, F.concat(F.lit("only "), k)).when(k % 5 == 2, F.concat(notes, F.lit(" WARNING: few cells"))).otherwise(notes)
    rows = each.select("run", "attempt", code.alias("exit_code"), F.lit("").alias("stdout"), said.alias("stderr"), (k * 10 + a).cast("double").alias("started"), (a * 2).cast("double").alias("seconds"), "k")
    return rows.unionByName(rows.filter(k % 9 < 3)).drop("k")


@query(RUNS + "SELECT r.run, coalesce(attempts, 0)::INT + 1 AS attempt FROM runs r LEFT JOIN folded f USING (run) WHERE NOT coalesce(done, false) AND coalesce(attempts, 0) < 2")
def runner_pending(spark, sf_dir):
    """Runs without a successful try and with less than two, and the number of their next one."""
    return matrix.pending(_runs(spark, sf_dir), _ledger(spark, sf_dir), 2).select("run", "attempt")


@query(
    RUNS
    + """SELECT r.run, CASE WHEN f.run IS NULL THEN 'waiting' WHEN done THEN 'done' ELSE 'failed' END AS state, coalesce(attempts, 0) AS attempts, last_exit_code::INT AS last_exit_code, coalesce(seconds, 0) AS seconds,
        coalesce(warnings, 0)::BIGINT AS warnings, coalesce(errors, 0)::BIGINT AS errors, CASE WHEN errors = 2 THEN 'first' WHEN errors = 1 THEN 'only ' || r.k END AS first_error FROM runs r LEFT JOIN folded f USING (run)"""
)
def runner_report(spark, sf_dir):
    """State, tries and lines of error of each run; tries that stand twice count once."""
    return matrix.report(_runs(spark, sf_dir), _ledger(spark, sf_dir))
