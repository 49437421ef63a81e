"""The driver's tables seen as grids, terrain, series, registries, documents and namelists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(number: str, shift: tuple[float, float] = (0.0, 0.0)) -> list:
    """row, col, lat, lon of a cell number on a grid of 15 columns."""
    row, col = F.floor(F.col(number) / 15).cast("int"), (F.col(number) % 15).cast("int")
    return [row.alias("row"), col.alias("col"), F.round(46.0 + shift[0] - 0.1 * row, 6).alias("lat"), F.round(10.0 + shift[1] + 0.1 * col, 6).alias("lon")]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of events: a variable a type, a cell a user."""
    hourly = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("var"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), "user_id").agg(F.round(F.avg("value"), 6).alias("value"))
    return hourly.select("var", "time", *cells("user_id"), "value")


def ref(spark: SparkSession, sf_dir: str, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Terrain from parts; small parts have none."""
    return table(spark, sf_dir, "part").select(*cells("p_partkey", shift), F.when(F.col("p_size") < 5, -9999.0).otherwise(F.col("p_retailprice")).alias("ref_value"))


def whole_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the terrain's grid, also those of the last row that no part stands for."""
    last = F.max(F.floor(F.col("p_partkey") / 15)).alias("last")
    rows = table(spark, sf_dir, "part").agg(last).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("r"))
    return rows.select(F.explode(F.sequence(F.col("r") * 15, F.col("r") * 15 + 14)).alias("number")).select(*cells("number"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scaled to plausible physics, each at its own time and cell."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("time"), *cells("user_id"), (273.15 + v / 20).alias("t"), (273.15 + v / 20 - v / 50).alias("td"), (v / 30).alias("u"), ((v - 50) / 30).alias("v"), (v / 25).alias("rain"), (v * 1000).alias("joules"), (v * 4).alias("z"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, region, name): nations as sections of regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pos"), F.col("r_name").alias("region"), F.col("n_name").alias("name"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, pos, value, line): orders as lines of a series, several a day and section."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderdate").alias("time"), F.col("c_nationkey").alias("pos"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("line"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "grid": """grid AS (
        SELECT event_type AS var, date_trunc('hour', ts) AS time, (user_id // 15)::INT AS row, (user_id % 15)::INT AS col,
               round(46.0::DOUBLE - 0.1::DOUBLE * (user_id // 15), 6) AS lat, round(10.0::DOUBLE + 0.1::DOUBLE * (user_id % 15), 6) AS lon, round(avg(value), 6) AS value
        FROM events GROUP BY event_type, date_trunc('hour', ts), user_id)""",
    "ref": """ref AS (
        SELECT (p_partkey // 15)::INT AS row, (p_partkey % 15)::INT AS col, round(46.0::DOUBLE - 0.1::DOUBLE * (p_partkey // 15), 6) AS lat,
               round(10.0::DOUBLE + 0.1::DOUBLE * (p_partkey % 15), 6) AS lon, CASE WHEN p_size < 5 THEN -9999.0::DOUBLE ELSE p_retailprice END AS ref_value FROM part)""",
    "moved": """moved AS (
        SELECT (p_partkey // 15)::INT AS row, (p_partkey % 15)::INT AS col, round(46.03::DOUBLE - 0.1::DOUBLE * (p_partkey // 15), 6) AS lat,
               round(10.04::DOUBLE + 0.1::DOUBLE * (p_partkey % 15), 6) AS lon, CASE WHEN p_size < 5 THEN -9999.0::DOUBLE ELSE p_retailprice END AS ref_value FROM part)""",
    "weather": """weather AS (
        SELECT event_id, ts AS time, (user_id // 15)::INT AS row, (user_id % 15)::INT AS col, round(46.0::DOUBLE - 0.1::DOUBLE * (user_id // 15), 6) AS lat,
               round(10.0::DOUBLE + 0.1::DOUBLE * (user_id % 15), 6) AS lon, 273.15::DOUBLE + value / 20 AS t, 273.15::DOUBLE + value / 20 - value / 50 AS td,
               value / 30 AS u, (value - 50) / 30 AS v, value / 25 AS rain, value * 1000 AS joules, value * 4 AS z FROM events)""",
    "sections": "sections AS (SELECT n_nationkey AS pos, r_name AS region, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "lines": "lines AS (SELECT o_orderdate AS time, c_nationkey AS pos, o_totalprice AS value, o_orderkey AS line FROM orders JOIN customer ON o_custkey = c_custkey)",
    "weights": """xyz_s AS (SELECT DISTINCT row, col, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM grid),
    xyz_t AS (SELECT row, col, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM moved),
    pairs AS (SELECT s.row AS src_row, s.col AS src_col, t.row, t.col, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 AS d2 FROM xyz_s s JOIN xyz_t t ON abs(s.x - t.x) < 18000 AND abs(s.y - t.y) < 18000 AND abs(s.z - t.z) < 18000),
    weights AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, src_row, src_col)::INT AS rank FROM pairs WHERE d2 < 18000.0 * 18000.0) WHERE rank <= 7)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
