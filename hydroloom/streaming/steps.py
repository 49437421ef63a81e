"""The time-stepped batch loop as a file stream: each new file of a landing folder is processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hydroloom.model import GRID


def stream_grids(spark: SparkSession, path: str, schema: str = GRID, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_steps(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply `step` to each batch and write it once, by batch number; ends when all files are done."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_means(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Means by variable, cell and hour; rows later than the watermark are dropped."""
    timed = stream.withColumn("at", F.col("time").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour"), "var", "row", "col").agg(F.avg("value").alias("value"))
