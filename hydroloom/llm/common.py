"""What the text operators share: the shared folder, free column names, null-safe columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.shared import shared_folder, written

__all__ = ["SPACES", "SPACE_CLASS", "free_name", "shared_folder", "table", "word_count", "written"]

#: White space of the word pattern `[^\x20\x09-\x0D]+`; bytes.split() uses the same six.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
