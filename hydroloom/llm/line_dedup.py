"""Line dedup by site-relative frequency.

Lines of each page are counted once a page and host; a line on more than `max_ratio` of its
host's pages (and on at least `min_pages`) is boilerplate and is dropped from every page of
that host.

Counting shuffles one (host, 64-bit hash, count) row a distinct line and task, never the
lines; hashes over the limit are then counted again by the exact line, so a hash collision
cannot drop a line.  The boilerplate lines of a host are few by the limit itself: their
ratios sum to at most the mean lines of a page, so a host has at most mean / max_ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, written

MAX_RATIO, MIN_PAGES = 0.08, 5
#: Boilerplate of all hosts together up to which it is sent to every executor.
BROADCAST_BYTES = 32 << 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, host_pages) of the lines over the limits; a null host is a host of its own.

    Lines are trimmed of white space; lines without a word never count.
    """
    each = pages.select(F.col(f"`{host}`").alias("host"), F.array_distinct(F.transform(_lines(F.col(f"`{text}`")), lambda x: F.btrim(x, F.lit(SPACES)))).alias("lines"))
    totals = each.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = each.select("host", F.explode("lines").alias("line")).filter("line != ''")
    over = (F.col("pages") >= min_pages) & (F.col("pages") > max_ratio * F.col("host_pages"))
    # a host's own share of its pages is needed before the limit, so counts meet totals by host: totals are one row a host
    counts = lines.groupBy("host", F.xxhash64("line").alias("hash")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    likely = written(counts.join(totals, counts["host"].eqNullSafe(totals["host"])).select(counts["host"], "hash", "host_pages", "pages").filter(over).drop("pages"), "likely-lines")
    keyed = lines.withColumn("hash", F.xxhash64("line"))
    exact = keyed.join(_small(likely), keyed["host"].eqNullSafe(likely["host"]) & (keyed["hash"] == likely["hash"])).groupBy(keyed["host"], "line", "host_pages").agg(F.count("*").alias("pages"))
    return exact.filter(over).select("host", "line", "pages", "host_pages")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table if its measured size allows; beyond that Spark's shuffled join stands."""
    size = df.select(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, all other columns and rows as they were.

    A null text stays null; a text of nothing but boilerplate becomes empty.  A null host is a
    host of its own; repeated rows count one by one.  With `counts`, columns n_lines and
    n_dropped are added, their names lengthened by `_` where `pages` has them.
    """
    found = boilerplate(pages, host, text, max_ratio, min_pages)
    by_host = written(found.groupBy("host").agg(F.collect_set("line").alias("lines")), "boilerplate")
    of, bad = free_name(pages, "line_host"), free_name(pages, "line_bad")
    joined = pages.join(_small(by_host.toDF(of, bad)), F.col(f"`{host}`").eqNullSafe(F.col(of)), "left")
    own = F.col(f"`{text}`")
    lines = F.split(own, "\n")
    rest = F.when(F.col(bad).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(bad), F.btrim(x, F.lit(SPACES)))))
    new = F.when(F.col(bad).isNull(), own).otherwise(F.array_join(rest, "\n"))
    extra = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(free_name(pages, "n_lines")), F.coalesce(F.size(lines) - F.size(rest), F.lit(0)).cast("long").alias(free_name(pages, "n_dropped"))]
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns], *extra * counts)
