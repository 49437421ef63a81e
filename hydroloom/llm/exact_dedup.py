"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by the next bytes of their normalised text, again and again, until a
group holds one document or its texts have ended; what ends together is equal, no digest is
compared.  One digit is a run of bytes that grows fourfold from round to round, so a text of n
bytes takes about log4(n / FIRST) rounds, and almost all documents leave after the first.

Groups are found by counting (group, digit) with a sum on each task first, so a group of any
size is one row to the task that owns it.  Rows meet their group's number in a join that
Spark may split where many rows share a digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, written

#: Bytes of the first digit, and the growth of the next ones.
FIRST, GROWTH = 64, 4
#: Row numbers up to which they are sent to every executor: with their groups about 100 bytes each in a broadcast.
BROADCAST_ROWS = 500_000


def normalised(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, size, digest, norm): a number for each row, code points of the text, and the text without white space."""
    norm = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE_CLASS + "+", "")
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).alias("size"), norm.alias("norm"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "size", F.sha2("norm", 256).alias("digest"), F.col("norm").cast("binary").alias("norm"))


def _split(members: DataFrame) -> DataFrame:
    """(row, group, ended) of the rows (row, group, digit, ended) whose digit another row of their group has, under the new group's number."""
    shared = members.groupBy("group", "digit").agg(F.count("*").alias("n"), F.min("row").alias("new")).filter("n > 1")
    # written, so that the join reads two plain shuffles, of which Spark splits crowded parts
    shared = written(shared.select(F.col("group").alias("g"), F.col("digit").alias("d"), "new"), "radix-groups")
    return members.join(shared, (F.col("group") == F.col("g")) & (F.col("digit") == F.col("d"))).select("row", F.col("new").alias("group"), "ended")


def equal_groups(rows: DataFrame) -> DataFrame:
    """(row, group) of the rows whose `norm` another row has, too; group is the smallest such row."""

    def digits(of: DataFrame, start: int, width: int) -> DataFrame:
        return of.withColumn("digit", F.substring("norm", start + 1, width)).withColumn("ended", F.length("norm") < start + width).drop("norm")

    def few(numbers: DataFrame, n: int) -> DataFrame:
        """Counted rows are broadcast if they are few; beyond that both sides of the join are shuffled."""
        return F.broadcast(numbers) if n <= BROADCAST_ROWS else numbers

    first = written(_split(digits(rows.select("row", "norm", F.lit(0).cast("long").alias("group")), 0, FIRST)), "radix")
    done = first.filter("ended").select("row", "group")
    going = first.filter("not ended").select("row", "group")
    if not (n := going.count()):
        return done
    # only rows that share their first digit are read again
    left = written(rows.select("row", "norm").join(few(going.select("row"), n), "row", "left_semi"), "radix-texts")
    start, width = FIRST, FIRST * (GROWTH - 1)
    while True:
        # the digit is cut out before the join, so texts stay where they are
        step = written(_split(digits(left, start, width).join(few(going, n), "row")), "radix")
        done = done.unionByName(step.filter("ended").select("row", "group"))
        going = step.filter("not ended").select("row", "group")
        if not (n := going.count()):
            return done
        start, width = start + width, (start + width) * (GROWTH - 1)


def with_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of `docs`.

    Texts are equal when identical without white space; null counts as empty, and all empty
    texts are equal.  Of equal texts the row with the most code points stays, then the one
    with the smallest id (of any type that has an order; null ids last), then one of the rows
    that repeat it.
    """
    rows = written(normalised(docs, id, text), "normalised")
    groups = equal_groups(rows)
    met = rows.select("row", "id", "size", "digest").join(groups, "row", "left")
    # sizes are no less than zero, so only they are negated; ids may be of any type that has an order
    order = F.struct(F.negative("size").alias("size"), F.col("id").isNull().alias("nameless"), "id", "row")
    best = met.filter("group is not null").groupBy(F.col("group").alias("of")).agg(F.min_by(F.struct("row", "id"), order).alias("best"), F.count("*").alias("n"))
    # written, so that the join below reads two plain shuffles, of which Spark splits crowded parts
    best = written(best, "radix-best")
    # rows without a group get a number that no group has, each its own, and so are spread
    out = met.join(best, F.coalesce("group", -F.col("row") - 1) == F.col("of"), "left")
    alone = F.col("of").isNull()
    return out.select(
        F.col("id").alias(id),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
