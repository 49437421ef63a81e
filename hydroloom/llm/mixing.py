"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash, once for each time they may be taken,
and stand in a queue; a document's virtual finish time is the queue's cumulative size up to
and including it, divided by the source's target.  All queues together, sorted by finish
time, are cut where their cumulative size would exceed the budget.

No window runs over a whole source or over all documents.  Queues are cut into buckets of
hashes (finish times into bucket ranges); sums of buckets are added up within blocks of
buckets and over blocks, and only the rows of one bucket are ever sorted in one task.  The
number of buckets follows the number of rows, so a source that holds most rows is spread like
the others.  Equal rows are counted first and queue as numbered repeats, each with a hash of
its own, so a row that stands a million times is spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, word_count, written

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, 42
#: Rows that one bucket is meant to hold, buckets of one block of sums, and repeats that one task unfolds.
BUCKET_ROWS, BLOCK, UNFOLD = 4_000, 1_000, 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, weight, source_size, target) from rows (source, source_size), one a source.

    Sources by code point, null last, take the weights in turn and share `share` times the
    whole size; a target stops at `repeats` times its source's size, and what it leaves is
    shared again by weight.  The sources that stop are those of the smallest size for their
    weight, up to the first that does not stop.  One row a source: the windows sort as many
    rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = repeats * F.col("source_size")
    by_need = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    placed = ranked.withColumn("level", left / F.sum("weight").over(from_here)).withColumn("stops", limit < F.col("weight") * F.col("level"))
    level = F.coalesce(F.min(F.when(~F.col("stops"), F.struct(limit / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"], F.lit(0.0))
    return placed.select("source", "weight", "source_size", F.when(F.col("stops"), limit.cast("double")).otherwise(F.col("weight") * level).alias("target"))


def identity(docs: DataFrame, source: str, id: str, text: str, every: bool = False) -> Column:
    """32 hex digits that rows share only if alike in id, source and text (with `every`: in all columns)."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (id, source, text)]
    # maps have no hash: they count as JSON
    plain = lambda f: F.to_json(F.struct(f"`{f.name}`"), {"ignoreNullFields": "false"}) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    rest = [F.xxhash64(*[F.struct(F.col(f"`{f.name}`").isNull(), plain(f)) for f in docs.schema.fields]).cast("string")] if every else []
    return F.md5(F.concat_ws(":", *parts, *rest))


def queued(docs: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", seed: int = SEED, repeats: int = REPEATS, key: Column | None = None, **shares) -> tuple[DataFrame, DataFrame, int]:
    """The rows in their queues, the targets, and the number of queued rows.

    Rows: alike (the `identity` of the row), n (its number among the rows alike), id, source,
    size, copy (0 to repeats - 1), mix_key, finish, source_size and target; ties in a queue
    go by key, id, size, alike and n.
    """
    alike = identity(docs, source, id, text) if key is None else key
    each = docs.select(alike.alias("alike"), F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    # equal rows are added up before they are shuffled
    sized = written(each.groupBy("alike", "id", "source", "size").agg(F.count("*").alias("many")), "sizes")
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"))
    targets = written(source_targets(totals, repeats=repeats, **shares), "targets")
    counted = sized.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("rows"), F.coalesce(F.max("many"), F.lit(0)).alias("most")).first()
    buckets = max(1, -(-counted["rows"] // BUCKET_ROWS))
    zero = F.lit(0).cast("long")
    if counted["most"] > UNFOLD:
        parts = sized.withColumn("part", F.explode(F.sequence(zero, F.floor((F.col("many") - 1) / UNFOLD)))).repartition("alike", "part")
        n = parts.withColumn("n", F.explode(F.sequence(F.col("part") * UNFOLD, F.least(F.col("part") * UNFOLD + UNFOLD, "many") - 1))).drop("part", "many")
    else:
        n = sized.withColumn("n", F.explode(F.sequence(zero, F.col("many") - 1))).drop("many")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string"), F.col("n").cast("string"), "alike"))
    copies = n.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)]))).withColumn("mix_key", mark)
    # the first eight hex digits give the bucket, so buckets stand in the order of keys
    bucket = (F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    copies = copies.withColumn("bucket", bucket)
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("mix_key", F.col("id").isNull(), "id", "size", "alike", "n").rowsBetween(Window.unboundedPreceding, 0)
    within = copies.withColumn("within", F.sum("size").over(inside))
    offsets = _ahead(copies.groupBy("source", "copy", "bucket").agg(F.sum("size").alias("held"))).toDF("s", "c", "b", "ahead")
    placed = within.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c")) & (F.col("bucket") == F.col("b")))
    small = targets.select(F.col("source").alias("t"), "source_size", "target")
    timed = placed.join(small, F.col("source").eqNullSafe(F.col("t"))).withColumn("finish", F.when(F.col("target") > 0, (F.col("ahead") + F.col("within")) / F.col("target")).otherwise(0.0))
    return timed.select("alike", "n", "id", "source", "size", "copy", "mix_key", "finish", "source_size", "target"), targets, counted["rows"] * repeats


def _ahead(sums: DataFrame) -> DataFrame:
    """(source, copy, bucket, ahead): what the source's buckets before this one hold, from rows with their own `held`.

    Two levels: blocks of BLOCK buckets are added up over the source, buckets within their block.
    """
    sums = written(sums.withColumn("block", F.floor(F.col("bucket") / BLOCK)), "bucket-sums")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("source", "copy", "block").agg(F.sum("held").alias("held")).withColumn("at", F.struct("copy", "block"))
    blocks = blocks.select(F.col("source").alias("s"), F.col("copy").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("held").over(before("source", "at")), F.lit(0)).alias("blocks_ahead"))
    own = sums.withColumn("inside", F.coalesce(F.sum("held").over(before("source", "copy", "block", "bucket")), F.lit(0)))
    met = own.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c")) & (F.col("block") == F.col("b")))
    return met.select("source", "copy", "bucket", F.col("blocks_ahead") + F.col("inside"))


def cut_at_budget(timed: DataFrame, budget: float, rows: int) -> DataFrame:
    """The rows, in order of finish time, whose cumulative size stays within the budget.

    At time 1 each queue has given its target at most, so the cut lies where each goes on with
    its next documents.  Sums of equal ranges of finish time find the block of ranges, and in
    it the range, in which the budget ends; only that range is sorted row by row.  A queue
    lasts at least until time 1 (a target is at most all its copies), so no range holds more
    than a few buckets' rows.
    """
    ranges = max(1, -(-rows // BUCKET_ROWS))
    at = timed.withColumn("range", F.floor(F.least("finish", F.lit(2.0)) * ranges).cast("long"))
    sums = written(at.groupBy("range").agg(F.sum("size").alias("held")).withColumn("block", F.floor(F.col("range") / BLOCK)), "range-sums")

    def edge(parts: DataFrame, by: str, ahead: int):
        """The first part with which the sum exceeds the budget; as many parts as blocks, or ranges of one block, in one window."""
        until = parts.withColumn("until", F.sum("held").over(Window.orderBy(by)) + F.lit(ahead))
        return until.filter(F.col("until") > F.lit(budget)).orderBy(by).select(by, (F.col("until") - F.col("held")).alias("ahead")).first()

    block = edge(sums.groupBy("block").agg(F.sum("held").alias("held")), "block", 0)
    if block is None:
        return timed
    last = edge(sums.filter(F.col("block") == block["block"]), "range", block["ahead"])
    order = ["finish", F.col("source").isNull(), "source", "copy", "mix_key", F.col("id").isNull(), "id", "size", "alike", "n"]
    cut = at.filter(F.col("range") == last["range"]).withColumn("until", F.sum("size").over(Window.orderBy(*order)) + F.lit(last["ahead"])).filter(F.col("until") <= F.lit(budget))
    return at.filter(F.col("range") < last["range"]).drop("range").unionByName(cut.drop("range", "until"))


def mix(docs: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", **settings) -> tuple[DataFrame, DataFrame]:
    """(the copies that the mix takes, in order of finish time; all copies as queued).

    Null texts have size 0; a null source is a source of its own, last in order.  A source of
    size 0 has target 0 and finish time 0.  Repeated rows queue one by one.
    """
    timed, targets, rows = queued(docs, source, id, text, **settings)
    timed = written(timed, "queues")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    return cut_at_budget(timed, budget, rows).orderBy("finish", "source", "copy", "mix_key"), timed


def mix_shares(docs: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of `docs`; taken: the words the mix takes of it."""
    taken, timed = mix(docs, source, id, text, **settings)
    sums = taken.groupBy(F.col("alike").alias("of"), F.col("n").alias("of_n"), F.col("source").alias("of_source"), F.col("id").alias("of_id")).agg(F.sum("size").alias("taken"))
    same = (F.col("alike") == F.col("of")) & (F.col("n") == F.col("of_n")) & F.col("source").eqNullSafe(F.col("of_source")) & F.col("id").eqNullSafe(F.col("of_id"))
    return timed.filter("copy = 0").join(sums, same, "left").select(F.col("id").alias(id), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that the mix takes, as often as it takes them, columns as they were.

    Rows alike in all columns cannot be told apart: they come as often as the mix takes any of
    them.  The texts move once, to meet their counts.
    """
    key, copies, times, alike, turn = (free_name(docs, f"mix_{x}") for x in ("key", "copies", "times", "alike", "turn"))
    own = identity(docs, source, id, text, every=True)
    taken, timed = mix(docs, source, id, text, key=own, **settings)
    rows = timed.filter("copy = 0").groupBy(F.col("alike").alias("of")).agg(F.count("*").alias(alike))
    counts = taken.groupBy(F.col("alike").alias(copies)).agg(F.count("*").alias(times)).join(rows, F.col(copies) == F.col("of")).drop("of")
    counts = written(counts, "times")
    keyed = docs.withColumn(key, own)

    def met(part: DataFrame) -> DataFrame:
        return keyed.join(part.hint("shuffle_merge"), F.col(key) == F.col(copies))

    one = F.col(alike) == 1
    found = met(counts.filter(one))
    if not counts.filter(~one).isEmpty():
        # of rows alike one stands for all, found before the shuffle; long runs of it are unfolded in parts
        repeated = counts.filter(~one)
        few = keyed.join(repeated.select(F.col(copies)), F.col(key) == F.col(copies), "left_semi").dropDuplicates([key])
        found = found.unionByName(few.join(repeated, F.col(key) == F.col(copies)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return found.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*kept)
