"""Which input variable becomes which output: tags, workflows and names as relations.

A side (in or out) has labels (collection, part, label) and items (collection, part, item,
value).  The labels of a part, in order, belong to its items, in order.  On the in side an
item is a variable and its value a workflow; on the out side the item is the workflow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Side = tuple[DataFrame, DataFrame]


def zipped(labels: DataFrame, items: DataFrame) -> DataFrame:
    """(collection, part, label, item, value): the n-th label of a part with its n-th item; those without a partner are left out.

    Equal items stand in the order of their values.  The window runs over one part.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy("collection", "part").orderBy(*by))
    left = labels.select("collection", "part", "label", place("label").alias("place"))
    right = items.select("collection", "part", "item", "value", place("item", "value").alias("place"))
    return left.join(right, ["collection", "part", "place"]).drop("place")


def _last(side: DataFrame) -> DataFrame:
    """One row a label and item: the value of the last collection and part."""
    return side.groupBy("label", "item").agg(F.max(F.struct("collection", "part", "value")).alias("last")).select("label", "item", F.col("last.value").alias("value"))


def mapped_rows(inputs: Side, outputs: Side) -> DataFrame:
    """(tag, in, workflow, out, reference) of collections that both sides have; out is NULL where no output has the workflow."""
    source, target = zipped(*inputs), zipped(*outputs)
    both = inputs[0].select("collection").union(inputs[1].select("collection")).distinct().intersect(outputs[0].select("collection").union(outputs[1].select("collection")).distinct())
    source, target = (_last(side.join(both, "collection", "left_semi")) for side in (source, target))
    known = target.select("label", F.col("item").alias("workflow"), F.col("value").alias("out"))
    named = source.select("label", F.col("item").alias("in"), F.col("value").alias("workflow")).join(known, ["label", "workflow"], "left")
    return named.select(F.col("label").alias("tag"), "in", "workflow", "out", F.concat_ws(":", "label", "workflow").alias("reference"))


def by_priority(rows: DataFrame, first: Sequence[str], field: str = "in") -> DataFrame:
    """Rows with a rank: those whose field is in `first` in that order, the others after them by the field.

    Ranks are dense by field, so rows of one name share a rank and no task sorts all rows.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in first]).cast("array<string>"), F.col(field))
    order = F.struct(F.when(place > 0, place).otherwise(len(first) + 1).alias("place"), F.col(field).alias("name"))
    names = rows.select(field).distinct().withColumn("rank", F.row_number().over(Window.orderBy(order)))
    return rows.join(names, field)


def pairs(rows: DataFrame, name: str, kind: str = "workflow") -> DataFrame:
    """The rows of a tag, a workflow, or a reference `tag:workflow`; no row if there is none."""
    if kind not in ("tag", "workflow", "reference"):
        raise ValueError(f"no kind of name: {kind!r}")
    if kind == "reference" and ":" not in name:
        raise ValueError("a reference is tag:workflow")
    return rows.filter(F.col(kind) == name)


def process_pairs(variables: DataFrame, processes: DataFrame, workflows: DataFrame, sep: str = ":") -> DataFrame:
    """(variable, state, pair): `paired` with the name `variable:workflow`, or what a variable lacks.

    Frames have a column variable, `workflows` also workflow.  A variable with a process but no
    workflow is paired with its own name and also `missing in dataset`; `missing in process`
    and `extra in process` have no pair.  Repeated variables count once.
    """
    listed = variables.select("variable", F.lit(True).alias("listed")).distinct()
    processed = processes.select("variable", F.lit(True).alias("processed")).distinct()
    known = workflows.groupBy("variable").agg(F.max("workflow").alias("workflow"), F.lit(True).alias("known"))
    every = listed.join(processed, "variable", "full").join(known, "variable", "left")
    asked, done = F.col("listed").isNotNull(), F.col("processed").isNotNull()
    states = F.array_compact(F.array(
        F.when(asked & done, "paired"), F.when(asked & F.col("known").isNull(), "missing in dataset"),
        F.when(asked & ~done, "missing in process"), F.when(~asked, "extra in process"),
    ))
    pair = F.concat(F.col("variable"), F.lit(sep), F.coalesce("workflow", "variable"))
    return every.select("variable", F.explode(states).alias("state"), pair.alias("pair")).withColumn("pair", F.when(F.col("state") == "paired", F.col("pair")))
