"""Namelists as relations: template rows, user overrides, validation, text.

Template rows: section, ord, param, mode (default or mandatory), default_value.  Overrides:
kind (by_value or by_pattern), key, value, active.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.functions.strings import fortran_text
from hydroloom.operators.masks import counted, small

#: Parameters of a template that one task compares with patterns.
PARAMS = 20_000


def build_updates(template: DataFrame, overrides: DataFrame) -> DataFrame:
    """(param, value, kind): by_value where the key is the parameter, by_pattern where the parameter contains the key.

    by_value wins; of several patterns the first by key does.  Of a key that is given more than
    once the last one counts: the highest `ord` where overrides have such a column, else the
    greatest value.  A parameter meets patterns by its substrings of the patterns' lengths, an
    equi-join; parameters are dealt to as many tasks as they need and stay there, if the
    patterns are few enough to be sent to all.
    """
    active = overrides.filter(F.coalesce("active", F.lit(True)))
    last = F.max_by("value", F.struct("ord", "value") if "ord" in overrides.columns else F.col("value"))
    given = active.groupBy("kind", "key").agg(last.alias("value"))
    exact = given.filter("kind = 'by_value'").select(F.col("key").alias("param"), F.col("value").alias("exact"))
    pattern = given.filter("kind = 'by_pattern'").select("key", F.col("value").alias("like"))
    tasks = max(-(-counted(template) // PARAMS), int(template.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    params = template.select("param").repartition(tasks, "param").distinct()
    lengths = pattern.agg(F.collect_set(F.length("key")).alias("lengths"))
    parts = params.join(F.broadcast(lengths)).select("param", F.explode(F.filter("lengths", lambda n: n <= F.length("param"))).alias("n"))
    starts = parts.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("param") - F.col("n") + 1)))
    pieces = starts.select("param", F.substring("param", F.col("at"), F.col("n")).alias("key"))
    # a piece that a parameter has twice is as good as one
    matched = pieces.join(small(pattern), "key").groupBy("param").agg(F.min_by("like", "key").alias("like"))
    both = exact.join(matched, "param", "full")
    return both.select("param", F.coalesce("exact", "like").alias("value"), F.when(F.col("exact").isNotNull(), "by_value").otherwise("by_pattern").alias("kind"))


def build_values(template: DataFrame, overrides: DataFrame) -> DataFrame:
    """Template rows with `value`: the override, else the default (none for mandatory parameters)."""
    updates = build_updates(template, overrides).select("param", F.col("value").alias("user_value"))
    default = F.when(F.col("mode") == "default", F.col("default_value"))
    return template.join(updates, "param", "left").withColumn("value", F.coalesce("user_value", default)).drop("user_value")


def validate(template: DataFrame, overrides: DataFrame) -> DataFrame:
    """(problem, param): mandatory parameters without a value, exact overrides of unknown parameters, and of unknown sections.

    Overrides may have a column `section`; where it is given the template must have it.
    """
    missing = build_values(template, overrides).filter((F.col("mode") == "mandatory") & F.col("value").isNull()).select(F.lit("missing mandatory").alias("problem"), "param")
    known = template.select("param").distinct()
    unknown = overrides.filter("kind = 'by_value' and coalesce(active, true)").select(F.col("key").alias("param")).join(known, "param", "left_anti").select(F.lit("unknown parameter").alias("problem"), "param")
    found = missing.unionByName(unknown)
    if "section" in overrides.columns:
        named = overrides.filter("section is not null and coalesce(active, true)").select("section").distinct()
        found = found.unionByName(named.join(template.select("section").distinct(), "section", "left_anti").select(F.lit("unknown section").alias("problem"), F.col("section").alias("param")))
    return found


def template_of(parsed: DataFrame, versions: DataFrame, mandatory: DataFrame | None = None) -> DataFrame:
    """(model, version, section, ord, param, mode, default_value) from namelists of given files.

    `parsed` is what `text.parse_namelist` returns, `versions` (file, model, version) names the
    files, `mandatory` (section, param) names the parameters without a default.  A parameter
    that stands twice in a section counts once, as its last line says; files without a version
    are left out.
    """
    last = F.max_by(F.struct("ord", "value"), "ord").alias("last")
    rows = parsed.groupBy("file", "section", "param").agg(last).join(small(versions), "file")
    if mandatory is None:
        rows = rows.withColumn("asked", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(small(mandatory.select("section", "param").distinct().withColumn("asked", F.lit(True))), ["section", "param"], "left")
    mode = F.when(F.col("asked"), "mandatory").otherwise("default")
    return rows.select("model", "version", "section", F.col("last.ord").alias("ord"), "param", mode.alias("mode"), F.when(F.col("asked").isNull(), F.col("last.value")).alias("default_value"))


def of_version(templates: DataFrame, model: str, version: str) -> DataFrame:
    """The template of one model and version; their names in any case."""
    fits = lambda c, x: F.lower(c) == x.lower()
    return templates.filter(fits("model", model) & fits("version", version)).drop("model", "version")


def to_text(values: DataFrame) -> DataFrame:
    """(section, text): each section's lines in the template's order; values with `value_kind` as a namelist writes them."""
    line = F.concat(F.lit("    "), "param", F.lit(" = "), fortran_text(F.col("value_kind"), F.col("value")))
    lines = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return values.groupBy("section").agg(F.concat(F.lit("&"), F.first("section"), F.lit("\n"), body, F.lit("\n/")).alias("text"))
