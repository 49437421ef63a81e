"""Sources in text form: grids, registries, discharge series, hydrograph documents, point assets.

Readers split lines and tokens with column functions.  Formats whose records span lines are
read a file a row (wholetext), since their files are small by nature.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.functions.strings import registry_tag, section_tag
from hydroloom.functions.times import parse_any
from hydroloom.model import nothing


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def read_ascii_grid(spark: SparkSession, path: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """(path, row, col, lat, lon, ref_value) of ESRI ASCII grids; row 0 is north, no-data and values out of least..most are NULL.

    The matrix is read as a stream of tokens, so its lines may be wrapped anywhere.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), _tokens(F.col("value")).alias("t"))
    head = lambda name: F.element_at(F.col("t"), (F.array_position(F.transform(F.slice("t", 1, 12), F.lower), name) + 1).cast("int")).cast("double")
    size = F.when(F.array_contains(F.transform(F.slice("t", 1, 12), F.lower), "nodata_value"), 12).otherwise(10)
    heads = whole.select("path", head("ncols").cast("int").alias("cols"), head("nrows").cast("int").alias("rows"), head("xllcorner").alias("west"), head("yllcorner").alias("south"), head("cellsize").alias("step"), F.when(size == 12, head("nodata_value")).otherwise(-9999.0).alias("no_data"), F.expr("slice(t, cast(%s as int) + 1, size(t))" % "if(array_contains(transform(slice(t, 1, 12), x -> lower(x)), 'nodata_value'), 12, 10)").alias("cells"))
    cells = heads.select("*", F.posexplode("cells").alias("i", "token"))
    value = F.col("token").cast("double")
    good = (value != F.col("no_data")) & ~nothing(value)
    for bound, keep in ((least, value >= F.lit(least)), (most, value <= F.lit(most))):
        if bound is not None:
            good &= keep
    row, col = F.floor(F.col("i") / F.col("cols")).cast("int"), (F.col("i") % F.col("cols")).cast("int")
    return cells.select("path", row.alias("row"), col.alias("col"), (F.col("south") + (F.col("rows") - row - 0.5) * F.col("step")).alias("lat"), (F.col("west") + (col + 0.5) * F.col("step")).alias("lon"), F.when(good, value).alias("ref_value"))


def read_sections_data(spark: SparkSession, path: str) -> DataFrame:
    """(time, pos, value, line): a time in the first column, a number a section in the others; what is no number is NULL.

    `line` orders lines by file and place in it; unreadable times raise.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "text")).filter(F.trim("text") != "")
    parts = lines.select(F.struct("path", "n").alias("line"), _tokens(F.col("text")).alias("t"))
    rows = parts.select("line", F.to_timestamp_ntz(F.col("t")[0], F.lit("yyyyMMddHHmm")).alias("time"), F.posexplode(F.slice("t", F.lit(2), F.size("t"))).alias("pos", "token"))
    return rows.select("time", "pos", F.col("token").try_cast("double").alias("value"), "line")


def read_sections_registry(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, pos, x, y, catchment, section, extra, tag) of the model's registries; comments (# or ;) and malformed lines are left out.

    pos counts the lines of each file, which meet in one task.  strict: a malformed line raises.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "text"))
    text = F.trim("text")
    kept = lines.filter((text != "") & ~text.startswith("#") & ~text.startswith(";")).select("path", "n", F.split(text, r"\s+", 5).alias("t"))
    part = lambda i: F.get(F.col("t"), F.lit(i))
    rows = kept.select("path", "n", part(0).try_cast("int").alias("x"), part(1).try_cast("int").alias("y"), part(2).alias("catchment"), part(3).alias("section"), part(4).alias("extra"))
    good = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = rows.withColumn("x", F.when(good, F.col("x")).otherwise(F.raise_error(F.lit("malformed registry line")).cast("int"))) if strict else rows.filter(good)
    from pyspark.sql import Window

    pos = (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).cast("int")
    return rows.select("path", pos.alias("pos"), "x", "y", "catchment", "section", "extra", registry_tag(F.col("catchment"), F.col("section")).alias("tag"))


def read_sections_db(spark: SparkSession, path: str, contains: dict[str, str] | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """The sections' database: `;` CSV in ISO-8859-1, rows whose columns contain the given texts (any case), with `tag`.

    columns: new names in their order; others are left out.
    """
    db = spark.read.csv(path, header=True, sep=";", encoding="ISO-8859-1")
    for name, part in (contains or {}).items():
        db = db.filter(F.contains(F.lower(name), F.lit(part.lower())))
    if "DATI_DA" in db.columns:
        db = db.withColumn("tag", section_tag(F.col("DATI_DA")))
    return db.select(*[F.col(old).alias(new) for old, new in columns.items()], *["tag"] * ("tag" in db.columns)) if columns else db


def basins_of(db: DataFrame, column: str = "BASIN") -> DataFrame:
    """(basin): the database's basins, each once, empty ones left out."""
    return db.select(F.col(f"`{column}`").alias("basin")).filter("basin is not null and basin != ''").distinct()


def explode_hydrographs(docs: DataFrame, column: str = "json", series: dict[str, str] | None = None) -> DataFrame:
    """(domain, section, run, kind, pos, time, value) of hydrograph documents (flat JSON objects of strings).

    A series shorter than the time list ends in NULLs, a longer one is cut; what is no number
    and -9990 or less is NULL.  Documents that are no JSON give no rows.
    """
    series = series or {"observed": "time_series_discharge_observed", "simulated": "time_series_discharge_simulated"}
    parsed = docs.select(F.from_json(column, "map<string,string>").alias("d")).filter(F.col("d").isNotNull())
    times = F.transform(F.split(F.col("d")["time_period"], ","), lambda x: F.trim(x))
    kinds = F.explode(F.create_map(*[x for kind, key in series.items() for x in (F.lit(kind), F.split(F.coalesce(F.col("d")[key], F.lit("")), ","))])).alias("kind", "values")
    base = parsed.select(F.col("d")["section_domain"].alias("domain"), F.col("d")["section_name"].alias("section"), F.col("d")["time_run"].alias("run"), times.alias("times"), kinds)
    rows = base.select("domain", "section", "run", "kind", "values", F.posexplode("times").alias("pos", "t"))
    value = F.trim(F.get("values", F.col("pos"))).try_cast("double")
    return rows.select("domain", "section", "run", "kind", "pos", parse_any(F.col("t")).alias("time"), F.when(~nothing(value) & (value > -9990), value).alias("value"))


def read_hydrographs(spark: SparkSession, path: str, **kind) -> DataFrame:
    return explode_hydrographs(spark.read.text(path, wholetext=True), "value", **kind)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature of the collections."""
    return spark.read.json(path, multiLine=True).select(F.explode("features").alias("feature")).select("feature.*")


def parse_namelist(lines: DataFrame, lower: bool = False) -> DataFrame:
    """(file, section, ord, param, value) from lines (file, n, text) of Fortran namelists.

    Section names are as written; `lower`: in lower case.

    `&name` opens a section, `/` closes it, `!` begins a remark; lines outside sections and
    without `=` are left out.
    """
    from pyspark.sql import Window

    text = F.trim(F.regexp_replace("text", r"!.*$", ""))
    order = Window.partitionBy("file").orderBy("n")
    name = F.trim(F.regexp_replace(text, "^&", ""))
    opened = F.when(text.startswith("&"), F.lower(name) if lower else name).when(text == "/", "")
    inside = lines.withColumn("section", F.last(opened, ignorenulls=True).over(order)).withColumn("clean", text)
    rows = inside.filter((F.col("section") != "") & ~F.col("clean").startswith("&") & F.col("clean").contains("="))
    parts = F.split("clean", "=", 2)
    return rows.select("file", "section", F.col("n").alias("ord"), F.trim(parts[0]).alias("param"), F.regexp_replace(F.trim(parts[1]), r",\s*$", "").alias("value"))


def join_continued(lines: DataFrame) -> DataFrame:
    """Lines (file, n, text) with those that go on (a comma or & at the end, the next without `=`) joined to one, at the first one's number."""
    from pyspark.sql import Window

    text = F.trim(F.regexp_replace("text", r"!.*$", ""))
    order = Window.partitionBy("file").orderBy("n")
    goes_on = F.lag(text).over(order).rlike(r"[,&]$") & ~text.contains("=") & ~text.startswith("&") & (text != "/") & (text != "")
    begun = lines.withColumn("clean", F.regexp_replace(text, r"&$", "")).withColumn("begins", F.when(goes_on, None).otherwise(F.col("n")))
    first = begun.withColumn("first", F.last("begins", ignorenulls=True).over(order))
    whole = F.sort_array(F.collect_list(F.struct("n", "clean")))
    return first.groupBy("file", F.col("first").alias("n")).agg(F.array_join(F.transform(whole, lambda x: x["clean"]), " ").alias("text"))


def read_namelist(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "text"))
    return parse_namelist(whole, lower)


#: Fields of the counted records of point assets, in the order of their lines.
DAM = ("name", "plants", "row_col", "volume_max", "volume_start", "discharge_max", "level_max", "code")
PLANT = ("plant", "plant_row_col", "corrivation", "plant_discharge_max", "plant_flag")
LAKE = ("name", "row_col", "volume_min", "volume_start", "constant")
INTAKE = ("name", "releases", "row_col")
RELEASE = ("release", "release_row_col", "discharge_max", "discharge_min", "share")


def _records(whole: DataFrame, parent: tuple[str, ...], child: tuple[str, ...] | None, mark: str) -> DataFrame:
    """Counted blocks: a first line with the number of parents, each parent's lines, then those of its children."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["value"], strict=True):
                lines = [line.split(mark)[0].strip() for line in text.splitlines()]
                lines = [line for line in lines if line]
                at, out, seen = 1, [], set()
                for i in range(int(lines[0])):
                    held = dict(zip(parent, lines[at : at + len(parent)], strict=True))
                    at += len(parent)
                    if held["name"] in seen:
                        raise ValueError(f"{path}: {held['name']} stands twice")
                    seen.add(held["name"])
                    n = int(held[parent[1]]) if child else 1
                    for j in range(n):
                        own = dict(zip(child, lines[at : at + len(child)], strict=True)) if child else {}
                        at += len(own)
                        out.append((path, i, j, held["name"], {**held, **own}))
                yield pd.DataFrame(out, columns=["path", "parent_no", "child_no", "name", "fields"])

    return whole.mapInPandas(split, "path string, parent_no int, child_no int, name string, fields map<string,string>")


def read_points(spark: SparkSession, path: str, kind: str, mark: str = "#") -> DataFrame:
    """Point assets, a row for each child (dam's plant, intake's release) or lake; a name that stands twice raises."""
    shapes = {"dam": (DAM, PLANT), "intake": (INTAKE, RELEASE), "lake": (LAKE, None)}
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if kind == "joint":
        count = F.regexp_extract(F.trim("value"), r"^(\d+)", 1).cast("int")
        return whole.select("path", F.when(count == 0, 0).otherwise(F.raise_error(F.lit("joints are not read")).cast("int")).alias("joints")).filter("joints > 0")
    return _records(whole, *shapes[kind], mark)


def plants_by_dam(points: DataFrame) -> DataFrame:
    """A row a dam with all its plants."""
    return points.groupBy("path", "name").agg(F.sort_array(F.collect_list(F.struct("child_no", F.col("fields")["plant"].alias("plant")))).alias("plants"))


def read_point_sections(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, domain, section): the first four of at least four columns."""
    t = _tokens(F.col("value"))
    return spark.read.text(path).select(t.alias("t")).filter(F.size("t") >= 4).select(*[F.col("t")[i].alias(n) for i, n in enumerate(("row", "col", "domain", "section"))])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) of a table of two columns."""
    t = _tokens(F.col("value"))
    return spark.read.text(path).select(t.alias("t")).filter(F.size("t") >= 2).select(F.col("t")[0].cast("double").alias("x"), F.col("t")[1].cast("double").alias("y"))
