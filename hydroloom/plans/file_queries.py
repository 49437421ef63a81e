"""Registered queries of files, layouts, names, ledgers and streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydroloom.functions import strings, times
from hydroloom.model import NO_DATA
from hydroloom.operators import masks, physics, series, shaping, spatial
from hydroloom.plans import adapters
from hydroloom.plans.adapters import with_views
from hydroloom.plans.queries import query, r6
from hydroloom.runner import execution
from hydroloom.shared import new_path, written
from hydroloom.sinks import tables
from hydroloom.sources import binary, text
from hydroloom.streaming import steps

C = F.col


# files


@query(
    """WITH s AS (SELECT s_suppkey // 3 AS file, s_suppkey % 3 AS own, s_suppkey AS k, count(*) OVER (PARTITION BY s_suppkey // 3) AS n FROM supplier)
    SELECT file::VARCHAR AS path, (i % 2)::INT AS row, (i // 2)::INT AS col, t::INT AS t, (k * 10 + i) / 10.0::DOUBLE AS value FROM s, range(6) a(i), range(4) b(t) WHERE n = 1 OR t = own"""
)
def scan_int_cube(spark, sf_dir):
    """Integer cubes of three steps of 2 x 3 cells each; a file of one step stands for all four steps expected."""
    k = C("s_suppkey")
    shown = lambda v: F.lpad(F.hex(v), 8, "0")
    little = lambda h: F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])
    step = F.concat(*[little(shown(k * 10 + i)) for i in range(6)])
    files = adapters.table(spark, sf_dir, "supplier").groupBy(F.floor(k / 3).cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), step.alias("step")))).alias("steps"))
    content = F.unhex(F.array_join(F.transform("steps", lambda s: s["step"]), ""))
    return binary.int_cube(written(files.select("path", content.alias("content")), "cubes"), 2, 3, expected=4)


def _assets(spark, sf_dir, name: str, lines) -> str:
    """The folder of asset files, a region a file: the number of records, then each nation's lines in order."""
    s = adapters.sections(spark, sf_dir)
    records = s.select("region", C("pos").alias("at"), lines(C("pos")).alias("line"))
    heads = s.groupBy("region").agg(F.concat(F.count("*").cast("string"), F.lit("  # records")).alias("line")).withColumn("at", F.lit(-1))
    path = new_path(spark, name)
    records.unionByName(heads).repartition("region").sortWithinPartitions("region", "at").select("region", "line").write.partitionBy("region").text(path)
    return f"{path}/*/*"


def _block(*lines: Column | str) -> Column:
    """Lines of a record, each with a remark."""
    return F.concat_ws("\n", *[F.concat(F.lit(x) if isinstance(x, str) else x.cast("string"), F.lit("   # remark")) for x in lines])


def _children(pos: Column, block) -> Column:
    """A record's children, pos % 3 of them."""
    made = F.transform(F.sequence(F.lit(0), F.lit(1)), block)
    return F.when(pos % 3 == 0, F.array().cast("array<string>")).when(pos % 3 == 1, F.slice(made, 1, 1)).otherwise(made)


ASSETS = with_views("sections") + ", d AS (SELECT *, (row_number() OVER (PARTITION BY region ORDER BY pos) - 1)::INT AS parent_no FROM sections) "


@query(ASSETS + "SELECT parent_no, i::INT AS child_no, 'dam ' || pos AS name, 'code' || pos AS code, 'plant ' || pos || '-' || i AS plant, (pos + i)::VARCHAR AS flag FROM d, range(2) c(i) WHERE i < pos % 3")
def scan_point_dams(spark, sf_dir):
    """Dams with up to two plants written as asset files, and scanned again; a row a plant."""

    def lines(pos):
        plants = _children(pos, lambda i: _block(F.concat(F.lit("plant "), pos, F.lit("-"), i), "3 4", "60", "12.5", pos + i))
        dam = _block(F.concat(F.lit("dam "), pos), pos % 3, "1 2", "1000.0", "500.0", "80.0", "30.0", F.concat(F.lit("code"), pos))
        return F.array_join(F.concat(F.array(dam), plants), "\n")

    read = text.read_points(spark, _assets(spark, sf_dir, "dams", lines), "dam")
    field = lambda n: C("fields")[n]
    return read.select("parent_no", "child_no", "name", field("code").alias("code"), field("plant").alias("plant"), field("plant_flag").alias("flag"))


@query(ASSETS + "SELECT parent_no, i::INT AS child_no, 'intake ' || pos AS name, 'release ' || pos || '-' || i AS release, '0.' || pos || i AS share FROM d, range(2) c(i) WHERE i < pos % 3")
def scan_point_intakes(spark, sf_dir):
    """Intakes with up to two releases written as asset files, and scanned again; a row a release."""

    def lines(pos):
        releases = _children(pos, lambda i: _block(F.concat(F.lit("release "), pos, F.lit("-"), i), "3 4", "12.5", "0.5", F.concat(F.lit("0."), pos, i)))
        return F.array_join(F.concat(F.array(_block(F.concat(F.lit("intake "), pos), pos % 3, "1 2")), releases), "\n")

    read = text.read_points(spark, _assets(spark, sf_dir, "intakes", lines), "intake")
    return read.select("parent_no", "child_no", "name", C("fields")["release"].alias("release"), C("fields")["share"].alias("share"))


@query(ASSETS + "SELECT parent_no, 'lake ' || pos AS name, (pos * 100)::VARCHAR AS volume_min, '0.' || pos AS constant FROM d")
def scan_point_lakes(spark, sf_dir):
    """Lakes written as asset files, and scanned again."""
    lines = lambda pos: _block(F.concat(F.lit("lake "), pos), "1 2", pos * 100, "7.5", F.concat(F.lit("0."), pos))
    read = text.read_points(spark, _assets(spark, sf_dir, "lakes", lines), "lake")
    return read.select("parent_no", "name", C("fields")["volume_min"].alias("volume_min"), C("fields")["constant"].alias("constant"))


@query(ASSETS + "SELECT 'dam ' || pos AS name, string_agg('plant ' || pos || '-' || i, ', ' ORDER BY i) AS plants FROM d, range(2) c(i) WHERE i < pos % 3 GROUP BY pos")
def plants_of_dams(spark, sf_dir):
    rows = adapters.sections(spark, sf_dir).withColumn("child_no", F.explode(F.sequence(F.lit(0), F.lit(1)))).filter("child_no < pos % 3")
    plant = F.concat(F.lit("plant "), C("pos"), F.lit("-"), C("child_no"))
    points = rows.select(C("region").alias("path"), F.concat(F.lit("dam "), C("pos")).alias("name"), "child_no", F.create_map(F.lit("plant"), plant).alias("fields"))
    return text.plants_by_dam(points).select("name", F.array_join(F.transform("plants", lambda p: p["plant"]), ", ").alias("plants"))


@query("SELECT (c_custkey // 15)::VARCHAR AS row, (c_custkey % 15)::VARCHAR AS col, c_mktsegment AS domain, replace(c_name, ' ', '_') AS section FROM customer WHERE c_custkey % 6 > 0")
def scan_point_sections(spark, sf_dir):
    """Sections by row and column written as lines, every sixth too short, and scanned again."""
    k, path = C("c_custkey"), new_path(spark, "point-sections")
    place = F.concat_ws("  ", F.floor(k / 15), k % 15)
    line = F.when(k % 6 == 0, place).otherwise(F.concat_ws(" ", place, "c_mktsegment", F.replace("c_name", F.lit(" "), F.lit("_"))))
    adapters.table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return text.read_point_sections(spark, path)


@query("SELECT p_partkey::DOUBLE AS x, p_retailprice AS y FROM part")
def scan_pairs(spark, sf_dir):
    """A table of two columns written as text and scanned again."""
    path = new_path(spark, "pairs")
    adapters.table(spark, sf_dir, "part").select(F.concat_ws("\t", "p_partkey", C("p_retailprice").cast("string")).alias("value")).write.text(path)
    return text.read_pairs(spark, path)


@query("SELECT p_partkey::INT AS p_partkey, p_name, p_retailprice FROM part")
def scan_csv_by_ending(spark, sf_dir):
    """Parts written as gzipped CSV, and scanned by the dispatcher."""
    path = f"{new_path(spark, 'scan')}/parts.csv"
    tables.write(adapters.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), path, "csv.gz")
    return binary.read(spark, path)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier")
def scan_parquet_appended(spark, sf_dir):
    """Suppliers written as Parquet twice, the second time appended, and scanned by the dispatcher."""
    path = f"{new_path(spark, 'scan')}/suppliers.parquet"
    s = adapters.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    tables.write(s, path)
    tables.write(s.withColumn("s_suppkey", C("s_suppkey") + 1_000_000), path, append=True)
    return binary.read(spark, path)


@query("SELECT n_name AS name, 10.0::DOUBLE + n_nationkey AS x, 46.0::DOUBLE - n_nationkey AS y FROM nation")
def scan_geojson(spark, sf_dir):
    """Nations written as GeoJSON, a collection a region, and scanned again by feature."""
    at = F.struct(F.lit("Point").alias("type"), F.array(10.0 + C("pos"), 46.0 - C("pos")).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), at.alias("geometry"), F.struct("name").alias("properties")))
    whole = F.concat(F.lit('{"type": "FeatureCollection",\n "features": ['), F.array_join(F.collect_list(feature), ",\n"), F.lit("]}"))
    path = new_path(spark, "geojson")
    adapters.sections(spark, sf_dir).groupBy("region").agg(whole.alias("line")).repartition("region").write.partitionBy("region").text(path)
    read = text.read_geojson(spark, f"{path}/*/*")
    return read.select("properties.name", C("geometry.coordinates")[0].alias("x"), C("geometry.coordinates")[1].alias("y"))


# grids


@query(with_views("ref") + ", rows AS (SELECT unnest(range(max(row) + 1)) AS r FROM ref) SELECT r::INT AS row, c::INT AS col, round(46.0::DOUBLE - 0.1::DOUBLE * r, 6) AS lat, round(10.0::DOUBLE + 0.1::DOUBLE * c, 6) AS lon, 1.0::DOUBLE AS value FROM rows, range(15) b(c)")
def constant_grid(spark, sf_dir):
    """Ones on every cell of the terrain's box, also where no part stands."""
    box = adapters.ref(spark, sf_dir).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    cells = spatial.regular_grid((box[0], box[1]), (box[2], box[3]), 0.1, spark)
    return cells.select("row", "col", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"), F.lit(1.0).alias("value"))


@query(
    with_views("grid")
    + """, clicks AS (SELECT * FROM grid WHERE var = 'click'), box AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM clicks),
    target AS (SELECT r AS row, c AS col, n - 0.02::DOUBLE * r AS lat, w + 0.02::DOUBLE * c AS lon FROM box, range(5001) a(r), range(72) b(c) WHERE r <= round((n - s) / 0.02) AND c <= round((e - w) / 0.02)),
    t AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM target),
    s AS (SELECT DISTINCT row, col, cos(radians(lat)) * cos(radians(lon)) * 6370997.0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0 AS y, sin(radians(lat)) * 6370997.0 AS z FROM clicks),
    near AS (SELECT t.row, t.col, s.row AS src_row, s.col AS src_col, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 AS d2 FROM s JOIN t ON abs(s.x - t.x) < 3336 AND abs(s.y - t.y) < 3336 AND abs(s.z - t.z) < 3336),
    best AS (SELECT * FROM near WHERE d2 < (0.02 * 111195 * 1.5) ** 2 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d2, src_row, src_col) = 1)
    SELECT g.time, b.row::INT AS row, b.col::INT AS col, round(t.lat, 6) AS lat, round(t.lon, 6) AS lon, g.value FROM best b JOIN clicks g ON g.row = src_row AND g.col = src_col JOIN target t ON t.row = b.row AND t.col = b.col"""
)
def warp_to_finer(spark, sf_dir):
    """The click field at a fifth of its spacing by nearest cell; cells too far from any have no row."""
    done = spatial.warp(adapters.grid(spark, sf_dir).filter("var = 'click'"), 0.02, spark).filter("value is not null")
    return done.select("time", "row", "col", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"), "value")


@query(with_views("ref") + "SELECT row, col, CASE WHEN ref_value >= 0 THEN 7.0::DOUBLE ELSE -9999.0::DOUBLE END AS value, (99999 - row)::INT AS flipped FROM ref")
def constant_on_land(spark, sf_dir):
    """A constant where there is terrain, beside the rows of the other vertical orientation."""
    filled = adapters.ref(spark, sf_dir).select("row", "col", physics.constant_on_land(C("ref_value"), 7.0).alias("value"), C("row").alias("own"))
    return shaping.flip_rows(filled, 100_000).select(C("own").alias("row"), "col", "value", C("row").alias("flipped"))


@query(with_views("grid") + "SELECT var, time, row, col, value FROM grid WHERE var IN ('click', 'error')")
def var_select(spark, sf_dir):
    return shaping.select_vars(adapters.grid(spark, sf_dir), ["click", "error"]).select("var", "time", "row", "col", "value")


@query(with_views("grid") + "SELECT var, time, row, col, value FROM grid WHERE var = 'view'")
def var_select_by_mapping(spark, sf_dir):
    return shaping.select_by_mapping(adapters.grid(spark, sf_dir), "rain:view").select("var", "time", "row", "col", "value")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'rain' ELSE event_type END AS name FROM events")
def var_rename_by_tag(spark, sf_dir):
    tag = F.concat(F.lit("domain:time:"), "event_type")
    return adapters.table(spark, sf_dir, "events").select("event_id", shaping.rename_by_tag(tag, {"click": "rain"}).alias("name"))


@query(with_views("ref") + "SELECT row, col, CASE WHEN ref_value = -9999 THEN -1.0::DOUBLE ELSE ref_value END AS value FROM ref")
def no_data_reset(spark, sf_dir):
    return adapters.ref(spark, sf_dir).select("row", "col", shaping.reset_no_data(C("ref_value"), NO_DATA, -1.0).alias("value"))


@query(with_views("grid") + 'SELECT var, time, col AS "X", (999 - row)::INT AS "Y", value::FLOAT AS value FROM grid')
def sink_s3m_layout(spark, sf_dir):
    return tables.s3m_layout(adapters.grid(spark, sf_dir), 1000)


# series


@query("SELECT o_orderkey AS line, 'n' || c_nationkey AS tag, o_orderdate::TIMESTAMP AS time, o_totalprice AS value, n_name AS section FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def sink_series(spark, sf_dir):
    """Series written with days since 1970 and the registry beside them; times come from the days read again."""
    path, tag = new_path(spark, "series"), F.concat(F.lit("n"), "pos")
    rows = adapters.lines(spark, sf_dir).select(C("time").cast("timestamp_ntz").alias("time"), tag.alias("tag"), "value", "line")
    tables.write_series(rows, adapters.sections(spark, sf_dir).select(tag.alias("tag"), C("name").alias("section")), path)
    registry = spark.read.parquet(f"{path}/registry")
    return spark.read.parquet(f"{path}/series").join(masks.small(registry), "tag").select("line", "tag", times.cf_decode(C("days")).alias("time"), "value", "section")


@query(
    with_views("grid")
    + """, a AS (SELECT time, max(value) AS click FROM grid WHERE var = 'click' GROUP BY time), b AS (SELECT time, max(value) AS view FROM grid WHERE var = 'view' AND value > 50 GROUP BY time), c AS (SELECT time, min(value) AS error FROM grid WHERE var = 'error' GROUP BY time)
    SELECT time, click, view, error FROM a FULL JOIN b USING (time) FULL JOIN c USING (time)"""
)
def series_side_by_side(spark, sf_dir):
    g = adapters.grid(spark, sf_dir)
    by = lambda rows, value, name: g.filter(rows).groupBy("time").agg(value.alias(name))
    frames = [by("var = 'click'", F.max("value"), "click"), by("var = 'view' and value > 50", F.max("value"), "view"), by("var = 'error'", F.min("value"), "error")]
    return series.concat_columns(frames)


@query("SELECT c_nationkey AS section, max(c_acctbal * -10.5) FILTER (WHERE c_acctbal * -10.5 > -9990) AS chart, max(c_acctbal * -10.5) FILTER (WHERE c_acctbal * -10.5 >= 0) AS shown, count(*) FILTER (WHERE c_acctbal * -10.5 <= -9990) AS missing FROM customer GROUP BY c_nationkey")
def maxima_for_chart_and_table(spark, sf_dir):
    """The two rules of valid values: the chart's takes negative ones, the table's doesn't."""
    v = C("c_acctbal") * -10.5
    held = lambda rule: F.max(F.when(rule(v), v))
    return adapters.table(spark, sf_dir, "customer").groupBy(C("c_nationkey").alias("section")).agg(held(series.valid_for_chart).alias("chart"), held(series.valid_for_table).alias("shown"), F.count_if(~series.valid_for_chart(v)).alias("missing"))


# names, times and scalars


@query("SELECT event_id, date_trunc('minute', ts) AS time, event_type AS kind, date_trunc('minute', ts) AS by_digits FROM events")
def times_and_tags_of_paths(spark, sf_dir):
    """Times and tags read from file names by a template, and times by a name's last digits."""
    path = F.concat(F.lit("maps/"), "event_type", F.lit("/rain_"), F.date_format("ts", "yyyyMMddHHmm"), F.lit(".nc"))
    named = adapters.table(spark, sf_dir, "events").select("event_id", path.alias("path"))
    time, tags = strings.date_and_tags(C("path"), "maps/{kind}/rain_%Y%m%d%H%M.nc")
    return named.select("event_id", time.alias("time"), tags["kind"].alias("kind"), times.time_from_name(C("path")).alias("by_digits"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01 00:00:00')) / 86400000000.0::DOUBLE, 9) AS days, ts AS back FROM events")
def cf_times(spark, sf_dir):
    days = times.cf_encode(C("ts"), "2000-01-01")
    coded = adapters.table(spark, sf_dir, "events").select("event_id", days.alias("days"))
    return coded.select("event_id", F.round("days", 9).alias("days"), times.cf_decode(C("days"), "2000-01-01").alias("back"))


@query("SELECT o_orderkey, o_orderdate - INTERVAL 18 HOUR AS by_hours, o_orderdate - INTERVAL 2 MONTH AS by_months, date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders")
def restart_times(spark, sf_dir):
    t = C("o_orderdate").cast("timestamp_ntz")
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", times.restart_time(t, 6, "3h").alias("by_hours"), times.restart_time(t, 2, "month").alias("by_months"), times.floor_time(t, "month").alias("month"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'str' WHEN 2 THEN 'int' WHEN 3 THEN 'float' ELSE 'str' END AS kind,
        CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN p_name WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || '.5d0' ELSE 'bare' END AS value,
        CASE p_partkey % 5 WHEN 0 THEN '.true.' WHEN 1 THEN '''' || p_name || '''' WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || '.5d0' ELSE '''bare''' END AS shown FROM part"""
)
def namelist_scalars(spark, sf_dir):
    """Tokens of namelists parsed to kinds and values, and written again."""
    k, size = C("p_partkey"), C("p_size").cast("string")
    token = F.when(k % 5 == 0, " .TRUE. ").when(k % 5 == 1, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(k % 5 == 2, size).when(k % 5 == 3, F.concat(size, F.lit(".5d0"))).otherwise("bare")
    parsed = adapters.table(spark, sf_dir, "part").select("p_partkey", strings.fortran_scalar(token).alias("s"))
    return parsed.select("p_partkey", "s.kind", "s.value", strings.fortran_text(C("s.kind"), C("s.value")).alias("shown"))


@query("SELECT c_custkey, 'Observed ' || c_name || ' [m3/s]' AS label, CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE printf('%.3f', c_acctbal) END AS shown, left(c_name, 12) AS brief FROM customer")
def labels_and_values(spark, sf_dir):
    value = F.when(C("c_custkey") % 4 > 0, C("c_acctbal"))
    return adapters.table(spark, sf_dir, "customer").select("c_custkey", strings.series_label(F.lit("observed"), C("c_name")).alias("label"), strings.shown_value(value).alias("shown"), strings.shortened(C("c_name"), 12).alias("brief"))


# ledger and streams


@query("SELECT o_orderpriority AS tag, count(*) AS runs, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS failed, sum((o_orderkey % 7)::DOUBLE) AS seconds, arg_max((o_orderkey % 3)::INT, o_orderkey) AS last_exit_code FROM orders GROUP BY o_orderpriority")
def run_ledger_summary(spark, sf_dir):
    """Orders as runs of a model."""
    k = C("o_orderkey")
    ledger = adapters.table(spark, sf_dir, "orders").select(C("o_orderpriority").alias("tag"), (k % 3).cast("int").alias("exit_code"), (k % 3 == 0).alias("ok"), k.cast("double").alias("started"), (k % 7).cast("double").alias("seconds"))
    return execution.summary(ledger)


def _landed(spark, sf_dir, files: int) -> str:
    """Events as fields in a landing folder of some files."""
    path = new_path(spark, "landing")
    e = adapters.table(spark, sf_dir, "events").select(C("event_type").alias("var"), C("ts").cast("timestamp_ntz").alias("time"), *adapters.cells("user_id"), "value")
    e.repartition(files).write.parquet(path)
    return path


@query("SELECT event_type AS var, ts AS time, (user_id // 15)::INT AS row, (user_id % 15)::INT AS col, CASE WHEN value < 20 THEN -9999.0::DOUBLE ELSE value END AS value FROM events")
def stream_of_steps(spark, sf_dir):
    """The step loop as a file stream of several batches: every file masked by limits once."""
    stream = steps.stream_grids(spark, _landed(spark, sf_dir, 4), files=2)
    out = new_path(spark, "steps")
    steps.run_steps(stream, lambda batch: masks.mask_by_limits(batch, 20.0), out, new_path(spark, "steps-state")).awaitTermination()
    return spark.read.parquet(f"{out}/*").select("var", "time", "row", "col", "value")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS time, event_type AS var, (user_id // 15)::INT AS row, (user_id % 15)::INT AS col, round(avg(value), 6) AS value FROM events
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 3 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) GROUP BY ALL"""
)
def stream_hourly_means(spark, sf_dir):
    """Hourly means of a file stream; hours that end within two hours of the last event stay open."""
    means = steps.hourly_means(steps.stream_grids(spark, _landed(spark, sf_dir, 4)))
    out = new_path(spark, "means")
    means.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "means-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(out)
    return done.select(C("window.start").cast("timestamp_ntz").alias("time"), "var", "row", "col", r6(C("value")).alias("value"))
