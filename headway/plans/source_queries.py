"""Queries that write the driver's tables in the domain's formats to the shared folder, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions.sessions import shared_path
from headway.operators import forecast, grid, history, serving
from headway.plans import bindings as B
from headway.plans.bindings import dated_query, query, rounded
from headway.plans.board_queries import cells
from headway.plans.model_queries import HALVES, halves
from headway.sources import intake, sinks, tables

PART = "CAST(p_partkey AS VARCHAR) AS key, p_name || ', \"' || p_brand || '\"' AS name"


def parts(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"))


def written(df, sep=",", **options):
    path = shared_path(df.sparkSession, "csv")
    df.write.options(header=True, sep=sep, escape='"', **options).csv(path)
    return path


@query("src_1_quoted_csv", f"SELECT {PART} FROM part")
def _(spark, d):
    return tables.read_csv(spark, written(parts(spark, d)))


@query("src_2_plain_csv", "SELECT CAST(p_partkey AS VARCHAR) AS key, '\"' || p_name AS name FROM part")
def _(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit('"'), "p_name").alias("name"))
    path = shared_path(spark, "plain")
    rows.write.options(header=True, sep=";", quote="").csv(path)  # each part file has the header
    return tables.read_csv(spark, path, ";", quoted=False)


@query("src_3_typed_csv", "SELECT p_partkey AS key, p_size AS size FROM part")
def _(spark, d):
    path = written(B.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")), ";")
    return tables.read_csv(spark, path, ";", schema="key long, size int", lenient=False)


@query("src_4_lenient_csv", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS size FROM part")
def _(spark, d):
    size = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return tables.read_csv(spark, written(B.table(spark, d, "part").select(F.col("p_partkey").alias("key"), size.alias("size")), ";"), ";", schema="key long, size int")


def raw_validations(spark, d):
    """Lines of 14 cells, and of 3 for every seventh event."""
    n, date = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    cell = {"tran_no": n.cast("string"), "tran_date_time": date, "validation_result": F.when(F.col("event_type") == "purchase", "1").otherwise("2"), "ngpt_route": F.concat((F.col("user_id") % 10).cast("string"), F.lit(" line"))}
    whole = F.concat_ws(";", *[cell.get(c, F.lit("x")) for c in tables.VALIDATIONS])
    path = shared_path(spark, "validations")
    rows = B.table(spark, d, "events").select(F.when(n % 7 == 0, F.concat(n.cast("string"), F.lit(";x;y"))).otherwise(whole).alias("line"))
    # one column whose name is the header: each part file has it, and any number of tasks writes
    rows.withColumnRenamed("line", ";".join(tables.VALIDATIONS)).write.options(header=True, sep="\x01", quote="").csv(path)
    return path


@query("src_5_validations", "SELECT CAST(event_id AS VARCHAR) AS tran_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tran_date_time, CASE WHEN event_type = 'purchase' THEN '1' ELSE '2' END AS validation_result, (user_id % 10) || ' line' AS ngpt_route FROM events WHERE event_id % 7 <> 0")
def _(spark, d):
    return tables.read_validations(spark, raw_validations(spark, d)).select("tran_no", "tran_date_time", "validation_result", "ngpt_route")


@query("src_5_malformed", "SELECT CAST(event_id AS VARCHAR) AS tran_no, event_id || ';x;y' AS line FROM events WHERE event_id % 7 = 0")
def _(spark, d):
    return tables.malformed(spark, raw_validations(spark, d)).select("tran_no", "line")


@query("src_6_sniffed_csv", "SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    path = written(B.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")), ";")
    return tables.read_csv(spark, path, tables.sniffed_separator(spark, path))


@query("src_7_json_document", "SELECT n_nationkey AS key, n_name AS name FROM nation")
def _(spark, d):
    path = shared_path(spark, "json")
    rows = B.table(spark, d, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("routes"))  # 25 rows
    rows.select(F.to_json(F.struct("routes")).alias("text")).coalesce(1).write.text(path)
    return tables.read_json(spark, path, "routes array<struct<key:int,name:string>>").select(F.explode("routes").alias("r")).select("r.*")


LINES = f"{B.POINTS} SELECT CAST(line AS VARCHAR) AS line, CAST(row_number() OVER (PARTITION BY line ORDER BY id) - 1 AS INT) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM st"


def geojson(spark, d):
    path = shared_path(spark, "geojson")
    sinks.write_geojson(B.stations(spark, d), path, "line", ["id"], ["line"])
    return path


def positions(rows):
    return rounded(rows.select(F.col("properties")["line"].alias("line"), "seq", "lon", "lat"))


@query("src_8_snk_6_geojson", f"WITH {LINES}")
def _(spark, d):
    return positions(tables.read_geojson(spark, geojson(spark, d)))


@query("src_8_bare_list", f"WITH {LINES}")
def _(spark, d):
    text = spark.read.text(geojson(spark, d), wholetext=True).select(F.regexp_extract("value", r"(?s)(\[\s*\{.*\])\s*\}", 1).alias("text"))
    return positions(tables.geojson_rows(text))


@query("src_9_zipped_geojson", f"WITH {LINES}")
def _(spark, d):
    text = spark.read.text(geojson(spark, d), wholetext=True).withColumnRenamed("value", "text")
    path = shared_path(spark, "zipped")
    sinks.zipped_text(text, "lines.geojson").write.parquet(path)
    return positions(tables.geojson_rows(tables.unzipped(spark.read.parquet(path), r"\.(geo)?json$")))


def feed_archive(spark, d):
    stops = B.table(spark, d, "part").select(F.col("p_partkey").alias("stop_id"), F.concat("p_name", F.lit(', "x"')).alias("stop_name"), (F.col("p_size") / 2).alias("stop_lat"), F.lit("?").alias("stop_lon"))
    trips = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("trip_id"), F.col("s_nationkey").alias("route_id"), F.when(F.col("s_suppkey") % 2 == 1, 1).alias("direction_id"))
    routes = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("route_id"), F.col("n_name").alias("route_long_name"), F.lit("0").alias("direction"))
    path = shared_path(spark, "feed")
    sinks.zipped_feed({"stops": stops, "trips": trips, "routes": routes}).write.parquet(path)
    return tables.feed_tables(spark.read.parquet(path))


@query("src_10_snk_5_feed_stops", "SELECT CAST(p_partkey AS VARCHAR) AS stop_id, p_name || ', \"x\"' AS stop_name, p_size / 2 AS stop_lat, CAST(NULL AS DOUBLE) AS stop_lon FROM part")
def _(spark, d):
    return feed_archive(spark, d)["stops"]


@query("src_10_feed_trips", "SELECT CAST(s_suppkey AS VARCHAR) AS trip_id, CAST(s_nationkey AS VARCHAR) AS route_id, n_name AS route_long_name, CAST(s_suppkey % 2 AS INT) AS direction_id FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    feed = feed_archive(spark, d)
    assert "direction" not in feed["routes"].columns
    return feed["trips"].join(feed["routes"], "route_id").select("trip_id", "route_id", "route_long_name", "direction_id")


@query("src_12_unwrapped", "SELECT o_orderkey AS key, CAST(o_custkey AS BIGINT) AS k FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    one = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("k")))
    body = F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, F.concat(F.lit('{"rows": ['), one, F.lit("]}")))
    body = body.when(k == 2, F.concat(F.lit('{"data": [{"attributes": '), one, F.lit("}]}"))).otherwise(F.concat(F.lit('{"features": [{"type": "x", "properties": '), one, F.lit("}]}")))
    rows = B.table(spark, d, "orders").select(F.explode(tables.unwrapped(body, "key long, k long")).alias("r"))
    return rows.select("r.*")


@query("src_13_hourly_columns", "SELECT CAST(l_orderkey AS BIGINT) AS key, l_quantity AS temp, l_discount AS rain FROM lineitem")
def _(spark, d):
    wide = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(F.struct("l_quantity", "l_discount")).alias("x")).select(F.transform("x", lambda v: v["l_quantity"]).alias("temp"), F.transform("x", lambda v: v["l_discount"]).alias("rain"), F.expr("transform(x, v -> key)").alias("key"))
    return tables.hourly_columns(wide, ["key", "temp", "rain"])


@query("src_17_first_source", "SELECT n_nationkey AS key FROM nation")
def _(spark, d):
    nation = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"))
    return tables.first_of(lambda: spark.read.parquet(f"{d}/no such table.parquet"), lambda: nation.filter("key < 0"), lambda: nation, lambda: nation.limit(1))


@query("src_18_bound_columns", "SELECT c_custkey AS id, c_name AS title, c_acctbal AS balance FROM customer")
def _(spark, d):
    return tables.bound(B.table(spark, d, "customer"), {"id": r"custkey|^id$", "title": "NAME", "balance": "acct|money"})


@dated_query("snk_1_labels", f"WITH {B.HISTORY} SELECT route, date, hour, round(value, 2) AS value FROM h")
def _(spark, d):
    path = shared_path(spark, "labels")
    sinks.write_labels(B.history(spark, d), path, grid.KEYS)
    return rounded(tables.read_csv(spark, path, ";", schema="route int, date date, hour int, value double"), 2)


@dated_query("snk_2_submission", f"WITH {B.DENSE}, {B.TARGETS}, {HALVES} SELECT route, date, hour, CAST(round_even(p, 0) AS BIGINT) AS prediction FROM b")
def _(spark, d):
    path = shared_path(spark, "submission")
    sinks.write_submission(forecast.submission(B.targets(spark), halves(spark, d)), path, 3 * 61 * 24)
    return tables.read_csv(spark, path, ";", schema="route int, date date, hour int, prediction long")


BOARD = f"WITH {B.BOARD}, r AS (SELECT hour, floor(value + 0.5) AS base, floor(value * 1.1 + 0.5) AS scenario FROM p WHERE route = 1 AND date = DATE '2024-01-29')"
CELLS = "CAST(CAST({c} AS BIGINT) AS VARCHAR)"


@query("snk_4_srv_21_board", f"{BOARD} SELECT printf('%02d:00', hour) AS \"период\", {CELLS.format(c='base')} AS \"базовые_посадки\", {CELLS.format(c='scenario')} AS \"сценарные_посадки\", 'прогноз' AS \"статус\" FROM r UNION ALL SELECT 'итого', {CELLS.format(c='sum(base)')}, {CELLS.format(c='sum(scenario)')}, 'прогноз' FROM r")
def _(spark, d):
    """A day's board with its total, which is the sum of rounded rows, as people download it."""
    rows = cells(spark, d).filter("route = 1 AND date = DATE '2024-01-29'")
    board = serving.present(rows.withColumn("period", F.format_string("%02d:00", "hour")), ["period"], F.lit(1.1)).select("period", "base", "scenario", F.lit("прогноз").alias("status"))
    path = shared_path(spark, "board")
    sinks.board_csv(board, path, {"period": "период", "base": "базовые_посадки", "scenario": "сценарные_посадки", "status": "статус"}, "period", sums=("base", "scenario"), order=("period",))
    return tables.read_csv(spark, path, ";")


@query("snk_3_marked_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS \"ид\", n_name || ' \"' AS \"название\" FROM nation")
def _(spark, d):
    path = shared_path(spark, "marked")
    sinks.board_csv(B.table(spark, d, "nation").withColumn("n_name", F.concat("n_name", F.lit(' "'))), path, {"n_nationkey": "ид", "n_name": "название"})
    return tables.read_csv(spark, path, ";")


@query("snk_7_json_report", "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance FROM supplier")
def _(spark, d):
    path = shared_path(spark, "report")
    sinks.write_json(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("balance")), path)
    return spark.read.schema("key long, balance double").json(path)


@dated_query("snk_8_rounded_csv", f"WITH {B.DAILY} SELECT route, date, round(total / 700, 2) AS total FROM dd")
def _(spark, d):
    path = shared_path(spark, "rounded")
    sinks.write_rounded(history.daily(B.dense(spark, d)).select("route", "date", (F.col("total") / 700).alias("total")), path)
    return rounded(tables.read_csv(spark, path, ";", schema="route int, date date, total double"), 2)


@query("src_15_cached_answers", f"WITH {B.POINTS} SELECT 'node/' || id AS event_id, CASE WHEN kind % 3 = 0 THEN 'primary' ELSE c_name END AS title, round(lat, 6) AS lat, round(lon, 6) AS lon, kind % 3 = 0 AS major FROM ev JOIN customer ON c_custkey = id WHERE id % 40 <> 7")
def _(spark, d):
    """Customers as features in forty cached files, of which one can't be read; taken in twice, the second time without opening a file."""
    k = F.col("c_custkey")
    where = B.places(spark, d).select(F.col("id").alias("c_custkey"), "kind", "lat", "lon")
    rows = B.table(spark, d, "customer").select("c_custkey", "c_name").join(where, "c_custkey")
    place = F.struct("lat", "lon")
    tags = F.when(F.col("kind") % 3 == 0, F.create_map(F.lit("highway"), F.lit("primary"))).otherwise(F.create_map(F.lit("name"), F.col("c_name"), F.lit("highway"), F.lit("construction")))
    element = F.struct(F.lit("node").alias("type"), k.alias("id"), F.when(k % 2 == 0, F.col("lat")).alias("lat"), F.when(k % 2 == 0, F.col("lon")).alias("lon"), F.when(k % 2 == 1, place).alias("center"), tags.alias("tags"))
    answers = rows.groupBy((k % 40).alias("part")).agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("text"))
    cache, store = shared_path(spark, "answers"), shared_path(spark, "store")
    answers.select("part", F.when(F.col("part") == 7, F.substring("text", 1, 200)).otherwise(F.col("text")).alias("text")).write.partitionBy("part").text(cache)
    first, again = (intake.take_in(spark, f"{cache}/part=*", store, intake.ELEMENTS) for _ in range(2))
    if again or not first:
        raise ValueError(f"{again} files were read a second time, {first} the first time")
    return rounded(intake.features(intake.documents(spark, store, intake.ELEMENTS)))
