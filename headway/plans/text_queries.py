"""Queries over names, titles, records and other scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.functions import text as T
from headway.operators import context, gtfs, records
from headway.plans import bindings as B
from headway.plans.bindings import dated_query, query, rounded

NAME = "p_name || ' №' || p_partkey || '; Ёлка,' || p_brand || ', 7'"


@query("scl_1_names", rf"""WITH x AS (SELECT p_partkey, {NAME} AS t FROM part) SELECT p_partkey, regexp_replace(translate(lower(t), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', '', 'g') AS plain, regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  CASE WHEN length(t) > 22 THEN t[1:21] || '…' ELSE t END AS short, array_to_string([trim(y) for y in string_split_regex(t, '[;,]') if trim(y) <> ''], '|') AS parts, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS padded FROM x""")
def _(spark, d):
    t = F.concat("p_name", F.lit(" №"), F.col("p_partkey").cast("string"), F.lit("; Ёлка,"), "p_brand", F.lit(", 7"))
    rows = B.table(spark, d, "part").select("p_partkey", t.alias("t"))
    return rows.select("p_partkey", T.normalised(F.col("t")).alias("plain"), T.slug(F.col("t")).alias("slug"), T.shortened(F.col("t"), 22).alias("short"), F.array_join(T.listed(F.col("t")), "|").alias("parts"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0").alias("padded"))


@query("scl_2_stop_names", r"""WITH x AS (SELECT p_partkey, 'Depot ' || p_brand || ' - ' || p_name || '  -  ' || p_type || ' - ' || p_type || CASE p_partkey % 6 WHEN 0 THEN ' - Покровское - Стрешнево' WHEN 1 THEN ' - Покровское - Стрешнево-2' WHEN 2 THEN ' - Свято - Данилов монастырь' WHEN 3 THEN ' - loop' WHEN 4 THEN ' - Покровское - Данилов' ELSE ' - End' END AS track FROM part),
  y AS (SELECT p_partkey, unnest(string_split_regex(track, '\s+-\s+')) AS part, generate_subscripts(string_split_regex(track, '\s+-\s+'), 1) AS i FROM x),
  g AS (SELECT *, sum(CASE WHEN regexp_matches(part, '^\p{Ll}') OR part = prev OR (prev = 'Покровское' AND part IN ('Глебово', 'Стрешнево')) OR (prev = 'Свято' AND starts_with(part, 'Данилов')) THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY i) AS g FROM (SELECT *, lag(part) OVER (PARTITION BY p_partkey ORDER BY i) AS prev FROM y)),
  n AS (SELECT p_partkey, g, string_agg(part, ' - ' ORDER BY i) AS name FROM g WHERE part IS DISTINCT FROM prev GROUP BY ALL)
  SELECT p_partkey, string_agg(name, '|' ORDER BY g) AS stops, count(*) AS n FROM n GROUP BY p_partkey""")
def _(spark, d):
    k = F.col("p_partkey") % 6
    end = F.when(k == 0, " - Покровское - Стрешнево").when(k == 1, " - Покровское - Стрешнево-2").when(k == 2, " - Свято - Данилов монастырь").when(k == 3, " - loop").when(k == 4, " - Покровское - Данилов").otherwise(" - End")
    track = F.concat(F.lit("Depot "), "p_brand", F.lit(" - "), "p_name", F.lit("  -  "), "p_type", F.lit(" - "), "p_type", end)
    stops = B.table(spark, d, "part").select("p_partkey", T.stop_names(track).alias("stops"))
    return stops.select("p_partkey", F.array_join("stops", "|").alias("stops"), F.size("stops").cast("long").alias("n"))


@dated_query("scl_4_sunday_first", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(dayofweek(o_orderdate) AS INT) AS weekday FROM orders")
def _(spark, d):
    return B.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().withColumn("weekday", S.sunday_first(F.col("date")))


@query("scl_8_log_levels", "SELECT c_custkey, round(ln(1 + greatest(0.0, c_acctbal)), 6) AS level, round(exp(least(12.0, greatest(0.0, c_acctbal / 500 - 1))) - 1, 4) AS back FROM customer")
def _(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", F.round(S.log_level(F.col("c_acctbal")), 6).alias("level"), F.round(S.from_log_level(F.col("c_acctbal") / 500 - 1), 4).alias("back"))


@query("scl_10_hour_bounds", "WITH x AS (SELECT event_id, CAST(event_id % 41 - 8 AS INT) AS a, CAST(event_id % 37 - 5 AS INT) AS b FROM events), y AS (SELECT event_id, least(23, greatest(0, a)) AS a, least(23, greatest(0, b)) AS b FROM x) SELECT event_id, least(a, b) AS first, greatest(a, b) AS last FROM y")
def _(spark, d):
    k = F.col("event_id")
    first, last = S.hour_bounds((k % 41 - 8).cast("int"), (k % 37 - 5).cast("int"))
    return B.table(spark, d, "events").select("event_id", first.alias("first"), last.alias("last"))


TEXTS = ", ".join(f"({k}, '{v}')" for k, v in S.WEATHER_TEXT.items())


@query("scl_13_weather_text", f"WITH t(code, name) AS (VALUES {TEXTS}), x AS (SELECT CAST(event_id % 100 AS INT) AS code, count(*) AS n FROM events GROUP BY 1) SELECT x.code, coalesce(name, 'код ' || x.code) AS weather, x.code IN {S.ALERTS} AS alert, n FROM x LEFT JOIN t USING (code)")
def _(spark, d):
    code = (F.col("event_id") % 100).cast("int")
    rows = B.table(spark, d, "events").groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    return rows.select("code", S.weather_text(F.col("code")).alias("weather"), S.weather_alert(F.col("code")).alias("alert"), "n")


@query("scl_18_hash_noise", "WITH x AS (SELECT c_custkey, list_reduce([CAST(2166136261 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) for c in string_split(c_name, '')], lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM customer) SELECT c_custkey, h AS hash, round(sin(CAST(h % 1000 AS DOUBLE)) * 10000 - floor(sin(CAST(h % 1000 AS DOUBLE)) * 10000), 6) AS noise FROM x")
def _(spark, d):
    rows = B.table(spark, d, "customer").select("c_custkey", S.fnv1a(F.col("c_name")).alias("hash"))
    return rows.withColumn("noise", F.round(S.sine_noise((F.col("hash") % 1000).cast("double")), 6))


@query("scl_20_traffic_scores", "WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 23 END AS roads, s_suppkey % 8 / 4.0 AS km, (s_suppkey % 31) / 8.0 AS dense FROM supplier) SELECT s_suppkey, round(CASE WHEN roads IS NULL THEN least(10.0, dense / 2) ELSE least(6.0, roads / greatest(km, 0.5)) + least(4.0, dense / 3) END, 1) AS score FROM x")
def _(spark, d):
    k = F.col("s_suppkey")
    return B.table(spark, d, "supplier").select("s_suppkey", S.traffic_score(F.when(k % 5 > 0, k % 23), (k % 8) / 4.0, (k % 31) / 8.0).alias("score"))


@query("flt_7_two_boxes", f"""WITH {B.POINTS}, x AS (SELECT id, lat + (id % 21 - 10) / 10.0 AS lat, lon + (id % 31 - 15) / 5.0 AS lon FROM ev)
  SELECT count(*) FILTER (lat BETWEEN 55.4 AND 56.1 AND lon BETWEEN 37.1 AND 38.0) AS in_city, count(*) FILTER (lat > 54.2 AND lat < 56.6 AND lon > 35.2 AND lon < 40.5) AS in_region FROM x""")
def _(spark, d):
    k = F.col("id")
    rows = B.places(spark, d).select((F.col("lat") + (k % 21 - 10) / 10.0).alias("lat"), (F.col("lon") + (k % 31 - 15) / 5.0).alias("lon"))
    return rows.agg(F.count_if(S.in_box(F.col("lat"), F.col("lon"), S.CITY)).alias("in_city"), F.count_if(S.in_box(F.col("lat"), F.col("lon"), S.REGION, strict=True)).alias("in_region"))


@query("flt_9_without_words", "SELECT p_name, count(*) AS n FROM part WHERE NOT regexp_matches(lower(p_name), 'ring|bolt') GROUP BY p_name")
def _(spark, d):
    return B.table(spark, d, "part").filter(T.without_words(F.col("p_name"), ("ring", "bolt"))).groupBy("p_name").agg(F.count("*").alias("n"))


@query("flt_10_mentions", "SELECT p_brand, count(*) FILTER (contains(lower(concat_ws(' ', p_name, p_type, p_brand, array_to_string(string_split(p_name, ' '), ' '))), 'widget')) AS n, count(*) AS n_all FROM part GROUP BY p_brand")
def _(spark, d):
    hit = T.mentions("widget", F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.split("p_name", " "))
    return B.table(spark, d, "part").groupBy("p_brand").agg(F.count_if(hit).alias("n"), F.count("*").alias("n_all"))


@query("flt_11_records_of_kind", "WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN o_orderpriority WHEN 2 THEN ' ' END AS kind, o_orderpriority AS t FROM orders) SELECT o_orderkey FROM x WHERE CASE WHEN trim(coalesce(kind, '')) <> '' THEN regexp_matches(lower(kind), 'high|urgent') OR trim(kind) = '0' ELSE regexp_matches(lower(t), 'high|urgent') END")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    rows = B.table(spark, d, "orders").withColumn("kind", F.when(k == 0, "0").when(k == 1, F.col("o_orderpriority")).when(k == 2, " "))
    return records.of_kind(rows, ["kind"], ["o_orderpriority"], "high|urgent").select("o_orderkey")


SEGMENTS = {"BUILDING": "house", "MACHINERY": "works"}


@query("flt_12_places", f"""WITH {B.POINTS}, x AS (SELECT ev.id, CASE WHEN id % 7 = 0 THEN ' ' WHEN id % 11 = 0 THEN 'Без названия' ELSE c_name END AS name, c_mktsegment AS kind, CASE WHEN id % 13 <> 0 THEN lat END AS lat, lon FROM ev JOIN customer ON c_custkey = id)
  SELECT id, name, CASE kind WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'works' ELSE kind END AS label FROM x WHERE trim(name) <> '' AND name <> 'Без названия' AND lat IS NOT NULL""")
def _(spark, d):
    names = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    k = F.col("id")
    rows = B.places(spark, d).join(names, "id").withColumns({"name": F.when(k % 7 == 0, " ").when(k % 11 == 0, T.NAMELESS).otherwise(F.col("c_name")), "lat": F.when(k % 13 != 0, F.col("lat"))})
    return rows.filter(T.is_place(F.col("name"), F.col("lat"), F.col("lon"))).select("id", "name", T.label(F.col("c_mktsegment"), SEGMENTS).alias("label"))


@query("flt_13_route_search", "SELECT n_nationkey AS route_id FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING contains(lower(n_nationkey || ' ' || n_name || ' ' || coalesce(string_agg(s_name, ' ' ORDER BY s_name), '')), '#00000001')")
def _(spark, d):
    routes = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("route_id"), F.col("n_nationkey").cast("string").alias("number"), F.col("n_name").alias("long_name"))
    stops = B.table(spark, d, "supplier").select(F.col("s_nationkey").alias("route_id"), F.col("s_name").alias("stop_name"))
    return gtfs.search(routes, stops, " #00000001 ").select("route_id")


HIGHWAY = "CASE o_orderkey % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'construction' WHEN 3 THEN '' END"


@query("flt_14_road_kinds", f"WITH x AS (SELECT {HIGHWAY} AS h FROM orders) SELECT CASE WHEN h IN ('motorway', 'trunk', 'primary') THEN 'major' ELSE 'repair' END AS kind, count(*) AS n FROM x GROUP BY 1")
def _(spark, d):
    k = F.col("o_orderkey") % 5
    highway = F.when(k == 0, "motorway").when(k == 1, "primary").when(k == 2, "construction").when(k == 3, "")
    return B.table(spark, d, "orders").groupBy(T.road_kind(highway).alias("kind")).agg(F.count("*").alias("n"))


@query("flt_15_years", "SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1999, 2001) GROUP BY 1")
def _(spark, d):
    when = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return B.table(spark, d, "orders").filter(T.in_years(when, ("1996", "1999", "2001"))).groupBy(F.substring(when, 1, 4).alias("year")).agg(F.count("*").alias("n"))


@query("flt_16_event_keys", f"""WITH {B.POINTS} SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) WHEN id % 3 = 1 THEN 'k' || kind ELSE printf('2024-01-%02d|%.5f|%.5f', id % 28 + 1, lat, lon) END AS event_id FROM ev""")
def _(spark, d):
    k = F.col("id")
    ids = [F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, ""), F.when(k % 3 == 1, F.concat(F.lit("k"), F.col("kind").cast("string")))]
    when = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    return B.places(spark, d).select("id", T.event_key(ids, when, F.col("lat"), F.col("lon")).alias("event_id"))


@query("flt_18_open_dates", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01'")
def _(spark, d):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(date)
    return B.table(spark, d, "orders").filter(T.is_open_date(text, "1998-01-01")).agg(F.count("*").alias("n"))


@query("agg_17_top_titles", "WITH x AS (SELECT CAST(l_suppkey % 10 AS INT) AS route, 'p' || l_partkey % 50 AS title, count(*) AS n FROM lineitem GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY n DESC, title) AS k FROM x) SELECT route, count(*) AS n_titles, string_agg(title, ',' ORDER BY k) FILTER (k <= 8) AS titles FROM y GROUP BY route")
def _(spark, d):
    rows = B.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("route"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("title"))
    return records.top_titles(rows, ["route"], "title").withColumn("titles", F.array_join("titles", ","))


@query("srv_16_17_19_tones", """WITH x AS (SELECT s_suppkey AS k, s_suppkey % 9 AS v FROM supplier) SELECT k, CASE WHEN v > 6 THEN 'hot' WHEN v >= 5 THEN 'warm' ELSE 'ok' END AS density, CASE WHEN v >= 6 THEN 'hot' WHEN v >= 4 THEN 'warm' ELSE 'ok' END AS traffic,
  CASE WHEN k % 4 = 0 THEN 'ok' WHEN v * 4 >= 20 THEN 'hot' WHEN v > 0 THEN 'warm' ELSE 'ok' END AS repair, CASE WHEN k % 2 > 0 THEN 'hot' WHEN v > 0 THEN 'warm' ELSE 'ok' END AS station, CASE WHEN v / 5 > 1 THEN 'hot' WHEN v / 5 >= 0.8 THEN 'warm' ELSE 'ok' END AS load,
  round(v / 5 * (0.62 + 0.72 * sin(v / 8 * pi())), 6) AS station_load FROM x""")
def _(spark, d):
    k = F.col("s_suppkey")
    v = k % 9
    return B.table(spark, d, "supplier").select(
        k.alias("k"), S.density_tone(v).alias("density"), S.traffic_tone(v).alias("traffic"), S.repair_tone(F.when(k % 4 != 0, v * 4)).alias("repair"), S.station_tone(v, k % 2).alias("station"), S.load_tone(v / 5).alias("load"),
        F.round(S.station_load(v / 5, v, F.lit(9)), 6).alias("station_load"),
    )


# Shapes and sets.
@dated_query("rsh_6_date_hours", f"WITH {B.HISTORY} SELECT date, hour, printf('%s %02d:00:00', CAST(date AS VARCHAR), hour) AS at, count(*) AS n FROM h GROUP BY ALL")
def _(spark, d):
    return B.history(spark, d).groupBy("date", "hour", T.date_hour(F.col("date"), F.col("hour")).alias("at")).agg(F.count("*").alias("n"))


@dated_query("win_10_offsets", f"WITH {B.HISTORY}, x AS (SELECT DISTINCT date, hour, datediff('day', (SELECT min(date) FROM h) - 1, date) AS ahead FROM h) SELECT date, hour, CAST((isodow(date) - 1) * 24 + hour AS INT) AS of_week, CAST((dayofyear(date) - 1) * 24 + hour AS INT) AS of_year, CAST(ahead AS INT) AS horizon, CASE WHEN ahead <= 7 THEN '1-7' WHEN ahead <= 14 THEN '8-14' WHEN ahead <= 28 THEN '15-28' WHEN ahead <= 42 THEN '29-42' ELSE '43-61' END AS bucket FROM x")
def _(spark, d):
    """Horizons from the day before the first order."""
    week, year = S.week_offsets(F.col("date"), F.col("hour"))
    rows = B.history(spark, d).select("date", "hour").distinct()
    first = rows.agg(F.date_sub(F.min("date"), 1).alias("_o"))  # one row
    ahead = F.datediff("date", F.col("_o"))
    return rows.join(F.broadcast(first)).select("date", "hour", week.alias("of_week"), year.alias("of_year"), ahead.alias("horizon"), S.horizon_bucket(ahead).alias("bucket"))


@query("rsh_4_overwritten", "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN -1.0 ELSE o_totalprice END AS price FROM orders")
def _(spark, d):
    rows = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    other = rows.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit(-1.0).alias("price"))
    return records.overwritten(rows, other, ["o_orderkey"], "price", F.col("o_custkey") % 5 != 0).select("o_orderkey", "price")


@query("rsh_7_masked", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 IN (1, 2)")
def _(spark, d):
    mask = F.when(F.col("o_orderkey") % 7 < 3, F.col("o_orderkey") % 7 > 0)
    return records.masked(B.table(spark, d, "orders").withColumn("mask", mask), "mask", ["o_orderkey", "o_orderstatus"])


@query("rsh_8_route_lists", "WITH x AS (SELECT o_orderkey, unnest([o_orderkey % 3, o_orderkey % 5, 7]) AS route FROM orders) SELECT CAST(route AS INT) AS route, count(*) AS n FROM x WHERE route IN (0, 2, 4, 7) GROUP BY route")
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.concat((k % 3).cast("string"), F.lit(", "), (k % 5).cast("string"), F.lit(";T1; 7,,"))
    rows = records.by_route(B.table(spark, d, "orders").select("o_orderkey", text.alias("routes")), known=[0, 2, 4, 7])
    return rows.groupBy("route").agg(F.count("*").alias("n"))


@query("rsh_9_mean_of_runs", "SELECT l_orderkey, l_linenumber, round(avg(l_quantity), 6) AS predicted, count(*) AS runs FROM lineitem GROUP BY ALL")
def _(spark, d):
    return rounded(records.mean_of_runs(B.table(spark, d, "lineitem").withColumnRenamed("l_quantity", "predicted"), ["l_orderkey", "l_linenumber"]))


@dated_query("set_1_stacked", f"WITH {B.HISTORY} SELECT route, date, hour, round(value, 2) AS value FROM h")
def _(spark, d):
    h = B.history(spark, d)
    day = F.lit(B.CUTOFF).cast("date")
    return rounded(records.stacked(h.filter(F.col("date") <= day), h.filter(F.col("date") > day).select("value", "hour", "date", "route")), 2)


@query("set_2_by_route", "WITH x AS (SELECT CAST(o_custkey % 3 AS INT) AS route, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders) SELECT route, max(v) AS top FROM x GROUP BY route")
def _(spark, d):
    rows = B.table(spark, d, "orders").select((F.col("o_custkey") % 3).cast("int").alias("route"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return records.by_part(rows, "route", [F.max("v").alias("top")])


@dated_query("set_4_calendar_days", f"WITH {B.HOLIDAYS_SQL}, {B.DATES} SELECT date FROM (SELECT date FROM ds WHERE isodow(date) >= 6 UNION SELECT date FROM hol) WHERE date NOT IN (SELECT date FROM ds WHERE day(date) = 10)")
def _(spark, d):
    days = B.dates(spark, d)
    return records.calendar_days(days.filter("weekday(date) >= 5"), B.holidays(spark), days.filter("day(date) = 10"))


@query("set_6_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    from headway.operators.grid import repeated

    return repeated(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("rank_4_listed_routes", "SELECT s_nationkey, CAST(row_number() OVER (ORDER BY length(CAST(s_nationkey AS VARCHAR)), CAST(s_nationkey AS VARCHAR)) AS INT) AS place FROM (SELECT DISTINCT s_nationkey FROM supplier)")
def _(spark, d):
    rows = B.table(spark, d, "supplier").select("s_nationkey", F.col("s_nationkey").cast("string").alias("route")).distinct()
    return context.ranked(rows, [F.length("route"), F.col("route")], "place").select("s_nationkey", "place")
