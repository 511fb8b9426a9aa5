"""Queries over what stands around routes and stations, and over cards and feeds of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.operators import calendars, context, geo, gtfs, records, serving
from headway.plans import bindings as B
from headway.plans.bindings import far_sql, query, rounded

FLAT = "sqrt(pow(({b}.lat - {a}.lat) * 111320.0, 2) + pow(({b}.lon - {a}.lon) * 111320.0 * cos(radians({a}.lat)), 2))"


def spots(spark, d):
    return B.places(spark, d).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.col("id").alias("place"), "lat", "lon")


@query("join_21_places_near_routes", f"WITH {B.POINTS}, x AS (SELECT DISTINCT st.line, ev.id FROM st JOIN ev ON {far_sql('ev', 'st')} <= 300) SELECT l.line AS route, count(x.id) AS n_places, 'p' || min(x.id) AS example FROM (SELECT DISTINCT line FROM st) l LEFT JOIN x ON x.line = l.line GROUP BY l.line")
def _(spark, d):
    return context.places_near(B.stations(spark, d).withColumnRenamed("line", "route"), spots(spark, d))


# Stations by name: stations "Ст-7 ё", stops "ст 7Е", each station on two routes.
NAMED = f"{B.POINTS}, sn AS (SELECT id AS station, id % 97 AS n, line, (line + 1) % 25 AS line2, lat, lon FROM st), sp AS (SELECT id, id % 97 AS n, kind AS route, lat, lon FROM ev)"
MATCHED = f"{NAMED}, mx AS (SELECT sp.id, sp.route, sn.station, sp.route IN (sn.line, sn.line2) AS serves, {FLAT.format(a='sn', b='sp')} AS metres FROM sp JOIN sn USING (n)), mm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY serves DESC, metres, station) AS k FROM mx) WHERE k = 1)"


def named_stations(spark, d):
    s = B.stations(spark, d)
    return s.select(F.col("id").alias("station"), F.concat(F.lit("Ст-"), (F.col("id") % 97).cast("string"), F.lit(" ё")).alias("name"), F.array("line", ((F.col("line") + 1) % 25).cast("int")).alias("routes"), "lat", "lon")


def named_stops(spark, d):
    return B.places(spark, d).select("id", F.concat(F.lit(" ст "), (F.col("id") % 97).cast("string"), F.lit("Е")).alias("name"), F.col("kind").alias("route"), "lat", "lon")


@query("join_22_matched_stations", f"WITH {MATCHED} SELECT id, station, serves, round(metres, 3) AS metres FROM mm")
def _(spark, d):
    return rounded(context.matched(named_stops(spark, d), named_stations(spark, d)).select("id", "station", "serves", "metres"), 3)


WEATHER = "we AS (SELECT CAST(r AS INT) AS route, CASE WHEN r % 7 > 0 THEN CAST(r % 10 AS DOUBLE) END AS temp, CASE r % 4 WHEN 0 THEN 'rain' WHEN 1 THEN 'clear' WHEN 2 THEN 'fog' END AS text FROM range(20) x(r))"


def route_weather(spark):
    r = F.col("id")
    return spark.range(20).select(r.cast("int").alias("route"), F.when(r % 7 > 0, (r % 10).cast("double")).alias("temp"), F.when(r % 4 == 0, "rain").when(r % 4 == 1, "clear").when(r % 4 == 2, "fog").alias("text"))


EACH = f"{NAMED}, {WEATHER}, sr AS (SELECT station, unnest([line, line2]) AS route FROM sn), sw AS (SELECT station, we.* FROM sr JOIN we USING (route))"
STATION_WEATHER = "tx AS (SELECT station, text, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, text) AS k FROM sw WHERE text IS NOT NULL GROUP BY station, text), te AS (SELECT station, avg(temp) AS temp FROM sw GROUP BY station)"


@query("join_23_route_weather", f"WITH {EACH} SELECT station, route, temp, text FROM sw")
def _(spark, d):
    return context.route_weather(named_stations(spark, d).select("station", "routes"), route_weather(spark)).select("station", "route", "temp", "text")


@query("agg_15_station_weather", f"WITH {EACH}, {STATION_WEATHER} SELECT sn.station, round(te.temp, 2) AS temp, tx.text FROM sn LEFT JOIN te USING (station) LEFT JOIN (SELECT * FROM tx WHERE k = 1) tx USING (station)")
def _(spark, d):
    return rounded(context.station_weather(named_stations(spark, d).select("station", "routes"), route_weather(spark)), 2)


@query("join_27_offices", f"WITH {NAMED}, x AS (SELECT station, unnest([line, line2]) AS route FROM sn) SELECT CAST(route AS INT) AS route, count(*) AS n_offices FROM x WHERE route IN (1, 5, 7, 11, 12) GROUP BY route")
def _(spark, d):
    rows = named_stations(spark, d).select("station", F.array_join(F.transform("routes", lambda x: x.cast("string")), ";").alias("routes"))
    return records.by_route(rows, known=[1, 5, 7, 11, 12]).groupBy("route").agg(F.count("*").alias("n_offices"))


STEPS = f"lw AS (SELECT line, id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM st WINDOW w AS (PARTITION BY line ORDER BY id)), ls AS (SELECT lw.*, coalesce({far_sql('lw', 'q')}, 0.0) AS step FROM lw, LATERAL (SELECT lw.plat AS lat, lw.plon AS lon) q)"


@query("agg_32_network", f"WITH {B.POINTS}, {STEPS} SELECT (SELECT count(DISTINCT line) FROM st) AS n_routes, (SELECT count(*) FROM st) AS n_stops, CAST(floor(sum(step) / 1000 + 0.5) AS BIGINT) AS km FROM ls")
def _(spark, d):
    s = B.stations(spark, d)
    return context.network(s.select("line").distinct(), s, "line", ["id"])


@query("geo_3_line_parts", f"WITH {B.POINTS}, x AS (SELECT *, CAST(floor(id / 50) AS BIGINT) AS part FROM st), lw AS (SELECT line, part, id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM x WINDOW w AS (PARTITION BY line, part ORDER BY id)), ls AS (SELECT lw.*, coalesce({far_sql('lw', 'q')}, 0.0) AS step FROM lw, LATERAL (SELECT lw.plat AS lat, lw.plon AS lon) q) SELECT line, round(sum(step) / 1000, 5) AS km, count(DISTINCT part) AS n_parts FROM ls GROUP BY line")
def _(spark, d):
    return rounded(geo.part_lengths(B.stations(spark, d).withColumn("part", F.floor(F.col("id") / 50)), "line", "part", ["id"]), 5)


@query("agg_34_density_bands", "WITH x AS (SELECT l_suppkey, count(*) / 90.0 AS v FROM lineitem GROUP BY l_suppkey) SELECT count(*) FILTER (v < 5) AS low, count(*) FILTER (v >= 5 AND v <= 6) AS middle, count(*) FILTER (v > 6) AS high FROM x")
def _(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count("*") / 90.0).alias("v"))
    return context.density_bands(rows, "v")


@query("agg_35_event_totals", "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events")
def _(spark, d):
    return context.totals(B.table(spark, d, "events"), "event_type", ["click", "error", "view"])


FACTS = """fa AS (SELECT s_suppkey AS route, round(CASE WHEN s_suppkey % 5 = 0 THEN least(10.0, s_suppkey % 31 / 2) ELSE least(6.0, s_suppkey % 23 / 2) + least(4.0, s_suppkey % 31 / 3) END, 1) AS traffic_score, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 23 END AS repairs FROM supplier)"""


def facts(spark, d):
    k = F.col("s_suppkey")
    roads = F.when(k % 5 > 0, k % 23)
    return B.table(spark, d, "supplier").select(k.alias("route"), S.traffic_score(roads, F.lit(2.0), (k % 31).cast("double")).alias("traffic_score"), roads.alias("repairs"))


@query("rank_3_by_traffic", f"WITH {FACTS} SELECT route, CAST(row_number() OVER (ORDER BY traffic_score DESC, route) AS INT) AS traffic_place, CAST(row_number() OVER (ORDER BY coalesce(repairs, -1) DESC, route) AS INT) AS repair_place FROM fa")
def _(spark, d):
    return context.by_traffic(facts(spark, d)).select("route", "traffic_place", "repair_place")


@query("srv_13_route_cards", """WITH x AS (SELECT s_suppkey AS route, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 21 - 10 END AS t, CASE s_suppkey % 3 WHEN 0 THEN 'ясно' WHEN 1 THEN 'дождь' END AS w, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 9 / 2 END AS wind, s_suppkey % 6 = 0 AS today, CASE WHEN s_suppkey % 7 > 0 THEN '2001-05-09T00:00' END AS nx,
    s_suppkey % 40 AS acc, s_suppkey % 40 / 8 AS per, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 3 END AS rep, s_suppkey % 19 / 2 AS score, s_suppkey % 8 AS pois, CASE s_suppkey % 3 WHEN 0 THEN ' ; Музей истории города и области; b' WHEN 1 THEN 'Парк' END AS ex, s_suppkey % 2 AS tram FROM supplier),
  n AS (SELECT *, [t, wind, acc, per, rep, score, pois, tram] AS v FROM x), s AS (SELECT *, [coalesce(CASE WHEN u = floor(u) THEN CAST(CAST(u AS BIGINT) AS VARCHAR) ELSE CAST(u AS VARCHAR) END, '—') for u in v] AS q FROM n),
  c AS (SELECT route, unnest([
    {'place': 1, 'label': 'Погода', 'value': CASE WHEN t IS NULL THEN '—' ELSE (CASE WHEN t > 0 THEN '+' ELSE '' END) || q[1] || '°' END, 'note': coalesce(w, 'нет данных'), 'off': false},
    {'place': 2, 'label': 'Ветер', 'value': q[2], 'note': 'км/ч', 'off': false},
    {'place': 3, 'label': 'Праздник', 'value': CASE WHEN today THEN 'да' ELSE 'нет' END, 'note': CASE WHEN today THEN 'сегодня' ELSE coalesce(nx[1:10], 'нет даты') END, 'off': NOT today},
    {'place': 4, 'label': 'Аварии', 'value': q[3], 'note': q[4] || ' на км', 'off': false},
    {'place': 5, 'label': 'Ремонт', 'value': q[5], 'note': CASE WHEN rep IS NULL THEN 'нет выгрузки' ELSE 'у линии' END, 'off': coalesce(rep, 0) = 0},
    {'place': 6, 'label': 'Пробки', 'value': q[6], 'note': CASE WHEN rep IS NULL THEN 'по ДТП' ELSE 'из 10' END, 'off': false},
    {'place': 7, 'label': 'Места', 'value': q[7], 'note': CASE WHEN ex IS NULL THEN 'в радиусе линии' WHEN ex = 'Парк' THEN ex ELSE 'Музей истории города и области'[1:21] || '…' END, 'off': pois = 0},
    {'place': 8, 'label': 'Трамвай', 'value': q[8], 'note': 'в описании ДТП', 'off': tram = 0}]) AS x FROM s)
  SELECT route, CAST(x.place AS INT) AS place, x.label, x.value, x.note, x.off FROM c""")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = B.table(spark, d, "supplier").select(
        k.alias("route"), F.when(k % 4 > 0, k % 21 - 10).alias("temperature"), F.when(k % 3 == 0, "ясно").when(k % 3 == 1, "дождь").alias("weather"), F.when(k % 5 > 0, (k % 9) / 2).alias("wind"), (k % 6 == 0).alias("holiday_today"), F.when(k % 7 > 0, "2001-05-09T00:00").alias("next_holiday"),
        (k % 40).alias("accidents"), ((k % 40) / 8).alias("accidents_per_km"), F.when(k % 5 > 0, k % 3).alias("repairs"), ((k % 19) / 2).alias("traffic_score"), (k % 8).alias("poi_count"), F.when(k % 3 == 0, " ; Музей истории города и области; b").when(k % 3 == 1, "Парк").alias("poi_examples"), (k % 2).alias("tram_accidents"),
    )
    return context.route_card(rows)


FLEET = '{"source": "x", "routes": {"1": {"vehicles": 12, "name": "one", "vehicle_class": "a"}, "7": {"vehicles": 0, "name": "seven", "vehicle_class": "b"}, "Т2": {"vehicles": 5}}}'


@query("srv_14_fleet", "SELECT CAST(n_nationkey AS VARCHAR) AS route, CASE n_nationkey WHEN 1 THEN 12 WHEN 7 THEN 0 END AS vehicles FROM nation")
def _(spark, d):
    fleet = spark.createDataFrame([(FLEET,)], "registry string").select(F.explode(context.fleets(F.col("registry"))).alias("f")).select("f.*")
    return context.with_fleet(B.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("route")), fleet)


@query("srv_15_station_cards", f"""WITH {MATCHED}, {WEATHER}, sr AS (SELECT station, unnest([line, line2]) AS route FROM sn), te AS (SELECT station, avg(temp) AS temp FROM sr JOIN we USING (route) GROUP BY station),
  ro AS (SELECT id % 40 AS station, count(*) AS n FROM ev WHERE id % 3 = 0 GROUP BY 1), nx AS (SELECT a.id, 'p' || b.id AS place, row_number() OVER (PARTITION BY a.id ORDER BY {far_sql('a', 'b')}, b.id) AS k FROM ev a JOIN ev b ON {far_sql('a', 'b')} <= 500), np AS (SELECT id, string_agg(place, ',' ORDER BY k) AS places FROM nx WHERE k <= 5 GROUP BY id)
  SELECT ev.id, mm.station, round(te.temp, 2) AS temp, CASE WHEN mm.station IS NOT NULL THEN coalesce(ro.n, 0) END AS roads, coalesce(np.places, '') AS places FROM ev LEFT JOIN mm USING (id) LEFT JOIN te ON te.station = mm.station LEFT JOIN ro ON ro.station = mm.station LEFT JOIN np ON np.id = ev.id""")
def _(spark, d):
    roads = B.places(spark, d).filter("id % 3 = 0").select((F.col("id") % 40).alias("station"))
    cards = context.station_cards(named_stops(spark, d), named_stations(spark, d), route_weather(spark), roads, spots(spark, d))
    return cards.select("id", "station", F.round("temp", 2).alias("temp"), "roads", F.array_join("places", ",").alias("places"))


STATUS = "CASE WHEN g = 0 THEN 'fact' WHEN g = 1 THEN 'forecast' WHEN g = 2 THEN 'missing' WHEN g = 3 THEN (CASE i WHEN 0 THEN 'fact' ELSE 'forecast' END) WHEN g = 4 THEN (CASE i WHEN 0 THEN 'fact' ELSE 'missing' END) ELSE (CASE i WHEN 0 THEN 'forecast' WHEN 1 THEN 'missing' ELSE 'fact' END) END"


@query("agg_19_status_codes", f"""WITH x AS (SELECT CAST(o_custkey % 3 AS INT) AS route, CAST(o_custkey % 6 AS INT) AS g, o_orderkey % 3 AS i, CAST(round(o_totalprice * 100) AS DOUBLE) AS v FROM orders), y AS (SELECT *, {STATUS} AS s FROM x)
  SELECT route, g AS period, sum(v) FILTER (s <> 'missing') AS value, count(*) FILTER (s <> 'missing') AS covered, count(*) AS expected, CASE WHEN count(*) FILTER (s = 'fact') = count(*) THEN 'fact' WHEN count(*) FILTER (s = 'missing') = count(*) THEN 'missing' WHEN count(*) FILTER (s = 'forecast') = count(*) THEN 'forecast' WHEN count(*) FILTER (s = 'missing') = 0 THEN 'estimate' WHEN count(*) FILTER (s = 'forecast') = 0 THEN 'partial-fact' ELSE 'partial-forecast' END AS status FROM y GROUP BY ALL""")
def _(spark, d):
    g, i = F.col("o_custkey") % 6, F.col("o_orderkey") % 3
    mixed = F.when(g == 3, F.when(i == 0, "fact").otherwise("forecast")).when(g == 4, F.when(i == 0, "fact").otherwise("missing")).otherwise(F.when(i == 0, "forecast").when(i == 1, "missing").otherwise("fact"))
    status = F.when(g == 0, "fact").when(g == 1, "forecast").when(g == 2, "missing").otherwise(mixed)
    rows = B.table(spark, d, "orders").select((F.col("o_custkey") % 3).cast("int").alias("route"), g.cast("int").alias("g"), status.alias("status"), F.when(status != "missing", F.round(F.col("o_totalprice") * 100)).alias("value"), F.lit(None).cast("double").alias("usual"))
    return serving.roll_up(rows, ["route"], F.col("g")).drop("usual")


# Feeds out of loose points.
POINTS = "r AS (SELECT l_suppkey AS route_id, CAST(l_orderkey % 2 AS INT) AS direction, l_partkey AS stop_id, l_linenumber * 100 + CAST(l_orderkey % 100 AS INT) AS k FROM lineitem), o AS (SELECT route_id, direction, stop_id, min(k) AS k FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY route_id, direction ORDER BY k, stop_id) AS s, count(*) OVER (PARTITION BY route_id, direction) AS c FROM o)"


def feed(spark, d):
    k = F.col("l_partkey")
    rows = B.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("route_id"), (F.col("l_orderkey") % 2).cast("int").alias("direction"), k.alias("stop_id"), F.concat(F.lit("stop "), k.cast("string")).alias("stop_name"),
        (55.5 + (k % 400) / 1000.0).alias("lat"), (37.3 + (k % 600) / 1000.0).alias("lon"), F.col("l_linenumber").alias("stop_sequence"), (F.col("l_orderkey") % 100).cast("int").alias("index"),
    )
    return gtfs.feed(rows)


@query("gtfs_1_trips", f"WITH {POINTS} SELECT route_id, 'trip-' || route_id || '-' || direction AS trip_id, direction AS direction_id, 'shape-' || route_id || '-' || direction AS shape_id FROM n WHERE c >= 2 AND s = 1")
def _(spark, d):
    return feed(spark, d)["trips"]


@query("gtfs_1_shapes", f"WITH {POINTS} SELECT 'shape-' || route_id || '-' || direction AS shape_id, s AS shape_pt_sequence, round(55.5 + (stop_id % 400) / 1000.0, 6) AS shape_pt_lat, round(37.3 + (stop_id % 600) / 1000.0, 6) AS shape_pt_lon FROM n WHERE c >= 2")
def _(spark, d):
    return rounded(feed(spark, d)["shapes"])


@query("gtfs_1_stops", f"WITH {POINTS} SELECT DISTINCT stop_id, 'stop ' || stop_id AS stop_name, round(55.5 + (stop_id % 400) / 1000.0, 6) AS stop_lat, round(37.3 + (stop_id % 600) / 1000.0, 6) AS stop_lon FROM n WHERE c >= 2")
def _(spark, d):
    return rounded(feed(spark, d)["stops"])


@query("join_26_first_seen_routes", "WITH s AS (SELECT l_partkey AS stop_id, s_nationkey AS route, min(l_orderkey * 10 + l_linenumber) AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) SELECT stop_id, string_agg(CAST(route AS VARCHAR), ',' ORDER BY k, route) AS routes FROM s GROUP BY stop_id")
def _(spark, d):
    times = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    trips = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("trip_id"), F.col("s_nationkey").alias("route_id"))
    return gtfs.routes_as_seen(trips, times, "seen")


@query("scl_7_named_calendars", f"WITH {B.HOLIDAYS_SQL}, {B.DATES}, c AS (SELECT 'holidays' AS calendar, date FROM hol UNION ALL SELECT 'short', CAST(date - 1 AS DATE) FROM hol UNION ALL SELECT 'summer', date FROM ds WHERE month(date) = 6) SELECT calendar, count(*) AS n_days, CAST(sum(CAST(isodow(ds.date) >= 6 OR EXISTS (SELECT 1 FROM c c2 WHERE c2.calendar = k.calendar AND c2.date = ds.date) AS INT)) AS BIGINT) AS n_off FROM ds, (SELECT DISTINCT calendar FROM c) k GROUP BY calendar")
def _(spark, d):
    h, days = B.holidays(spark), B.dates(spark, d)
    named = {"holidays": h, "short": h.select(F.date_sub("date", 1).alias("date")), "summer": days.filter("month(date) = 6")}
    calendar = records.stacked(*[v.select(F.lit(k).alias("calendar"), "date") for k, v in named.items()])
    return calendars.off_days(days, calendar).groupBy("calendar").agg(F.count("*").alias("n_days"), F.sum("off_day").alias("n_off"))
