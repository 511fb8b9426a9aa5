"""Queries that answer for boards, and those over text and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.operators import context, grid, serving
from headway.plans import bindings as B
from headway.plans.bindings import dated_query, query, rounded, tone_sql
from headway.sources import tables
from headway.streaming import counts


def cells(spark, d):
    """Every cell of 2024-01-01..30 with value, status and usual."""
    f = B.facts(spark, d)
    all_cells = grid.dense(B.routes(spark), "2024-01-01", "2024-01-30")
    return serving.typical(serving.cells(all_cells, f, B.board_forecast(spark, d)), f)


@dated_query("srv_1_cells", f"WITH {B.BOARD} SELECT route, date, hour, round(value, 6) AS value, 'fact' AS status FROM f UNION ALL SELECT route, date, hour, round(value, 6), 'forecast' FROM p")
def _(spark, d):
    return rounded(serving.cells(grid.dense(B.routes(spark), "2024-01-01", "2024-01-30"), B.facts(spark, d), B.board_forecast(spark, d)))


@dated_query("win_2_typical", f"WITH {B.CELLS} SELECT route, date, hour, round(usual, 6) AS usual FROM u")
def _(spark, d):
    return rounded(cells(spark, d).select(*grid.KEYS, "usual"))


@query("srv_3_tones", f"WITH {B.CELLS} SELECT {tone_sql('value', 'usual')} AS tone, count(*) AS n FROM u GROUP BY 1")
def _(spark, d):
    return cells(spark, d).groupBy(S.tone(F.col("value"), F.col("usual")).alias("tone")).agg(F.count("*").alias("n"))


@query("srv_4_day_rows", f"WITH {B.CELLS} SELECT route, hour, round(value, 6) AS value, status, round(usual, 6) AS usual FROM u WHERE date = DATE '2024-01-29'")
def _(spark, d):
    return rounded(serving.day_rows(cells(spark, d), "2024-01-29"))


def _roll(period: str) -> str:
    return f"""WITH {B.CELLS} SELECT route, {period} AS period, round(sum(value), 4) AS value, round(sum(usual), 4) AS usual, count(*) AS covered, count(*) AS expected,
  CASE WHEN count(*) FILTER (status = 'fact') = count(*) THEN 'fact' WHEN count(*) FILTER (status = 'forecast') = count(*) THEN 'forecast' ELSE 'estimate' END AS status FROM u GROUP BY route, {period}"""


@query("srv_5_month_rows", _roll("CAST(date AS VARCHAR)"))
def _(spark, d):
    return rounded(serving.roll_up(cells(spark, d), ["route"], F.col("date").cast("string")), 4)


@query("srv_6_year_rows", _roll("strftime(date, '%Y-%m')"))
def _(spark, d):
    return rounded(serving.roll_up(cells(spark, d), ["route"], F.date_format("date", "yyyy-MM")), 4)


WEATHER = (("rain", 0, 1.12, True), ("rain", 1, 1.05, False), ("snow", 0, 0.91, True))


@query("srv_7_scenarios", """WITH x AS (SELECT o_orderkey, CAST(o_custkey % 3 AS INT) AS route, CASE o_orderkey % 4 WHEN 0 THEN 'rain' WHEN 1 THEN 'snow' WHEN 2 THEN 'base' END AS weather, o_orderkey % 5 = 0 AS event_on, CASE WHEN o_orderkey % 10 = 0 THEN 1.25 END AS ev, o_orderkey % 7 = 0 AS season_on, CASE WHEN o_orderkey % 14 = 0 THEN 0.8 END AS se FROM orders),
  w AS (SELECT * FROM (VALUES ('rain', 0, 1.12, true), ('rain', 1, 1.05, false), ('snow', 0, 0.91, true)) v(weather, route, c, a)),
  y AS (SELECT x.*, c, CASE WHEN event_on AND ev IS NOT NULL THEN 'event' WHEN season_on AND se IS NOT NULL THEN 'season' WHEN event_on OR season_on THEN 'invalid' WHEN x.weather <> 'base' AND coalesce(a, false) THEN 'weather' WHEN x.weather <> 'base' THEN 'unestimated' ELSE 'base' END AS origin FROM x LEFT JOIN w ON w.weather = x.weather AND w.route = x.route)
  SELECT o_orderkey, origin, CAST(CASE origin WHEN 'event' THEN ev WHEN 'season' THEN se WHEN 'weather' THEN c ELSE 1.0 END AS DOUBLE) AS coefficient FROM y""")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = B.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("route"),
        F.when(k % 4 == 0, "rain").when(k % 4 == 1, "snow").when(k % 4 == 2, "base").alias("weather"),
        (k % 5 == 0).alias("event_on"), F.when(k % 10 == 0, "1,25").otherwise("x").alias("event_text"),
        (k % 7 == 0).alias("season_on"), F.when(k % 14 == 0, "0.8").otherwise("9").alias("season_text"),
    )
    return serving.resolve(rows, spark.createDataFrame(list(WEATHER), "weather string, route int, coefficient double, apply boolean")).select("o_orderkey", "origin", "coefficient")


@dated_query("srv_8_board_totals", f"WITH {B.CELLS} SELECT route, date, CAST(sum(floor(value + 0.5)) AS BIGINT) AS base, CAST(sum(floor(value * 1.1 + 0.5)) AS BIGINT) AS scenario, CAST(sum(floor(usual + 0.5)) AS BIGINT) AS usual FROM u WHERE status = 'fact' GROUP BY ALL")
def _(spark, d):
    return serving.present(cells(spark, d).filter("status = 'fact'"), ["route", "date"], F.lit(1.1))


@query("srv_9_added_trips", "SELECT o_orderkey, CAST(floor(floor(o_totalprice + 0.5) * 10 / 12 + 0.5) AS BIGINT) AS load FROM orders")
def _(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", serving.with_added_trips(S.half_up(F.col("o_totalprice")), F.lit(10), F.lit(2)).alias("load"))


@dated_query("srv_10_peak_hour", f"WITH {B.BOARD} SELECT route, date, arg_max(hour, value * 100 - hour) AS peak_hour, max(value) AS peak_value FROM f GROUP BY ALL")
def _(spark, d):
    return serving.peak(B.facts(spark, d), ["route", "date"])


@query("rank_5_watchlist", f"WITH {B.CELLS}, x AS (SELECT *, CASE WHEN usual > 0 THEN value / usual - 1 END AS deviation FROM u WHERE date = DATE '2024-01-15' AND hour BETWEEN 7 AND 12), y AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY deviation DESC NULLS LAST, hour) AS n FROM x) SELECT route, hour, round(value, 6) AS value, round(usual, 6) AS usual, round(deviation, 6) AS deviation, {tone_sql('value', 'usual')} AS tone FROM y WHERE n = 1")
def _(spark, d):
    return rounded(serving.watchlist(cells(spark, d), "2024-01-15", 7, 6).select("route", "hour", "value", "usual", "deviation", "tone"))


@dated_query("srv_12_risks", f"WITH {B.CELLS}, x AS (SELECT *, {tone_sql('value', 'usual')} AS tone FROM u WHERE value IS NOT NULL AND usual IS NOT NULL) SELECT route, date, hour, tone FROM x WHERE tone IN ('hot', 'warm') AND date <= DATE '2024-01-28'")
def _(spark, d):
    return serving.risks(cells(spark, d).filter("status = 'fact'")).select(*grid.KEYS, "tone")


@query("agg_22_scenario_coefficients", f"WITH {B.BOARD}, x AS (SELECT *, CASE WHEN day(date) % 3 = 0 THEN 'rain' ELSE 'dry' END AS weather FROM f) SELECT route, round(median(value) FILTER (weather = 'rain') / nullif(median(value), 0), 6) AS coefficient, count(*) FILTER (weather = 'rain') AS target_hours, count(DISTINCT date) FILTER (weather = 'rain') AS target_days, count(*) FILTER (weather = 'rain') >= 40 AND count(DISTINCT date) FILTER (weather = 'rain') >= 8 AS apply FROM x GROUP BY route")
def _(spark, d):
    return serving.scenario_coefficients(B.facts(spark, d).withColumn("weather", F.when(F.dayofmonth("date") % 3 == 0, "rain").otherwise("dry")), "rain")


@query("rank_1_route_ranking", "SELECT s_nationkey, n, round(per_acct, 6) AS per_acct, CAST(row_number() OVER (ORDER BY round(per_acct, 6) DESC, n DESC, s_nationkey) AS INT) AS rank FROM (SELECT s_nationkey, count(*) AS n, count(*) / greatest(1.0, sum(abs(s_acctbal)) / 1000) AS per_acct FROM supplier GROUP BY s_nationkey)")
def _(spark, d):
    n = B.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.count("*") / F.greatest(F.lit(1.0), F.sum(F.abs("s_acctbal")) / 1000), 6).alias("per_acct"))
    return context.ranked(n, [F.desc("per_acct"), F.desc("n"), F.col("s_nationkey")])


@query("rank_2_top_stations", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 8")
def _(spark, d):
    return context.most(B.table(spark, d, "lineitem"), "l_suppkey", 8)


@query("agg_17_word_hits", r"SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), 'licen[sc]e|released')) AS n_license FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), 'street|road|lane') GROUP BY source")
def _(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    return B.table(spark, d, "documents").filter(~low.rlike("street|road|lane")).groupBy("source").agg(F.count("*").alias("n"), F.count_if(low.rlike("licen[sc]e|released")).alias("n_license"))


@query("src_7_json_fields", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    k = F.from_json("props", F.lit("k long"))["k"]
    return B.table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@dated_query("src_14_day_string", """WITH s AS (SELECT CAST(o_custkey % 100 AS INT) AS customer, CAST(min(o_orderdate) AS DATE) AS first, string_agg(CAST(o_orderkey % 2 AS VARCHAR), '' ORDER BY o_orderkey) AS marks FROM orders GROUP BY 1)
  SELECT customer, CAST(first + CAST(i AS INT) AS DATE) AS date, CAST(marks[CAST(i AS INT) + 1] AS INT) AS day_off FROM s, LATERAL (SELECT unnest(range(length(marks))) AS i)""")
def _(spark, d):
    """Strings of 0 and 1 that the orders of each of a hundred groups of customers form."""
    from headway.operators.calendars import day_strings

    o = B.table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).cast("int").alias("customer"))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 2).cast("string").alias("m")))), lambda x: x["m"]), "")
    return day_strings(o.agg(F.to_date(F.min("o_orderdate")).alias("first"), marks.alias("marks"))).select("customer", "date", "day_off")


@query("src_16_links", r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS t FROM pages),
  b AS (SELECT page_id, i, h[i] AS href, trim(regexp_replace(regexp_replace(t[i], '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM a)),
  c AS (SELECT page_id, title, min(i) AS i, arg_min(href, i) AS href FROM b WHERE length(title) >= 5 GROUP BY ALL) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS rank, href, title FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 15""")
def _(spark, d):
    return tables.links(B.table(spark, d, "pages"), 5)


@query("stream_1_interval_counts", "SELECT CAST(user_id % 10 AS INT) AS route, time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS boardings FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def _(spark, d):
    """The batch form; tests/test_streaming.py runs the same operator as a stream."""
    return counts.interval_counts(B.validations(spark, d), 15)


@query("stream_1_vehicle_counts", "SELECT CAST(user_id % 10 AS INT) AS route, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) FILTER (event_type = 'purchase') AS boardings, count(DISTINCT user_id) AS active_trams, count(*) AS n_rows FROM events GROUP BY ALL")
def _(spark, d):
    """The batch form; tests/test_streaming.py runs the same operator as a stream."""
    return counts.vehicle_counts(B.validations(spark, d))
