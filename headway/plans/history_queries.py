"""Queries over labels, calendars, history and forecasts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.operators import calendars, folds, forecast, grid, history, labels, metrics
from headway.operators import intervals as I
from headway.plans import bindings as B
from headway.plans.bindings import dated_query, query, rounded


@dated_query("agg_1_hourly_boardings", f"WITH {B.VALID} SELECT route, date, CAST(hour AS INT) AS hour, count(*) AS boardings FROM v WHERE ok GROUP BY ALL")
def _(spark, d):
    return labels.hourly(B.validations(spark, d))


@dated_query("agg_2_interval_boardings", f"WITH {B.VALID}, w AS (SELECT CAST(w AS INT) AS width FROM (VALUES (10), (15), (20), (30)) x(w)) SELECT width, route, date, printf('%02d:%02d', hour, minute // width * width) AS interval, count(*) AS boardings FROM v, w WHERE ok GROUP BY ALL")
def _(spark, d):
    return labels.by_interval(B.validations(spark, d))


@dated_query("agg_3_boardings_and_vehicles", f"WITH {B.VALID} SELECT route, date, CAST(hour AS INT) AS hour, count(*) FILTER (ok) AS boardings, count(DISTINCT vehicle) AS active_trams FROM v GROUP BY ALL HAVING count(*) FILTER (ok) > 0")
def _(spark, d):
    return labels.with_vehicles(B.validations(spark, d))


@dated_query("flt_5_splits", f"WITH {B.VALID}, x AS (SELECT route, date, count(*) AS boardings FROM v WHERE ok GROUP BY ALL) SELECT route, date, boardings, CASE WHEN date <= DATE '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM x WHERE date <= DATE '2024-01-22'")
def _(spark, d):
    day = labels.hourly(B.validations(spark, d)).groupBy("route", "date").agg(F.sum("boardings").alias("boardings"))
    return labels.splits(day, {"train": ("2024-01-01", "2024-01-15"), "test": ("2024-01-10", "2024-01-22")})


@dated_query("agg_5_daily", f"WITH {B.HISTORY} SELECT route, date, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, count(*) AS hours FROM h GROUP BY ALL")
def _(spark, d):
    return rounded(history.daily(B.history(spark, d)), 4)


@query("agg_6_profiles", f"WITH {B.DENSE} SELECT route, hour, CAST(isodow(date) - 1 AS INT) AS dow, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std, count(*) AS n FROM z WHERE date <= DATE '{B.CUTOFF}' GROUP BY ALL")
def _(spark, d):
    rows = B.dense(spark, d).filter(F.col("date") <= F.lit(B.CUTOFF).cast("date")).withColumn("dow", F.weekday("date"))
    return rounded(history.profile(rows, ["route", "hour", "dow"]), 4)


def scored(spark, d):
    """The champion forecast beside the actuals, with calendar flags."""
    known = B.dense(spark, d)
    made = forecast.champion(B.targets(spark), known, B.holidays(spark), B.CUTOFF)
    actual = known.filter(F.col("date") > F.lit(B.CUTOFF).cast("date")).withColumnRenamed("value", "actual")
    rows = made.join(actual, grid.KEYS, "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    rows = calendars.flags(rows, B.holidays(spark))
    return rows.withColumn("school_off", (F.col("date") >= F.lit("2001-05-26").cast("date")).cast("int"))


CHAMPION = (
    B.DENSE + ", " + B.TARGETS + ", " + B.HOLIDAYS_SQL + ", " + B.ewm_sql("t", "z", B.CUTOFF, 4, "p")
    + f""", hr AS (SELECT route, hour, value, row_number() OVER (PARTITION BY route, hour ORDER BY date DESC) - 1 AS k FROM z WHERE date IN (SELECT date FROM hol) AND date <= DATE '{B.CUTOFF}'),
  hp AS (SELECT route, hour, sum(value * power(0.75, k)) / sum(power(0.75, k)) AS pooled, count(*) AS n FROM hr WHERE k < 6 GROUP BY ALL),
  m AS (SELECT p.route, p.date, p.hour, CASE WHEN p.date IN (SELECT date FROM hol) AND n >= 2 THEN pooled ELSE p.value END AS predicted FROM p LEFT JOIN hp USING (route, hour)),
  sc AS (SELECT m.route, m.date, m.hour, predicted, coalesce(h.value, 0.0) AS actual, isodow(m.date) >= 6 OR m.date IN (SELECT date FROM hol) AS off, m.date >= DATE '2001-05-26' AS school FROM m LEFT JOIN h USING (route, date, hour))"""
)
ERROR = "round(sum(actual), 3) AS actual_sum, round(sum(predicted), 3) AS predicted_sum, round(sum(abs(actual - predicted)) / nullif(sum(actual), 0), 6) AS wape, round(greatest(0.0, 1 - sum(abs(actual - predicted)) / nullif(sum(actual), 0)), 6) AS score"


def _error(df):
    return df.select(*[c for c in df.columns if c not in ("actual_sum", "predicted_sum", "wape", "score")], F.round("actual_sum", 3).alias("actual_sum"), F.round("predicted_sum", 3).alias("predicted_sum"), F.round("wape", 6).alias("wape"), F.round("score", 6).alias("score"))


@dated_query("fc_3_champion", f"WITH {CHAMPION} SELECT route, date, hour, round(predicted, 4) AS predicted FROM m")
def _(spark, d):
    return rounded(forecast.champion(B.targets(spark), B.dense(spark, d), B.holidays(spark), B.CUTOFF).select(*grid.KEYS, "predicted"), 4)


@query("agg_7_wape", f"WITH {CHAMPION} SELECT {ERROR} FROM sc")
def _(spark, d):
    return _error(metrics.by(scored(spark, d), []))


@query("agg_9_wape_by_route", f"WITH {CHAMPION} SELECT route, {ERROR} FROM sc GROUP BY route")
def _(spark, d):
    return _error(metrics.by(scored(spark, d), ["route"]))


@query("agg_39_wape_by_week", f"WITH {CHAMPION} SELECT CAST(datediff('day', DATE '{B.FIRST}', date) // 7 AS BIGINT) AS week, {ERROR} FROM sc GROUP BY 1")
def _(spark, d):
    return _error(metrics.weekly(scored(spark, d), B.FIRST))


@query(
    "agg_8_wape_by_slice",
    f"""WITH {CHAMPION}, s AS (SELECT *, datediff('day', DATE '{B.CUTOFF}', date) AS ahead FROM sc),
    l AS (SELECT *, unnest(list_filter(['all', CASE WHEN NOT off THEN 'workday' END, CASE WHEN off THEN 'holiday' END, CASE WHEN school THEN 'school_off' END, CASE WHEN NOT off AND hour BETWEEN 7 AND 9 THEN 'morning_peak' END,
      CASE WHEN NOT off AND hour BETWEEN 16 AND 19 THEN 'evening_peak' END, 'route_' || route, 'days_' || CASE WHEN ahead <= 7 THEN '1-7' WHEN ahead <= 14 THEN '8-14' WHEN ahead <= 28 THEN '15-28' WHEN ahead <= 42 THEN '29-42' ELSE '43-61' END], lambda x: x IS NOT NULL)) AS slice FROM s)
    SELECT slice, {ERROR} FROM l GROUP BY slice""",
)
def _(spark, d):
    return _error(metrics.by_slices(scored(spark, d), B.CUTOFF))


@query("agg_12_weekday_by_hour", f"WITH {B.DENSE} SELECT CAST(isodow(date) - 1 AS INT) AS weekday, " + ", ".join(f"round(avg(value) FILTER (hour = {i}), 4) AS h{i}" for i in range(24)) + " FROM z GROUP BY 1")
def _(spark, d):
    return rounded(metrics.weekday_hours(B.dense(spark, d)), 4)


@query("agg_13_error_histogram", "WITH x AS (SELECT l_extendedprice AS v FROM lineitem), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x) SELECT CAST(least(59, floor((v - lo) / ((hi - lo) / 60))) AS INT) AS bin, count(*) AS n FROM x, b GROUP BY 1")
def _(spark, d):
    return metrics.histogram(B.table(spark, d, "lineitem"), "l_extendedprice")


@query("agg_14_month_level", f"WITH {B.DENSE}, {B.HOLIDAYS_SQL} SELECT route, CAST(month(date) AS INT) AS month, round(sum(value) / count(DISTINCT date), 4) AS level FROM z WHERE date NOT IN (SELECT date FROM hol) GROUP BY ALL")
def _(spark, d):
    rows = B.dense(spark, d).join(B.holidays(spark), "date", "left_anti")
    return rounded(history.month_levels(rows), 4)


@query("agg_23_climatology", f"""WITH {B.HISTORY}, a AS (SELECT route, CAST(month(date) AS INT) AS month, hour, avg(value) AS v FROM h GROUP BY ALL), b AS (SELECT route, hour, avg(value) AS w FROM h GROUP BY ALL)
  SELECT CAST(r AS INT) AS route, CAST(m AS INT) AS month, CAST(x AS INT) AS hour, round(coalesce(v, w), 4) AS value FROM range(3) q(r), range(1, 13) s(m), range(24) t(x) LEFT JOIN a ON a.route = r AND a.month = m AND a.hour = x LEFT JOIN b ON b.route = r AND b.hour = x""")
def _(spark, d):
    cells = B.routes(spark).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    known = B.history(spark, d).withColumn("month", F.month("date"))
    return rounded(history.climatology(cells, known, [["route", "month", "hour"], ["route", "hour"]]), 4)


@query("agg_25_peak_windows", f"""WITH {B.DENSE}, x AS (SELECT hour, sum(value) AS v FROM z WHERE isodow(date) <= 5 GROUP BY hour), y AS (SELECT hour, sum(v) OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS three FROM x)
  SELECT (SELECT hour FROM y WHERE hour BETWEEN 0 AND 9 ORDER BY three DESC, hour LIMIT 1) AS morning, (SELECT hour FROM y WHERE hour BETWEEN 12 AND 21 ORDER BY three DESC, hour LIMIT 1) AS evening""")
def _(spark, d):
    return history.peak_windows(B.dense(spark, d))


WIDTHS = (7, 14, 28, 56)
LASTS = "OVER (PARTITION BY route ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@dated_query("agg_26_trailing", f"WITH {B.DAILY} SELECT route, date, total, " + ", ".join(f"round(avg(total) {LASTS.format(n - 1)}, 2) AS mean{n}, round(stddev_pop(total) {LASTS.format(n - 1)}, 1) AS std{n}, round(median(total) {LASTS.format(n - 1)}, 2) AS median{n}" for n in WIDTHS) + " FROM dd")
def _(spark, d):
    out = history.trailing(history.daily(B.dense(spark, d)).select("route", "date", "total"), WIDTHS, medians=True)
    return out.select("route", "date", "total", *[(F.round(c, 1 if c.startswith("std") else 2) + F.lit(0.0)).alias(c) for c in out.columns[3:]])


@dated_query("agg_26_window_ratios", f"""WITH {B.DAILY}, s AS (SELECT route, date, total, sum(total) OVER (PARTITION BY date) AS network, """ + ", ".join(f"sum(total) {LASTS.format(n - 1)} AS s{n}, sum(total) OVER (PARTITION BY route ORDER BY date ROWS BETWEEN {2 * n - 1} PRECEDING AND {n} PRECEDING) AS b{n}" for n in WIDTHS) + """ FROM dd)
  SELECT route, date, network, round(CASE WHEN network > 0 THEN total / network ELSE 0.0 END, 6) AS route_share, """ + ", ".join(f"round(CASE WHEN b{n} > 1 THEN s{n} / b{n} ELSE 1.0 END, 6) AS ratio{n}" for n in WIDTHS) + " FROM s")
def _(spark, d):
    return rounded(history.window_ratios(history.daily(B.dense(spark, d)).select("route", "date", "total"), WIDTHS).drop("total"))


@query("agg_27_trend", f"""WITH {B.DAILY}, x AS (SELECT route, sum(total) FILTER (date > DATE '{B.CUTOFF}' - 14) AS last, sum(total) FILTER (date <= DATE '{B.CUTOFF}' - 14) AS before FROM dd WHERE date <= DATE '{B.CUTOFF}' AND date > DATE '{B.CUTOFF}' - 28 GROUP BY route)
  SELECT route, round(last, 4) AS last, round(before, 4) AS before, round(CASE WHEN before <= 0 THEN 1.0 ELSE greatest(0.88, least(1.12, last / before)) END, 6) AS trend FROM x""")
def _(spark, d):
    out = history.trend(history.daily(B.dense(spark, d)), B.CUTOFF)
    return out.select("route", F.round("last", 4).alias("last"), F.round("before", 4).alias("before"), F.round("trend", 6).alias("trend"))


@query("agg_29_hour_shapes", f"""WITH {B.DENSE}, x AS (SELECT route, hour, CASE WHEN isodow(date) <= 5 THEN 'weekday' WHEN isodow(date) = 6 THEN 'sat' ELSE 'sun' END AS day_group, value / greatest(sum(value) OVER (PARTITION BY route, date), 1e-6) AS s, power(0.75, datediff('day', date, DATE '{B.CUTOFF}') // 7) AS w FROM z WHERE date <= DATE '{B.CUTOFF}'),
  y AS (SELECT route, day_group, hour, sum(s * w) / sum(w) AS share FROM x GROUP BY ALL) SELECT route, day_group, hour, round(share / sum(share) OVER (PARTITION BY route, day_group), 6) AS share FROM y""")
def _(spark, d):
    return rounded(history.hour_shapes(B.dense(spark, d), B.CUTOFF))


@query("agg_30_dead_routes", f"WITH {B.HISTORY} SELECT CAST(r AS INT) AS route FROM range(6) x(r) LEFT JOIN h ON h.route = r GROUP BY r HAVING coalesce(sum(value), 0) <= 0")
def _(spark, d):
    return history.without_volume(B.routes(spark, 6), B.history(spark, d))


@query("agg_31_scaler", "SELECT round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std FROM lineitem")
def _(spark, d):
    return rounded(forecast.scaler(B.table(spark, d, "lineitem"), ["l_quantity", "l_discount"]))


@query("agg_37_latest_wins", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    from headway.operators.serving import latest

    return latest(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("price"))


# Calendars and scalars.
@dated_query("scl_3_calendar_parts", f"""SELECT CAST(d AS DATE) AS date, CAST(isodow(d) - 1 AS INT) AS dow, CAST(day(d) AS INT) AS day, CAST(month(d) AS INT) AS month, CAST(dayofyear(d) AS INT) AS doy, CAST(weekofyear(d) AS INT) AS week, CAST(quarter(d) AS INT) AS quarter,
  CAST(day(d) = 1 AS INT) AS month_start, CAST(CAST(d AS DATE) = last_day(d) AS INT) AS month_end FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(spark, d):
    return B.dates(spark, d).withColumns(calendars.parts(F.col("date")))


def _cycles_sql() -> str:
    out = []
    for name, x, p in (("hour", "hour", "24"), ("dow", "(isodow(date) - 1)", "7"), ("month", "month(date)", "12"), ("doy", "dayofyear(date)", "365.25")):
        out += [f"round({f}(2 * pi() * {x} / {p}), 6) + 0.0 AS {name}_{f}" for f in ("sin", "cos")]
    for name, x, p, n in (("week", "((isodow(date) - 1) * 24 + hour)", "168", 3), ("year", "((dayofyear(date) - 1) * 24 + hour)", "8766", 2)):
        out += [f"round({f}(2 * pi() * {x} * {k} / {p}), 6) + 0.0 AS {name}{k}_{f}" for k in range(1, n + 1) for f in ("sin", "cos")]
    return ", ".join(out)


@dated_query("scl_5_6_cycles", f"WITH {B.HISTORY} SELECT route, date, hour, {_cycles_sql()} FROM h")
def _(spark, d):
    return rounded(B.history(spark, d).drop("value").withColumns(calendars.cycles(F.col("date"), F.col("hour"))))


@dated_query("scl_7_calendar_flags", f"WITH {B.HOLIDAYS_SQL} SELECT CAST(d AS DATE) AS date, CAST(isodow(d) >= 6 AS INT) AS weekend, CAST(CAST(d AS DATE) IN (SELECT date FROM hol) AS INT) AS holiday, CAST(isodow(d) >= 6 OR CAST(d AS DATE) IN (SELECT date FROM hol) AS INT) AS off_day, CAST(CAST(d AS DATE) + 1 IN (SELECT date FROM hol) AS INT) AS preholiday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(spark, d):
    return calendars.flags(B.dates(spark, d), B.holidays(spark))


@query("scl_11_rounding", "SELECT l_orderkey, CAST(floor(l_quantity / 2 + 0.5) AS BIGINT) AS half_up, round_even(l_quantity / 2, 0) AS half_even, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    x = F.col("l_quantity") / 2
    return B.table(spark, d, "lineitem").groupBy("l_orderkey", S.half_up(x).alias("half_up"), S.half_even(x).alias("half_even")).agg(F.count("*").alias("n"))


@query("scl_17_plurals", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 BETWEEN 11 AND 14 THEN 'рейсов' WHEN o_orderkey % 10 = 1 THEN 'рейс' WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 'рейса' ELSE 'рейсов' END AS word FROM orders")
def _(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", S.plural(F.col("o_orderkey"), "рейс", "рейса", "рейсов").alias("word"))


@query("scl_12_weather_kinds", """WITH x AS (SELECT event_id, CAST(event_id % 100 AS INT) AS code, event_id % 7 / 10.0 AS precip, CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 0.0 END AS snow FROM events)
  SELECT event_id, CASE WHEN snow > 0 OR code IN (71,73,75,77,85,86) THEN 'snow' WHEN precip >= 0.2 OR code IN (51,53,55,56,57,61,63,65,66,67,80,81,82) THEN 'rain' WHEN code IN (45,48) THEN 'fog' ELSE 'clear' END AS kind FROM x""")
def _(spark, d):
    k = F.col("event_id")
    return B.table(spark, d, "events").select("event_id", S.weather_kind((k % 7) / 10.0, F.when(k % 11 == 0, 0.5).otherwise(0.0), (k % 100).cast("int")).alias("kind"))


@query("flt_3_tolerant_timestamps", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE date_trunc('second', ts) END AS ts FROM events")
def _(spark, d):
    k, ts = F.col("event_id") % 5, F.col("ts")
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T"), F.date_format(ts, "HH:mm:ss"))).when(k == 2, F.date_format(ts, "dd.MM.yyyy")).when(k == 3, F.date_format(ts, "dd.MM.yyyy HH:mm:ss")).otherwise("n/a")
    return B.table(spark, d, "events").select("event_id", S.tolerant_timestamp(text).alias("ts"))


@query("flt_17_coefficients", "WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 300 / 100.0 AS DOUBLE) AS v FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN v BETWEEN 0.5 AND 2 THEN round(v, 3) END AS coefficient FROM x")
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 9 == 0, "abc").otherwise(F.replace(((k % 300) / 100.0).cast("string"), F.lit("."), F.lit(",")))
    return B.table(spark, d, "orders").select("o_orderkey", S.coefficient(text).alias("coefficient"))


# Joins with history.
@dated_query("join_1_filled_grid", f"WITH {B.HISTORY}, {B.TARGETS} SELECT t.route, t.date, t.hour, round(coalesce(value, 0.0), 4) AS value FROM t LEFT JOIN h USING (route, date, hour)")
def _(spark, d):
    return rounded(grid.filled(B.targets(spark), B.history(spark, d), "value"), 4)


@query("rsh_3_outside_grid", f"WITH {B.HISTORY}, {B.TARGETS} SELECT count(*) AS n_rows, round(coalesce(sum(value), 0), 2) AS total FROM h ANTI JOIN t USING (route, date, hour)")
def _(spark, d):
    return rounded(grid.outside(B.history(spark, d), B.targets(spark), "value"), 2)


@query("set_5_label_gap", f"WITH {B.VALID}, a AS (SELECT route, date, hour, count(*) AS n FROM v WHERE ok GROUP BY ALL), b AS (SELECT route, date, hour, count(*) AS n FROM v WHERE minute < 30 GROUP BY ALL) SELECT count(*) AS n_keys, CAST(sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS BIGINT) AS gap FROM a FULL JOIN b USING (route, date, hour)")
def _(spark, d):
    v = B.validations(spark, d)
    return grid.gap(labels.hourly(v), labels.hourly(v.filter(F.minute("ts") < 30).withColumn("ok", F.lit(True))))


@dated_query("rsh_2_day_vectors", f"WITH {B.HISTORY}, d AS (SELECT DISTINCT route, date FROM h) SELECT d.route, d.date, CAST(x AS INT) AS hour, round(coalesce(value, 0.0), 4) AS value FROM d CROSS JOIN range(24) r(x) LEFT JOIN h ON h.route = d.route AND h.date = d.date AND h.hour = x")
def _(spark, d):
    return rounded(grid.long_rows(grid.vectors(B.history(spark, d), "value")), 4)


@dated_query("join_9_school_breaks", f"WITH {B.BREAKS_SQL}, {B.DATES}, s AS (SELECT DISTINCT system FROM br) SELECT date, s.system, CAST(EXISTS (SELECT 1 FROM br WHERE br.system = s.system AND date BETWEEN first AND last) AS INT) AS inside FROM ds, s")
def _(spark, d):
    return calendars.in_interval(B.dates(spark, d), B.breaks(spark)).select("date", "system", "inside")


# Orders are open from their date to the last shipping date of their lines.
OPEN = "op AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def open_orders(spark, d):
    last = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("last"))
    return B.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("first")).join(last.hint("merge"), "o_orderkey")


@query("join_9_open_orders", f"WITH {OPEN} SELECT o.o_orderkey, count(op.o_orderkey) AS n_open FROM orders o LEFT JOIN op ON op.o_custkey = o.o_custkey AND CAST(o.o_orderdate AS DATE) BETWEEN op.first AND op.last GROUP BY o.o_orderkey")
def _(spark, d):
    """How many orders of the customer are open on the date of each order."""
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", I.position(F.col("o_orderdate")).alias("_at"))
    held = I.stabbed(orders, open_orders(spark, d).select("o_custkey", I.position(F.col("first")).alias("_start"), I.position(F.col("last")).alias("_end")), ["o_custkey"])
    return orders.join(held, ["o_custkey", "_at"], "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_open"))


@query("join_9_instants", "WITH p AS (SELECT user_id, ts AS first, ts + INTERVAL (1 + event_id % 600) MINUTE AS last FROM events WHERE event_type = 'purchase') SELECT e.event_id, count(p.user_id) AS n FROM events e LEFT JOIN p ON p.user_id = e.user_id AND e.ts BETWEEN p.first AND p.last GROUP BY e.event_id")
def _(spark, d):
    """In how many spans that a purchase of the user opens, minutes to hours long, each event falls."""
    events = B.table(spark, d, "events").select("event_id", "user_id", "event_type", I.position(F.col("ts"), instant=True).alias("_at"))
    spans = events.filter("event_type = 'purchase'").select("user_id", F.col("_at").alias("_start"), (F.col("_at") + (1 + F.col("event_id") % 600) * 60_000_000).alias("_end"))
    held = I.stabbed(events, spans, ["user_id"])
    return events.join(held, ["user_id", "_at"], "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


@dated_query("join_11_nearest_holiday", f"""WITH {B.HOLIDAYS_SQL}, {B.DATES}
  SELECT date, CAST(least(21, coalesce((SELECT min(datediff('day', hol.date, ds.date)) FROM hol WHERE hol.date <= ds.date), 21)) AS INT) AS since, CAST(least(21, coalesce((SELECT min(datediff('day', ds.date, hol.date)) FROM hol WHERE hol.date >= ds.date), 21)) AS INT) AS until FROM ds""")
def _(spark, d):
    return calendars.nearest_marks(B.dates(spark, d), B.holidays(spark), 21)


@query("join_11_nearest_shipment", """WITH s AS (SELECT DISTINCT CAST(l_suppkey % 100 AS INT) AS route, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT o_orderkey, CAST(o_custkey % 100 AS INT) AS route, CAST(o_orderdate AS DATE) AS date FROM orders),
  a AS (SELECT o.*, s.date AS before FROM o ASOF LEFT JOIN s ON s.route = o.route AND o.date >= s.date), b AS (SELECT a.*, s.date AS after FROM a ASOF LEFT JOIN s ON s.route = a.route AND a.date <= s.date)
  SELECT o_orderkey, CAST(least(400, coalesce(datediff('day', before, date), 400)) AS INT) AS since, CAST(least(400, coalesce(datediff('day', date, after), 400)) AS INT) AS until FROM b""")
def _(spark, d):
    """Days from each order back and ahead to the nearest returned shipment of its route."""
    orders = B.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).cast("int").alias("route"), F.to_date("o_orderdate").alias("date"))
    ships_ = B.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select((F.col("l_suppkey") % 100).cast("int").alias("route"), F.to_date("l_shipdate").alias("date"))
    return calendars.nearest_marks(orders, ships_, 400, ["route"]).select("o_orderkey", "since", "until")


@dated_query("scl_19_transferred_holidays", f"""WITH {B.HOLIDAYS_SQL}, {B.DATES}
  SELECT date, (SELECT strftime(hol.date, '%m-%d') FROM hol WHERE abs(datediff('day', hol.date, ds.date)) <= 3 ORDER BY abs(datediff('day', hol.date, ds.date)), hol.date LIMIT 1) AS name FROM ds""")
def _(spark, d):
    named = B.holidays(spark).withColumn("name", F.date_format("date", "MM-dd"))
    return calendars.nearest_name(B.dates(spark, d), named)


SHIP = "sh AS (SELECT CAST(l_suppkey % 10 AS INT) AS route, CAST(l_shipdate AS DATE) AS date, CAST(l_partkey % 50 AS INT) AS station, l_returnflag = 'R' AS flag, l_quantity AS q FROM lineitem), od AS (SELECT DISTINCT CAST(o_custkey % 10 AS INT) AS route, CAST(o_orderdate AS DATE) AS date FROM orders)"


def ships(spark, d):
    return B.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("route"), F.to_date("l_shipdate").alias("date"), (F.col("l_partkey") % 50).cast("int").alias("station"), (F.col("l_returnflag") == "R").alias("flag"), F.col("l_quantity").alias("q"))


def order_days(spark, d):
    return B.table(spark, d, "orders").select((F.col("o_custkey") % 10).cast("int").alias("route"), F.to_date("o_orderdate").alias("date")).distinct()


@dated_query("join_12_as_of", f"WITH {SHIP}, f AS (SELECT route, date, max(q) AS q FROM sh WHERE flag GROUP BY ALL) SELECT od.route, od.date, coalesce(CASE WHEN datediff('day', f.date, od.date) < 45 THEN f.q END, 0.0) AS q FROM od ASOF LEFT JOIN f ON od.route = f.route AND od.date >= f.date")
def _(spark, d):
    f = ships(spark, d).filter("flag").groupBy("route", "date").agg(F.max("q").alias("q"))
    return history.as_of(order_days(spark, d), f, ["route"], ["q"], 45)


@dated_query("join_28_events_before", f"""WITH {SHIP}, p AS (SELECT route, date, count(*) AS n FROM sh WHERE flag GROUP BY ALL), a AS (SELECT route, date, 1 AS r, 0 AS n FROM od UNION ALL SELECT route, date, 0, n FROM p),
  w AS (SELECT route, date, r, CAST(coalesce(sum(n) OVER (PARTITION BY route ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS n7, CAST(coalesce(sum(n) OVER (PARTITION BY route ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS n30 FROM a) SELECT route, date, n7, n30 FROM w WHERE r = 1""")
def _(spark, d):
    return history.counts_before(order_days(spark, d), ships(spark, d).filter("flag"))


@dated_query("win_8_stations_hit", f"""WITH {SHIP}, p AS (SELECT route, first AS date, count(*) AS n FROM (SELECT route, station, min(date) AS first FROM sh WHERE flag GROUP BY ALL) GROUP BY ALL)
  SELECT od.route, od.date, CAST(coalesce((SELECT sum(n) FROM p WHERE p.route = od.route AND p.date < od.date), 0) AS BIGINT) AS n_hit FROM od""")
def _(spark, d):
    return history.stations_hit(order_days(spark, d), ships(spark, d).filter("flag"))


@dated_query("join_14_same_weekday", f"WITH {B.DENSE}, {B.TARGETS}, " + B.ewm_sql("t", "z", B.CUTOFF, 4, "p") + " SELECT route, date, hour, round(sum(value), 3) AS past_sum, count(*) AS n_past FROM p_r WHERE k < 4 GROUP BY ALL")
def _(spark, d):
    rows = history.same_weekday(B.targets(spark), B.dense(spark, d), B.CUTOFF, 4)
    return rows.select(*grid.KEYS, F.round(F.aggregate("past", F.lit(0.0), lambda a, x: a + x), 3).alias("past_sum"), F.size("past").cast("long").alias("n_past"))


@dated_query("join_16_step_back", f"WITH {B.DENSE}, {B.TARGETS}, x AS (SELECT *, date - CAST(7 * greatest(1, ceil(datediff('day', DATE '{B.CUTOFF}', date) / 7.0)) AS INT) AS d FROM t) SELECT x.route, x.date, x.hour, round(coalesce(z.value, 0.0), 4) AS lag FROM x LEFT JOIN z ON z.route = x.route AND z.hour = x.hour AND z.date = x.d")
def _(spark, d):
    return rounded(history.step_back(B.targets(spark), B.dense(spark, d), B.CUTOFF, 7), 4)


# Windows.
@dated_query("win_1_day_share", f"WITH {B.DENSE} SELECT route, date, hour, round(CASE WHEN sum(value) OVER w > 0 THEN value / sum(value) OVER w ELSE 1 / 24.0 END, 6) AS share FROM z WINDOW w AS (PARTITION BY route, date)")
def _(spark, d):
    return rounded(history.day_share(B.dense(spark, d)).select(*grid.KEYS, "share"))


LAGS = "lag(value, {i}) OVER w AS lag{i}"
DEEP = "OVER (PARTITION BY route, hour, isodow(date) ORDER BY date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


@dated_query("win_3_lags", f"""WITH {B.DENSE}, y AS (SELECT route, date, hour, {', '.join(LAGS.format(i=i) for i in range(1, 5))}, count(value) {DEEP.format(4)} AS n_lags,
  round(stddev_pop(value) {DEEP.format(4)}, 1) AS lag_std, avg(value) {DEEP.format(8)} AS deep FROM z WINDOW w AS (PARTITION BY route, hour, isodow(date) ORDER BY date))
  SELECT * EXCLUDE (deep), round(deep, 2) AS deep_mean, lag1 - lag2 AS lag_trend, round(CASE WHEN deep > 0 THEN lag1 / deep END, 6) AS lag_ratio, CASE WHEN deep > 0 THEN abs(lag1 / deep - 1) > 0.5 END AS shock FROM y""")
def _(spark, d):
    out = history.lag_features(B.dense(spark, d))
    places = {"lag_std": 1, "deep_mean": 2, "lag_ratio": 6}
    return out.drop("value").withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in places.items()})


# Forecasts.
@dated_query("fc_1_seasonal_naive", f"""WITH {B.DENSE}, {B.TARGETS}, {B.ewm_sql("t", "z", B.CUTOFF, 4, "p")}, dd AS (SELECT route, date, sum(value) AS total FROM z GROUP BY ALL),
  tr AS (SELECT route, sum(total) FILTER (date > DATE '{B.CUTOFF}' - 14) AS a, sum(total) FILTER (date <= DATE '{B.CUTOFF}' - 14) AS b FROM dd WHERE date <= DATE '{B.CUTOFF}' AND date > DATE '{B.CUTOFF}' - 28 GROUP BY route),
  x AS (SELECT p.*, CASE WHEN b <= 0 THEN 1.0 ELSE greatest(0.88, least(1.12, a / b)) END AS trend, greatest(0.0, least(1.0, (45 - datediff('day', DATE '{B.CUTOFF}', p.date)) / 24.0)) AS keep FROM p LEFT JOIN tr USING (route))
  SELECT route, date, hour, round(value * (1 + (coalesce(trend, 1.0) - 1) * keep), 3) AS predicted FROM x""")
def _(spark, d):
    return rounded(forecast.seasonal_naive(B.targets(spark), B.dense(spark, d), B.CUTOFF, 4, "ewm", "decay").select(*grid.KEYS, "predicted"), 3)


@query("fc_2_rule_grid", f"""WITH {B.DENSE}, {B.TARGETS}, {B.ewm_sql("t", "z", B.CUTOFF, 8, "p")},
  l AS (SELECT route, date, hour, list(value ORDER BY k) AS v FROM p_r WHERE k < 8 GROUP BY ALL),
  tr AS (SELECT route, sum(value) FILTER (date > DATE '{B.CUTOFF}' - 14) AS a, sum(value) FILTER (date <= DATE '{B.CUTOFF}' - 14) AS b FROM z WHERE date <= DATE '{B.CUTOFF}' AND date > DATE '{B.CUTOFF}' - 28 GROUP BY route),
  x AS (SELECT l.*, z.value AS actual, CASE WHEN b <= 0 THEN 1.0 ELSE greatest(0.88, least(1.12, a / b)) END AS trend, greatest(0.0, least(1.0, (45 - datediff('day', DATE '{B.CUTOFF}', l.date)) / 24.0)) AS keep FROM l JOIN z USING (route, date, hour) LEFT JOIN tr USING (route)),
  r AS (SELECT *, row_number() OVER (ORDER BY i, j, m) - 1 AS rule FROM (VALUES (1, 1), (2, 2), (3, 4), (4, 8)) a(i, k), (VALUES (1, 'median'), (2, 'mean'), (3, 'ewm')) b(j, how), (VALUES (1, 'none'), (2, 'flat'), (3, 'decay')) c(m, tr)),
  y AS (SELECT rule, r.k, how, tr, actual, CASE how WHEN 'median' THEN list_median(v[1:r.k]) WHEN 'mean' THEN list_sum(v[1:r.k]) / len(v[1:r.k])
      ELSE list_sum([u * power(0.75, i - 1) for u, i in v[1:r.k]]) / list_sum([power(0.75, i - 1) for u, i in v[1:r.k]]) END * (1 + (coalesce(trend, 1.0) - 1) * CASE tr WHEN 'none' THEN 0.0 WHEN 'flat' THEN 1.0 ELSE keep END) AS predicted FROM x, r)
  SELECT CAST(rule AS INT) AS rule, CAST(k AS INT) AS k, how, tr AS trend, round(greatest(0.0, 1 - sum(abs(actual - predicted)) / sum(actual)), 6) AS score FROM y GROUP BY ALL""")
def _(spark, d):
    known = B.dense(spark, d)
    actual = known.select(*grid.KEYS, F.col("value").alias("actual"))
    return rounded(forecast.rule_grid(B.targets(spark).join(actual, grid.KEYS), known, B.CUTOFF))


@dated_query("fc_7_copy_week", f"WITH {B.DENSE}, {B.TARGETS} SELECT t.route, t.date, t.hour, round(coalesce(z.value, 0.0), 4) AS predicted FROM t LEFT JOIN z ON z.route = t.route AND z.hour = t.hour AND z.date = t.date - 7")
def _(spark, d):
    return rounded(forecast.copy_week(B.targets(spark), B.dense(spark, d)), 4)


MODELS = CHAMPION + ", w AS (SELECT sc.route, sc.date, sc.hour, actual, predicted AS a, coalesce(z.value, 0.0) AS b FROM sc LEFT JOIN z ON z.route = sc.route AND z.hour = sc.hour AND z.date = sc.date - 7)"


def two_models(spark, d):
    a = scored(spark, d).select(*grid.KEYS, "actual", F.col("predicted").alias("a"))
    b = forecast.copy_week(B.targets(spark), B.dense(spark, d)).select(*grid.KEYS, F.col("predicted").alias("b"))
    return a.join(b, grid.KEYS)


@query("fc_10_blend_search", f"""WITH {MODELS}, wg AS (SELECT k AS id, k / 10.0 AS w_a, (10 - k) / 10.0 AS w_b FROM range(11) x(k)), s AS (SELECT route, id, w_a, w_b, sum(abs(actual - a * w_a - b * w_b)) / sum(actual) AS wape FROM w, wg GROUP BY ALL)
  SELECT route, CAST(w_a AS DOUBLE) AS w_a, CAST(w_b AS DOUBLE) AS w_b, round(wape, 6) AS wape FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY round(wape, 12), id) AS n FROM s) WHERE n = 1""")
def _(spark, d):
    return rounded(metrics.blend_search(two_models(spark, d), ["a", "b"], 0.1, ["route"]))


@query("fc_11_leave_one_out", f"""WITH {MODELS}, wg AS (SELECT k AS id, k / 10.0 AS w_a, (10 - k) / 10.0 AS w_b FROM range(11) x(k)),
  e AS (SELECT CAST(isoyear(date) * 100 + weekofyear(date) AS INT) AS origin, id, w_a, w_b, sum(abs(actual - a * w_a - b * w_b)) AS err, sum(actual) AS vol FROM w, wg GROUP BY ALL),
  o AS (SELECT *, sum(err) OVER (PARTITION BY id) - err AS oe, sum(vol) OVER (PARTITION BY id) - vol AS ov FROM e),
  r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY round(greatest(0.0, 1 - oe / greatest(ov, 1)), 12) DESC, id) AS n FROM o)
  SELECT r.origin, CAST(r.w_a AS DOUBLE) AS w_a, CAST(r.w_b AS DOUBLE) AS w_b, round(greatest(0.0, 1 - e.err / e.vol), 6) AS anchor, round(greatest(0.0, 1 - r.err / r.vol), 6) AS blend FROM r JOIN e ON e.origin = r.origin AND e.id = 10 WHERE n = 1""")
def _(spark, d):
    rows = folds.fold_of(two_models(spark, d)).withColumn("origin", F.col("fold").cast("int"))
    return metrics.leave_one_out(rows, ["a", "b"]).withColumns({c: F.round(c, 6) for c in ("anchor", "blend")})


@query("agg_40_forecast_differences", f"WITH {MODELS} SELECT round(avg(abs(a - b)), 4) AS mae, round(max(abs(a - b)), 4) AS max_diff, round(sum(a) / greatest(sum(b), 1), 6) AS total_ratio, count(*) AS n FROM w")
def _(spark, d):
    rows = two_models(spark, d)
    out = metrics.differences(rows.select(*grid.KEYS, F.col("a").alias("value")), rows.select(*grid.KEYS, F.col("b").alias("value")), grid.KEYS)
    return out.select(F.round("mae", 4).alias("mae"), F.round("max_diff", 4).alias("max_diff"), F.round("total_ratio", 6).alias("total_ratio"), "n")


@dated_query("fc_13_selective_ensemble", f"""WITH {MODELS}, dl AS (SELECT route, date, sum(b) AS daily FROM w GROUP BY ALL), s AS (SELECT w.*, daily, CASE WHEN sum(a) OVER (PARTITION BY w.route, w.date) > 0 THEN a / sum(a) OVER (PARTITION BY w.route, w.date) ELSE 1 / 24.0 END AS share FROM w JOIN dl USING (route, date)),
  mx AS (SELECT route, date, hour, b, 0.8 * a + 0.2 * daily * share AS x FROM s) SELECT route, date, hour, round(greatest(0.0, CASE route WHEN 1 THEN 0.65 * x + 0.35 * b WHEN 2 THEN 0.9 * x + 0.1 * b ELSE x END), 2) AS predicted FROM mx""")
def _(spark, d):
    rows = two_models(spark, d)
    base = rows.select(*grid.KEYS, F.col("a").alias("predicted"))
    tree = rows.select(*grid.KEYS, F.col("b").alias("predicted"))
    daily = rows.groupBy("route", "date").agg(F.sum("b").alias("daily"))
    return rounded(forecast.selective(base, daily, tree, {1: 0.35, 2: 0.1}), 2)


@dated_query("fc_9_spread_daily", f"""WITH {MODELS}, dl AS (SELECT route, date, sum(b) AS total FROM w GROUP BY ALL), s AS (SELECT route, date, hour, total, greatest(a - 1000, 0) AS share FROM w JOIN dl USING (route, date))
  SELECT route, date, hour, round(total * CASE WHEN sum(share) OVER q > 0 THEN share / sum(share) OVER q ELSE 1 / 24.0 END, 3) AS predicted FROM s WINDOW q AS (PARTITION BY route, date)""")
def _(spark, d):
    rows = two_models(spark, d)
    totals = rows.groupBy("route", "date").agg(F.sum("b").alias("total"))
    return rounded(forecast.spread_daily(totals, rows.select(*grid.KEYS, (F.col("a") - 1000).alias("share"))).select(*grid.KEYS, "predicted"), 3)


@query("fc_15_week_folds", "SELECT CAST(o_custkey % 3 AS INT) AS route, CAST(isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS INT) AS fold, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    rows = B.table(spark, d, "orders").select((F.col("o_custkey") % 3).cast("int").alias("route"), F.to_date("o_orderdate").alias("date"))
    return folds.fold_of(rows).groupBy("route", F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n"))


@query("fc_22_points", f"WITH {CHAMPION}, s AS (SELECT route, greatest(0.0, 1 - sum(abs(actual - predicted)) / sum(actual)) AS score FROM sc GROUP BY route) SELECT route, CAST(CASE WHEN score <= .48 THEN 0 WHEN score <= .60 THEN 1 WHEN score <= .70 THEN 2 WHEN score <= .80 THEN 3 WHEN score <= .88 THEN 4 ELSE 5 END AS INT) AS points FROM s")
def _(spark, d):
    return metrics.by(scored(spark, d), ["route"]).select("route", S.points(F.col("score")).alias("points"))


@dated_query("fc_23_daily_trees")
def _(spark, d):
    """Gradient boosted trees on daily totals; a plain loop tests the trees."""
    days = history.trailing(history.daily(B.dense(spark, d)).select("route", "date", "total"), (7, 28)).withColumn("dow", F.weekday("date"))
    from pyspark.sql import Window as W

    w = W.partitionBy("route").orderBy("date")
    rows = days.withColumns({c: F.lag(c).over(w) for c in ("mean7", "mean28", "std7", "std28")}).dropna(subset=["mean28"])
    cut = F.lit(B.CUTOFF).cast("date")
    model = forecast.boosted(rows.filter(F.col("date") <= cut), ["route", "dow", "mean7", "mean28", "std7", "std28"], "total", trees=10, depth=4)
    return forecast.score_with(model, rows.filter(F.col("date") > cut)).select("route", "date", F.round("total", 3).alias("total"), F.round("predicted", 3).alias("predicted"))


def _horizons(spark, d):
    rows = two_models(spark, d).withColumns({"horizon": F.datediff("date", F.lit(B.CUTOFF).cast("date")), "dow": F.weekday("date")})
    half = F.lit("2001-06-01").cast("date")
    return rows.filter(F.col("date") < half), rows.filter(F.col("date") >= half)


def by_origin(spark, d, origin: str, days: int = 61):
    """Each hour of the days after an origin: its actual, the champion's forecast and the copied week as the origin knew them, and the horizon."""
    first, last = str(date.fromisoformat(origin) + timedelta(days=1)), str(date.fromisoformat(origin) + timedelta(days=days))
    targets, known = grid.dense(B.routes(spark), first, last), B.dense(spark, d)
    rows = forecast.seasonal_naive(targets, known, origin).withColumnRenamed("predicted", "a")
    ahead = F.datediff("date", F.lit(origin).cast("date"))
    rows = rows.withColumns({"horizon": ahead, "dow": F.weekday("date"), "_back": F.date_sub("date", (7 * F.ceil(ahead / 7)).cast("int"))})
    back = known.select("route", "hour", F.col("date").alias("_back"), F.col("value").alias("b"))
    rows = rows.join(back, ["route", "hour", "_back"]).drop("_back")
    return rows.join(known.withColumnRenamed("value", "actual"), grid.KEYS)


@dated_query("fc_19_residual_trees")
def _(spark, d):
    """The frozen forecast corrected by trees of the first month's errors; a plain loop tests the trees."""
    train, rows = _horizons(spark, d)
    out = forecast.corrected(train, rows, ["route", "dow", "hour", "b"], "a", "actual", trees=5, depth=4)
    return rounded(out.select(*grid.KEYS, "predicted"), 3)


@dated_query("fc_24_horizon_buckets")
def _(spark, d):
    """Trees by range of the horizon, learned from two earlier origins that show the whole of it; a plain loop tests the trees."""
    train = by_origin(spark, d, "2000-12-31").unionByName(by_origin(spark, d, "2001-02-28"))
    out = forecast.bucketed(train, by_origin(spark, d, B.CUTOFF), ["route", "dow", "hour", "a", "b"], "actual", [(1, 14), (15, 61)], trees=4, depth=3)
    return rounded(out.select(*grid.KEYS, "predicted"), 3)
