"""Queries over features joined to grids, searches of forecasts, and fitted models."""

from __future__ import annotations

from datetime import date
from math import comb

from pyspark.sql import functions as F

from headway.functions.sessions import cut
from headway.operators import boosting, calendars, folds, forecast, grid, history, metrics, sampling, selection
from headway.plans import bindings as B
from headway.plans.bindings import dated_query, query, rounded
from headway.plans.history_queries import CHAMPION, ERROR, MODELS, _error, scored, two_models

PAST = f"date <= DATE '{B.CUTOFF}'"
OFF = "CAST(isodow({d}) >= 6 OR {d} IN (SELECT date FROM hol) AS INT)"


def past(spark, d):
    rows = calendars.flags(B.dense(spark, d).filter(PAST), B.holidays(spark))
    return rows.withColumn("dow", F.weekday("date"))


KEYSETS = {"cell": ["route", "hour", "dow"], "off": ["route", "hour", "off_day"], "hour": ["route", "hour"], "day": ["route", "dow"]}


def _keyset_sql() -> str:
    parts = ", ".join(f"q_{n} AS (SELECT {', '.join(k)}, avg(value) AS mean, median(value) AS median FROM k GROUP BY ALL)" for n, k in KEYSETS.items())
    columns = ", ".join(f"round(coalesce(q_{n}.mean, 0.0), 2) AS {n}_mean, round(coalesce(q_{n}.median, 0.0), 2) AS {n}_median" for n in KEYSETS)
    joins = " ".join(f"LEFT JOIN q_{n} ON " + " AND ".join(f"q_{n}.{c} = a.{c}" for c in k) for n, k in KEYSETS.items())
    return f"""WITH {B.DENSE}, {B.TARGETS}, {B.HOLIDAYS_SQL}, k AS (SELECT *, CAST(isodow(date) - 1 AS INT) AS dow, {OFF.format(d='date')} AS off_day FROM z WHERE {PAST}), {parts},
  a AS (SELECT *, CAST(isodow(date) - 1 AS INT) AS dow, {OFF.format(d='date')} AS off_day FROM t) SELECT a.route, a.date, a.hour, {columns} FROM a {joins}"""


@dated_query("join_2_profiles", _keyset_sql())
def _(spark, d):
    rows = calendars.flags(B.targets(spark), B.holidays(spark)).withColumn("dow", F.weekday("date")).select(*grid.KEYS, "dow", "off_day")
    return rounded(history.with_profiles(rows, past(spark, d), KEYSETS).drop("dow", "off_day"), 2)


@query("agg_6_off_day_profiles", f"WITH {B.DENSE}, {B.HOLIDAYS_SQL} SELECT route, hour, {OFF.format(d='date')} AS off_day, round(avg(value), 2) AS mean, round(median(value), 2) AS median, count(*) AS n FROM z WHERE {PAST} GROUP BY ALL")
def _(spark, d):
    return rounded(history.profile(past(spark, d), ["route", "hour", "off_day"]).drop("std"), 2)


@dated_query("agg_10_network_days", f"WITH {B.DENSE} SELECT date, round(sum(value), 2) AS total FROM z GROUP BY date")
def _(spark, d):
    return rounded(history.network_days(B.dense(spark, d)), 2)


@query("agg_11_hour_profile", f"WITH {B.DENSE} SELECT hour, round(avg(value), 2) AS mean, count(*) AS n FROM z GROUP BY hour")
def _(spark, d):
    return rounded(history.profile(B.dense(spark, d), ["hour"]).select("hour", "mean", "n"), 2)


@query("agg_12_weekday_errors", f"WITH {CHAMPION} SELECT CAST(isodow(date) - 1 AS INT) AS weekday, " + ", ".join(f"round(avg(abs(actual - predicted)) FILTER (hour = {i}), 0) AS h{i}" for i in range(24)) + " FROM sc GROUP BY 1")
def _(spark, d):
    return rounded(metrics.weekday_hours(scored(spark, d).withColumn("error", F.abs(F.col("actual") - F.col("predicted"))), "error"), 0)


#: Temperatures by date and hour out of the orders, in which hours without an order are unknown.
WEATHER = "wt AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 24 AS INT) AS hour, CAST(max(o_custkey % 41) - 20 AS INT) AS temp FROM orders GROUP BY ALL)"


def weather(spark, d):
    return B.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 24).cast("int").alias("hour"), (F.col("o_custkey") % 41 - 20).cast("int").alias("temp"))


@dated_query("join_3_weather", f"WITH {B.TARGETS}, {WEATHER} SELECT route, date, hour, temp FROM t LEFT JOIN wt USING (date, hour)")
def _(spark, d):
    """Repeated readings of an hour: the warmest counts."""
    return history.with_weather(B.targets(spark), weather(spark, d), ["temp"]).select(*grid.KEYS, "temp")


HALVES = "b AS (SELECT t.route, t.date, t.hour, z.value / 2 AS p FROM t JOIN z ON z.route = t.route AND z.hour = t.hour AND z.date = t.date - 7)"


def halves(spark, d):
    return forecast.copy_week(B.targets(spark), B.dense(spark, d)).withColumn("predicted", F.col("predicted") / 2)


@query("join_5_missing", f"WITH {B.DENSE}, {B.TARGETS}, {HALVES} SELECT t.route, count(*) AS n, count(*) FILTER (p IS NULL) AS n_missing, CAST(sum(coalesce(CAST(round_even(greatest(0.0, p), 0) AS BIGINT), 0)) AS BIGINT) AS total FROM t LEFT JOIN (SELECT * FROM b WHERE hour % 7 <> 0) b USING (route, date, hour) GROUP BY t.route")
def _(spark, d):
    out = forecast.submission(B.targets(spark), halves(spark, d).filter("hour % 7 <> 0"))
    return out.groupBy("route").agg(F.count("*").alias("n"), F.count_if("missing").alias("n_missing"), F.sum("prediction").alias("total"))


@dated_query("join_10_break_distances", f"""WITH {B.BREAKS_SQL}, {B.DATES}, s AS (SELECT DISTINCT system FROM br), x AS (SELECT date, system FROM ds, s),
  y AS (SELECT x.*, CAST(EXISTS (SELECT 1 FROM br WHERE br.system = x.system AND x.date BETWEEN first AND last) AS INT) AS inside, (SELECT min(datediff('day', x.date, first)) FROM br WHERE br.system = x.system AND first > x.date) AS u, (SELECT min(datediff('day', last, x.date)) FROM br WHERE br.system = x.system AND last < x.date) AS s FROM x),
  z AS (SELECT date, system, inside, CAST(CASE WHEN inside = 1 THEN 0 ELSE least(21, coalesce(u, 21)) END AS INT) AS until, CAST(CASE WHEN inside = 1 THEN 0 ELSE least(21, coalesce(s, 21)) END AS INT) AS since FROM y) SELECT *, CAST(inside = 0 AND since <= 7 AS INT) AS first_week FROM z""")
def _(spark, d):
    return calendars.interval_distances(B.dates(spark, d), B.breaks(spark))


@dated_query("join_13_frozen", f"WITH {B.DAILY} SELECT a.route, a.date, round(CASE WHEN a.date > DATE '{B.CUTOFF}' THEN c.total ELSE a.total END, 2) AS total FROM dd a LEFT JOIN (SELECT route, total FROM dd WHERE date = DATE '{B.CUTOFF}') c USING (route)")
def _(spark, d):
    days = history.daily(B.dense(spark, d)).select("route", "date", "total")
    return rounded(history.frozen(days, B.CUTOFF, ["route"], ["total"]), 2)


# The same holidays each year, by name.
NAMED = "nm AS (SELECT make_date(CAST(y AS INT), CAST(m AS INT), CAST(a AS INT)) AS date, printf('%02d-%02d', m, a) AS name FROM range(1995, 2002) q(y), (VALUES (5, 1), (5, 9), (6, 12)) v(m, a))"
SAME = f"""hr AS (SELECT route, hour, name, value, row_number() OVER (PARTITION BY route, hour, name ORDER BY date DESC) - 1 AS k FROM z JOIN nm USING (date) WHERE {PAST}),
  hp AS (SELECT route, hour, name, sum(value * power(0.75, k)) / sum(power(0.75, k)) AS same, count(*) AS n_same FROM hr WHERE k < 6 GROUP BY ALL)"""


def named(spark):
    years = spark.range(1995, 2002).select(F.explode(F.array(*[F.struct(F.make_date(F.col("id").cast("int"), F.lit(m), F.lit(a)).alias("date"), F.lit(f"{m:02d}-{a:02d}").alias("name")) for m, a in ((5, 1), (5, 9), (6, 12))])).alias("x"))
    return years.select("x.*")


@dated_query("join_15_same_holiday", f"WITH {B.DENSE}, {B.TARGETS}, {NAMED}, {SAME} SELECT t.route, t.date, t.hour, round(same, 2) AS same, n_same FROM t JOIN nm USING (date) JOIN hp ON hp.route = t.route AND hp.hour = t.hour AND hp.name = nm.name")
def _(spark, d):
    out = history.named_pool(B.targets(spark), B.dense(spark, d), named(spark), B.CUTOFF, 6).filter("name IS NOT NULL")
    return rounded(out.select(*grid.KEYS, history.decayed(F.col("past")).alias("same"), F.size("past").cast("long").alias("n_same")), 2)


@dated_query("fc_6_holiday_or_weekly", f"WITH {B.DENSE}, {B.TARGETS}, {NAMED}, {SAME}, {B.ewm_sql('t', 'z', B.CUTOFF, 8, 'p')} SELECT p.route, p.date, p.hour, round(CASE WHEN n_same >= 2 THEN same ELSE p.value END, 2) AS predicted FROM p LEFT JOIN nm USING (date) LEFT JOIN hp ON hp.route = p.route AND hp.hour = p.hour AND hp.name = nm.name")
def _(spark, d):
    return rounded(forecast.holiday_or_weekly(B.targets(spark), B.dense(spark, d), named(spark), B.CUTOFF).select(*grid.KEYS, "predicted"), 2)


@query("agg_18_holiday_years", f"WITH {B.HOLIDAYS_SQL} SELECT CAST(year(date) AS INT) AS year, count(DISTINCT date) AS n, CAST((SELECT min(date) FROM hol WHERE date >= DATE '2001-02-23') AS VARCHAR) AS next, (SELECT min(date) FROM hol WHERE date >= DATE '2001-02-23') = DATE '2001-02-23' AS is_today FROM hol WHERE year(date) IN (SELECT year(o_orderdate) FROM orders) GROUP BY 1")
def _(spark, d):
    """The years that the orders have."""
    upcoming = calendars.next_holiday(B.holidays(spark), "2001-02-23").select(F.col("date").cast("string").alias("next"), "is_today")
    years = B.dates(spark, d).select(F.year("date").alias("year")).distinct()
    return calendars.by_year(B.holidays(spark)).join(years, "year", "left_semi").join(F.broadcast(upcoming))


@dated_query("agg_24_climatology", f"""WITH {B.HISTORY}, {B.TARGETS}, k AS (SELECT *, month(date) AS m, isodow(date) AS w FROM h WHERE {PAST} ), a AS (SELECT route, hour, m, w, avg(value) AS v FROM k GROUP BY ALL), b AS (SELECT route, hour, w, avg(value) AS v FROM k GROUP BY ALL), c AS (SELECT route, hour, avg(value) AS v FROM k GROUP BY ALL)
  SELECT t.route, t.date, t.hour, round(coalesce(a.v, b.v, c.v), 2) AS value FROM t LEFT JOIN a ON a.route = t.route AND a.hour = t.hour AND a.m = month(t.date) AND a.w = isodow(t.date) LEFT JOIN b ON b.route = t.route AND b.hour = t.hour AND b.w = isodow(t.date) LEFT JOIN c ON c.route = t.route AND c.hour = t.hour""")
def _(spark, d):
    parts = {"month": F.month("date"), "dow": F.weekday("date")}
    known = B.history(spark, d).filter(PAST).withColumns(parts)
    out = history.climatology(B.targets(spark).withColumns(parts), known, [["route", "hour", "month", "dow"], ["route", "hour", "dow"], ["route", "hour"]])
    return rounded(out.select(*grid.KEYS, "value"), 2)


@query("agg_39_models_by_week", f"WITH {MODELS}, x AS (SELECT CAST(datediff('day', DATE '{B.FIRST}', date) // 7 AS BIGINT) AS week, actual, unnest(['a', 'b']) AS model, unnest([a, b]) AS predicted FROM w) SELECT week, model, {ERROR} FROM x GROUP BY week, model")
def _(spark, d):
    rows = two_models(spark, d).withColumn("week", F.floor(F.datediff("date", F.lit(B.FIRST).cast("date")) / 7))
    return _error(metrics.by_models(rows, ["a", "b"], ["week"]))


@query("agg_42_models_by_slice", f"WITH {MODELS}, x AS (SELECT CAST(month(date) AS INT) AS month, isodow(date) >= 6 AS weekend, actual, unnest(['a', 'b', 'blend']) AS model, unnest([a, b, 0.7 * a + 0.3 * b]) AS predicted FROM w) SELECT month, weekend, model, {ERROR} FROM x GROUP BY month, weekend, model")
def _(spark, d):
    rows = two_models(spark, d).withColumns({"month": F.month("date"), "weekend": F.weekday("date") >= 5, "blend": 0.7 * F.col("a") + 0.3 * F.col("b")})
    return _error(metrics.by_models(rows, ["a", "b", "blend"], ["month", "weekend"]))


@query("agg_43_route_scale", f"WITH {B.DENSE} SELECT route, round(greatest(1.0, avg(value)), 2) AS scale FROM z WHERE {PAST} GROUP BY route")
def _(spark, d):
    return rounded(history.route_scale(B.dense(spark, d).filter(PAST)), 2)


@query("win_4_weekday_lags", f"WITH {B.DAILY}, x AS (SELECT route, CAST(isodow(date) - 1 AS INT) AS dow, total, row_number() OVER (PARTITION BY route, isodow(date) ORDER BY date DESC) AS k FROM dd WHERE {PAST}) SELECT route, dow, CAST(i AS INT) AS lag, round(coalesce(total, 0.0), 2) AS total FROM (SELECT DISTINCT route, dow FROM x) CROSS JOIN range(1, 9) r(i) LEFT JOIN x USING (route, dow) WHERE k = i")
def _(spark, d):
    days = history.daily(B.dense(spark, d)).select("route", "date", "total")
    out = history.weekday_lags(days, B.CUTOFF).select("route", "dow", F.posexplode("lags").alias("p", "total"))
    return rounded(out.select("route", "dow", (F.col("p") + 1).alias("lag"), "total"), 2)


@query("rank_8_best_fold", f"WITH {CHAMPION}, s AS (SELECT route, CAST(isoyear(date) * 100 + weekofyear(date) AS INT) AS fold, round(greatest(0.0, 1 - sum(abs(actual - predicted)) / sum(actual)), 9) AS score FROM sc GROUP BY ALL) SELECT route, fold, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, fold) AS k FROM s) WHERE k = 1")
def _(spark, d):
    each = metrics.by(folds.fold_of(scored(spark, d)).withColumn("fold", F.col("fold").cast("int")), ["route", "fold"])
    return rounded(metrics.best_fold(each.select("route", "fold", "score"), ["route"]))


@dated_query("fc_4_pooled_shapes", f"""WITH {CHAMPION}, px AS (SELECT route, hour, CASE WHEN isodow(date) <= 5 THEN 'weekday' WHEN isodow(date) = 6 THEN 'sat' ELSE 'sun' END AS g, value / greatest(sum(value) OVER (PARTITION BY route, date), 1e-6) AS s, power(0.75, datediff('day', date, DATE '{B.CUTOFF}') // 7) AS w FROM z WHERE {PAST} AND date > DATE '{B.CUTOFF}' - 56 AND date NOT IN (SELECT date FROM hol)),
  py AS (SELECT route, g, hour, sum(s * w) / sum(w) AS share FROM px GROUP BY ALL), pz AS (SELECT route, g, hour, CASE WHEN sum(share) OVER (PARTITION BY route, g) > 0 THEN share / sum(share) OVER (PARTITION BY route, g) ELSE 1 / 24.0 END AS pool FROM py),
  d AS (SELECT m.*, sum(predicted) OVER (PARTITION BY route, date) AS day, CASE WHEN isodow(date) <= 5 THEN 'weekday' WHEN isodow(date) = 6 THEN 'sat' ELSE 'sun' END AS g FROM m)
  SELECT d.route, d.date, d.hour, round(CASE WHEN d.date IN (SELECT date FROM hol) AND day > 0 THEN predicted ELSE day * (0.5 * CASE WHEN day > 0 THEN predicted / day ELSE 0.0 END + 0.5 * coalesce(pool, 0.0)) END, 1) AS predicted FROM d LEFT JOIN pz USING (route, g, hour)""")
def _(spark, d):
    return rounded(forecast.pooled(B.targets(spark), B.dense(spark, d), B.holidays(spark), B.CUTOFF).select(*grid.KEYS, "predicted"), 1)


SPANS = [
    selection.Span(*x)
    for x in (
        ("2000-06-30", "2000-08-30", "dev"), ("2000-08-31", "2000-10-31", "dev"), ("2000-10-31", "2000-12-31", "dev"), ("2001-02-28", "2001-04-30", "dev"),
        (B.CUTOFF, B.LAST, "lock"), ("2001-05-14", B.LAST, "check"), ("2001-05-28", B.LAST, "check"),
    )
]
SETTINGS = {"weeks": (3, 4, 6), "decays": (0.6, 0.75), "holidays": (4, 6), "shares": (0.0, 0.5), "shape_weeks": (2, 4), "shape_decays": (1.0,)}


def _search_sql() -> str:
    """The rule as it is stated: profiles fixed at each origin, chosen on dev, confirmed by all spans and the lock."""
    values = lambda xs, kind: ", ".join(f"(CAST({x} AS {kind}))" for x in xs)
    spans = ", ".join(f"({i}, DATE '{s.origin}', DATE '{s.last}', '{s.role}')" for i, s in enumerate(SPANS))
    n = len(SPANS)
    chance = " ".join(f"WHEN {k} THEN {sum(comb(n, j) for j in range(k, n + 1))} / {2**n}.0" for k in range(n + 1))
    return f"""WITH {B.DENSE}, {B.HOLIDAYS_SQL}, sp AS (SELECT * FROM (VALUES {spans}) v(span, origin, last, role)),
  zz AS (SELECT *, CAST(isodow(date) AS INT) AS dow, CASE WHEN isodow(date) <= 5 THEN 0 ELSE isodow(date) - 5 END AS grp, date IN (SELECT date FROM hol) AS free, value / greatest(sum(value) OVER (PARTITION BY route, date), 1e-6) AS part FROM z),
  w AS (SELECT span, route, hour, dow, value, row_number() OVER (PARTITION BY span, route, hour, dow ORDER BY date DESC) - 1 AS k FROM zz JOIN sp ON date <= origin),
  hd AS (SELECT span, route, hour, value, row_number() OVER (PARTITION BY span, route, hour ORDER BY date DESC) - 1 AS k FROM zz JOIN sp ON date <= origin WHERE free),
  ds AS (SELECT * FROM (VALUES {values(SETTINGS["decays"], "DOUBLE")}) v(decay)), ws AS (SELECT * FROM (VALUES {values(SETTINGS["weeks"], "INT")}) v(weeks)), hs AS (SELECT * FROM (VALUES {values(SETTINGS["holidays"], "INT")}) v(holidays)), ss AS (SELECT * FROM (VALUES {values(SETTINGS["shape_weeks"], "INT")}) v(shape_weeks)),
  wp AS (SELECT span, route, hour, dow, weeks, decay, sum(value * power(decay, k)) / sum(power(decay, k)) AS base FROM w JOIN ws ON k < weeks, ds GROUP BY ALL),
  wt AS (SELECT *, sum(base) OVER (PARTITION BY span, route, dow, weeks, decay) AS total FROM wp),
  hp AS (SELECT span, route, hour, holidays, decay, CASE WHEN count(*) >= 2 THEN sum(value * power(decay, k)) / sum(power(decay, k)) END AS held FROM hd JOIN hs ON k < holidays, ds GROUP BY ALL),
  ht AS (SELECT *, sum(held) OVER (PARTITION BY span, holidays, decay) AS volume FROM hp),
  sh AS (SELECT span, route, hour, grp, shape_weeks, avg(part) AS p FROM zz JOIN sp ON date <= origin, ss WHERE NOT free AND date > origin - CAST(7 * shape_weeks AS INT) GROUP BY ALL),
  st AS (SELECT * REPLACE (p / greatest(sum(p) OVER (PARTITION BY span, route, grp, shape_weeks), 1e-9) AS p) FROM sh),
  c AS (SELECT weeks, decay, holidays, 0.0 AS share, CAST(4 AS INT) AS shape_weeks FROM ws, ds, hs UNION ALL SELECT weeks, decay, holidays, 0.5, shape_weeks FROM ws, ds, hs, ss),
  f AS (SELECT t.span, t.role, c.*, t.value AS actual, greatest(0.0, CASE WHEN t.free AND ht.volume > 0 THEN ht.held WHEN share = 0 THEN wt.base ELSE wt.total * (0.5 * wt.base / greatest(wt.total, 1e-6) + 0.5 * coalesce(st.p, 0.0)) END) AS predicted
    FROM (SELECT span, role, zz.* FROM zz JOIN sp ON date > origin AND date <= last) t JOIN c ON TRUE
    JOIN wt ON wt.span = t.span AND wt.route = t.route AND wt.hour = t.hour AND wt.dow = t.dow AND wt.weeks = c.weeks AND wt.decay = c.decay
    LEFT JOIN ht ON ht.span = t.span AND ht.route = t.route AND ht.hour = t.hour AND ht.holidays = c.holidays AND ht.decay = c.decay
    LEFT JOIN st ON st.span = t.span AND st.route = t.route AND st.hour = t.hour AND st.grp = t.grp AND st.shape_weeks = c.shape_weeks),
  s AS (SELECT span, role, weeks, decay, holidays, share, shape_weeks, greatest(0.0, 1 - sum(abs(actual - predicted)) / sum(actual)) AS score FROM f GROUP BY ALL),
  gn AS (SELECT s.*, round(s.score - o.score, 9) AS gain FROM s JOIN s o ON o.span = s.span AND o.weeks = 4 AND o.decay = 0.75 AND o.holidays = 6 AND o.share = 0),
  e AS (SELECT weeks, decay, holidays, share, shape_weeks, min(gain) FILTER (role = 'dev') AS least, round(avg(gain) FILTER (role = 'dev'), 9) AS mean, count(*) FILTER (gain > 1e-9) AS wins, min(gain) FILTER (role = 'lock') AS lock_gain FROM gn GROUP BY ALL),
  v AS (SELECT *, CAST(CASE wins {chance} END AS DOUBLE) AS p, row_number() OVER (ORDER BY least DESC, mean DESC, weeks, decay, holidays, share, shape_weeks) = 1 AS chosen FROM e)
  SELECT weeks, CAST(decay AS DOUBLE) AS decay, holidays, CAST(share AS DOUBLE) AS share, shape_weeks, CAST(1.0 AS DOUBLE) AS shape_decay, round(least, 6) AS least_gain, round(mean, 6) AS mean_gain, wins, round(lock_gain, 6) AS lock_gain, CAST({n} AS INT) AS windows, round(p, 6) AS p_value, chosen,
    chosen AND NOT (weeks = 4 AND decay = 0.75 AND holidays = 6 AND share = 0) AND p <= 0.05 AND lock_gain >= 0 AS accepted FROM v"""


@query("fc_5_profile_search", _search_sql())
def _(spark, d):
    return rounded(selection.search(B.dense(spark, d), B.holidays(spark), SPANS, selection.profiles(**SETTINGS)))


@dated_query("fc_8_roll_forward", f"""WITH RECURSIVE {B.DENSE}, r AS (SELECT a.route, a.hour, a.date, b.value AS prev, a.value AS cur, 0 AS step FROM z a JOIN z b ON b.route = a.route AND b.hour = a.hour AND b.date = a.date - 7 WHERE a.date > DATE '{B.CUTOFF}' - 7 AND a.date <= DATE '{B.CUTOFF}'
  UNION ALL SELECT route, hour, date + 7, cur, (prev + cur) / 2, step + 1 FROM r WHERE step < 9) SELECT route, date, hour, round(cur, 2) AS predicted FROM r WHERE step > 0 AND date <= DATE '{B.LAST}'""")
def _(spark, d):
    make = lambda targets, known, cutoff: forecast.seasonal_naive(targets, known, cutoff, 2, "mean")
    recent = B.dense(spark, d).filter(f"{PAST} AND date > DATE '{B.CUTOFF}' - INTERVAL 60 DAYS")
    return rounded(forecast.roll_forward(recent, B.routes(spark), date.fromisoformat(B.FIRST), date.fromisoformat(B.LAST), make), 2)


FOLDS = f"{MODELS}, fo AS (SELECT CAST(isoyear(date) * 100 + weekofyear(date) AS INT) AS fold, greatest(0.0, 1 - sum(abs(actual - b)) / sum(actual)) AS base, greatest(0.0, 1 - sum(abs(actual - a)) / sum(actual)) AS candidate, greatest(0.0, 1 - sum(abs(actual - b)) FILTER (isodow(date) <= 5) / sum(actual) FILTER (isodow(date) <= 5)) AS bw, greatest(0.0, 1 - sum(abs(actual - a)) FILTER (isodow(date) <= 5) / sum(actual) FILTER (isodow(date) <= 5)) AS cw FROM w WHERE date < DATE '2001-06-25' GROUP BY 1), fk AS (SELECT *, fold >= 200125 AS lock FROM fo)"


@query("fc_12_gate", f"WITH {FOLDS}, ga AS (SELECT avg(candidate - base) FILTER (NOT lock) AS mean_gain, count(*) FILTER (NOT lock AND candidate > base) AS wins, max(base - candidate) FILTER (NOT lock) AS worst_drop, min(candidate - base) FILTER (lock) AS lock_gain, min(cw - bw) FILTER (NOT lock) AS workday_gain FROM fk) SELECT round(mean_gain, 6) AS mean_gain, wins, round(worst_drop, 6) AS worst_drop, round(lock_gain, 6) AS lock_gain, round(workday_gain, 6) AS workday_gain, mean_gain >= 0.005 AND wins >= 3 AND worst_drop <= 0.01 AND lock_gain > 0 AND workday_gain >= -0.002 AS accepted FROM ga")
def _(spark, d):
    rows = folds.fold_of(two_models(spark, d).filter("date < DATE '2001-06-25'"))
    work = F.weekday("date") < 5
    only = lambda c: F.when(work, F.col(c))
    each = rows.groupBy("fold").agg(
        metrics.score(F.col("actual"), F.col("b")).alias("base"), metrics.score(F.col("actual"), F.col("a")).alias("candidate"),
        metrics.score(only("actual"), only("b")).alias("base_workday"), metrics.score(only("actual"), only("a")).alias("candidate_workday"),
    )
    return rounded(metrics.gate(each.withColumn("kind", F.when(F.col("fold") >= 200125, "lock").otherwise("dev"))))


@dated_query("fc_14_over_range", f"""WITH {MODELS}, r AS ({B.grid_sql('x', '2001-04-01', B.LAST).split(' AS (', 1)[1]} SELECT r.route, r.date, r.hour, CAST(round_even(greatest(0.0, coalesce(w.a, o.value / 2, 0.0)), 0) AS BIGINT) AS prediction FROM r LEFT JOIN (SELECT * FROM w WHERE date >= DATE '2001-05-20') w ON w.route = r.route AND w.date = r.date AND w.hour = r.hour LEFT JOIN (SELECT * FROM z WHERE date < DATE '2001-06-01') o ON o.route = r.route AND o.date = r.date AND o.hour = r.hour WHERE r.route <> 2""")
def _(spark, d):
    new = scored(spark, d).filter("date >= DATE '2001-05-20'")
    old = B.dense(spark, d).filter("date < DATE '2001-06-01'").withColumn("predicted", F.col("value") / 2)
    return forecast.over_range(grid.dense(B.routes(spark), "2001-04-01", B.LAST), old, new, without=(2,))


FOLD_DAYS = "DATE '2001-01-01' AND DATE '2001-06-30'"


@dated_query("fc_15_out_of_fold", f"""WITH {B.DENSE}, r AS (SELECT z.route, z.date, z.hour, z.value AS y, p.value AS x, CAST(isoyear(z.date) * 100 + weekofyear(z.date) AS INT) AS fold, isodow(z.date) >= 6 AS weekend FROM z JOIN z p ON p.route = z.route AND p.hour = z.hour AND p.date = z.date - 7 WHERE z.date BETWEEN {FOLD_DAYS}),
  gr AS (SELECT route, weekend, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r GROUP BY ALL),
  q AS (SELECT route, weekend, fold, """ + ", ".join(f"CASE WHEN weekend THEN coalesce(sum({c}) OVER (PARTITION BY route, weekend ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE sum({c}) OVER (PARTITION BY route, weekend) - {c} END AS {c}" for c in ("n", "sx", "sy", "sxx", "sxy")) + """ FROM gr),
  b AS (SELECT *, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0.0) AS slope FROM q WHERE n >= 24)
  SELECT r.route, r.date, r.hour, CAST(q.n AS BIGINT) AS n_train, CASE WHEN slope IS NOT NULL THEN round(greatest(0.0, (b.sy - slope * b.sx) / b.n + slope * x), 1) END AS predicted FROM r JOIN q USING (route, weekend, fold) LEFT JOIN b USING (route, weekend, fold)""")
def _(spark, d):
    """Each hour from the same hour of the week before, by route: weekdays fitted on all other weeks, weekends on earlier ones."""
    rows = B.dense(spark, d).filter("date BETWEEN DATE '2000-12-25' AND DATE '2001-06-30'")
    past = rows.select("route", "hour", F.date_add("date", 7).alias("date"), F.col("value").alias("x"))
    rows = folds.fold_of(rows.filter(f"date BETWEEN {FOLD_DAYS}").join(past, grid.KEYS))
    out = folds.out_of_fold(rows, ["x"], "value", forward=F.weekday("date") >= 5, by=["route"], least=24)
    return rounded(out.select(*grid.KEYS, "n_train", "predicted"), 1)


@query("fc_16_origins", "WITH e AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders), m AS (SELECT CAST(date_trunc('month', last) - INTERVAL (i) MONTH AS DATE) - 1 AS c, last FROM e, range(0, 12) r(i)) SELECT CAST(c AS VARCHAR) AS cutoff, CAST(c + 1 AS VARCHAR) AS first, CAST(c + 61 AS VARCHAR) AS last FROM m WHERE c + 61 <= last ORDER BY c DESC LIMIT 5")
def _(spark, d):
    last = B.table(spark, d, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]
    return spark.createDataFrame([tuple(map(str, w)) for w in forecast.origins(last, 5, 61)], "cutoff string, first string, last string")


@dated_query("fc_17_n_linear")
def _(spark, d):
    """Least squares over windows of each route; tests compare it with a plain loop."""
    return rounded(forecast.n_linear(history.daily(B.dense(spark, d)).select("route", "date", "total"), B.CUTOFF, 61), 0)


def _halves(spark, d):
    rows = two_models(spark, d).withColumns({"dow": F.weekday("date"), "horizon": F.datediff("date", F.lit(B.CUTOFF).cast("date"))})
    half = F.lit("2001-06-01").cast("date")
    return rows.filter(F.col("date") < half), rows.filter(F.col("date") >= half)


LINES = ["l_quantity", "discount", "tax"]
#: Bins of the line items' inputs, as steps: 10 of the quantity, each per cent of discount and tax.
EDGES = [[float(x) for x in range(5, 50, 5)], [float(x) for x in range(10)], [float(x) for x in range(8)]]


def lines(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"), *[F.round(100 * F.col(f"l_{c}")).alias(c) for c in ("discount", "tax")], F.round(F.col("l_extendedprice")).alias("price"))


def _split_sql() -> str:
    """The root's split gains for squared loss: sums of what the mean leaves, below and above each edge."""
    cuts = " UNION ALL ".join(f"SELECT {i} AS feature, {k} AS bin, {c} <= {e} AS below, g FROM x" for i, (c, edges) in enumerate(zip(LINES, EDGES)) for k, e in enumerate(edges))
    return f"""WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, round(100 * l_discount) AS discount, round(100 * l_tax) AS tax, round(l_extendedprice) AS price FROM lineitem), x AS (SELECT *, (SELECT avg(price) FROM l) - price AS g FROM l),
  c AS (SELECT feature, bin, count(*) FILTER (below) AS n_left, sum(g) FILTER (below) AS gl, count(*) AS n, sum(g) AS g FROM ({cuts}) GROUP BY ALL)
  SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, n_left, n - n_left AS n_right, round((gl * gl / (n_left + 1.0) + (g - gl) * (g - gl) / (n - n_left + 1.0) - g * g / (n + 1.0)) / n, 3) AS gain FROM c WHERE n_left >= 20 AND n - n_left >= 20"""


@query("fc_18_split_gains", _split_sql())
def _(spark, d):
    """What each split of the first tree's root would gain, by row, over all line items."""
    known, loss = lines(spark, d).select(F.col("price").alias("_y"), *LINES), boosting.squared()
    mean = known.agg(loss.start(F.col("_y"))).first()[0]
    rows = known.select("_y", F.lit(mean).alias("_raw"), F.array(*[boosting.bin_of(F.col(c), e) for c, e in zip(LINES, EDGES)]).alias("_bins"))
    tried = boosting.split_gains(boosting.histograms(rows, boosting.Tree(), [1], loss), 1.0, 20)[1]  # a row a bin
    made = [(f, b, left[2], right[2], gain / (left[2] + right[2])) for gain, f, b, left, right in tried]
    return rounded(spark.createDataFrame(made, "feature int, bin int, n_left long, n_right long, gain double"), 3)


@query("fc_18_losses")
def _(spark, d):
    """The mean loss and the weighted error over all line items of trees by each loss, and the share of prices under the prediction; a plain loop tests the trees."""
    rows, out = lines(spark, d), None
    price = F.col("price")
    for loss in (boosting.squared(), boosting.absolute(), boosting.quantile(0.7), boosting.huber(5000.0), boosting.fair(5000.0), boosting.poisson(), boosting.tweedie(1.5)):
        model = boosting.fit(rows, LINES, "price", loss, trees=3, depth=2, rate=0.5, edges=EDGES)
        made = boosting.predict(model, rows)
        flat = boosting.Model(model.inputs, model.edges, loss, model.start, model.rate, [])
        one = made.agg(F.avg(loss.value(price, boosting.raw(flat))).alias("loss_before"), F.avg(loss.value(price, boosting.raw(model))).alias("loss_after"), metrics.wape(price, F.col("predicted")).alias("wape"), F.avg((price <= F.col("predicted")).cast("double")).alias("share_below"))
        one = one.select(F.lit(loss.name).alias("loss"), (F.col("loss_after") < F.col("loss_before")).alias("falls"), "wape", "share_below")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("fc_21_parameter_search")
def _(spark, d):
    """Settings of trees tried by a sampler that learns from the errors so far; a plain loop tests the sampler."""
    train, valid = _halves(spark, d)
    train, valid = cut(train), cut(valid)
    inputs = ["route", "dow", "hour", "a", "b"]
    space = [sampling.Real("rate", 0.05, 0.5, log=True), sampling.Whole("depth", 1, 4), sampling.Choice("loss", ("absolute", "quantile", "squared"))]
    losses = {"absolute": boosting.absolute(), "quantile": boosting.quantile(0.55), "squared": boosting.squared()}

    def error(setting: dict) -> float:
        model = boosting.fit(train, inputs, "actual", losses[setting["loss"]], trees=3, depth=setting["depth"], rate=setting["rate"], bins=16)
        made = boosting.predict(model, valid).agg(metrics.wape(F.col("actual"), F.greatest(F.lit(0.0), F.col("predicted"))).alias("wape"))
        return made.first()["wape"]

    trials = sampling.search(spark, space, error, trials=8, batch=4, seed=7)
    made = [(t.number, float(t.setting["rate"]), int(t.setting["depth"]), t.setting["loss"], t.value) for t in trials]
    return rounded(spark.createDataFrame(made, "trial int, rate double, depth int, loss string, wape double"))


@query("agg_44_importances")
def _(spark, d):
    """How much the inputs of fitted trees count; a plain loop tests the trees."""
    train, _ = _halves(spark, d)
    inputs = ["route", "dow", "hour", "a", "b"]
    return rounded(forecast.importances(forecast.boosted(train, inputs, "actual", trees=5, depth=4), spark))


@dated_query("fc_23_mean_trees")
def _(spark, d):
    """Trees on the mean hour of a day, times its hours; a plain loop tests the trees."""
    days = history.daily(B.dense(spark, d)).withColumns({"dow": F.weekday("date"), "month": F.month("date")})
    model = forecast.boosted(days.filter(PAST), ["route", "dow", "month"], "mean", trees=5, depth=4)
    out = forecast.score_with(model, days.filter(f"NOT ({PAST})"))
    return rounded(out.select("route", "date", "mean", (F.col("predicted") * F.col("hours")).alias("predicted")), 1)
