"""The driver's tables as the domain's: each table here has one Spark form and one SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.operators import forecast, grid, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CUTOFF, FIRST, LAST = "2001-04-30", "2001-05-01", "2001-06-30"
#: Public holidays of the years of the tables.
HOLIDAYS = ("2000-01-01", "2000-05-01", "2000-05-09", "2000-11-04", "2001-01-01", "2001-01-07", "2001-02-23", "2001-03-08", "2001-05-01", "2001-05-09", "2001-06-12")
BREAKS = (("quarter", "2001-03-19", "2001-03-29"), ("quarter", "2001-06-02", "2001-08-30"), ("module", "2001-02-12", "2001-02-20"), ("module", "2001-04-16", "2001-04-22"), ("module", "2001-06-04", "2001-08-30"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def dated_query(name: str, sql: str | None = None):
    """The same for rows with a date, which goes out as ISO text, as in the files that the domain exchanges."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark, d).withColumn("date", F.col("date").cast("string"))

        return query(name, sql and f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({sql})")(run)

    return add


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


#: The dates of the orders, each once, as ``ds`` (date).
DATES = "ds AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"


def dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


def routes(spark: SparkSession, n: int = 3) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("route"))


# Raw validations out of events.
VALID = "v AS (SELECT CAST(user_id % 10 AS INT) AS route, CAST(ts AS DATE) AS date, hour(ts) AS hour, minute(ts) AS minute, event_type = 'purchase' AS ok, user_id AS vehicle FROM events)"


def validations(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select(
        F.concat((F.col("user_id") % 10).cast("string"), F.lit(" line")).alias("ngpt_route"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("tran_date_time"),
        F.when(F.col("event_type") == "purchase", " 1.0").otherwise("2").alias("validation_result"),
        F.col("user_id").cast("string").alias("garage_number"),
    )
    return labels.parse(raw)


# A long hourly history out of orders. Values are money in whole cents, so that sums don't depend on the order.
HISTORY = "h AS (SELECT CAST(o_custkey % 3 AS INT) AS route, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 24 AS INT) AS hour, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS value FROM orders GROUP BY ALL)"


def history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.groupBy((F.col("o_custkey") % 3).cast("int").alias("route"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 24).cast("int").alias("hour")).agg(F.sum(cents).cast("double").alias("value"))


def grid_sql(name: str, first: str, last: str) -> str:
    return f"{name} AS (SELECT CAST(r AS INT) AS route, CAST(d AS DATE) AS date, CAST(x AS INT) AS hour FROM range(3) a(r), generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY) b(d), range(24) c(x))"


TARGETS = grid_sql("t", FIRST, LAST)
#: The whole history without gaps, from its first day to its last.
DENSE = HISTORY + ", g AS (SELECT CAST(r AS INT) AS route, CAST(d AS DATE) AS date, CAST(x AS INT) AS hour FROM range(3) a(r), (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM h) b, range(24) c(x)), z AS (SELECT g.route, g.date, g.hour, coalesce(h.value, 0.0) AS value FROM g LEFT JOIN h USING (route, date, hour))"
#: Daily totals over every day.
DAILY = DENSE + ", dd AS (SELECT route, date, sum(value) AS total FROM z GROUP BY ALL)"


def targets(spark: SparkSession) -> DataFrame:
    return grid.dense(routes(spark), FIRST, LAST)


def dense(spark: SparkSession, d: str) -> DataFrame:
    known = history(spark, d)
    return grid.filled(grid.spanning(routes(spark), known), known, "value")


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in HOLIDAYS], "date string").select(F.col("date").cast("date").alias("date"))


HOLIDAYS_SQL = "hol AS (SELECT CAST(x AS DATE) AS date FROM (VALUES " + ", ".join(f"('{x}')" for x in HOLIDAYS) + ") v(x))"


def breaks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BREAKS), "system string, a string, b string").select("system", F.col("a").cast("date").alias("start"), F.col("b").cast("date").alias("end"))


BREAKS_SQL = "br AS (SELECT s AS system, CAST(a AS DATE) AS first, CAST(b AS DATE) AS last FROM (VALUES " + ", ".join(f"('{s}', '{a}', '{b}')" for s, a, b in BREAKS) + ") v(s, a, b))"

# Facts of four whole weeks and a forecast of two days, for boards.
FACTS = (
    "e AS (SELECT CAST(user_id % 3 AS INT) AS route, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL), "
    + grid_sql("gf", "2024-01-01", "2024-01-28")
    + ", f AS (SELECT gf.route, gf.date, gf.hour, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM gf LEFT JOIN e USING (route, date, hour)), "
    + grid_sql("gp", "2024-01-29", "2024-01-30")
)


def ewm_sql(target: str, past: str, cutoff: str, k: int, name: str) -> str:
    """The decayed mean of the newest k values of the target's weekday up to the cutoff and a week before."""
    return f"""{name}_r AS (SELECT {target}.route, {target}.date, {target}.hour, p.value, row_number() OVER (PARTITION BY {target}.route, {target}.date, {target}.hour ORDER BY p.date DESC) - 1 AS k
      FROM {target} JOIN {past} p ON p.route = {target}.route AND p.hour = {target}.hour AND isodow(p.date) = isodow({target}.date) AND p.date <= DATE '{cutoff}' AND p.date <= {target}.date - 7),
    {name} AS (SELECT {target}.route, {target}.date, {target}.hour, coalesce(sum(value * power(0.75, k)) / sum(power(0.75, k)), 0.0) AS value FROM {target} LEFT JOIN (SELECT * FROM {name}_r WHERE k < {k}) USING (route, date, hour) GROUP BY ALL)"""


BOARD = FACTS + ", " + ewm_sql("gp", "f", "2024-01-28", 4, "p")
#: Every cell of the month, with the median of the route's other dates of the same weekday and hour.
CELLS = (
    BOARD
    + """, c AS (SELECT route, date, hour, value, 'fact' AS status FROM f UNION ALL SELECT route, date, hour, value, 'forecast' FROM p),
  u AS (SELECT c.route, c.date, c.hour, c.value, c.status, CASE WHEN count(f.value) >= 3 THEN median(f.value) END AS usual
        FROM c LEFT JOIN f ON f.route = c.route AND f.hour = c.hour AND isodow(f.date) = isodow(c.date) AND f.date <> c.date GROUP BY ALL)"""
)


def facts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type <> 'error'")
    n = e.groupBy((F.col("user_id") % 3).cast("int").alias("route"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.count("*").cast("double").alias("value"))
    return grid.filled(grid.dense(routes(spark), "2024-01-01", "2024-01-28"), n, "value")


def board_forecast(spark: SparkSession, d: str) -> DataFrame:
    ahead = grid.dense(routes(spark), "2024-01-29", "2024-01-30")
    return forecast.seasonal_naive(ahead, facts(spark, d), "2024-01-28").withColumnRenamed("predicted", "value")


# Places.
POINTS = (
    "st AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS line, 55.5 + (s_suppkey * 37 % 400) / 1000.0 AS lat, 37.3 + (s_suppkey * 53 % 600) / 1000.0 AS lon FROM supplier), "
    "ev AS (SELECT c_custkey AS id, c_nationkey AS kind, c_acctbal AS size, 55.5 + (c_custkey * 91 % 4001) / 10000.0 AS lat, 37.3 + (c_custkey * 57 % 6007) / 10000.0 AS lon FROM customer)"
)
FAR = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


def far_sql(a: str, b: str) -> str:
    return FAR.format(a=a, b=b)


def stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("line"), (55.5 + (k * 37 % 400) / 1000.0).alias("lat"), (37.3 + (k * 53 % 600) / 1000.0).alias("lon"))


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("kind"), F.col("c_acctbal").alias("size"), (55.5 + (k * 91 % 4001) / 10000.0).alias("lat"), (37.3 + (k * 57 % 6007) / 10000.0).alias("lon"))


def rounded(df: DataFrame, places_: int = 6) -> DataFrame:
    """Doubles to some places, as sums differ in the last bits with the order."""
    return df.select(*[(F.round(c, places_) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tone_sql(value: str, usual: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'missing' WHEN {usual} IS NULL OR {usual} <= 0 THEN 'ok' WHEN {value} / {usual} > 1.15 THEN 'hot' WHEN {value} / {usual} > 1 THEN 'warm' ELSE 'ok' END"

