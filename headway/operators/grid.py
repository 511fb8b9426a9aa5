"""Dense grids of route, date and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["route", "date", "hour"]


def dense(routes: DataFrame, first: str, last: str, hours: range = range(24)) -> DataFrame:
    """Every route, date and hour. Built by exploding sequences, so no join is needed."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")
    return routes.select("route", days).withColumn("hour", F.explode(F.array(*map(F.lit, hours))))


def spanning(routes: DataFrame, rows: DataFrame, hours: range = range(24)) -> DataFrame:
    """Every route and hour of each day from the first of ``rows`` to the last. The two ends are one row, which each route meets."""
    ends = rows.agg(F.min("date").alias("_a"), F.max("date").alias("_b")).filter("_a IS NOT NULL")
    days = routes.select("route").join(F.broadcast(ends)).select("route", F.explode(F.sequence("_a", "_b")).alias("date"))
    return days.withColumn("hour", F.explode(F.array(*map(F.lit, hours))))


def filled(grid: DataFrame, labels: DataFrame, value: str = "boardings") -> DataFrame:
    """The grid with its labels, 0 where there is none."""
    return grid.join(labels.select(*KEYS, value), KEYS, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def repeated(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys with more than one row: empty if a one-to-one join is safe."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def outside(rows: DataFrame, grid: DataFrame, value: str = "boardings") -> DataFrame:
    """How many rows and how much value the grid doesn't hold."""
    return rows.join(grid, KEYS, "left_anti").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def gap(a: DataFrame, b: DataFrame, value: str = "boardings") -> DataFrame:
    """The total difference of two label tables over the union of their keys."""
    both = a.select(*KEYS, F.col(value).alias("_a")).join(b.select(*KEYS, F.col(value).alias("_b")), KEYS, "full")
    return both.agg(F.count("*").alias("n_keys"), F.sum(F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))).alias("gap"))


def vectors(rows: DataFrame, value: str = "boardings") -> DataFrame:
    """One array of 24 hours for each route and date; absent hours are 0, hours out of range are ignored."""
    by_hour = F.map_from_entries(F.collect_list(F.struct("hour", F.col(value).cast("double"))))
    days = rows.filter(F.col("hour").between(0, 23)).groupBy("route", "date").agg(by_hour.alias("_m"))
    return days.select("route", "date", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("_m", h), F.lit(0.0))).alias("hours"))


def long_rows(days: DataFrame, value: str = "value") -> DataFrame:
    return days.select("route", "date", F.posexplode("hours").alias("hour", value))
