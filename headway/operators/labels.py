"""Counts from raw validations. Each is one partial and one final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions import scalars as S

WIDTHS = (10, 15, 20, 30)


def parse(raw: DataFrame, strict: bool = False) -> DataFrame:
    """route, ts, ok, vehicle from the text columns ngpt_route, tran_date_time, validation_result and garage_number; rows
    without a route or a time go."""
    rows = raw.select(
        S.route_number(F.col("ngpt_route")).alias("route"),
        S.tolerant_timestamp(F.col("tran_date_time")).alias("ts"),
        S.successful(F.col("validation_result"), strict).alias("ok"),
        F.nullif(F.trim("garage_number"), F.lit("")).alias("vehicle"),
    )
    return rows.dropna(subset=["route", "ts"])


def hourly(rows: DataFrame) -> DataFrame:
    """Successful validations by route, date and hour; hours without any are absent."""
    return rows.filter("ok").groupBy("route", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.count("*").alias("boardings"))


def by_interval(rows: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The same for tumbling intervals of several widths in one pass."""
    wide = rows.filter("ok").withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    return wide.groupBy("width", "route", F.to_date("ts").alias("date"), S.interval_start(F.col("ts"), F.col("width")).alias("interval")).agg(F.count("*").alias("boardings"))


def with_vehicles(rows: DataFrame) -> DataFrame:
    """Boardings beside the number of distinct vehicles of all validations, failed ones too; hours without a boarding go."""
    hours = rows.groupBy("route", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))
    return hours.agg(F.count_if("ok").alias("boardings"), F.count_distinct("vehicle").alias("active_trams")).filter("boardings > 0")


def splits(rows: DataFrame, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """Name the first of the inclusive date ranges that holds each row's date; other rows go."""
    name = F.lit(None).cast("string")
    for key, (first, last) in reversed(ranges.items()):
        name = F.when(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")), key).otherwise(name)
    return rows.withColumn("split", name).filter("split IS NOT NULL")
