"""Numbers and ranks over all rows without one group: rows are dealt by ranges, counted by partition, and numbered from where the partition begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.sessions import cut


def _dealt(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows dealt by ranges of ``order`` with their partition's number ``_part``, and (_part, _start): how many rows stand before each partition.

    Written once, as the ranges are drawn from a sample and two runs of the plan might differ. The starts are one row per partition.
    """
    rows = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # one row per partition, of which the session sets the number
    starts, at = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], at))
        at += r["_n"]
    return rows, df.sparkSession.createDataFrame(starts, "_part int, _start long")


#: Starts that are broadcast; more are joined.
FEW = 100_000


def numbered_by(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's number from 0 among those of its key, in ``order``; keys aren't null. A key of any size is spread over as many partitions as it fills:
    rows are dealt by ranges of key and order, and a partition's numbers begin where the ones before it end."""
    rows = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = cut(sizes.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_start")))
    local = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    placed = rows.withColumn("_local", local).join(F.broadcast(starts) if starts.count() <= FEW else starts, [*by, "_part"])
    return placed.withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's number from 0 in ``order``, as a long; ties get numbers in some order. No rows, no numbers."""
    rows, starts = _dealt(df, order)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_local", local).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's rank from 1 in ``order``: ties share the least, as SQL's rank() has it. Equal keys stand in one range, so ties never part."""
    rows, starts = _dealt(df, order)
    return rows.withColumn("_local", F.rank().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_local")).cast("int")).drop("_part", "_local", "_start")
