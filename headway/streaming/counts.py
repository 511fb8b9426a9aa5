"""Boardings and vehicles as a stream, in the same terms as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows  # watermarks need an instant


def interval_counts(rows: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Successful validations by route and tumbling window from a stream of (route, ts, ok); a window closes once the watermark,
    ``late`` behind the newest time, has passed it. Also takes a batch."""
    counted = _watermarked(rows, late).filter("ok").groupBy("route", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("boardings"))
    return counted.select("route", F.col("w.start").cast("timestamp_ntz").alias("start"), "boardings")


def vehicle_counts(rows: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """(route, start, boardings, active_trams, n_rows) of each window from a stream of (route, ts, ok, vehicle), failed validations counting for vehicles: the
    batch's hourly counts as a stream, windows without a boarding included. Also takes a batch.

    Two states in a row: by (route, window, vehicle), which makes the vehicles distinct however often one is seen, and by (route, window). Both are let go when the
    watermark passes the window, so they hold what is open only, and a route with many vehicles is spread over tasks in the first. Rows that come later
    than the watermark aren't in ``n_rows``; ``late_rows`` finds them.
    """
    each = _watermarked(rows, late).groupBy("route", F.window("ts", f"{minutes} minutes").alias("w"), "vehicle").agg(F.count_if("ok").alias("boardings"), F.count("*").alias("n_rows"))
    whole = each.groupBy("route", F.window(F.window_time("w"), f"{minutes} minutes").alias("w")).agg(F.sum("boardings").alias("boardings"), F.count("vehicle").alias("active_trams"), F.sum("n_rows").alias("n_rows"))
    return whole.select("route", F.col("w.start").cast("timestamp_ntz").alias("start"), "boardings", "active_trams", "n_rows")


def late_rows(arrived: DataFrame, closed: DataFrame, minutes: int = 60) -> DataFrame:
    """(route, start, n_late): rows that arrived and are in no count, of windows that have closed; a window that the watermark had passed before its first row is one of them.

    ``arrived`` are all rows that the stream has read, as a batch, and ``closed`` what ``vehicle_counts`` has written. A watermark closes every window that ends before it,
    so those up to the last closed one are closed.
    """
    start = F.window("ts", f"{minutes} minutes")["start"].cast("timestamp_ntz").alias("start")
    came = arrived.groupBy("route", start).agg(F.count("*").alias("_came"))
    last = closed.agg(F.max("start").alias("_last"))  # one row
    rows = came.join(F.broadcast(last)).filter(F.col("start") <= F.col("_last")).join(closed.select("route", "start", "n_rows"), ["route", "start"], "left")
    return rows.withColumn("n_late", F.col("_came") - F.coalesce("n_rows", F.lit(0))).filter("n_late > 0").select("route", "start", "n_late")


def write(counts: DataFrame, path: str, checkpoint: str):
    """Append closed windows as Parquet, exactly once."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
