"""Joins of transit feeds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_trip_stops(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """For each route the stops of its first trip in order; stop times without a stop go."""
    first = trips.groupBy("route_id").agg(F.min("trip_id").alias("trip_id"))
    return stop_times.join(first, "trip_id").join(stops, "stop_id").select("route_id", "trip_id", "stop_sequence", "stop_id", "stop_name")


def routes_by_stop(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """For each stop its distinct routes, ordered, and their number."""
    seen = stop_times.select("stop_id", "trip_id").join(trips.select("trip_id", "route_id"), "trip_id").select("stop_id", "route_id").distinct()
    return seen.groupBy("stop_id").agg(F.count("*").alias("n_routes"), F.array_join(F.transform(F.array_sort(F.collect_list("route_id")), lambda x: x.cast("string")), ",").alias("routes"))


def routes_as_seen(trips: DataFrame, stop_times: DataFrame, order: str) -> DataFrame:
    """For each stop its distinct routes in the order in which they are first seen, ties by route, joined by commas."""
    first = stop_times.select("stop_id", "trip_id", order).join(trips.select("trip_id", "route_id"), "trip_id").groupBy("stop_id", "route_id").agg(F.min(order).alias("_k"))
    listed = F.array_sort(F.collect_list(F.struct("_k", "route_id")))
    return first.groupBy("stop_id").agg(F.array_join(F.transform(listed, lambda x: x["route_id"].cast("string")), ",").alias("routes"))


def search(routes: DataFrame, stops: DataFrame, needle: str) -> DataFrame:
    """Routes (route_id, number, long_name) whose number, name or stops' names (route_id, stop_name) contain the needle, in any case; an empty one
    finds all. A route's stops are a few dozen."""
    names = stops.groupBy("route_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("stop_name"))).alias("_names"))
    text = F.lower(F.concat_ws(" ", "number", "long_name", F.coalesce("_names", F.lit(""))))
    return routes.join(names, "route_id", "left").filter(F.contains(text, F.lit(needle.strip().lower()))).drop("_names")


def departures(stop_times: DataFrame, trips: DataFrame, service_dates: DataFrame, stops: DataFrame) -> DataFrame:
    """Each stop time on each date of its service; the stop may be unknown."""
    return stop_times.join(trips, "trip_id").join(service_dates, "service_id").join(stops, "stop_id", "left")


def trips_by_route(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Number of trips, at least 1."""
    n = trips.groupBy("route_id").agg(F.count("*").alias("n"))
    return routes.select("route_id").join(n, "route_id", "left").select("route_id", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).cast("long").alias("n_trips"))


def build(records: DataFrame, minutes: int = 5) -> DataFrame:
    """Stop times from loose points (route_id, direction, stop_id, stop_sequence, index): ordered, one a stop, a trip where two are
    left at least, a departure every ``minutes`` from midnight; hours may pass 24."""
    key = F.col("stop_sequence") * 100 + F.col("index")
    once = records.groupBy("route_id", "direction", "stop_id").agg(F.min(key).alias("_k"))
    w = W.partitionBy("route_id", "direction")
    rows = once.withColumns({"seq": F.row_number().over(w.orderBy("_k", "stop_id")), "_n": F.count("*").over(w)}).filter("_n >= 2")
    at = (F.col("seq") - 1) * minutes
    return rows.select("route_id", "direction", "stop_id", F.col("seq").cast("long").alias("stop_sequence"), F.format_string("%02d:%02d:00", F.floor(at / 60), at % 60).alias("departure_time"))


def feed(records: DataFrame, minutes: int = 5) -> dict[str, DataFrame]:
    """The tables of a feed from loose points (route_id, direction, stop_id, stop_name, lat, lon, stop_sequence, index), a trip and a shape for each route and direction
    as ``build`` makes them. Of a stop's positions and names the one first in its trip counts, then the least."""
    key = F.col("stop_sequence") * 100 + F.col("index")
    times = build(records, minutes).withColumn("trip_id", F.concat_ws("-", F.lit("trip"), "route_id", "direction"))
    spot = F.struct(key.alias("k"), "stop_name", "lat", "lon")
    stops = records.groupBy("stop_id").agg(F.min(spot).alias("s")).select("stop_id", "s.stop_name", F.col("s.lat").alias("stop_lat"), F.col("s.lon").alias("stop_lon"))
    at = records.groupBy("route_id", "direction", "stop_id").agg(F.min(spot).alias("s"))
    shapes = times.join(at, ["route_id", "direction", "stop_id"]).select(F.concat_ws("-", F.lit("shape"), "route_id", "direction").alias("shape_id"), F.col("s.lat").alias("shape_pt_lat"), F.col("s.lon").alias("shape_pt_lon"), F.col("stop_sequence").alias("shape_pt_sequence"))
    trips = times.filter("stop_sequence = 1").select("route_id", "trip_id", F.col("direction").alias("direction_id"), F.concat_ws("-", F.lit("shape"), "route_id", "direction").alias("shape_id"))
    return {
        "routes": trips.select("route_id").distinct(),
        "stops": stops.join(times.select("stop_id").distinct(), "stop_id", "left_semi"),
        "trips": trips,
        "stop_times": times.select("trip_id", "stop_id", "stop_sequence", F.col("departure_time").alias("arrival_time"), "departure_time"),
        "shapes": shapes,
    }


def demo(spark, n_routes: int = 9, n_stops: int = 6) -> dict[str, DataFrame]:
    """A feed of made-up routes: stops along straight lines that fan out from the middle of a city."""
    i, j = F.col("i"), F.col("j")
    points = spark.range(n_routes).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_stops - 1))).alias("j"))
    angle = i * (2 * math.pi / n_routes)
    return feed(
        points.select(
            F.concat(F.lit("route_"), (i + 1).cast("string")).alias("route_id"), F.lit(0).alias("direction"), F.concat_ws("_", F.lit("stop"), i + 1, j + 1).alias("stop_id"),
            F.concat((i + 1).cast("string"), F.lit(" · остановка "), (j + 1).cast("string")).alias("stop_name"),
            F.round(55.75 + (j + 1) * 0.01 * F.sin(angle), 6).alias("lat"), F.round(37.62 + (j + 1) * 0.018 * F.cos(angle), 6).alias("lon"), (j + 1).alias("stop_sequence"), F.lit(0).alias("index"),
        )
    )


def drop_runs(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Without rows whose value is that of the row before."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_p", F.lag(column).over(w)).withColumn("_f", F.row_number().over(w)).filter((F.col("_f") == 1) | ~F.col(column).eqNullSafe(F.col("_p"))).drop("_p", "_f")
