"""What larger tables asked of joins, searches and files, on small rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from headway.functions import scalars, sessions
from headway.operators import context, geo, intervals
from headway.sources import tables


def broadcasts(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def cross_town(spark, n=40):
    points = spark.range(n).select("id", (F.col("id") % 3).alias("line"), (55.5 + F.col("id") * 37 % 400 / 1000).alias("lat"), (37.3 + F.col("id") * 53 % 600 / 1000).alias("lon"))
    return points, geo.segments(points, ["line"], ["id"])


def test_cells_of_lines_are_not_broadcast(spark):
    points, arcs = cross_town(spark)
    assert not broadcasts(geo.by_line(points, "id", arcs, ["line"], 300.0))


def test_arcs_are_dealt_out_before_they_are_cut_into_cells(spark):
    points, arcs = cross_town(spark)
    cells, _ = geo.line_cells(arcs.coalesce(1), 300.0)
    assert "REPARTITION_BY_NUM" in cells._jdf.queryExecution().executedPlan().toString()


def test_semi_join_with_lines_is_not_broadcast(spark):
    points, arcs = cross_town(spark)
    assert not broadcasts(geo.near_lines(points, arcs, 300.0))


def test_points_in_intervals_are_not_broadcast(spark):
    points = spark.range(50).select((F.col("id") % 5).alias("k"), F.col("id").alias("_at"))
    spans = points.select("k", F.col("_at").alias("_start"), (F.col("_at") + 7).alias("_end"))
    assert not broadcasts(intervals.stabbed(points, spans, ["k"]))


def test_open_orders_are_not_broadcast(spark):
    from headway.plans.history_queries import open_orders

    assert not broadcasts(open_orders(spark, "/root/testdata/sf0.001"))


def test_long_lines_of_geojson(spark):
    spots = [[37 + i / 1e5, 55.0] for i in range(30_000)]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"line": "1"}, "geometry": {"type": "MultiLineString", "coordinates": [spots, spots[:2]]}}]})
    got = tables.geojson_rows(spark.createDataFrame([(text,)], "text string")).groupBy("part").agg(F.count("*").alias("n"), F.max("seq").alias("last")).orderBy("part").collect()
    assert [(r["part"], r["n"], r["last"]) for r in got] == [(0, 30_000, 29_999), (1, 2, 1)]


def test_the_last_stop_of_a_long_line_is_placed(spark):
    """A third of three times the length may be more than the length, by the last bit."""
    lines = spark.range(400).select(F.col("id").alias("line"), F.explode(F.array(F.lit(0), F.lit(1))).alias("at"), F.lit(0.0).alias("lat"))
    points = lines.withColumn("lon", F.when(F.col("at") == 1, 101 + F.col("line") / 9).otherwise(0.0))
    stops = spark.range(400).select(F.col("id").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"), F.lit(4).alias("n"))
    got = geo.placed(points, "line", ["at"], stops).filter("place = 3").collect()
    assert len(got) == 400 and all(abs(r["lon"] - (101 + r["line"] / 9)) < 1e-9 for r in got)


def looked_at(monkeypatch):
    """The numbers of pairs that searches in cells have made so far."""
    seen, ring = [], geo._ring

    def counted(*args):
        pairs = ring(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(geo, "_ring", counted)
    return seen


def crowd(spark, n=2000):
    """Places in a square of some 300 metres, a pair of them at each position."""
    return spark.range(n).select("id", (55.7 + F.floor(F.col("id") / 2) * 37 % 1000 / 400_000).alias("lat"), (37.6 + F.floor(F.col("id") / 2) * 91 % 997 / 200_000).alias("lon"))


def test_closest_in_a_crowd(spark, monkeypatch):
    seen, rows = looked_at(monkeypatch), crowd(spark)
    far = spark.createDataFrame([(5000, 55.71, 37.6), (5001, 55.8, 37.6), (5002, None, None)], "id long, lat double, lon double")
    left = rows.filter("id % 20 = 0").unionByName(far)
    got = {(r["id"], r["rank"], r["r_id"]) for r in geo.closest(left, ["id"], rows, 1500.0, 3, ["id"]).collect()}
    assert sum(seen) < 100 * 2000 / 4
    monkeypatch.undo()
    pairs = left.crossJoin(rows.select(F.col("id").alias("o"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))).withColumn("m", scalars.haversine(F.col("olat"), F.col("olon"), F.col("lat"), F.col("lon"))).filter("m <= 1500").collect()
    want = set()
    for i in {r["id"] for r in pairs}:
        want |= {(i, k, r["o"]) for k, r in enumerate(sorted((r for r in pairs if r["id"] == i), key=lambda r: (r["m"], r["o"]))[:3], 1)}
    assert got == want and any(i == 5000 for i, _, _ in got)


def test_nearest_in_a_crowd(spark, monkeypatch):
    seen, rows = looked_at(monkeypatch), crowd(spark)
    got = {r["id"]: (r["r_id"], r["metres"]) for r in geo.nearest(rows, "id", rows, ["id"]).collect()}
    assert got == {i: (i - i % 2, 0.0) for i in range(2000)}  # of two at one position the first
    assert sum(seen) < 2000 * 2000 / 4


def test_roll_up_has_no_sort_of_pairs(spark):
    """Nothing but the few kinds of each position is gathered."""
    from headway.plans import catalog

    plan = catalog.queries()["agg_15_station_roll_up"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    below = "\n".join(lines[max(i for i, x in enumerate(lines) if "ObjectHashAggregate" in x) + 1 :])
    assert "collect_set" in plan and "HashAggregate" in below and "SortAggregate" not in plan


def test_matched_keeps_no_pairs(spark):
    """The best station of each stop, against a plain loop, without a sort of all pairs."""
    stops = spark.range(60).select("id", F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("name"), (F.col("id") % 7).alias("route"), F.when(F.col("id") != 5, 55 + F.col("id") % 11 / 100).alias("lat"), (37 + F.col("id") % 5 / 100).alias("lon"))
    stations = spark.range(80).select((100 - F.col("id")).alias("station"), F.concat(F.lit("A "), (F.col("id") % 4).cast("string")).alias("name"), F.when(F.col("id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("id") % 5, F.col("id") % 3)).alias("routes"), F.when(F.col("id") != 7, 55 + F.col("id") % 6 / 100).alias("lat"), (37 + F.col("id") % 4 / 100).alias("lon"))
    seen = []

    def far(a, b, c, d):
        return F.hypot(c - a, d - b)

    got = {r["id"]: (r["station"], r["serves"], r["metres"]) for r in context.matched(stops, stations, far).collect()}
    known = stations.collect()
    for s in stops.collect():
        best = min(((r["name"].replace("A ", "a") == s["name"]) and (s["route"] not in r["routes"], math.inf if None in (r["lat"], s["lat"]) else math.hypot(s["lat"] - r["lat"], s["lon"] - r["lon"]), r["station"]) or (2,) for r in known))
        seen.append(s["id"])
        assert (got[s["id"]][0], got[s["id"]][1]) == (best[2], not best[0]) and (got[s["id"]][2] == best[1] or abs(got[s["id"]][2] - best[1]) < 1e-12)
    assert len(seen) == len(got) == 60


def test_matched_sorts_nothing_by_stop(spark):
    stops = spark.range(9).select("id", F.lit("a").alias("name"), F.lit(1).alias("route"), F.lit(55.0).alias("lat"), F.lit(37.0).alias("lon"))
    stations = stops.select(F.col("id").alias("station"), "name", F.array("route").alias("routes"), "lat", "lon")
    cuts = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(context, "cut", lambda df: cuts.append(df._jdf.queryExecution().executedPlan().toString()) or sessions.cut(df), raising=False)
        df = context.matched(stops, stations)
    plans = [*cuts, df._jdf.queryExecution().executedPlan().toString()]
    assert not any("SortAggregate" in x for x in plans)
