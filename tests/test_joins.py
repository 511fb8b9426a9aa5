"""Joins with intervals, marks and lines against plain loops."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from headway.operators import calendars, context, geo, gtfs, intervals


def test_intervals_hold_points(spark):
    rng = random.Random(1)
    spans = [(k, a, a + rng.choice([0, 1, 5, 100, 5000, -3])) for k in ("x", "y") for a in (rng.randrange(-3000, 3000) for _ in range(150))]
    spans += [("x", -(10**15), 10**15)] * 2  # a long one, twice
    points = [(k, rng.randrange(-3500, 9000)) for k in ("x", "y", "z") for _ in range(200)] + [("y", spans[0][1])]
    got = {(r["k"], r["_at"]): r["n"] for r in intervals.stabbed(spark.createDataFrame(points, "k string, _at long"), spark.createDataFrame(spans, "k string, _start long, _end long").repartition(3), ["k"]).collect()}
    want = {p: sum(k == p[0] and a <= p[1] <= b for k, a, b in spans) for p in points}
    assert got == {p: n for p, n in want.items() if n}
    index = intervals.indexed(spark.createDataFrame([("x", -(10**15), 10**15), ("x", 3, 4)], "k string, _start long, _end long"), ["k"])
    assert index.count() <= 4  # two bins each, however long
    assert intervals.stabbed(spark.createDataFrame(points, "k string, _at long"), spark.createDataFrame([], "k string, _start long, _end long"), ["k"]).count() == 0


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_marks_on_both_sides(spark, stretch):
    rng = random.Random(stretch)
    marks = [(k, rng.randrange(-500, 500)) for k in (1, 2) for _ in range(25)] + [(1, 4), (1, 4)]
    points = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(-600, 600)) for i in range(400)]
    got = intervals.around(spark.createDataFrame(points, "id int, k int, _at long").repartition(4), spark.createDataFrame(marks, "k int, _at long"), ["k"], stretch).collect()
    assert len(got) == len(points)
    for r in got:
        own = [m for k, m in marks if k == r["k"]]
        assert r["_last"] == max([m for m in own if m <= r["_at"]], default=None) and r["_next"] == min([m for m in own if m >= r["_at"]], default=None)


def test_breaks_of_calendars(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(120)]
    breaks = [("a", date(2024, 1, 10), date(2024, 1, 12)), ("a", date(2024, 1, 11), date(2024, 1, 20)), ("b", date(2024, 3, 1), date(2024, 3, 1)), ("b", date(2023, 1, 1), date(2023, 1, 9))]
    out = calendars.interval_distances(spark.createDataFrame([(d,) for d in days], "date date"), spark.createDataFrame(breaks, "system string, start date, end date"), 21).collect()
    assert len(out) == 240
    for r in out:
        own = [(a, b) for s, a, b in breaks if s == r["system"]]
        inside = any(a <= r["date"] <= b for a, b in own)
        until = min([21, *[(a - r["date"]).days for a, _ in own if a > r["date"]]])
        since = min([21, *[(r["date"] - b).days for _, b in own if b < r["date"]]])
        assert (r["inside"], r["until"], r["since"]) == ((1, 0, 0) if inside else (0, until, since))
        assert r["first_week"] == int(not inside and since <= 7)


def plain_metres(p, a, b):
    """From a point to an arc by trying many of its points."""
    def vector(lat, lon):
        x, y = math.radians(lat), math.radians(lon)
        return (math.cos(x) * math.cos(y), math.cos(x) * math.sin(y), math.sin(x))

    def angle(u, v):
        return 2 * math.asin(min(1.0, math.dist(u, v) / 2))

    u, v, w = vector(*a), vector(*b), vector(*p)
    d, best = angle(u, v), math.inf
    for i in range(2001):
        t = i / 2000
        q = u if d == 0 else tuple((math.sin((1 - t) * d) * x + math.sin(t * d) * y) / math.sin(d) for x, y in zip(u, v))
        best = min(best, angle(w, q))
    return 6371000.0 * best


def test_points_near_lines(spark):
    """Lines of long and short arcs, across 180 degrees and near a pole, a line of one point, and one that stands still."""
    lines = {"city": [(55.7, 37.5), (55.7, 37.7), (55.8, 37.7)], "date": [(10.0, 179.9), (10.1, -179.8)], "pole": [(89.9, 10.0), (89.9, 190.0)], "dot": [(0.0, 0.0)], "still": [(1.0, 1.0), (1.0, 1.0)]}
    rows = [(k, i, lat, lon) for k, v in lines.items() for i, (lat, lon) in enumerate(v)]
    rng = random.Random(3)
    points = [(lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.04, 0.04)) for _, _, lat, lon in rows for _ in range(25)]
    points += [(55.7 + rng.uniform(-0.01, 0.01), rng.uniform(37.5, 37.7)) for _ in range(40)] + [(10.05 + rng.uniform(-0.02, 0.02), lon) for lon in (179.95, -179.95, 180.0, -180.0, 179.99)] + [(89.99, rng.uniform(-180, 180)) for _ in range(10)]
    points = [(i, lat, ((lon + 180) % 360) - 180) for i, (lat, lon) in enumerate(points)]
    frame = spark.createDataFrame([*points, (9999, None, None)], "id int, lat double, lon double")
    arcs = geo.segments(spark.createDataFrame(rows, "line string, at int, lat double, lon double").repartition(3), ["line"], ["at"])
    metres = 600.0
    far = {(k, i): min(plain_metres((lat, lon), a, b) for a, b in zip(v, v[1:] or v)) for k, v in lines.items() for i, lat, lon in points}
    clear = {key for key, m in far.items() if abs(m - metres) > 5}  # the loop's steps are coarse
    near = {i for (k, i), m in far.items() if m <= metres}
    got = {r["id"] for r in geo.near_lines(frame, arcs, metres).collect()}
    unsure = {i for k, i in set(far) - clear}
    assert got - unsure == near - unsure and len(near) > 60
    pairs = {(r["line"], r["id"]) for r in geo.by_line(frame, "id", arcs, ["line"], metres).collect()}
    assert pairs & clear == {key for key, m in far.items() if m <= metres} & clear
    assert geo.near_lines(frame, arcs.limit(0), metres).count() == 0


def test_cards_know_nothing_of_their_facts(spark):
    rows = spark.createDataFrame([(1, 2.5, None, True, "x"), (2, None, 0, None, None)], "id int, a double, b int, c boolean, d string")
    factors = (context.Factor("A", "a", "%", "d", stand_in="none", signed=True), context.Factor("B", "b", tail="t", needs="b", stand_in="unknown", can_be_off=True), context.Factor("C", "c", can_be_off=True))
    got = {(r["id"], r["place"]): (r["label"], r["value"], r["note"], r["off"]) for r in context.cards(rows, "id", factors).collect()}
    assert got == {
        (1, 1): ("A", "+2.5%", "x", False), (1, 2): ("B", context.UNKNOWN, "unknown", True), (1, 3): ("C", context.YES, "", False),
        (2, 1): ("A", context.UNKNOWN, "none", False), (2, 2): ("B", "0", "t", True), (2, 3): ("C", context.NO, "", True),
    }


def test_a_made_up_feed(spark):
    feed = gtfs.demo(spark, 3, 4)
    stops = feed["stops"].collect()
    assert len(stops) == 12 and feed["stop_times"].count() == 12
    assert all(54 < r["stop_lat"] < 57 and 36 < r["stop_lon"] < 39 for r in stops)


def test_a_string_of_days_is_checked(spark):
    rows = calendars.day_strings(spark.createDataFrame([(7, "2024-02-28", "101")], "id int, first string, marks string").withColumn("first", F.col("first").cast("date"))).collect()
    assert [(r["id"], str(r["date"]), r["day_off"]) for r in rows] == [(7, "2024-02-28", 1), (7, "2024-02-29", 0), (7, "2024-03-01", 1)]
    with pytest.raises(Exception, match="only 0 and 1"):
        calendars.day_string("2024-01-01", "102", spark).collect()
