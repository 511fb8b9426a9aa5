"""Small cases with known results."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.operators import forecast, geo, grid, history, labels, metrics, serving
from headway.sources import sinks, tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ten_minute_counts(spark):
    rows = [("05:00:00", "1"), ("05:09:59", "1"), ("05:10:00", "2"), ("05:15:00", "1"), ("05:20:00", "1")]
    raw = spark.createDataFrame([("25 line", f"2025-01-01 {t}", r, " ") for t, r in rows], "ngpt_route string, tran_date_time string, validation_result string, garage_number string")
    got = labels.by_interval(labels.parse(raw), (10,)).orderBy("interval").collect()
    assert [(r["route"], r["interval"], r["boardings"]) for r in got] == [(25, "05:00", 2), (25, "05:10", 1), (25, "05:20", 1)]


@pytest.mark.parametrize("text, ok, strict", [("1", True, True), ("1.0", True, False), (" 1 ", True, False), ("2", False, False), (None, False, False), ("x", False, False)])
def test_success(spark, text, ok, strict):
    c = F.lit(text).cast("string")
    assert value(spark, S.successful(c)) is ok and value(spark, S.successful(c, True)) is strict


@pytest.mark.parametrize("text, want", [("25 line", 25), ("no digits", None), (None, None), ("T2b7", 2), ("99999999999", None)])
def test_route_number(spark, text, want):
    assert value(spark, S.route_number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("0,5", 0.5), ("2", 2.0), ("2.01", None), ("abc", None), ("", None), (None, None), ("1,2345", 1.235)])
def test_coefficient(spark, text, want):
    assert value(spark, S.coefficient(F.lit(text).cast("string"))) == want


def test_rounding(spark):
    assert [value(spark, S.half_up(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [1, 2, 3, 0]
    assert [value(spark, S.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_fnv(spark):
    assert value(spark, S.fnv1a(F.lit("a"))) == 0xE40C292C
    assert value(spark, S.fnv1a(F.lit(""))) == 2166136261


def test_weather(spark):
    kinds = [(0.0, 0.0, 71, "snow"), (5.0, 0.1, 61, "snow"), (0.2, 0.0, 0, "rain"), (0.0, 0.0, 45, "fog"), (None, None, None, "clear")]
    for precip, snow, code, want in kinds:
        assert value(spark, S.weather_kind(F.lit(precip).cast("double"), F.lit(snow).cast("double"), F.lit(code).cast("int"))) == want


def test_typical_needs_three_other_dates(spark):
    days = [f"2024-01-{d:02d}" for d in (1, 8, 15, 22)]
    facts = spark.createDataFrame([(1, d, 8, float(v)) for d, v in zip(days, (1, 5, 9, 100))], "route int, date string, hour int, value double").withColumn("date", F.col("date").cast("date"))
    assert {str(r["date"]): r["usual"] for r in serving.typical(facts, facts).collect()} == {days[0]: 9.0, days[1]: 9.0, days[2]: 5.0, days[3]: 5.0}
    few = facts.filter("date < DATE '2024-01-22'")
    assert {r["usual"] for r in serving.typical(few, few).collect()} == {None}


def test_scenario_order(spark):
    rows = spark.createDataFrame([
        (1, "rain", True, "1,2", True, "0.9"), (2, "rain", True, "9", True, "0.9"), (3, "rain", True, "x", False, None), (4, "rain", False, None, False, None), (5, "fog", False, None, False, None), (6, "base", False, None, False, None), (7, None, False, None, False, None),
    ], "route int, weather string, event_on boolean, event_text string, season_on boolean, season_text string")
    weather = spark.createDataFrame([("rain", 4, 1.1, True), ("rain", 3, 1.3, True)], "weather string, route int, coefficient double, apply boolean")
    got = {r["route"]: (r["origin"], r["coefficient"]) for r in serving.resolve(rows, weather).collect()}
    assert got == {1: ("event", 1.2), 2: ("season", 0.9), 3: ("invalid", 1.0), 4: ("weather", 1.1), 5: ("unestimated", 1.0), 6: ("base", 1.0), 7: ("base", 1.0)}


def far(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_within_finds_points_east_and_west(spark):
    step = 140 / (111320 * math.cos(math.radians(55.75)))
    left = spark.createDataFrame([(1, 55.75, 37.6)], "id int, lat double, lon double")
    right = spark.createDataFrame([(1, 55.75, 37.6 + step), (2, 55.75, 37.6 - step), (3, 55.75, 37.6 + 2 * step)], "id int, lat double, lon double")
    assert sorted(r["r_id"] for r in geo.within(left, right, 150.0).collect()) == [1, 2]


def test_sampled_line_walks(spark):
    line = [(55.7, 37.5), (55.7, 37.5), (55.702, 37.505), (55.71, 37.51)]
    points = spark.createDataFrame([(1, i, *p) for i, p in enumerate(line)], "line int, seq int, lat double, lon double")
    want, at, passed = [line[0]], 300.0, 0.0
    for a, b in zip(line, line[1:]):
        d = far(a, b)
        while d > 0 and at <= passed + d:
            s = (at - passed) / d
            want.append((a[0] + (b[0] - a[0]) * s, a[1] + (b[1] - a[1]) * s))
            at += 300.0
        passed += d
    want.append(line[-1])
    got = [(r["lat"], r["lon"]) for r in geo.sampled(points, ["line"], ["seq"], 300.0).orderBy("at").collect()]
    assert len(got) == len(want) and all(abs(g[0] - w[0]) < 1e-9 and abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))


def test_placed_stops(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.0, 3.0)], "line int, seq int, lat double, lon double")
    stops = spark.createDataFrame([(1, i, 4) for i in range(4)], "line int, place int, n int")
    assert [round(r["lon"], 6) for r in geo.placed(points, "line", ["seq"], stops).orderBy("place").collect()] == [0, 1, 2, 3]


def test_clusters_are_transitive(spark):
    stops = spark.createDataFrame([(1, "a", 55.0, 37.0), (2, "a", 55.01, 37.0), (3, "a", 55.02, 37.0), (4, "a", 56.0, 37.0), (5, "b", 55.0, 37.0)], "id int, name string, lat double, lon double")
    assert sorted((r["cluster"], r["name"], r["n"]) for r in geo.clusters(stops).collect()) == [(1, "a", 3), (4, "a", 1), (5, "b", 1)]


def test_clusters_of_long_chains(spark):
    # 150 stops a kilometre apart, with ids along the line, and a second line whose ids are mixed
    rows = [(i, "a", 55.0 + i * 0.009, 37.0) for i in range(150)] + [(1000 + i * 67 % 150, "b", 55.0 + i * 0.009, 37.0) for i in range(150)]
    got = geo.clusters(spark.createDataFrame(rows, "id int, name string, lat double, lon double")).collect()
    assert sorted((r["cluster"], r["name"], r["n"], round(r["lat"], 6)) for r in got) == [(0, "a", 150, 55.6705), (1000, "b", 150, 55.6705)]


def test_nearest_on_the_whole_sphere(spark):
    left = [(1, 55.0, 179.999), (2, 89.99, 10.0), (3, 80.0, 37.0), (4, -89.9, -170.0), (5, 0.0, 0.0), (6, -40.0, -60.0)]
    right = [("a", 55.0, -179.999), ("b", 55.0, 179.9), ("c", 89.99, -170.0), ("d", 80.0, 37.04), ("e", 79.9, 37.0), ("f", -89.9, 20.0)]
    want = {i: min(right, key=lambda r: far((lat, lon), r[1:]))[0] for i, lat, lon in left} | {7: None}
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name}, lat double, lon double")
    got = geo.nearest(frame([*left, (7, None, 37.0)], "id int"), "id", frame(right, "name string"), ["name"]).collect()
    assert {r["id"]: r["r_name"] for r in got} == want
    lone = geo.nearest(frame([(1, 0.0, 0.0)], "id int"), "id", frame([("z", 0.0, 179.0)], "name string"), ["name"]).collect()
    assert [r["r_name"] for r in lone] == ["z"]


def test_within_on_the_whole_sphere(spark):
    rng = __import__("random").Random(4)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), rng.uniform(-90, -88)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179.9, 180), rng.uniform(-180, -179.9)]))
    left, right = ([(i, *spot()) for i in range(150)] for _ in range(2))
    for metres in (1_500.0, 400_000.0, 9_000_000.0):
        want = {(a, b) for a, *p in left for b, *q in right if far(p, q) <= metres}
        frames = (spark.createDataFrame([*rows, (999, None, 1.0)], "id int, lat double, lon double") for rows in (left, right))
        got = [(r["id"], r["r_id"]) for r in geo.within(*frames, metres).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_as_of_is_brute_force(spark):
    """Facts on one date, gaps longer than the reach, a key that holds most rows."""
    rng = __import__("random").Random(8)
    day = lambda n: date.fromordinal(730_000 + n)
    rows = [(rng.choice([1, 1, 1, 2, 3]), day(rng.randrange(400)), i) for i in range(300)]
    facts = [(rng.choice([1, 1, 2]), day(rng.randrange(400)), rng.randrange(9)) for _ in range(60)]
    want = {}
    for route, at, i in rows:
        seen = [(d, q) for r, d, q in facts if r == route and d <= at and (at - d).days < 20]
        want[i] = max(seen)[1] if seen else 0
    got = history.as_of(spark.createDataFrame(rows, "route int, date date, i int"), spark.createDataFrame(facts, "route int, date date, q int"), ["route"], ["q"], 20)
    assert {r["i"]: r["q"] for r in got.collect()} == want


def test_n_linear_is_a_plain_loop(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    days = [(r, date.fromordinal(730_000 + i), float(100 + 20 * (i % 7) + rng.integers(0, 9) + r)) for r in (1, 2) for i in range(90 if r == 1 else 20)]
    origin = date.fromordinal(730_089)
    got = {}
    for r in forecast.n_linear(spark.createDataFrame(days, "route int, date date, total double"), str(origin), 5, 14).collect():
        got.setdefault(r["route"], {})[(r["date"] - origin).days] = r["predicted"]
    past = np.array([v for r, _, v in days if r == 1])
    xs = [past[e - 13 : e + 1] - past[e] for e in range(13, len(past) - 5)]
    ys = [past[e + 1 : e + 6] - past[e] for e in range(13, len(past) - 5)]
    want = np.maximum((past[-14:] - past[-1]) @ np.linalg.lstsq(np.array(xs), np.array(ys), rcond=1e-2)[0] + past[-1], 0)
    assert np.allclose([got[1][k] for k in range(1, 6)], want) and set(got[2].values()) == {[v for r, _, v in days if r == 2][-1]}


def test_roll_forward_feeds_itself(spark):
    known = [(1, date(2024, 1, d), 8, float(d)) for d in range(1, 15)]
    make = lambda t, h, c: forecast.seasonal_naive(t, h, c, 2, "mean")
    out = forecast.roll_forward(spark.createDataFrame(known, "route int, date date, hour int, value double"), spark.createDataFrame([(1,)], "route int"), date(2024, 1, 15), date(2024, 1, 30), make)
    got = {(r["date"].day, r["hour"]): r["predicted"] for r in out.collect()}
    assert len(got) == 16 * 24 and got[15, 8] == 4.5 and got[22, 8] == (8 + 4.5) / 2 and got[29, 8] == (4.5 + 6.25) / 2 and got[29, 9] == 0


def test_submission_must_be_whole(spark, tmp_path):
    template = grid.dense(spark.createDataFrame([(1,)], "route int"), "2024-01-01", "2024-01-01", range(3))
    some = spark.createDataFrame([(1, date(2024, 1, 1), 0, 2.5), (1, date(2024, 1, 1), 1, -3.0)], "route int, date date, hour int, predicted double")
    made = forecast.submission(template, some)
    assert sorted((r["hour"], r["prediction"], r["missing"]) for r in made.collect()) == [(0, 2, False), (1, 0, False), (2, 0, True)]
    with pytest.raises(ValueError, match="1 of them missing"):
        sinks.write_submission(made, str(tmp_path / "s"), 3)
    assert sinks.write_submission(made.filter("NOT missing"), str(tmp_path / "t"), 2) == 2
    with pytest.raises(ValueError, match="3 rows are expected"):
        sinks.write_submission(made.filter("NOT missing"), str(tmp_path / "u"), 3)


def test_stop_names(spark):
    from headway.functions import text as T

    cases = {"Парк - Вокзал": ["Парк", "Вокзал"], "Покровское - Стрешнево - Сокол": ["Покровское - Стрешнево", "Сокол"], "Метро - северный выход - Метро": ["Метро - северный выход", "Метро"], "А - А - А-Б": ["А", "А-Б"], "Свято - Данилов монастырь": ["Свято - Данилов монастырь"], " - ": [], None: []}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.stop_names(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_first_source_that_has_rows(spark):
    def fails():
        raise OSError("down")

    assert tables.first_of(fails, lambda: spark.range(0), lambda: spark.range(3)).count() == 3
    with pytest.raises(OSError, match="down"):
        tables.first_of(lambda: spark.range(0), fails)


def test_board_file(spark, tmp_path):
    rows = spark.createDataFrame([("08:00", 5), ('a"b', 7)], "period string, n int")
    sinks.board_csv(rows, str(tmp_path / "b"), {"period": "период", "n": "посадки"}, "period", sums=("n",), order=("period",))
    text = next((tmp_path / "b").glob("part-*")).read_bytes().decode()
    assert text == '\ufeffпериод;посадки\r\n"08:00";"5"\r\n"a""b";"7"\r\n"итого";"12"\r\n'


def test_gate(spark):
    rows = [(i, "dev", 0.8, 0.81, 0.8, 0.8) for i in range(4)] + [(9, "lock", 0.8, 0.805, 0.8, 0.8)]
    schema = "fold int, kind string, base double, candidate double, base_workday double, candidate_workday double"
    assert metrics.gate(spark.createDataFrame(rows, schema)).first()["accepted"]
    assert not metrics.gate(spark.createDataFrame(rows[:4] + [(9, "lock", 0.8, 0.79, 0.8, 0.8)], schema)).first()["accepted"]
    assert metrics.sign_test(4, 4) == 1 / 16


def test_origins():
    assert forecast.origins(date(2025, 8, 31), 2, 61) == [(date(2025, 5, 31), date(2025, 6, 1), date(2025, 7, 31)), (date(2025, 6, 30), date(2025, 7, 1), date(2025, 8, 30))]


def test_seasonal_naive_without_past(spark):
    targets = grid.dense(spark.createDataFrame([(1,)], "route int"), "2024-01-08", "2024-01-08", range(2))
    empty = spark.createDataFrame([], "route int, date date, hour int, value double")
    assert {r["predicted"] for how in ("ewm", "mean", "median") for r in forecast.seasonal_naive(targets, empty, "2024-01-07", 4, how).collect()} == {0.0}


def test_vectors_round_trip(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 3, 7), (1, "2024-01-01", 25, 9)], "route int, date string, hour int, boardings int")
    back = grid.long_rows(grid.vectors(rows)).filter("value > 0").collect()
    assert [(r["hour"], r["value"]) for r in back] == [(3, 7.0)]


def test_lag_as_of_without_facts(spark):
    rows = spark.createDataFrame([(1, "2024-03-01")], "route int, date string").withColumn("date", F.col("date").cast("date"))
    facts = spark.createDataFrame([(1, "2024-01-01", 5)], "route int, date string, n int").withColumn("date", F.col("date").cast("date"))
    assert history.as_of(rows, facts, ["route"], ["n"], 45).first()["n"] == 0
    assert history.as_of(rows, facts, ["route"], ["n"], 90).first()["n"] == 5


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿route,name\r\n1,\"a \"\"b\"\",\nc\"\r\n,\r\n2,\r\n".encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(path), line_feeds=True).collect()] == [("1", 'a "b",\nc'), ("2", None)]
    assert tables.sniffed_separator(spark, str(path)) == ","


def test_geojson(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"RouteNumber":"7"},"geometry":{"type":"MultiLineString","coordinates":[[[37.1,55.1],[37.2,55.2]],[[37.3,55.3]]]}}]}')
    got = tables.read_geojson(spark, str(tmp_path / "r.json")).orderBy("part", "seq").collect()
    assert [(r["part"], r["seq"], r["lon"], r["lat"]) for r in got] == [(0, 0, 37.1, 55.1), (0, 1, 37.2, 55.2), (1, 0, 37.3, 55.3)]
    (tmp_path / "l.json").write_text('[{"properties":{"n":"1"},"geometry":{"type":"Point","coordinates":[37.1, 55.1]}},{"properties":{"n":"2"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]')
    got = tables.read_geojson(spark, str(tmp_path / "l.json")).orderBy("feature", "seq").collect()
    assert [(r["properties"]["n"], r["part"], r["seq"], r["lon"], r["lat"]) for r in got] == [("1", 0, 0, 37.1, 55.1), ("2", 0, 0, 1.0, 2.0), ("2", 0, 1, 3.0, 4.0)]


def test_feed(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("stops.txt", "\ufeffstop_id,stop_name,stop_lat,stop_lon\r\n1,\"A, B\",55.5,37.5\r\n\r\n2,\"C\nD\",x,\r\n3\r\n")
        z.writestr("in/trips.txt", "trip_id,direction_id\n7,1\n8,\n")
    feed = tables.read_feed(spark, str(tmp_path / "f.zip"))
    assert [tuple(r) for r in feed["stops"].orderBy("stop_id").collect()] == [("1", "A, B", 55.5, 37.5), ("2", "C\nD", None, None), ("3", None, None, None)]
    assert sorted(tuple(r) for r in feed["trips"].collect()) == [("7", 1), ("8", 0)] and "routes" not in feed


def test_unwrapped_payloads(spark):
    df = spark.createDataFrame([('[{"a":1}]',), ('{"rows":[{"a":2}]}',), ('{"data":[{"a":3}]}',), ("{}",), ('{"features":[{"id":1,"attributes":{"a":4}},{"properties":{"a":5}}]}',)], "p string")
    assert [[x["a"] for x in r[0]] for r in df.select(tables.unwrapped(F.col("p"), "struct<a:int>")).collect()] == [[1], [2], [3], [], [4, 5]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "route int, name string")
    sinks.write_labels(df, str(tmp_path / "l"), ["route"])
    assert tables.read_csv(spark, str(tmp_path / "l"), ";").count() == 2
    sinks.write_partitioned(df, str(tmp_path / "p"), ["route"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("route = 1").first()["name"] == "a"


def test_leave_one_out(spark):
    rows = [(1, 10.0, 10.0, 0.0), (2, 10.0, 0.0, 10.0), (3, 10.0, 0.0, 10.0), (4, 0.0, 0.0, 0.0)]
    got = {r["origin"]: r for r in metrics.leave_one_out(spark.createDataFrame(rows, "origin int, actual double, a double, b double"), ["a", "b"], step=0.5).collect()}
    assert (got[1]["w_a"], got[1]["w_b"], got[1]["anchor"], got[1]["blend"]) == (0.0, 1.0, 1.0, 0.0)
    assert (got[2]["w_a"], got[2]["anchor"], got[2]["blend"]) == (0.0, 0.0, 1.0)  # a tie goes to the grid's first
    assert got[4]["anchor"] is None and got[4]["blend"] is None


def test_trees_by_horizon_and_of_errors(spark):
    rows = spark.range(200).select((F.col("id") % 2 * 10 + 1).cast("int").alias("horizon"), (F.col("id") % 5).cast("double").alias("x"))
    rows = rows.withColumns({"actual": F.when(F.col("horizon") == 1, 3.0).otherwise(7.0), "base": F.lit(5.0)})
    asked = spark.createDataFrame([(1, 1.0, 5.0), (11, 1.0, 5.0), (None, 1.0, 5.0), (1, 2.0, -9.0)], "horizon int, x double, base double")
    got = [(r["horizon"], round(r["predicted"], 3)) for r in forecast.bucketed(rows, asked, ["x"], "actual", [(1, 5), (10, 15)], trees=1, depth=2).collect()]
    assert got.count((1, 3.0)) == 2 and (11, 7.0) in got and len(got) == 4
    alone = forecast.bucketed(rows, asked, ["x"], "actual", [(1, 5), (10, 15)], least=101, trees=1, depth=2).collect()
    assert len({r["predicted"] for r in alone if r["x"] == 1.0}) == 1
    fixed = forecast.corrected(rows.filter("horizon = 11"), asked, ["x"], trees=1, depth=2).collect()
    assert sorted(round(r["predicted"], 3) for r in fixed) == [0.0, 7.0, 7.0, 7.0]
