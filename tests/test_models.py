"""Trees, folds, the choice of profiles and settings, and ranks, each against a plain loop over the same rows."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.operators import boosting, folds, ranking, sampling, selection


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (400, 3)).astype(float)
    y = np.round(3 * x[:, 0] + (x[:, 1] > 4) * 10 + rng.exponential(2, 400), 2)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, numbers):
    x, y = numbers
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(5).cache()


EDGES = [[float(i) for i in range(7)]] * 3
LOSSES = [boosting.squared(), boosting.absolute(), boosting.quantile(0.8), boosting.huber(3.0), boosting.fair(3.0), boosting.poisson(), boosting.tweedie(1.5)]


def percentile(values, level):
    """The least value that so many of all are at most."""
    ordered = sorted(values)
    return ordered[max(0, math.ceil(level * len(ordered)) - 1)]


def derivatives(name, y, raw):
    """First and second derivatives as the losses are defined."""
    gap = raw - y
    one = np.ones_like(y)
    return {
        "squared": lambda: (gap, one),
        "absolute": lambda: (np.sign(gap), one),
        "quantile": lambda: (np.where(gap < 0, -0.8, 1 - 0.8), one),
        "huber": lambda: (np.clip(gap, -3, 3), one),
        "fair": lambda: (3 * gap / (np.abs(gap) + 3), 9 / (np.abs(gap) + 3) ** 2),
        "poisson": lambda: (np.exp(raw) - y, np.exp(raw)),
        "tweedie": lambda: (-y * np.exp(-0.5 * raw) + np.exp(0.5 * raw), 0.5 * y * np.exp(-0.5 * raw) + 0.5 * np.exp(0.5 * raw)),
    }[name]()


def plain_boost(x, y, loss, trees, depth, rate, least=20, ridge=1.0):
    """The same trees by loops over rows; returns raw predictions and the first tree's splits."""
    start = {"squared": y.mean, "poisson": lambda: math.log(y.mean()), "tweedie": lambda: math.log(y.mean()), "quantile": lambda: percentile(y, 0.8)}.get(loss.name, lambda: percentile(y, 0.5))()
    raw, made = np.full(len(y), start), []
    for _ in range(trees):
        g, h = derivatives(loss.name, y, raw)
        node, splits, values = np.ones(len(y), int), {}, {}
        for level in range(depth):
            for n in [n for n in sorted(set(node)) if n >= 2**level]:
                here, best = node == n, None
                for feature in range(x.shape[1]):
                    for edge in range(7):
                        left = here & (x[:, feature] <= edge)
                        right = here & ~left
                        if left.sum() >= least and right.sum() >= least:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, right)) - g[here].sum() ** 2 / (h[here].sum() + ridge)
                            if best is None or float(f"{gain:.9g}") > best[0]:
                                best = (float(f"{gain:.9g}"), feature, edge)
                if best and best[0] > 1e-12:
                    splits[n] = best[1:]
                    node[here] = 2 * n + (x[here, best[1]] > best[2])
        for n in set(node):
            here = node == n
            values[n] = -g[here].sum() / (h[here].sum() + ridge)
            if loss.renewed is not None:
                values[n] = percentile((y - raw)[here], loss.renewed)
        raw = raw + rate * np.array([values[n] for n in node])
        made.append(splits)
    return raw, made


@pytest.mark.parametrize("loss", LOSSES, ids=lambda x: x.name)
def test_trees_equal_a_plain_loop(frame, numbers, loss):
    x, y = numbers
    model = boosting.fit(frame, ["a", "b", "c"], "y", loss, trees=3, depth=3, rate=0.3, edges=EDGES)
    want, splits = plain_boost(x, y, loss, 3, 3, 0.3)
    assert [t.splits for t in model.trees] == splits
    got = {tuple(r[:4]): r["raw"] for r in frame.withColumn("raw", boosting.raw(model)).collect()}
    assert all(abs(got[(*map(float, r), v)] - w) < 1e-6 for r, v, w in zip(x, y, want))
    before = boosting.Model(model.inputs, model.edges, loss, model.start, model.rate, [])
    assert boosting.mean_loss(model, frame, "y").first()[0] < boosting.mean_loss(before, frame, "y").first()[0]


def test_a_quantile_covers_its_level(frame):
    for level in (0.2, 0.8):
        model = boosting.fit(frame, ["a", "b", "c"], "y", boosting.quantile(level), trees=8, depth=2, rate=0.5, edges=EDGES)
        share = boosting.predict(model, frame).agg(F.avg((F.col("y") <= F.col("predicted")).cast("int"))).first()[0]
        assert abs(share - level) < 0.06


def test_importances_and_edges(spark, frame):
    model = boosting.fit(frame, ["a", "b", "c"], "y", trees=2, depth=2)
    shares = boosting.importances(model)
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > shares["b"] > shares["c"] >= 0
    assert model.edges[0] == [float(i) for i in range(7)]  # found by percentiles
    nulls = spark.createDataFrame([(None, float("nan"), 1.0)], "a double, b double, c double")
    low = spark.createDataFrame([(-1.0, 99.0, 1.0)], "a double, b double, c double")
    assert boosting.predict(model, nulls).first()["predicted"] == boosting.predict(model, low).first()["predicted"]
    assert boosting.predict(boosting.fit(frame.limit(0), ["a"], "y", boosting.absolute()), frame).first()["predicted"] == 0.0


def test_out_of_fold_equals_refitting(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        day = date(2024, 1, 1) + timedelta(days=i)
        for k in range(4):
            a, b = rng.normal(), rng.normal()
            rows.append((k % 2, day, float(a), float(b), float(5 + 2 * a - b + (day.weekday() >= 5) + rng.normal() / 10)))
    rows.append((0, date(2024, 1, 3), None, 1.0, 4.0))
    frame = folds.fold_of(spark.createDataFrame(rows, "route int, date date, a double, b double, y double")).repartition(3)
    got = folds.out_of_fold(frame, ["a", "b"], "y", forward=F.weekday("date") >= 5, by=["route"], least=6).collect()
    assert len(got) == len(rows)
    known = [(r[0], r[1], *r[2:], r[1].isocalendar()[:2], r[1].weekday() >= 5) for r in rows if r[2] is not None]
    for r in got:
        fold, off = r["date"].isocalendar()[:2], r["date"].weekday() >= 5
        train = [k for k in known if k[0] == r["route"] and k[6] == off and (k[5] < fold if off else k[5] != fold)]
        assert r["n_train"] == len(train)
        if len(train) < 6 or r["a"] is None:
            assert r["predicted"] is None
            continue
        x = np.array([(1, k[2], k[3]) for k in train])
        w = np.linalg.lstsq(x, np.array([k[4] for k in train]), rcond=None)[0]
        assert abs(r["predicted"] - max(0, w @ (1, r["a"], r["b"]))) < 1e-6
    assert folds.out_of_fold(frame.limit(0), ["a"], "y").count() == 0


def test_the_choice_of_a_profile(spark):
    """A history in which one week counts: the search must find it on dev spans; a lock span that speaks against it stops it."""
    first, rows = date(2024, 1, 1), []
    for i in range(200):
        day = first + timedelta(days=i)
        level = 10.0 * (1 + i // 7) if i < 150 else 300.0 - 10 * (i // 7)
        rows += [(0, day, h, level + h) for h in (7, 8)]
    known = spark.createDataFrame(rows, "route int, date date, hour int, value double")
    holidays = spark.createDataFrame([(date(2024, 2, 23),), (date(2024, 3, 8),)], "date date")
    dev = [selection.Span("2024-03-03", "2024-03-10", "dev"), selection.Span("2024-04-07", "2024-04-14", "dev")]
    grid = selection.profiles((1, 4), (0.75,), (6,), (0.0,), (4,), (1.0,))
    out = {r["weeks"]: r for r in selection.search(known, holidays, [*dev, selection.Span("2024-05-05", "2024-05-12", "lock")], grid, alpha=0.2).collect()}
    assert out[1]["chosen"] and out[1]["accepted"] and out[1]["wins"] == 3 and abs(out[1]["p_value"] - 1 / 8) < 1e-9
    assert out[4]["least_gain"] == 0.0 and not out[4]["chosen"]
    down = selection.search(known, holidays, [*dev, selection.Span("2024-06-02", "2024-06-04", "lock")], grid, alpha=1.0).collect()
    lock = {r["weeks"]: r["lock_gain"] for r in down}
    assert [r["accepted"] for r in down if r["weeks"] == 1] == [lock[1] >= 0]
    # the lock has no say in the choice itself
    assert [r["weeks"] for r in down if r["chosen"]] == [1]


def test_the_sampler(spark):
    space = [sampling.Real("x", 0.001, 1.0, log=True), sampling.Whole("n", 1, 20), sampling.Choice("kind", ("a", "b", "c"))]

    def surface(s):
        return (math.log10(s["x"]) + 2) ** 2 + (s["n"] - 12) ** 2 / 40 + {"a": 0.5, "b": 0.0, "c": 1.0}[s["kind"]]

    found = sampling.search(spark, space, surface, trials=40, batch=4, seed=1)
    again = sampling.search(spark, space, surface, trials=40, batch=4, seed=1)
    assert [t.setting for t in found] == [t.setting for t in again] and [t.number for t in found] == list(range(40))
    # the same as one trial after the other with settings drawn batch by batch
    rng, done = random.Random(1), []
    while len(done) < 40:
        pending = []
        for _ in range(4):
            pending.append(sampling.suggest(space, done, pending, rng))
        done += [sampling.Trial(len(done) + i, s, surface(s)) for i, s in enumerate(pending)]
    assert done == found
    learned, drawn = [], []
    for seed in range(8):
        rng = random.Random(seed)
        learned.append(min(t.value for t in sampling.search(spark, space, surface, trials=40, seed=seed)))
        drawn.append(min(surface({"x": 10 ** rng.uniform(-3, 0), "n": rng.randint(1, 20), "kind": rng.choice("abc")}) for _ in range(40)))
    assert sum(learned) < sum(drawn)
    assert sampling.search(spark, space, lambda s: float("nan"), trials=2)[0].value == float("inf")


def test_ranks_without_one_group(spark):
    rows = [(i, (i * 7) % 13 if i % 5 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = {r["id"]: r["r"] for r in ranking.ranked(frame, [F.col("v").desc_nulls_last()], "r").collect()}
    values = {i: -1 if v is None else v for i, v in rows}
    assert got == {i: 1 + sum(w > v for w in values.values()) for i, v in values.items()}
    order = [r["id"] for r in sorted(ranking.numbered(frame, [F.col("v").asc_nulls_last(), F.col("id")], "n").collect(), key=lambda r: r["n"])]
    assert order == [i for i, v in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    parts = ranking.numbered_by(frame.withColumn("k", F.when(F.col("id") < 150, "big").otherwise("small")), ["k"], [F.col("id").desc()], "n").collect()
    assert all(r["n"] == (149 - r["id"] if r["k"] == "big" else 199 - r["id"]) for r in parts) and len(parts) == 200
    assert ranking.ranked(frame.limit(0), [F.col("v")], "r").count() == 0
