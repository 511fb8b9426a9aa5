"""Sampled search of settings: a tree-structured Parzen estimator whose trials are concurrent Spark jobs."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Share of the trials that count as good, values drawn for each setting, and random trials before the first that learns.
GOOD, DRAWN, RANDOM = 0.25, 24, 4


@dataclass(frozen=True)
class Real:
    """A number between two bounds, on a scale of logarithms if ``log``."""

    name: str
    low: float
    high: float
    log: bool = False

    def ends(self) -> tuple[float, float]:
        return (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def outer(self, x: float) -> float:
        return min(self.high, max(self.low, math.exp(x) if self.log else x))


@dataclass(frozen=True)
class Whole:
    """A whole number between two bounds, both included."""

    name: str
    low: int
    high: int

    def ends(self) -> tuple[float, float]:
        return self.low - 0.5, self.high + 0.5

    def inner(self, value: int) -> float:
        return float(value)

    def outer(self, x: float) -> int:
        return min(self.high, max(self.low, round(x)))


@dataclass(frozen=True)
class Choice:
    """One of some options."""

    name: str
    options: tuple


@dataclass(frozen=True)
class Trial:
    number: int
    setting: dict
    value: float


class Bells:
    """A mixture of a flat part and a bell at each point, as wide as the way to its farther neighbour, cut off at the bounds."""

    def __init__(self, points: list[float], low: float, high: float):
        self.low, self.high, self.points = low, high, sorted(points)
        edges, least = [low, *self.points, high], (high - low) / min(100.0, 1.0 + len(points))
        self.widths = [min(high - low, max(least, edges[i + 1] - edges[i], edges[i + 2] - edges[i + 1])) for i in range(len(self.points))]

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.points) + 1)
        if i == len(self.points):
            return rng.uniform(self.low, self.high)
        while not self.low <= (x := rng.gauss(self.points[i], self.widths[i])) <= self.high:
            pass
        return x

    def density(self, x: float) -> float:
        total = 1.0 / (self.high - self.low)
        for at, width in zip(self.points, self.widths):
            below = lambda v: 0.5 * (1 + math.erf((v - at) / (width * math.sqrt(2))))  # noqa: E731, B023
            inside = below(self.high) - below(self.low)
            total += math.exp(-0.5 * ((x - at) / width) ** 2) / (width * math.sqrt(2 * math.pi) * max(inside, 1e-12))
        return total / (len(self.points) + 1)


def suggest(space: list, done: list[Trial], pending: list[dict], rng: random.Random) -> dict:
    """A setting to try: of values drawn around those of the good trials, for each part the one that is most likely there against the rest.

    Settings that still run count among the rest, so a batch spreads out. The first RANDOM trials are drawn evenly.
    """
    ranked = sorted(done, key=lambda t: (t.value, t.number))
    n = max(1, math.ceil(GOOD * len(ranked)))
    good, rest = [t.setting for t in ranked[:n]], [t.setting for t in ranked[n:]] + pending
    out = {}
    for part in space:
        if isinstance(part, Choice):
            weight = lambda some, o: (1 + sum(s[part.name] == o for s in some)) / (len(part.options) + len(some))  # noqa: E731, B023
            if len(done) < RANDOM:
                out[part.name] = rng.choice(part.options)
            else:
                drawn = rng.choices(part.options, [weight(good, o) for o in part.options], k=DRAWN)
                out[part.name] = max(drawn, key=lambda o: (weight(good, o) / weight(rest, o), -part.options.index(o)))
        elif len(done) < RANDOM:
            out[part.name] = part.outer(rng.uniform(*part.ends()))
        else:
            near, far = (Bells([part.inner(s[part.name]) for s in some], *part.ends()) for some in (good, rest))
            drawn = [part.outer(near.draw(rng)) for _ in range(DRAWN)]
            out[part.name] = max(drawn, key=lambda v: near.density(part.inner(v)) / far.density(part.inner(v)))
    return out


def search(spark: SparkSession, space: list, error: Callable[[dict], float], trials: int, batch: int = 4, seed: int = 0) -> list[Trial]:
    """The trials in order, ``error`` of each by its setting; the least is best, NaN or null is the worst.

    Settings of a batch are drawn before any of them runs, so the same seed makes the same trials however long each takes. A batch's trials run as
    concurrent jobs, each in a scheduler pool of its own; under ``spark.scheduler.mode=FAIR`` they share the cluster evenly, else they queue.
    """
    rng, done = random.Random(seed), []
    sc = spark.sparkContext

    def run(number: int, setting: dict) -> Trial:
        sc.setLocalProperty("spark.scheduler.pool", f"trial-{number}")
        try:
            value = error(setting)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)
        return Trial(number, setting, float("inf") if value is None or math.isnan(value) else float(value))

    with ThreadPoolExecutor(max_workers=batch) as pool:
        while len(done) < trials:
            pending = []
            for _ in range(min(batch, trials - len(done))):
                pending.append(suggest(space, done, pending, rng))
            jobs = [pool.submit(inheritable_thread_target(spark)(run), len(done) + i, s) for i, s in enumerate(pending)]
            done += [j.result() for j in jobs]
    return done
