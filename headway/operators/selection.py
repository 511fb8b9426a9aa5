"""The choice of a seasonal profile: searched on development windows, confirmed on windows that had no say."""

from __future__ import annotations

from dataclasses import astuple, dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions.sessions import cut
from headway.operators import history as H
from headway.operators import metrics as M


@dataclass(frozen=True)
class Profile:
    """The newest ``weeks`` values of a weekday and the newest ``holidays`` of holidays, weighted by ``decay`` to the power of their place; and the share of a day's
    hourly shape that comes from all days of its group over ``shape_weeks``, weighted by ``shape_decay`` a week."""

    weeks: int = 4
    decay: float = 0.75
    holidays: int = 6
    share: float = 0.0
    shape_weeks: int = 4
    shape_decay: float = 1.0


@dataclass(frozen=True)
class Span:
    """The days after ``origin`` up to ``last``, and what they serve for: dev, lock or check."""

    origin: str
    last: str
    role: str


#: Cells of a gathered key beside the seven weekdays: holidays, and the shapes of weekdays, Saturdays, Sundays.
HOLIDAY, SHAPES = 7, (8, 9, 10)


def profiles(weeks: tuple, decays: tuple, holidays: tuple, shares: tuple, shape_weeks: tuple, shape_decays: tuple) -> list[Profile]:
    """The grid in order, each profile once: without a share of the shape its other settings don't matter."""
    made = (Profile(w, d, h) if not s else Profile(w, d, h, s, sw, sd) for w, d, h, s, sw, sd in product(weeks, decays, holidays, shares, shape_weeks, shape_decays))
    return list(dict.fromkeys(made))


def _group(date: str) -> Column:
    """The place of the day's group in SHAPES."""
    return F.greatest(F.lit(0), F.weekday(date) - 4)


def seen(spark: SparkSession, spans: list[Span], holidays: DataFrame, weeks: int, newest: int, shape_weeks: int) -> DataFrame:
    """(date, span, kind, slot): which days each origin may see, and at which place from the newest; kind is ``week``, ``holiday``, ``shape`` or ``target``.

    It has spans x (7 weeks + newest + 7 shape_weeks + days ahead) rows, whatever the history's size.
    """
    rows = spark.createDataFrame([(i, s.origin, s.last) for i, s in enumerate(spans)], "span int, origin string, last string").select("span", F.col("origin").cast("date").alias("origin"), F.col("last").cast("date").alias("last"))
    free = holidays.select("date").distinct()

    def back(n: int, kind: str) -> DataFrame:
        days = rows.select("span", "origin", F.explode(F.sequence(F.lit(0), F.lit(7 * n - 1))).alias("i"))
        return days.select(F.date_sub("origin", F.col("i")).alias("date"), "span", F.lit(kind).alias("kind"), F.floor(F.col("i") / 7).cast("int").alias("slot"))

    every = F.array(*[F.struct(F.lit(i).alias("span"), F.lit(s.origin).cast("date").alias("origin")) for i, s in enumerate(spans)])
    known = free.select("date", F.explode(every).alias("s")).select("date", "s.*").filter("date <= origin")
    known = known.withColumn("slot", F.row_number().over(W.partitionBy("span").orderBy(F.desc("date"))) - 1).filter(F.col("slot") < newest)
    ahead = rows.select(F.explode(F.sequence(F.date_add("origin", 1), F.col("last"))).alias("date"), "span", F.lit("target").alias("kind"), F.lit(0).alias("slot"))
    shapes = back(shape_weeks, "shape").join(F.broadcast(free), "date", "left_anti")
    return back(weeks, "week").unionByName(known.select("date", "span", F.lit("holiday").alias("kind"), "slot")).unionByName(shapes).unionByName(ahead)


def gathered(history: DataFrame, days: DataFrame, slots: int) -> DataFrame:
    """(span, route, hour, cell, s0.., n0..): what each origin sees of each key, place by place: values of weekdays and holidays, sums of
    shares of the day for shapes. One pass over the history serves all origins: a row meets those that may see it, and places are summed before the shuffle."""
    total = F.greatest(F.sum("value").over(W.partitionBy("route", "date")), F.lit(1e-6))
    cell = F.when(F.col("kind") == "week", F.weekday("date")).when(F.col("kind") == "holiday", HOLIDAY).otherwise(SHAPES[0] + _group("date"))
    value = F.when(F.col("kind") == "shape", F.col("value") / F.col("_day")).otherwise(F.col("value"))
    rows = history.join(F.broadcast(days.select("date").distinct()), "date", "left_semi").withColumn("_day", total).join(F.broadcast(days), "date")
    sums = [x for i in range(slots) for x in (F.sum(F.when(F.col("slot") == i, value)).alias(f"s{i}"), F.count(F.when(F.col("slot") == i, 1)).alias(f"n{i}"))]
    return rows.groupBy("span", "route", "hour", cell.alias("cell")).agg(*sums)


def _decayed(n: int, decay: float) -> Column:
    """The decayed mean of the first n places that have a value; places without one are the oldest."""
    top = sum((F.coalesce(F.col(f"s{i}") * decay**i, F.lit(0.0)) for i in range(1, n)), F.coalesce(F.col("s0"), F.lit(0.0)))
    return F.try_divide(top, sum((F.when(F.col(f"n{i}") > 0, decay**i).otherwise(0.0) for i in range(1, n)), F.when(F.col("n0") > 0, 1.0).otherwise(0.0)))


def _shape(n: int, decay: float) -> Column:
    top = sum((F.coalesce(F.col(f"s{i}") * decay**i, F.lit(0.0)) for i in range(1, n)), F.coalesce(F.col("s0"), F.lit(0.0)))
    return F.coalesce(F.try_divide(top, sum((F.col(f"n{i}") * decay**i for i in range(1, n)), F.col("n0").cast("double"))), F.lit(0.0))


def scores(history: DataFrame, holidays: DataFrame, spans: list[Span], candidates: list[Profile]) -> DataFrame:
    """(span, candidate, score) of each profile on each span. ``history`` (route, date, hour, value) has a row for each hour, and ends with the last span at the earliest.

    A holiday takes the holidays' mean if there are two at least and any has volume, else its weekday's. Each cell of a span meets the candidates, a parameter of some
    dozens, within its own row.
    """
    spark = history.sparkSession
    weekly = list(dict.fromkeys((c.weeks, c.decay) for c in candidates))
    holiday = list(dict.fromkeys((c.holidays, c.decay) for c in candidates))
    shapes = list(dict.fromkeys((c.shape_weeks, c.shape_decay) for c in candidates if c.share))
    most = max(w for w, _ in weekly), max(h for h, _ in holiday), max([w for w, _ in shapes], default=1)
    days = cut(seen(spark, spans, holidays, *most))
    known = cut(gathered(history.withColumn("value", F.col("value").cast("double")), days.filter("kind <> 'target'"), max(most)))
    by_day = W.partitionBy("span", "route", "cell")
    week = known.filter(F.col("cell") < HOLIDAY).select("span", "route", "hour", F.col("cell").alias("dow"), "cell", *[F.coalesce(_decayed(*k), F.lit(0.0)).alias(f"w{i}") for i, k in enumerate(weekly)])
    week = week.select("span", "route", "hour", "dow", *[f"w{i}" for i in range(len(weekly))], *[F.sum(f"w{i}").over(by_day).alias(f"t{i}") for i in range(len(weekly))])
    free = known.filter(F.col("cell") == HOLIDAY).select("span", "route", "hour", *[F.when(F.col("n1") > 0, _decayed(*k)).alias(f"h{i}") for i, k in enumerate(holiday)]) if most[1] > 1 else None
    pool = known.filter(F.col("cell") > HOLIDAY).select("span", "route", "hour", (F.col("cell") - SHAPES[0]).alias("group"), "cell", *[_shape(*k).alias(f"_p{i}") for i, k in enumerate(shapes)])
    pool = pool.select("span", "route", "hour", "group", *[(F.col(f"_p{i}") / F.greatest(F.sum(f"_p{i}").over(by_day), F.lit(1e-9))).alias(f"p{i}") for i in range(len(shapes))])
    ahead = days.filter("kind = 'target'").select("date", "span")
    marked = ahead.join(F.broadcast(holidays.select("date").distinct().withColumn("_h", F.lit(True))), "date", "left")
    rows = history.join(F.broadcast(marked), "date").select("span", "route", "hour", F.weekday("date").alias("dow"), _group("date").alias("group"), F.coalesce("_h", F.lit(False)).alias("_h"), F.col("value").cast("double").alias("actual"))
    rows = rows.join(week, ["span", "route", "hour", "dow"], "left")
    if shapes:
        rows = rows.join(pool, ["span", "route", "hour", "group"], "left")
    if free is not None:
        volume = free.groupBy("span").agg(*[F.sum(f"h{i}").alias(f"v{i}") for i in range(len(holiday))])
        rows = rows.join(free, ["span", "route", "hour"], "left").join(F.broadcast(volume), "span", "left")  # a row a span

    def made(c: Profile) -> Column:
        i, j = weekly.index((c.weeks, c.decay)), holiday.index((c.holidays, c.decay))
        value = F.coalesce(f"w{i}", F.lit(0.0))
        if c.share:
            total, shape = F.coalesce(f"t{i}", F.lit(0.0)), F.coalesce(f"p{shapes.index((c.shape_weeks, c.shape_decay))}", F.lit(0.0))
            value = total * ((1 - c.share) * value / F.greatest(total, F.lit(1e-6)) + c.share * shape)
        if free is not None:
            value = F.when(F.col("_h") & (F.coalesce(f"v{j}", F.lit(0.0)) > 0), F.coalesce(f"h{j}", F.lit(0.0))).otherwise(value)
        return F.greatest(value, F.lit(0.0))

    tried = F.array(*[F.struct(F.lit(i).alias("candidate"), made(c).alias("predicted")) for i, c in enumerate(candidates)])
    return rows.select("span", "actual", F.explode(tried).alias("r")).groupBy("span", "r.candidate").agg(M.score(F.col("actual"), F.col("r.predicted")).alias("score"))


def search(history: DataFrame, holidays: DataFrame, spans: list[Span], candidates: list[Profile], champion: Profile = Profile(), alpha: float = 0.05) -> DataFrame:
    """A row per candidate: its settings, least_gain and mean_gain over the champion on the dev spans, and wins, p_value and lock_gain of all spans.

    Chosen is the candidate with the best least gain on dev spans, then the best mean gain, then the first; no other span has a say in it. It is
    accepted if it isn't the champion, the sign test over the spans of all roles is at most ``alpha``, and it isn't worse on any lock span.
    """
    at = candidates.index(champion)
    found = cut(scores(history, holidays, spans, candidates))  # spans x candidates rows
    base = found.filter(F.col("candidate") == at).select("span", F.col("score").alias("_c"))
    role = F.element_at(F.array(*[F.lit(s.role) for s in spans]), F.col("span") + 1)
    gain = F.round(F.col("score") - F.col("_c"), 9)
    rows = found.join(F.broadcast(base), "span").select("candidate", role.alias("role"), gain.alias("gain"))
    dev = F.when(F.col("role") == "dev", F.col("gain"))
    each = rows.groupBy("candidate").agg(F.min(dev).alias("least_gain"), F.round(F.avg(dev), 9).alias("mean_gain"), F.count_if(F.col("gain") > 1e-9).alias("wins"), F.min(F.when(F.col("role") == "lock", F.col("gain"))).alias("lock_gain"))
    best = each.agg(F.min_by("candidate", F.struct(-F.col("least_gain"), -F.col("mean_gain"), "candidate")).alias("_best"))
    chance = F.create_map(*[F.lit(x) for n in range(len(spans) + 1) for x in (n, M.sign_test(n, len(spans)))])
    settings = history.sparkSession.createDataFrame([(i, *astuple(c)) for i, c in enumerate(candidates)], "candidate int, weeks int, decay double, holidays int, share double, shape_weeks int, shape_decay double")
    out = settings.join(F.broadcast(each), "candidate").join(F.broadcast(best))
    out = out.withColumns({"windows": F.lit(len(spans)), "p_value": F.element_at(chance, F.col("wins").cast("int")), "chosen": F.col("candidate") == F.col("_best")})
    ok = F.col("chosen") & (F.col("candidate") != at) & (F.col("p_value") <= alpha) & (F.col("lock_gain") >= 0)
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_best", "candidate")
