"""Profiles, lags and pools that look back from a cutoff. History is (route, date, hour, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECAY = 0.75


def profile(history: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, median and sample deviation by keys."""
    v = F.col(value).cast("double")
    return history.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.count("*").alias("n"))


def daily(history: DataFrame, value: str = "value") -> DataFrame:
    """Sum and mean over the observed hours by route and date."""
    return history.groupBy("route", "date").agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("hours"))


def network_days(history: DataFrame, value: str = "value") -> DataFrame:
    """The sum over all routes by date."""
    return history.groupBy("date").agg(F.sum(value).alias("total"))


def decayed(values: Column, decay: float = DECAY) -> Column:
    """The mean of a newest-first array with weights ``decay`` to the power of the place; null if it is empty."""
    weights = F.transform(values, lambda _, i: F.pow(F.lit(decay), i))
    top = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, top / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def same_weekday(targets: DataFrame, history: DataFrame, cutoff: str, k: int, value: str = "value") -> DataFrame:
    """For each target (route, date, hour): the newest ``k`` values of its weekday up to the cutoff and a week before the
    target at the latest, as a newest-first array ``past``.

    Every target of one route, hour and weekday after the cutoff sees the same days, so the days are ranked once and joined by key.
    Targets must lie after the cutoff.
    """
    known = history.filter(F.col("date") <= F.lit(cutoff).cast("date")).withColumn("dow", F.weekday("date"))
    newest = F.row_number().over(W.partitionBy("route", "hour", "dow").orderBy(F.desc("date")))
    top = known.withColumn("_n", newest).filter(F.col("_n") <= k + 1)
    lists = top.groupBy("route", "hour", "dow").agg(F.reverse(F.array_sort(F.collect_list(F.struct("date", F.col(value).cast("double").alias("v"))))).alias("_days"))
    rows = targets.withColumn("dow", F.weekday("date")).join(lists, ["route", "hour", "dow"], "left")
    fit = F.filter("_days", lambda d: d["date"] <= F.date_sub(F.col("date"), 7))
    return rows.withColumn("past", F.coalesce(F.transform(F.slice(fit, 1, k), lambda d: d["v"]), F.array().cast("array<double>"))).drop("_days", "dow")


def pool(targets: DataFrame, history: DataFrame, days: DataFrame, cutoff: str, k: int, value: str = "value") -> DataFrame:
    """The newest ``k`` values of the given ``days`` (dates) up to the cutoff by route and hour, as ``past``."""
    known = history.join(days.select("date").distinct(), "date", "left_semi").filter(F.col("date") <= F.lit(cutoff).cast("date"))
    newest = F.row_number().over(W.partitionBy("route", "hour").orderBy(F.desc("date")))
    top = known.withColumn("_n", newest).filter(F.col("_n") <= k)
    lists = top.groupBy("route", "hour").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("past"))
    return targets.join(lists, ["route", "hour"], "left").withColumn("past", F.coalesce("past", F.array().cast("array<double>")))


def named_pool(targets: DataFrame, history: DataFrame, names: DataFrame, cutoff: str, k: int, value: str = "value") -> DataFrame:
    """The newest ``k`` values, up to the cutoff, of the days that bear the name of the target's day (date, name), by route and hour, as ``past``; empty for days
    without a name. Targets must lie after the cutoff."""
    known = history.join(names, "date").filter(F.col("date") <= F.lit(cutoff).cast("date"))
    newest = F.row_number().over(W.partitionBy("route", "hour", "name").orderBy(F.desc("date")))
    top = known.withColumn("_n", newest).filter(F.col("_n") <= k)
    lists = top.groupBy("route", "hour", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("past"))
    rows = targets.join(names, "date", "left").join(lists, ["route", "hour", "name"], "left")
    return rows.withColumn("past", F.coalesce("past", F.array().cast("array<double>")))


def with_profiles(rows: DataFrame, history: DataFrame, keys: dict[str, list[str]], columns: tuple[str, ...] = ("mean", "median")) -> DataFrame:
    """The history's profiles by several key lists beside each row, as ``name_mean`` and so on; 0 where the history has none."""
    for name, by in keys.items():
        found = profile(history, by).select(*by, *[F.col(c).alias(f"{name}_{c}") for c in columns])
        rows = rows.join(found, by, "left").withColumns({f"{name}_{c}": F.coalesce(f"{name}_{c}", F.lit(0.0)) for c in columns})
    return rows


def with_weather(rows: DataFrame, weather: DataFrame, columns: list[str]) -> DataFrame:
    """The weather of each row's date and hour; nulls where it is unknown. Of repeated readings of an hour the greatest by ``columns`` counts, whole."""
    once = weather.groupBy("date", "hour").agg(F.max(F.struct(*columns)).alias("_w")).select("date", "hour", "_w.*")
    return rows.join(once, ["date", "hour"], "left")


def frozen(rows: DataFrame, cutoff: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with a date, in which those after the cutoff have the columns of the cutoff's day; null if that is absent."""
    day = F.lit(cutoff).cast("date")
    last = rows.filter(F.col("date") == day).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(last, keys, "left").withColumns({c: F.when(F.col("date") > day, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def weekday_lags(days: DataFrame, origin: str, n: int = 8, value: str = "total") -> DataFrame:
    """For each route and weekday the newest ``n`` daily values up to the origin, newest first, as ``lags``, filled up with 0; over dense daily rows."""
    known = days.filter(F.col("date") <= F.lit(origin).cast("date")).withColumn("dow", F.weekday("date"))
    newest = F.row_number().over(W.partitionBy("route", "dow").orderBy(F.desc("date")))
    top = known.withColumn("_n", newest).filter(F.col("_n") <= n).groupBy("route", "dow").agg(F.map_from_entries(F.collect_list(F.struct("_n", F.col(value).cast("double").alias("v")))).alias("_m"))
    return top.select("route", "dow", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("lags"))


def route_scale(history: DataFrame, value: str = "value") -> DataFrame:
    """Mean level by route, at least 1."""
    return history.groupBy("route").agg(F.greatest(F.lit(1.0), F.avg(value)).alias("scale"))


def month_levels(history: DataFrame, value: str = "value") -> DataFrame:
    """Mean daily volume by route and month."""
    return history.groupBy("route", F.month("date").alias("month")).agg((F.sum(value) / F.count_distinct("date")).alias("level"))


def without_volume(routes: DataFrame, history: DataFrame, value: str = "value") -> DataFrame:
    """Routes that have no volume in the history."""
    total = history.groupBy("route").agg(F.sum(value).alias("_v"))
    return routes.select("route").join(total, "route", "left").filter("coalesce(_v, 0) <= 0").select("route")


def step_back(targets: DataFrame, history: DataFrame, cutoff: str, step: int, value: str = "value", name: str = "lag") -> DataFrame:
    """The value so many steps of ``step`` days before each target as first reach the cutoff, at least one; absent: 0."""
    ahead = F.datediff("date", F.lit(cutoff).cast("date"))
    steps = F.greatest(F.lit(1), F.ceil(ahead / step)).cast("int")
    past = history.select("route", "hour", F.col("date").alias("_d"), F.col(value).alias(name))
    rows = targets.withColumn("_d", F.date_sub("date", steps * step))
    return rows.join(past, ["route", "hour", "_d"], "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_d")


def lag_features(rows: DataFrame, value: str = "value", jump: float = 0.5) -> DataFrame:
    """Lags 1 to 4 over the same weekday and hour, their number, deviation, mean of up to eight, trend, ratio to that mean, and whether that
    ratio is a shock: off by more than ``jump``."""
    w = W.partitionBy("route", "hour", F.weekday("date")).orderBy("date")
    lags = {f"lag{i}": F.lag(value, i).over(w) for i in range(1, 5)}
    before = w.rowsBetween(-4, -1)
    out = rows.withColumns(lags | {"n_lags": F.count(value).over(before), "lag_std": F.stddev_pop(value).over(before), "deep_mean": F.avg(value).over(w.rowsBetween(-8, -1))})
    out = out.withColumns({"lag_trend": F.col("lag1") - F.col("lag2"), "lag_ratio": F.when(F.col("deep_mean") > 0, F.col("lag1") / F.col("deep_mean"))})
    return out.withColumn("shock", F.abs(F.col("lag_ratio") - 1) > jump)


def trailing(days: DataFrame, widths: tuple[int, ...] = (7, 14, 28, 56), value: str = "total", medians: bool = False) -> DataFrame:
    """Mean and population deviation, and if asked for the median, of the last days, today included, by route, over dense daily rows."""
    w = W.partitionBy("route").orderBy("date")
    out = {}
    for n in widths:
        last = w.rowsBetween(-(n - 1), 0)
        out |= {f"mean{n}": F.avg(value).over(last), f"std{n}": F.stddev_pop(value).over(last)}
        if medians:  # of an array of at most n values
            sorted_ = F.array_sort(F.collect_list(value).over(last))
            half = F.floor(F.size(sorted_) / 2).cast("int")
            out[f"median{n}"] = F.when(F.size(sorted_) % 2 == 1, F.get(sorted_, half)).otherwise((F.get(sorted_, half - 1) + F.get(sorted_, half)) / 2)
    return days.withColumns(out)


def window_ratios(days: DataFrame, widths: tuple[int, ...] = (7, 14, 28, 56), value: str = "total") -> DataFrame:
    """Over dense daily rows: the network's total of the day, the route's share in it, and for each width the ratio of the last so many days to those before,
    1 where these have no volume to speak of."""
    w = W.partitionBy("route").orderBy("date")
    network = F.sum(value).over(W.partitionBy("date"))
    out = {"network": network, "route_share": F.when(network > 0, F.col(value) / network).otherwise(0.0)}
    for n in widths:
        last, before = F.sum(value).over(w.rowsBetween(-(n - 1), 0)), F.sum(value).over(w.rowsBetween(-(2 * n - 1), -n))
        out[f"ratio{n}"] = F.when(before > 1, last / before).otherwise(1.0)
    return days.withColumns(out)


def climatology(cells: DataFrame, history: DataFrame, levels: list[list[str]], value: str = "value") -> DataFrame:
    """``value`` of each cell: the mean of the first of the key lists, the finest first, for which the history has any row."""
    out = cells
    for i, keys in enumerate(levels):
        mean = history.groupBy(*keys).agg(F.avg(value).alias(f"_m{i}")) if keys else history.agg(F.avg(value).alias(f"_m{i}"))
        out = out.join(mean, keys, "left") if keys else out.join(F.broadcast(mean))
    return out.withColumn("value", F.coalesce(*[F.col(f"_m{i}") for i in range(len(levels))])).drop(*[f"_m{i}" for i in range(len(levels))])


def trend(days: DataFrame, cutoff: str, width: int = 14, low: float = 0.88, high: float = 1.12, value: str = "total") -> DataFrame:
    """The ratio of the last ``width`` days up to the cutoff to those before, held between bounds; 1 without earlier volume."""
    ago = F.datediff(F.lit(cutoff).cast("date"), F.col("date"))
    sums = days.filter((ago >= 0) & (ago < 2 * width)).groupBy("route").agg(F.sum(F.when(ago < width, F.col(value)).otherwise(0)).alias("last"), F.sum(F.when(ago >= width, F.col(value)).otherwise(0)).alias("before"))
    ratio = F.when(F.col("before") <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide("last", "before"))))
    return sums.withColumn("trend", ratio)


def hour_shapes(history: DataFrame, cutoff: str, decay: float = DECAY, value: str = "value") -> DataFrame:
    """The share of each hour in a day by route and day group (weekdays, Saturday, Sunday), days weighted by age in weeks, summing to 1."""
    group = F.when(F.weekday("date") < 5, "weekday").when(F.weekday("date") == 5, "sat").otherwise("sun")
    known = history.filter(F.col("date") <= F.lit(cutoff).cast("date")).withColumn("day_group", group)
    total = F.greatest(F.sum(value).over(W.partitionBy("route", "date")), F.lit(1e-6))
    weeks = F.floor(F.datediff(F.lit(cutoff).cast("date"), F.col("date")) / 7)
    known = known.withColumns({"_s": F.col(value) / total, "_w": F.pow(F.lit(decay), weeks)})
    mean = known.groupBy("route", "day_group", "hour").agg((F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).alias("share"))
    whole = F.sum("share").over(W.partitionBy("route", "day_group"))
    return mean.withColumn("share", F.when(whole > 0, F.col("share") / whole).otherwise(1 / 24))


def day_share(rows: DataFrame, value: str = "value") -> DataFrame:
    """Each hour's share of its route's day; 1/24 where the day has no volume."""
    total = F.sum(value).over(W.partitionBy("route", "date"))
    return rows.withColumn("share", F.when(total > 0, F.col(value) / total).otherwise(1 / 24))


def peak_windows(history: DataFrame, value: str = "value") -> DataFrame:
    """First hours of the three busiest hours in a row on workdays, in the morning (from 0 to 9) and later (12 to 21), ties to the earlier."""
    hours = history.filter(F.weekday("date") < 5).groupBy("hour").agg(F.sum(value).alias("v"))
    moving = hours.withColumn("three", F.sum("v").over(W.partitionBy(F.lit(0)).orderBy("hour").rowsBetween(0, 2)))  # 24 rows
    best = lambda a, b: F.max_by(F.when(F.col("hour").between(a, b), F.col("hour")), F.when(F.col("hour").between(a, b), F.struct("three", (-F.col("hour")).alias("h"))))
    return moving.agg(best(0, 9).alias("morning"), best(12, 21).alias("evening"))


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], columns: list[str], days: int) -> DataFrame:
    """The newest fact at or before each row's date and less than ``days`` days old, by keys; zeros where there is none.

    Both sides go through one window by key and stretch of ``days`` days, so each is shuffled once, and a key that holds many of the rows is spread over its stretches.
    A fact is given to the one or two stretches in which it can still count. Of several facts on one date the last by columns counts.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    stretch = lambda day: F.floor(day / days).alias("_s")
    fact = F.struct("date", *columns)
    spread = facts.select(*keys, "date", fact.alias("_f"), F.lit(None).alias("_r"), F.explode(F.array_distinct(F.array(stretch(number("date")), stretch(number("date") + days - 1)))).alias("_s"))
    both = spread.unionByName(rows.select(*keys, "date", F.lit(None).alias("_f"), F.struct(*[rows[c] for c in rows.columns]).alias("_r"), stretch(number("date"))))
    order = W.partitionBy(*keys, "_s").orderBy(F.col("date"), F.col("_r").isNotNull(), "_f").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_f", F.last("_f", ignorenulls=True).over(order)).filter("_r IS NOT NULL")
    fresh = F.datediff("date", "_f.date") < days
    return seen.select("_r.*", *[F.coalesce(F.when(fresh, F.col(f"_f.{c}")), F.lit(0)).alias(c) for c in columns])


def counts_before(days: DataFrame, events: DataFrame, widths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each route and date of ``days``, the events of the route in the so many days before, that day left out."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    per_day = events.groupBy("route", "date").agg(F.count("*").alias("_n"))
    both = days.select("route", "date", F.lit(1).alias("_row"), F.lit(0).cast("long").alias("_n")).unionByName(per_day.withColumn("_row", F.lit(0)))
    w = W.partitionBy("route").orderBy(number(F.col("date")))
    return both.withColumns({f"n{x}": F.coalesce(F.sum("_n").over(w.rangeBetween(-x, -1)), F.lit(0)) for x in widths}).filter("_row = 1").drop("_row", "_n")


def stations_hit(days: DataFrame, events: DataFrame) -> DataFrame:
    """How many distinct stations of the route had an event before each day. Only a station's first event matters."""
    first = events.groupBy("route", "station").agg(F.min("date").alias("date"))
    return counts_before_all(days, first)


def counts_before_all(days: DataFrame, events: DataFrame) -> DataFrame:
    per_day = events.groupBy("route", "date").agg(F.count("*").alias("_n"))
    both = days.select("route", "date", F.lit(1).alias("_row"), F.lit(0).cast("long").alias("_n")).unionByName(per_day.withColumn("_row", F.lit(0)))
    w = W.partitionBy("route").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(W.unboundedPreceding, -1)
    return both.withColumn("n_hit", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter("_row = 1").drop("_row", "_n")
