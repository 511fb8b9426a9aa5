"""Seasonal forecasts, their blends, and forecasts by trees."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions.sessions import cut
from headway.operators import boosting
from headway.operators import history as H
from headway.operators import metrics as M
from headway.operators.grid import dense


def _base(past: Column, how: str) -> Column:
    """The median, mean or decayed mean (ewm) of a newest-first array; null if it is empty."""
    ordered, half = F.array_sort(past), F.floor(F.size(past) / 2).cast("int")
    return {
        "ewm": lambda: H.decayed(past),
        "mean": lambda: F.try_divide(F.aggregate(past, F.lit(0.0), lambda a, x: a + x), F.size(past)),
        "median": lambda: F.when(F.size(past) % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2),
    }[how]()


def _with_trend(targets: DataFrame, history: DataFrame, cutoff: str, fade: tuple[int, int]) -> DataFrame:
    """``_trend`` of the route less 1, and how much of it is left at the target's horizon (``_keep``)."""
    ahead = F.datediff("date", F.lit(cutoff).cast("date"))
    keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (fade[1] - ahead) / (fade[1] - fade[0])))
    ratio = H.trend(H.daily(history), cutoff).select("route", F.col("trend").alias("_t"))
    return targets.join(ratio, "route", "left").withColumns({"_trend": F.coalesce("_t", F.lit(1.0)) - 1, "_keep": keep}).drop("_t")


def seasonal_naive(targets: DataFrame, history: DataFrame, cutoff: str, k: int = 4, how: str = "ewm", trend: str = "none", fade: tuple[int, int] = (21, 45)) -> DataFrame:
    """``predicted`` from the newest ``k`` values of each target's weekday: their median, mean or decayed mean (ewm), times the
    route's trend, flat or fading to 1 between two horizons in days. Targets without a past get 0."""
    rows = H.same_weekday(targets, history, cutoff, k).withColumn("predicted", F.coalesce(_base(F.col("past"), how), F.lit(0.0))).drop("past")
    if trend == "none":
        return rows
    rows = _with_trend(rows, history, cutoff, fade)
    return rows.withColumn("predicted", F.col("predicted") * (1 + F.col("_trend") * (F.lit(1.0) if trend == "flat" else F.col("_keep")))).drop("_trend", "_keep")


def champion(targets: DataFrame, history: DataFrame, holidays: DataFrame, cutoff: str, weeks: int = 4, pooled: int = 6) -> DataFrame:
    """The decayed mean of the last weeks; on holidays that of the last holidays, if there are two at least."""
    plain = seasonal_naive(targets, history, cutoff, weeks)
    marked = plain.join(holidays.select("date").distinct().withColumn("_h", F.lit(1)), "date", "left")
    return H.pool(marked, history, holidays, cutoff, pooled).withColumn("predicted", F.when((F.col("_h") == 1) & (F.size("past") >= 2), H.decayed(F.col("past"))).otherwise(F.col("predicted"))).drop("_h", "past")


def rule_grid(targets: DataFrame, history: DataFrame, cutoff: str, ks=(1, 2, 4, 8), hows=("median", "mean", "ewm"), trends=("none", "flat", "decay"), fade: tuple[int, int] = (21, 45)) -> DataFrame:
    """The score of each rule on targets that have an ``actual``, best first. One plan serves all: each target's newest values are gathered once, and it
    meets the rules, a few dozen, within its own row; the sums are combined before the shuffle."""
    rows = _with_trend(H.same_weekday(targets, history, cutoff, max(ks)), history, cutoff, fade)
    rules = [(k, h, t) for k in ks for h in hows for t in trends]
    kept = {"none": F.lit(0.0), "flat": F.lit(1.0), "decay": F.col("_keep")}
    bases = {(k, h): F.coalesce(_base(F.slice("past", 1, k), h), F.lit(0.0)).alias(f"_{k}_{h}") for k in ks for h in hows}
    rows = rows.select("actual", "_trend", "_keep", *bases.values())
    tried = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(k).alias("k"), F.lit(h).alias("how"), F.lit(t).alias("trend"), (F.col(f"_{k}_{h}") * (1 + F.col("_trend") * kept[t])).alias("predicted")) for i, (k, h, t) in enumerate(rules)])
    each = rows.select("actual", F.explode(tried).alias("r")).select("actual", "r.*")
    scored = each.groupBy("rule", "k", "how", "trend").agg(M.score(F.col("actual"), F.col("predicted")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 12)), "rule")


def pooled(targets: DataFrame, history: DataFrame, holidays: DataFrame, cutoff: str, weeks: int = 4, shape_weeks: int = 8, shape_decay: float = H.DECAY, share: float = 0.5, holiday_days: int = 6) -> DataFrame:
    """The champion with its hourly shape mixed: ``share`` of the shape of the day's group (weekdays, Saturday, Sunday) over the last weeks without holidays, the rest its own.
    Holidays keep the champion's forecast where it has any volume."""
    made = champion(targets, history, holidays, cutoff, weeks, holiday_days).join(holidays.select("date").distinct().withColumn("_h", F.lit(1)), "date", "left")
    recent = history.filter(F.col("date") > F.date_sub(F.lit(cutoff).cast("date"), 7 * shape_weeks)).join(holidays.select("date").distinct(), "date", "left_anti")
    group = F.when(F.weekday("date") < 5, "weekday").when(F.weekday("date") == 5, "sat").otherwise("sun")
    shapes = H.hour_shapes(recent, cutoff, shape_decay).select("route", "day_group", "hour", F.col("share").alias("_pool"))
    rows = made.withColumn("day_group", group).join(shapes, ["route", "day_group", "hour"], "left")
    day = F.sum("predicted").over(W.partitionBy("route", "date"))
    own = F.when(day > 0, F.col("predicted") / day).otherwise(0.0)
    mixed = day * ((1 - share) * own + share * F.coalesce("_pool", F.lit(0.0)))
    return rows.withColumn("predicted", F.when((F.col("_h") == 1) & (day > 0), F.col("predicted")).otherwise(mixed)).drop("_h", "_pool", "day_group")


def holiday_or_weekly(targets: DataFrame, history: DataFrame, names: DataFrame, cutoff: str, holiday_days: int = 6, weeks: int = 8, how: str = "ewm") -> DataFrame:
    """The decayed mean (or mean) of the last days of the same holiday, if there are two at least, else of the last weeks. ``names`` has date and name."""
    named = H.named_pool(targets, history, names, cutoff, holiday_days).withColumnRenamed("past", "_same")
    rows = H.same_weekday(named, history, cutoff, weeks)
    value = F.when(F.size("_same") >= 2, _base(F.col("_same"), how)).otherwise(_base(F.col("past"), how))
    return rows.withColumn("predicted", F.coalesce(value, F.lit(0.0))).drop("_same", "past", "name")


def roll_forward(history: DataFrame, routes: DataFrame, first: date, last: date, make, step: int = 7) -> DataFrame:
    """``predicted`` from ``first`` to ``last``, ``step`` days at a time: ``make(targets, history, cutoff)`` forecasts each stretch from the history and the
    forecasts before it. Each stretch is written to the shared folder, so the plan of a later one doesn't grow."""
    known, out, day = history.select("route", "date", "hour", F.col("value").cast("double").alias("value")), None, first
    while day <= last:
        end = min(last, day + timedelta(days=step - 1))
        made = cut(make(dense(routes, str(day), str(end)), known, str(day - timedelta(days=1))).select("route", "date", "hour", "predicted"))
        out = made if out is None else out.unionByName(made)
        known = known.unionByName(made.withColumnRenamed("predicted", "value"))
        day = end + timedelta(days=1)
    return out


def over_range(grid: DataFrame, baseline: DataFrame, new: DataFrame, without: tuple[int, ...] = ()) -> DataFrame:
    """A whole number for each cell of the grid: the new forecast, else the baseline, else 0; at least 0, halves to even. Routes of ``without`` go."""
    rows = grid.filter(~F.col("route").isin(*without)) if without else grid
    for name, table in (("_new", new), ("_old", baseline)):
        rows = rows.join(table.select("route", "date", "hour", F.col("predicted").alias(name)), ["route", "date", "hour"], "left")
    value = F.greatest(F.lit(0.0), F.coalesce("_new", "_old", F.lit(0.0)))
    return rows.withColumn("prediction", F.bround(value, 0).cast("long")).drop("_new", "_old")


def submission(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """The template's cells with a whole ``prediction``, at least 0, halves to even, and whether it is ``missing`` (then 0)."""
    rows = template.select("route", "date", "hour").join(predictions.select("route", "date", "hour", F.col("predicted").alias("_p")), ["route", "date", "hour"], "left")
    return rows.select("route", "date", "hour", F.bround(F.greatest(F.lit(0.0), F.coalesce("_p", F.lit(0.0))), 0).cast("long").alias("prediction"), F.col("_p").isNull().alias("missing"))


def n_linear(days: DataFrame, origin: str, horizon: int, lookback: int = 28, value: str = "total") -> DataFrame:
    """``predicted`` daily totals of the days after the origin, by route: a linear map from the last ``lookback`` days to the next, both less the last value, by least
    squares over all windows up to the origin that show a whole horizon. Routes with fewer windows than ``lookback`` repeat their last value.

    A route's days, a few thousand numbers, meet in one task.
    """
    import numpy as np
    import pandas as pd

    def fit(route: pd.DataFrame) -> pd.DataFrame:
        past = route.sort_values("date")[value].to_numpy(float)
        wide = np.lib.stride_tricks.sliding_window_view(past, lookback + horizon) if len(past) >= lookback + horizon else np.zeros((0, lookback + horizon))
        last = past[-lookback:]
        made = np.full(horizon, past[-1])
        if len(wide) >= lookback:
            centred = wide - wide[:, lookback - 1 : lookback]
            made = np.maximum((last - last[-1]) @ np.linalg.lstsq(centred[:, :lookback], centred[:, lookback:], rcond=1e-2)[0] + last[-1], 0)
        return pd.DataFrame({"route": route["route"].iloc[0], "ahead": range(1, horizon + 1), "predicted": made})

    known = days.filter(F.col("date") <= F.lit(origin).cast("date")).select("route", "date", F.col(value).cast("double"))
    made = known.groupBy("route").applyInPandas(fit, "route int, ahead int, predicted double")
    return made.select("route", F.expr(f"date_add(DATE '{origin}', ahead)").alias("date"), "predicted")


def importances(model, spark) -> DataFrame:
    """How much each input of fitted trees counts, the greatest first."""
    found = boosting.importances(model[0])
    return spark.createDataFrame(list(found.items()), "feature string, importance double").orderBy(F.desc(F.round("importance", 12)), "feature")


def search(train: DataFrame, valid: DataFrame, inputs: list[str], target: str, grid: list[dict]) -> DataFrame:
    """The weighted error on ``valid`` of trees fitted with each of a few settings, the least first."""
    out = None
    for i, options in enumerate(grid):
        rows = score_with(boosted(train, inputs, target, **options), valid)
        named = sorted((k, v.name if isinstance(v, boosting.Loss) else v) for k, v in options.items())
        one = rows.agg(M.wape(F.col(target), F.col("predicted")).alias("wape")).select(F.lit(i).alias("setting"), F.lit(str(named)).alias("options"), "wape")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.round("wape", 12), "setting")


def copy_week(targets: DataFrame, history: DataFrame, value: str = "value") -> DataFrame:
    """The value of seven days before; absent: 0."""
    past = history.select("route", F.date_add("date", 7).alias("date"), "hour", F.col(value).cast("double").alias("predicted"))
    return targets.join(past, ["route", "date", "hour"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0.0)))


def spread_daily(totals: DataFrame, shapes: DataFrame, total: str = "total") -> DataFrame:
    """Daily totals dealt to hours by shares, which are clipped at 0 and scaled to 1; a day without shares is even."""
    rows = totals.join(shapes.select("route", "date", "hour", F.greatest(F.col("share"), F.lit(0.0)).alias("share")), ["route", "date"])
    whole = F.sum("share").over(W.partitionBy("route", "date"))
    return rows.withColumn("predicted", F.col(total) * F.when(whole > 0, F.col("share") / whole).otherwise(1 / 24))


def selective(base: DataFrame, daily: DataFrame, tree: DataFrame, weights: dict[int, float], daily_weight: float = 0.2) -> DataFrame:
    """The base forecast mixed with a daily model spread over its own hours, then by route with a second hourly model.

    The weights by route are a parameter of a few entries; routes without one keep the first mix.
    """
    shared = H.day_share(base, "predicted")
    mixed = shared.join(daily.select("route", "date", "daily"), ["route", "date"], "left")
    first = F.when(F.col("daily").isNull(), F.col("predicted")).otherwise((1 - daily_weight) * F.col("predicted") + daily_weight * F.col("daily") * F.col("share"))
    both = mixed.withColumn("_first", first).join(tree.select("route", "date", "hour", F.col("predicted").alias("_tree")), ["route", "date", "hour"], "left")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<int,double>")
    w = F.when(F.col("_tree").isNotNull(), F.coalesce(F.try_element_at(table, F.col("route")), F.lit(0.0))).otherwise(0.0)
    return both.select("route", "date", "hour", F.greatest(F.lit(0.0), F.when(w > 0, (1 - w) * F.col("_first") + w * F.col("_tree")).otherwise(F.col("_first"))).alias("predicted"))


def origins(last_known: date, n: int, horizon: int) -> list[tuple[date, date, date]]:
    """The cutoffs at the last ``n`` month ends whose horizon is known, oldest first, each with its first and last target day."""
    out, day = [], last_known
    while len(out) < n and day.year > 1:
        day = day.replace(day=1) - timedelta(days=1)
        if day + timedelta(days=horizon) <= last_known:
            out.append((day, day + timedelta(days=1), day + timedelta(days=horizon)))
    return out[::-1]


def boosted(features: DataFrame, inputs: list[str], target: str, trees: int = 30, depth: int = 5, floor: float = 0.0, loss: boosting.Loss | None = None, rate: float = 0.1, **options):
    """Boosted trees by absolute loss, or another, on the rows whose target isn't null; ``score_with`` applies them and holds results to ``floor`` at least."""
    return boosting.fit(features, inputs, target, loss or boosting.absolute(), trees=trees, depth=depth, rate=rate, **options), floor


def score_with(model, rows: DataFrame) -> DataFrame:
    fitted, floor = model
    return boosting.predict(fitted, rows).withColumn("predicted", F.greatest(F.lit(floor), F.col("predicted")))


def bucketed(train: DataFrame, rows: DataFrame, inputs: list[str], target: str, ranges: list[tuple[int, int]], least: int = 80, **options) -> DataFrame:
    """``predicted`` by a model of the row's horizon range; ranges with fewer than ``least`` training rows, and rows outside of all, take
    the model of all rows. Ranges must not overlap."""
    whole = boosted(train, inputs, target, **options)
    inside = [F.coalesce(F.col("horizon").between(low, high), F.lit(False)) for low, high in ranges]
    counts = train.filter(F.col(target).isNotNull()).agg(*[F.count_if(x) for x in inside]).first() if ranges else []
    rest, out = F.lit(True), None
    for x, n in zip(inside, counts):
        if n >= least:
            part = score_with(boosted(train.filter(x), inputs, target, **options), rows.filter(x))
            rest, out = rest & ~x, part if out is None else out.unionByName(part)
    other = score_with(whole, rows.filter(rest))
    return other if out is None else out.unionByName(other)


def corrected(train: DataFrame, rows: DataFrame, inputs: list[str], base: str = "base", actual: str = "actual", **options) -> DataFrame:
    """``predicted``: a frozen forecast plus what trees, fitted to its errors, add; at least 0."""
    model = boosted(train.withColumn("_left", F.col(actual) - F.col(base)), inputs, "_left", floor=float("-inf"), **options)
    return score_with(model, rows).withColumn("predicted", F.greatest(F.lit(0.0), F.col(base) + F.col("predicted")))


def scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of columns, deviations under 1e-6 as 1."""
    return rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) < 1e-6, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_std"))])
