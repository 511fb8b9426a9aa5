"""Answers for boards: facts before forecasts, what is usual, scenarios, roll-ups and watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.operators.grid import KEYS


def cells(grid: DataFrame, facts: DataFrame, forecast: DataFrame) -> DataFrame:
    """value and status of each cell: the fact, else the forecast, else missing."""
    rows = grid.select(*KEYS).join(facts.select(*KEYS, F.col("value").alias("_f")), KEYS, "left").join(forecast.select(*KEYS, F.col("value").alias("_p")), KEYS, "left")
    status = F.when(F.col("_f").isNotNull(), "fact").when(F.col("_p").isNotNull(), "forecast").otherwise("missing")
    return rows.select(*KEYS, F.coalesce("_f", "_p").cast("double").alias("value"), status.alias("status"))


def typical(rows: DataFrame, facts: DataFrame, least: int = 3) -> DataFrame:
    """``usual``: the median of the facts of the same route, weekday and hour on other dates; null under ``least`` of them.

    A weekday's dates are at most a few hundred a route and hour, so the list of each bucket is short.
    """
    lists = facts.groupBy("route", F.weekday("date").alias("_dow"), "hour").agg(F.collect_list(F.struct("date", F.col("value").cast("double").alias("v"))).alias("_all"))
    joined = rows.withColumn("_dow", F.weekday("date")).join(lists, ["route", "_dow", "hour"], "left")
    others = F.array_sort(F.transform(F.filter("_all", lambda x: x["date"] != F.col("date")), lambda x: x["v"]))
    out = joined.withColumn("_o", others)
    half = F.floor(F.size("_o") / 2).cast("int")
    median = F.when(F.size("_o") % 2 == 1, F.get("_o", half)).otherwise((F.get("_o", half - 1) + F.get("_o", half)) / 2)
    return out.withColumn("usual", F.when(F.size("_o") >= least, median)).drop("_dow", "_all", "_o")


def day_rows(cells: DataFrame, day: str) -> DataFrame:
    """The cells of one day by route and hour: value, status and what is usual."""
    return cells.filter(F.col("date") == F.lit(day).cast("date")).select("route", "hour", "value", "status", "usual")


def roll_up(rows: DataFrame, keys: list[str], period: Column) -> DataFrame:
    """Sums by period with how many cells are covered, and a status that tells facts, forecasts and gaps apart."""
    facts, ahead, n = F.count_if(F.col("status") == "fact"), F.count_if(F.col("status") == "forecast"), F.count("*")
    status = (
        F.when(facts == n, "fact")
        .when(facts + ahead == 0, "missing")
        .when(ahead == n, "forecast")
        .when(facts + ahead == n, "estimate")
        .when(ahead == 0, "partial-fact")
        .otherwise("partial-forecast")
    )
    return rows.groupBy(*keys, period.alias("period")).agg(F.sum("value").alias("value"), F.sum("usual").alias("usual"), (facts + ahead).alias("covered"), n.alias("expected"), status.alias("status"))


def resolve(rows: DataFrame, weather: DataFrame) -> DataFrame:
    """coefficient and origin for rows with route, weather, event_on, event_text, season_on, season_text.

    A valid hand-typed event comes before a valid season, then an invalid hand-typed one (1), then the weather's
    estimate if it is to apply, weather without one (1), and 1. ``weather`` (weather, route, coefficient, apply) has a row a route and kind.
    """
    event, season = S.coefficient(F.col("event_text")), S.coefficient(F.col("season_text"))
    known = weather.select("weather", "route", F.col("coefficient").alias("_c"), F.col("apply").alias("_a"))
    j = rows.join(known, ["weather", "route"], "left")
    typed = F.col("event_on") | F.col("season_on")
    is_weather = F.col("weather").isNotNull() & (F.col("weather") != "base")
    origin = F.when(F.col("event_on") & event.isNotNull(), "event").when(F.col("season_on") & season.isNotNull(), "season").when(typed, "invalid").when(is_weather & F.coalesce("_a", F.lit(False)), "weather").when(is_weather, "unestimated").otherwise("base")
    j = j.withColumn("origin", origin)
    value = F.when(F.col("origin") == "event", event).when(F.col("origin") == "season", season).when(F.col("origin") == "weather", F.col("_c")).otherwise(1.0)
    return j.withColumn("coefficient", value.cast("double")).drop("_c", "_a")


def present(rows: DataFrame, keys: list[str], coefficient: Column) -> DataFrame:
    """Totals of a board: the sum of the rounded rows, before and after the coefficient."""
    base, then = S.half_up(F.col("value")), S.half_up(F.col("value") * coefficient)
    return rows.groupBy(*keys).agg(F.sum(base).alias("base"), F.sum(then).alias("scenario"), F.sum(S.half_up(F.col("usual"))).alias("usual"))


def with_added_trips(value: Column, trips: Column, added: Column) -> Column:
    """The load after ``added`` trips on top of ``trips``, rounded again."""
    return S.half_up(value * trips / (trips + added))


def peak(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hour with the greatest value, the earliest of equal ones."""
    return rows.filter("value IS NOT NULL").groupBy(*keys).agg(F.max_by("hour", F.struct("value", (-F.col("hour")).alias("h"))).alias("peak_hour"), F.max("value").alias("peak_value"))


def watchlist(rows: DataFrame, date: str, hour: int, span: int) -> DataFrame:
    """For each route the hour from ``hour`` on, within ``span``, whose value exceeds the usual most in proportion, routes by that;
    unknown comes last and hours don't wrap at midnight."""
    seen = rows.filter((F.col("date") == F.lit(date).cast("date")) & F.col("hour").between(hour, hour + span - 1))
    deviation = F.when(F.col("usual") > 0, F.col("value") / F.col("usual") - 1)
    one = W.partitionBy("route").orderBy(F.desc_nulls_last("deviation"), "hour")
    best = seen.withColumn("deviation", deviation).withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    return best.withColumn("tone", S.tone(F.col("value"), F.col("usual"))).orderBy(F.desc_nulls_last("deviation"), "route")


def risks(rows: DataFrame) -> DataFrame:
    """Rows with value and usual whose tone is hot or warm."""
    t = S.tone(F.col("value"), F.col("usual"))
    return rows.filter("value IS NOT NULL AND usual IS NOT NULL").withColumn("tone", t).filter(F.col("tone").isin("hot", "warm"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by the order: keyed upserts."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")  # combined before the shuffle
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*rows.columns)


def scenario_coefficients(hours: DataFrame, weather: str, min_hours: int = 40, min_days: int = 8) -> DataFrame:
    """By route: the median of the hours under a weather over the median of all; to apply only with enough hours and days."""
    hit = F.col("weather") == weather
    g = hours.groupBy("route").agg(F.median(F.when(hit, F.col("value"))).alias("_t"), F.median("value").alias("_b"), F.count_if(hit).alias("target_hours"), F.count_distinct(F.when(hit, F.col("date"))).alias("target_days"))
    enough = (F.col("target_hours") >= min_hours) & (F.col("target_days") >= min_days)
    return g.select("route", F.round(S.ratio(F.col("_t"), F.col("_b")), 6).alias("coefficient"), "target_hours", "target_days", enough.alias("apply"))
