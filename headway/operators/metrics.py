"""Forecast errors: weighted absolute error by slices, and what is chosen by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions import scalars as S


def wape(actual: Column, predicted: Column) -> Column:
    """Aggregate: sum of absolute errors over sum of actuals; null without volume."""
    return F.try_divide(F.sum(F.abs(actual - predicted)), F.nullif(F.sum(actual), F.lit(0)))


def score(actual: Column, predicted: Column) -> Column:
    """Aggregate: 1 less the weighted error, at least 0."""
    return F.greatest(F.lit(0.0), 1 - wape(actual, predicted))


def by(rows: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Sums, error and score by keys, or over all."""
    a, p = F.col(actual), F.col(predicted)
    return rows.groupBy(*keys).agg(F.sum(a).alias("actual_sum"), F.sum(p).alias("predicted_sum"), wape(a, p).alias("wape"), score(a, p).alias("score"))


def by_slices(rows: DataFrame, origin: str) -> DataFrame:
    """The error of overlapping slices in one pass: each row names its slices and is counted in each.

    Rows have route, date, hour, actual, predicted, and 0/1 columns off_day and school_off.
    """
    tag = lambda cond, name: F.when(cond, F.lit(name))
    off = F.col("off_day") == 1
    tags = F.array(
        F.lit("all"),
        tag(~off, "workday"),
        tag(off, "holiday"),
        tag(F.col("school_off") == 1, "school_off"),
        tag(~off & F.col("hour").between(7, 9), "morning_peak"),
        tag(~off & F.col("hour").between(16, 19), "evening_peak"),
        F.concat(F.lit("route_"), F.col("route").cast("string")),
        F.concat(F.lit("days_"), S.horizon_bucket(F.datediff("date", F.lit(origin).cast("date")))),
    )
    return by(rows.withColumn("slice", F.explode(F.array_compact(tags))), ["slice"])


def by_models(rows: DataFrame, models: list[str], keys: list[str], actual: str = "actual") -> DataFrame:
    """The error of several models' columns by keys, a row a key and model; each input row is counted for each model in one pass."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("_p")) for m in models])
    return by(rows.select(*keys, actual, F.explode(each).alias("_m")).select(*keys, actual, "_m.*"), [*keys, "model"], actual, "_p")


def weekly(rows: DataFrame, first: str) -> DataFrame:
    """The error of successive seven-day windows from ``first``."""
    return by(rows.withColumn("week", F.floor(F.datediff("date", F.lit(first).cast("date")) / 7)), ["week"])


def weekday_hours(rows: DataFrame, value: str = "value") -> DataFrame:
    """Mean by weekday, hours as columns h0 to h23."""
    table = rows.groupBy(F.weekday("date").alias("weekday")).pivot("hour", list(range(24))).agg(F.avg(value))
    return table.select("weekday", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def histogram(rows: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Counts by equal bins between the least and the greatest value, the last bin closed."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_lo")) / width))).otherwise(0)
    return rows.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and greatest absolute difference, and ratio of totals, over the keys of both."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    far = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.avg(far).alias("mae"), F.max(far).alias("max_diff"), (F.sum("_a") / F.greatest(F.sum("_b"), F.lit(1.0))).alias("total_ratio"), F.count("*").alias("n"))


def best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by the order, which must be total."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def best_fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's folds (fold, score) the one with the best score, ties to the first. A choice by the score it reports is too good a guess of later scores."""
    return best(rows, keys, [F.round("score", 12).desc_nulls_last(), F.col("fold")])


def gate(folds: DataFrame, gain: float = 0.005, wins: int = 3, drop: float = 0.01, tolerance: float = 0.002) -> DataFrame:
    """Whether a candidate may replace the base: rows have fold, kind (dev or lock), base, candidate, base_workday, candidate_workday."""
    d = F.col("candidate") - F.col("base")
    dev, lock = F.col("kind") == "dev", F.col("kind") == "lock"
    out = folds.agg(
        F.avg(F.when(dev, d)).alias("mean_gain"),
        F.count_if(dev & (d > 0)).alias("wins"),
        F.max(F.when(dev, -d)).alias("worst_drop"),
        F.min(F.when(lock, d)).alias("lock_gain"),
        F.min(F.when(dev, F.col("candidate_workday") - F.col("base_workday"))).alias("workday_gain"),
    )
    ok = (F.col("mean_gain") >= gain) & (F.col("wins") >= wins) & (F.col("worst_drop") <= drop) & (F.col("lock_gain") > 0) & (F.col("workday_gain") >= -tolerance)
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def _mixtures(rows: DataFrame, models: list[str], step: float, keys: list[str]) -> DataFrame:
    """Absolute error and volume of each grid weight, by keys; ids follow the grid's order.

    The grid of weights is a handful of rows, so every row meets each of them within its task, and the sums are combined before the
    shuffle.
    """
    n, grid = round(1 / step), [()]
    for i in range(len(models)):
        grid = [g + (k,) for g in grid for k in range(n - sum(g) + 1) if i < len(models) - 1 or sum(g) + k == n]
    table = F.array(*[F.struct(F.lit(i).alias("id"), *[F.lit(k / n).alias(f"w_{m}") for m, k in zip(models, g)]) for i, g in enumerate(grid)])
    tried = rows.withColumn("_w", F.explode(table)).select(*keys, "actual", *models, "_w.*")
    mixed = sum((F.col(m) * F.col(f"w_{m}") for m in models[1:]), F.col(models[0]) * F.col(f"w_{models[0]}"))
    return tried.groupBy(*keys, "id", *[f"w_{m}" for m in models]).agg(F.sum(F.abs(F.col("actual") - mixed)).alias("_error"), F.sum("actual").alias("_volume"))


def blend_search(rows: DataFrame, models: list[str], step: float = 0.1, keys: list[str] | None = None) -> DataFrame:
    """The best weights on the simplex by weighted error, by keys; rows have actual and a column for each model. Ties go to the grid's first."""
    keys = keys or []
    scored = _mixtures(rows, models, step, keys).withColumn("wape", F.try_divide("_error", F.nullif("_volume", F.lit(0)))).drop("_error", "_volume")
    return best(scored, keys or [F.lit(0)], [F.round("wape", 12).asc_nulls_last(), F.col("id")]).drop("id")


def leave_one_out(rows: DataFrame, models: list[str], origin: str = "origin", step: float = 0.1) -> DataFrame:
    """For each origin the weights that the other origins choose, with its own score by the first model (anchor) and by them (blend).

    One pass over the rows: what the others sum to is the total less the origin's own. A score without volume is null.
    """
    each = _mixtures(rows, models, step, [origin])
    same = W.partitionBy("id")
    left = {c: F.sum(c).over(same) - F.col(c) for c in ("_error", "_volume")}
    others = each.withColumn("_others", F.greatest(F.lit(0.0), 1 - left["_error"] / F.greatest(left["_volume"], F.lit(1.0))))
    own = F.greatest(F.lit(0.0), 1 - F.try_divide("_error", F.nullif("_volume", F.lit(0))))
    own = F.when(F.col("_volume") != 0, own)
    chosen = best(others, [origin], [F.round("_others", 12).desc(), F.col("id")]).withColumn("blend", own)
    anchor = each.filter(F.col(f"w_{models[0]}") == 1).select(origin, own.alias("anchor"))
    return chosen.join(anchor, origin).select(origin, *[f"w_{m}" for m in models], "anchor", "blend")


def sign_test(wins: int, n: int) -> float:
    """The chance of at least so many wins in ``n`` fair tosses."""
    from math import comb

    return sum(comb(n, k) for k in range(wins, n + 1)) / 2**n
