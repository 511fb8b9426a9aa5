"""Joins of points with intervals and marks on a line of whole numbers: days since 1970, or microseconds for instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions.sessions import cut


def position(at: Column, instant: bool = False) -> Column:
    """A date as its day's number, or an instant as its microsecond's."""
    return F.unix_micros(at.cast("timestamp")) if instant else F.unix_date(at.cast("date")).cast("long")


def indexed(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _start, _end, _level, _bin): each interval (``_start`` to ``_end``, both included) in the bins that it touches at the level whose bins are as long as
    itself or up to twice as long: two bins at most, however long it is. Intervals that end before they start hold nothing."""
    level = F.ceil(F.log2((F.col("_end") - F.col("_start") + 1).cast("double"))).cast("int")
    rows = intervals.filter("_end >= _start").withColumn("_level", level)
    bins = F.sequence(F.expr("shiftright(_start, _level)"), F.expr("shiftright(_end, _level)"))
    return rows.withColumn("_bin", F.explode(bins))


def stabbed(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _at, n): for each distinct point (keys, ``_at``) that any interval of its keys holds, how many do.

    A point looks into one bin of each level that occurs, of which there are 64 at most, so the join is one of equal keys, and a crowded bin is what adaptive skew
    handling splits. Nothing is expanded day by day. Both sides are more rows than the files that Spark would judge them by, so they are merged, never broadcast.
    """
    index = cut(indexed(intervals.select(*keys, "_start", "_end"), keys))
    levels = sorted(r["_level"] for r in index.select("_level").distinct().collect())
    if not levels:
        return points.select(*keys, "_at").distinct().limit(0).withColumn("n", F.lit(0).cast("long"))
    asked = points.select(*keys, "_at").distinct().withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", F.expr("shiftright(_at, _level)"))
    hit = asked.join(index.hint("merge"), [*keys, "_level", "_bin"]).filter((F.col("_start") <= F.col("_at")) & (F.col("_at") <= F.col("_end")))
    return hit.groupBy(*keys, "_at").agg(F.count("*").alias("n"))


def around(points: DataFrame, marks: DataFrame, keys: list[str], stretch: int) -> DataFrame:
    """``points`` (keys, ``_at``, ..) with ``_last`` and ``_next``: the nearest marks (keys, ``_at``) at or before and at or after each; null where there is none.

    Both sides go once through a window by keys and stretch of so many positions. What a stretch doesn't hold comes from the stretches beside it: of each that has
    marks the first and last are handed on. So a key that holds many of the rows is spread over its stretches, and no mark is copied, however far it reaches.
    """
    part = F.floor(F.col("_at") / stretch)
    mark = marks.select(*keys, "_at").distinct().withColumn("_s", part)
    both = points.withColumns({"_s": part, "_mark": F.lit(None).cast("long")}).unionByName(mark.withColumn("_mark", F.col("_at")), allowMissingColumns=True).withColumn("_asks", F.col("_mark").isNull())
    here = W.partitionBy(*keys, "_s").orderBy("_at")
    seen = both.withColumns({
        "_last": F.max("_mark").over(here.rangeBetween(W.unboundedPreceding, 0)),
        "_next": F.min("_mark").over(here.rangeBetween(0, W.unboundedFollowing)),
    }).filter("_asks").drop("_mark", "_asks")
    edges = mark.groupBy(*keys, "_s").agg(F.min("_at").alias("_first_mark"), F.max("_at").alias("_last_mark"))
    stretches = points.select(*keys, part.alias("_s")).distinct().join(edges, [*keys, "_s"], "full")
    order = W.partitionBy(*keys).orderBy("_s")  # a row per stretch that has rows
    handed = stretches.select(
        *keys, "_s",
        F.max("_last_mark").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_from_before"),
        F.min("_first_mark").over(order.rowsBetween(1, W.unboundedFollowing)).alias("_from_after"),
    )
    out = seen.join(handed, [*keys, "_s"], "left").withColumns({"_last": F.coalesce("_last", "_from_before"), "_next": F.coalesce("_next", "_from_after")})
    return out.drop("_s", "_from_before", "_from_after")
