"""Records as they are exchanged: which of them count, and how tables of them are put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import text as T


def of_kind(rows: DataFrame, kinds: list[str], texts: list[str], pattern: str, code: str = "0") -> DataFrame:
    """Records of one kind. One that names its kind counts if a name matches the pattern or is the code, another one if any of its texts
    matches. If no record names its kind, all count."""
    values = [F.nullif(F.trim(c), F.lit("")) for c in kinds]
    named = F.coalesce(*values).isNotNull()
    matches = reduce(lambda a, b: a | b, [F.coalesce(F.lower(v).rlike(pattern) | (v == code), F.lit(False)) for v in values])
    whole = F.coalesce(F.lower(F.concat_ws(" ", *texts)).rlike(pattern), F.lit(False))
    any_named = rows.agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("_any"))  # one row
    return rows.join(F.broadcast(any_named)).filter(~F.col("_any") | F.when(named, matches).otherwise(whole)).drop("_any")


def stacked(*tables: DataFrame) -> DataFrame:
    """The rows of tables one below the other, by column names; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def by_part(rows: DataFrame, column: str, measures: list[Column]) -> DataFrame:
    """Measures of each value of a column, stacked: what a loop over the values gives, from one scan and one aggregation. The values needn't be known before."""
    return rows.groupBy(column).agg(*measures)


def calendar_days(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Dates of base or added but not removed, each once."""
    return base.select("date").union(added.select("date")).distinct().join(removed.select("date"), "date", "left_anti")


def overwritten(rows: DataFrame, other: DataFrame, keys: list[str], column: str, where: Column) -> DataFrame:
    """``column`` from the other table where a condition on the row holds and the other table has its key."""
    new = other.select(*keys, F.col(column).alias("_new"))
    return rows.join(new, keys, "left").withColumn(column, F.when(where & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_new")


def masked(rows: DataFrame, mask: str, columns: list[str]) -> DataFrame:
    """Columns of the rows whose mask is set; a null mask isn't."""
    return rows.filter(F.coalesce(F.col(mask).cast("boolean"), F.lit(False))).select(*columns)


def by_route(rows: DataFrame, routes: str = "routes", known: list[int] | None = None) -> DataFrame:
    """A row for each number in a list of routes as text, and only for the known ones if these are given."""
    out = rows.withColumn("route", F.explode(T.numbers(F.col(routes)))).drop(routes)
    return out.filter(F.col("route").isin(known)) if known is not None else out


def mean_of_runs(rows: DataFrame, keys: list[str], value: str = "predicted") -> DataFrame:
    """The mean over repeated runs of a model, and their number."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("runs"))


def top_titles(rows: DataFrame, keys: list[str], title: str, k: int = 8) -> DataFrame:
    """For each key the number of different titles, and the ``k`` that occur most often, ties by title.

    Titles are counted before they meet; what meets is one row a title of the key.
    """
    hits = rows.groupBy(*keys, title).agg(F.count("*").alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(title).alias("t"))))
    return hits.groupBy(*keys).agg(F.count("*").alias("n_titles"), F.transform(F.slice(ordered, 1, k), lambda x: x["t"]).alias("titles"))


def in_order(rows: DataFrame, route: str) -> DataFrame:
    """Rows by route as people list them: shorter names first, then by name."""
    return rows.orderBy(F.length(route), route)
