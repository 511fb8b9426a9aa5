"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut


def _joined_to_least(pairs: DataFrame) -> DataFrame:
    """Rows (u, v, least) with the least of u and its v. The minima are cut off, so that the join exchanges both sides and
    adaptive execution splits a hub's partition."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least")))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that ``edges`` (u, v) join to a smaller one; root is the least node of its component.

    Each step writes its edges to the shared folder. The steps end when an entire round leaves the edges as they were,
    after about the logarithm of the longest path.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = now.union(now.select("v", "u"))
        large = cut(_joined_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        kept = _joined_to_least(large)
        small = kept.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(kept.select("u", F.col("least").alias("v")))
        now = cut(small.distinct())
