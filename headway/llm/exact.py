"""Exact dedup: rows group by a 128-bit content hash, bytes are compared inside the groups; the smallest id stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut, reused, sieved

#: Runs of white space that are not already one space.
_RUNS = r"[\t-\r][ \t-\r]*| [ \t-\r]+"


def normalised(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed or carriage return as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def hash128(digest: Column) -> Column:
    """128 bits of a hexadecimal SHA-256."""
    return F.unhex(F.substring(digest, 1, 32))


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Ids and digests are written once; they are grouped by the 128-bit hash, which combines within each map
    task, so that a group holding a third of all rows arrives as a row per task. Then the bytes are compared, of the rows alone whose hash is in a group of two and more:
    a sieve of bounded size (``common.sieved``) tells them where they are, and only their texts are shuffled, each distinct one once per map task. A hash with more than
    one text is a collision, and its rows alone are grouped again by text. The groups are joined back to the ids by hash; this carries no text, and both sides
    are exchanged for the join only, so adaptive execution splits the partition of a hot group.

    Null text equals empty text. A row with a null doc_id counts in its group but stays only where all ids of the group
    are null. Rows that repeat both id and text can't be told apart: all are reported, and as kept if their id is.
    An empty table gives no rows; other columns are not read.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    rows = reused(texts.select("doc_id", "text_sha256")).withColumn("key", hashed(F.col("text_sha256")))
    shared = cut(rows.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    bodies = texts.withColumn("key", hashed(F.col("text_sha256"))).select("doc_id", "text_sha256", "key", "body")
    # what the sieve lets through beside the shared hashes has one text, like nearly all of these
    compared = sieved(bodies.select("key", "body"), F.xxhash64("key"), shared.select(F.xxhash64("key").alias("h")), "maybe").filter("maybe")
    collided = cut(compared.groupBy("key", "body").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1").select("key"))
    found = rows.join(shared, "key", "left")
    if not collided.isEmpty():
        # Two texts with one 128-bit hash. No such pair of texts is known, so there are few keys to broadcast.
        again = bodies.join(F.broadcast(collided), "key")
        exact = again.groupBy("key", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.join(F.broadcast(collided), "key", "left_anti").unionByName(again.join(exact, ["key", "body"]).drop("body"))
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


SQL = r"""
SELECT doc_id, coalesce(min(doc_id) OVER (PARTITION BY body), doc_id) AS keep_id, CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
"""
