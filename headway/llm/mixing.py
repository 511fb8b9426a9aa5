"""Mixing sources to target weights: nested thresholds on a hash of the document, found by histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import cut, reused
from headway.operators.ranking import numbered

#: The size of the mix as a share of all words, the times that a word may be taken, the weights of the sources in their order, repeating.
SHARE, MOST, WEIGHTS = 1.5, 2, (3, 1, 2)
#: Bits of the hash, and bits that a histogram adds to those known: 1024 buckets for each source.
BITS, STEP = 60, 10
#: Sources up to this number are broadcast (a few MB); more are joined.
FEW = 50_000


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def spot_of(doc_id: Column, text: Column) -> Column:
    """A place in [0, 2**60) that follows from the row's id and text alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _to_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns of their source. A source may hold a third of the rows: few sources are broadcast, and of many adaptive execution splits it."""
    right = sources.withColumnRenamed("source", "source_")
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Each source gets its weight's part of ``share`` of all words; what passes ``most`` times its
    size is dealt among the others by weight, until no source is above.

    A round costs one aggregation over the sources and brings the driver two sums. A source once at its limit stays there, as the others' level only
    rises. Sources without words get no words and don't count.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n"), F.lit(len(weights))) + 1).cast("int"))
    rows = cut(numbered(sizes, [F.col("source").asc_nulls_last()], "n").select("source", "source_size", weight.cast("double").alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("limit")))
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None
    while True:
        at_limit = F.col("limit") <= F.lit(level) * F.col("weight")
        r = rows.agg(F.coalesce(F.sum(F.when(at_limit, F.col("limit"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(at_limit, 1)).alias("full")).first()
        if r["full"] == full or not r["weight"]:
            break
        full, level = r["full"], (budget - r["taken"]) / r["weight"]
    return rows.select("source", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """(source, whole, spot): each document is taken ``whole`` times, and once more if its place is at most ``spot``.

    ``rows`` are (source, size, spot), ``goals`` (source, source_size, target). A histogram of the first bits sums the words of each bucket; one bucket of
    each source holds the place where the words reach what is left of the target. Only its rows are looked at again, by the bits that follow, until it holds one
    place. Rows there are taken if that comes nearer to the target. A larger target always takes the rows of a smaller one.
    """
    left = F.col("target") - F.col("whole") * F.col("source_size")
    state = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = cut(state.select("source", "whole", left.alias("left"), F.lit(0).cast("long").alias("below")))
    done, known = None, 0
    while known < BITS:
        known += STEP
        bucket = F.shiftright("spot", BITS - known)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("spot").alias("first"), F.max("spot").alias("last"))
        by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**STEP rows a source
        found = _to_sources(sums.withColumn("before", F.coalesce(F.sum("words").over(by_source), F.lit(0))), state, few)
        start = F.col("below") + F.col("before")
        found = found.filter((start <= F.col("left")) & (F.col("left") < start + F.col("words"))).select("source", "whole", "left", "bucket", start.alias("below"), "words", "first", "last")
        found = cut(found)
        nearer = 2 * F.col("left") > 2 * F.col("below") + F.col("words")
        ready = found.filter("first = last").select("source", F.when(nearer, F.col("last")).otherwise(F.col("first") - 1).alias("spot"))
        done = ready if done is None else done.union(ready)
        state = cut(found.filter("first < last").select("source", "whole", "left", "below", "bucket"))
        if state.isEmpty():
            break
        rows = reused(_to_sources(rows, state.select("source", "bucket"), few).filter(bucket == F.col("bucket")).select("source", "size", "spot"))
        state = state.drop("bucket")
    marks = goals.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"))
    return cut(marks.join(done.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").select("source", "source_size", "target", "whole", F.coalesce("spot", F.lit(-1).cast("long")).alias("spot")))


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_md5, source, size, source_size, target, times, taken.

    ``times`` says how often the document is in the mix, at most ``most`` times rounded up; ``taken`` is that many times its size. Documents are read once; sizes and places stay in a
    thin table, which is summed by source and bucket, never sorted or shuffled whole. So a source of any size adds a row per bucket and task.

    A null text has no words and a size of 0; a null source is a source of its own, the last. A row's place follows from its id and text, so rows that repeat
    both are taken together, also where both are null, and runs agree. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "source", size_of(F.col("text")).alias("size"), spot_of(F.col("doc_id"), F.col("text")).alias("spot"))
    rows = reused(rows)
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = sizes.count() <= FEW
    goals = cut(targets(sizes, share, most, weights))
    marks = thresholds(rows.select("source", "size", "spot").filter("size > 0"), goals, few)
    out = _to_sources(rows.withColumnRenamed("spot", "place"), marks, few)
    times = F.col("whole") + F.when(F.col("place") <= F.col("spot"), 1).otherwise(0)
    return out.select("doc_id", "text_md5", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` says. Rows are known by id and text; the few dropped or repeated ones meet by key."""
    keys = mixed.groupBy(F.col("doc_id").alias("key_id"), "text_md5").agg(F.max("times").alias("key_times"))
    digest = F.md5(F.coalesce(docs["text"], F.lit("")))
    found = docs.join(keys, docs["doc_id"].eqNullSafe(keys["key_id"]) & (digest == keys["text_md5"])).filter("key_times > 0")
    return found.withColumn("key_times", F.explode(F.sequence(F.lit(1), F.col("key_times").cast("int")))).select(*[docs[c] for c in docs.columns])


def _level_sql(rounds: int = 40) -> str:
    """Rounds of the level at which sources fill up, each from the one before."""
    first = "lv0 AS (SELECT CAST(0.0 AS DOUBLE) AS level)"
    more = [
        f"lv{i} AS (SELECT CASE WHEN sum(CASE WHEN most > level * weight THEN weight ELSE 0.0 END) > 0 THEN (any_value(budget) - sum(CASE WHEN most <= level * weight THEN most ELSE 0.0 END)) / sum(CASE WHEN most > level * weight THEN weight ELSE 0.0 END) ELSE any_value(level) END AS level FROM s, lv{i - 1})"
        for i in range(1, rounds + 1)
    ]
    return ", ".join([first, *more]) + f", lv AS (SELECT level FROM lv{rounds})"


SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
       CAST('0x' || substr(md5(concat_ws(':', doc_id, md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS spot FROM documents),
s AS MATERIALIZED (SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0 * source_size AS most, 1.5 * (SELECT sum(size) FROM d) AS budget
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
{_level_sql(8)},
t AS (SELECT source, source_size, CAST(least(most, level * weight) AS DOUBLE) AS target FROM s, lv),
m AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, spot, sum(size) AS words FROM d WHERE size > 0 GROUP BY ALL),
c AS (SELECT source, spot, words, sum(words) OVER (PARTITION BY source ORDER BY spot) - words AS below FROM g),
x AS (SELECT c.source, CASE WHEN 2 * (target - whole * source_size) > 2 * below + words THEN spot ELSE spot - 1 END AS mark
      FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source WHERE below <= target - whole * source_size AND target - whole * source_size < below + words)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN spot <= coalesce(mark, -1) THEN 1 ELSE 0 END) AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
