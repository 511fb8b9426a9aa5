"""What several operators share: cutting lineage and mapping batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.sessions import cut, reused, shared_dir, shared_path  # noqa: F401  used by the operators


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[list[list]], dict]], schema: str) -> DataFrame:
    """Apply a function to batches of rows, given as one list per column and returned as a dict of lists or arrays.

    ``make`` runs once in each task and returns that function, so that caches and tables live as long as the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step([c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], names=kinds.names)

    return df.select(*columns).mapInArrow(run, schema)


def free(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of ``df`` has."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


#: Bits of a sieve for each key, and bits of the largest one: 16 MB.
SPARSE, MOST_BITS = 64, 1 << 27
#: Bits that one row of a sieve holds, as ``bitmap_construct_agg`` makes them.
BLOCK = 1 << 15


def sieved(rows: DataFrame, h: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false where the 64-bit hash ``h`` is none of those in ``keys`` (one column of longs), true where it may be one.

    Each key sets one bit of a bitmap that is broadcast. It has ``SPARSE`` bits a key and at most ``MOST_BITS`` in all, whatever the number of keys; beyond that it fills up and lets
    more rows through, so what follows has to decide. Without keys nothing passes. Built-in functions only.
    """
    size, n = BLOCK, keys.count()
    while size < min(SPARSE * n, MOST_BITS):
        size *= 2
    block, bits = free(rows, "block"), free(rows, "bits")
    place = F.pmod(F.col(keys.columns[0]), F.lit(size))
    made = keys.groupBy(F.shiftright(place, 15).alias(block)).agg(F.bitmap_construct_agg(place.bitwiseAND(BLOCK - 1)).alias(bits))
    at = F.pmod(h, F.lit(size))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at, 3).bitwiseAND(BLOCK // 8 - 1) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    # the bitmap has at most MOST_BITS / BLOCK rows of 4 KB
    met = rows.withColumn(block, F.shiftright(at, 15)).join(F.broadcast(made), block, "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(known, F.lit(False)).alias(name))
