"""Token-id files of patched frame-of-reference blocks.

A file holds whole documents: the magic ``HPF1``; little-endian counts of documents (u4), ids (u8) and blocks (u4); the doc_ids (i8,
with a u1 each that is 0 where the id is null); the number of ids of each document (u8); the byte position of each block and
of the end (u8), from the first block; then the blocks. A block holds up to ``BLOCK`` ids, less the block's minimum, packed at a width that fits a
given share of them; the high bits of the rest stand in an exception list behind.
A block: minimum (u4), width (u1), number of exceptions (u2), packed low bits, positions of exceptions (u1), high bits of these (u4).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import map_rows, shared_path
from headway.llm.tokens import END, encoded_in_order, encoder

MAGIC, BLOCK = b"HPF1", 256
#: Share of a block's ids that the width must fit, and ids after which a file is closed.
SHARE, FILE = 0.9, 1 << 20
_HEAD = 7


def _lengths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.frexp(x.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, bytes]:
    """Positions of the blocks and of their end, and the blocks' bytes."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, "<u8"), b""
    table = np.full(n * BLOCK, ids[-1], "<u4")
    table[: len(ids)] = ids
    table = table.reshape(n, BLOCK)
    low = table.min(1)
    table -= low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    widths = _lengths(np.partition(table, rank, axis=1)[:, rank])
    odd = table > ((1 << widths.astype(np.int64)) - 1).astype("<u4")[:, None]
    patched = odd.sum(1)
    sizes = _HEAD + widths * (BLOCK // 8) + 5 * patched
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint8)
    out[at[:-1, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at[:-1] + 4] = widths
    out[at[:-1, None] + np.array([5, 6])] = patched.astype("<u2").view(np.uint8).reshape(n, 2)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        narrow = table[rows].astype("<u2" if width <= 16 else "<u4")
        bits = np.unpackbits(narrow[:, :, None].view(np.uint8), axis=2, bitorder="little")[:, :, :width]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        out[(at[rows] + _HEAD)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(odd)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(patched) - patched, patched)
        behind = (at[:-1] + _HEAD + widths * (BLOCK // 8))[row]
        out[behind + nth] = place
        high = (table[row, place].astype(np.int64) >> widths[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(behind + patched[row] + 4 * nth)[:, None] + np.arange(4)] = high
    return at.astype("<u8"), out.tobytes()


def decode_blocks(at: np.ndarray, data: bytes, count: int) -> np.ndarray:
    """The ids again."""
    at, raw, n = at.astype(np.int64), np.frombuffer(data, np.uint8), len(at) - 1
    if not n:
        return np.zeros(0, np.int64)
    head = raw[at[:-1, None] + np.arange(_HEAD)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.int64)
    widths = head[:, 4].astype(np.int64)
    patched = np.ascontiguousarray(head[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    table = np.zeros((n, BLOCK), np.int64)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        packed = raw[(at[rows] + _HEAD)[:, None] + np.arange(width * BLOCK // 8)]
        kind = np.dtype("<u2" if width <= 16 else "<u4")
        bits = np.zeros((len(rows), BLOCK, 8 * kind.itemsize), np.uint8)
        bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
        table[rows] = np.packbits(bits, axis=2, bitorder="little").view(kind)[:, :, 0]
    if patched.any():
        row = np.repeat(np.arange(n), patched)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(patched) - patched, patched)
        behind = (at[:-1] + _HEAD + widths * (BLOCK // 8))[row]
        place = raw[behind + nth].astype(np.int64)
        high = raw[(behind + patched[row] + 4 * nth)[:, None] + np.arange(4)]
        table[row, place] |= np.ascontiguousarray(high).view("<u4")[:, 0].astype(np.int64) << widths[row]
    return (table + low[:, None]).reshape(-1)[:count]


def encode_file(names: list, ids: list[np.ndarray], share: float = SHARE) -> bytes:
    joined = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    at, blocks = encode_blocks(joined, share)
    return b"".join(
        [
            MAGIC,
            np.array([len(ids)], "<u4").tobytes(),
            np.array([len(joined)], "<u8").tobytes(),
            np.array([len(at) - 1], "<u4").tobytes(),
            np.array([x or 0 for x in names], "<i8").tobytes(),
            np.array([x is not None for x in names], np.uint8).tobytes(),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            at.tobytes(),
            blocks,
        ]
    )


def decode_file(data: bytes) -> tuple[list, list[np.ndarray]]:
    """The doc_ids and each document's ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token-id file")
    docs, count, blocks = (int(np.frombuffer(data, k, 1, o)[0]) for k, o in (("<u4", 4), ("<u8", 8), ("<u4", 16)))
    at = 20
    names = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    index = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs)
    ids = decode_blocks(index, data[at + 17 * docs + 8 * (blocks + 1) :], count)
    return [int(x) if k else None for x, k in zip(names, known)], np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


def decode_range(data: bytes, first: int, last: int) -> np.ndarray:
    """The file's ids from ``first`` to before ``last``: only the blocks that hold them are read, found by the index."""
    docs, count, blocks = (int(np.frombuffer(data, k, 1, o)[0]) for k, o in (("<u4", 4), ("<u8", 8), ("<u4", 16)))
    first, last = max(0, first), min(last, count)
    if first >= last:
        return np.zeros(0, np.int64)
    at = 20 + 17 * docs
    a, b = first // BLOCK, -(-last // BLOCK)
    index = np.frombuffer(data, "<u8", b - a + 1, at + 8 * a)
    start = at + 8 * (blocks + 1)
    found = decode_blocks(index - index[0], data[start + int(index[0]) : start + int(index[-1])], (b - a) * BLOCK)
    return found[first - a * BLOCK : last - a * BLOCK]


def read_range(spark, path: str, first: int, last: int) -> DataFrame:
    """The ids from ``first`` to before ``last`` in the order of the files at ``path``: rows (start, ids), one a file that has any of them."""
    files = spark.read.schema("run int, before long, n_ids long, data binary").parquet(path)
    sizes = dict(files.groupBy("run").agg(F.sum("n_ids")).collect())  # one number a run
    starts = F.create_map(*[F.lit(x) for run in sorted(sizes) for x in (run, sum(n for r, n in sizes.items() if r < run))]) if sizes else F.lit(None).cast("map<int,long>")
    placed = files.withColumn("start", F.element_at(starts, F.col("run")) + F.col("before"))
    mine = placed.filter((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))

    def step(c):
        ids = [decode_range(data, first - start, last - start).tolist() for start, data in zip(*c)]
        return {"start": [max(first, start) for start in c[0]], "ids": ids}

    return map_rows(mine, ["start", "data"], lambda: step, "start long, ids array<long>")


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = END, share: float = SHARE, file_ids: int = FILE) -> str:
    """Write all texts' ids, each followed by ``end``, in ascending doc_id order; return the path.

    The path is a Parquet table whose ``data`` column holds the files, one a row, beside the place in the order: ``run`` ascending, then
    ``before`` (ids of the run in front of the file). Spark's writer commits them, so any store and lost tasks will do. A task holds one file's ids at a time.
    """
    rows = encoded_in_order(docs, tokenizer, end)
    kind = encoder(tokenizer).kind

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, held, before, run = [], [], 0, 0, 0

        def flush():
            data = encode_file(names, ids, share)
            return pa.RecordBatch.from_pydict({"run": pa.array([run], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.large_binary() if len(data) >> 31 else pa.binary())})

        for batch in batches:
            for r, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                run = r
                names.append(name)
                ids.append(np.frombuffer(raw, kind))
                held += len(ids[-1])
                if held >= file_ids:
                    yield flush()
                    names, ids, before, held = [], [], before + held, 0
        if names:
            yield flush()

    path = path or shared_path(docs.sparkSession, "token-ids")
    rows.mapInArrow(files, "run int, before long, n_ids long, data binary").write.option("compression", "none").parquet(path)
    return path


def read_ids(spark, path: str) -> DataFrame:
    """One row per document from the files at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A run's first id is at the sum of the earlier runs' sizes; there is one number a run, so these go to the driver and out.
    Files are read one at a time. An empty table has no files and gives no rows.
    """
    files = spark.read.schema("run int, before long, n_ids long, data binary").parquet(path)
    sizes = dict(files.groupBy("run").agg(F.sum("n_ids")).collect())
    first, at = {}, 0
    for run in sorted(sizes):
        first[run] = at
        at += sizes[run]

    def make():
        def step(c):
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for run, before, data in zip(*c):
                start = first[run] + before
                for name, ids in zip(*decode_file(data)):
                    for k, v in zip(out, (name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        out[k].append(v)
                    start += len(ids)
            return out

        return step

    return map_rows(files, ["run", "before", "data"], make, "doc_id long, start long, n_tokens long, ids_crc32 long")
