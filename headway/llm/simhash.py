"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut, map_rows
from headway.llm.components import components

SEED = 42
#: Words in a shingle, and differing bits up to which two fingerprints link.
SHINGLE, DISTANCE = 4, 4
#: Reference fingerprints, and fingerprints compared at once in a block.
PIVOTS, BLOCK = 32, 1024
#: Fingerprints that share a key, on average, if their bits were even.
PER_KEY = 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_REFERENCES = np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, as a signed number: a bit is set where more than half of the shingles' hashes have it. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[shingle - 1 :] or [len(body)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [body[a:b] for a, b in zip(starts, ends)], repeat(SEED)), np.uint64, len(ends))
    digits = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(digits[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_md5, print) for each row."""

    def make():
        return lambda c: {"doc_id": c[0], "text_md5": c[1], "print": [fingerprint(t, shingle) for t in c[2]]}

    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "text")
    return map_rows(rows, ["doc_id", "text_md5", "text"], make, "doc_id long, text_md5 string, print long")


def near(prints: np.ndarray, part: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within ``distance``: of all, or where ``part`` has two values, across these.

    ``table`` holds each fingerprint's distances to the references. By the triangle inequality a pair whose distances
    to some reference differ by more than ``distance`` is farther apart than that, so it is discarded unread. Sorting by the
    first reference leaves a window of each row's possible partners; the others thin these out; survivors are verified.
    """
    table = np.bitwise_count(prints[:, None] ^ _REFERENCES[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table, part = prints[order], table[order], part[order]
    until = np.searchsorted(table[:, 0], table[:, 0] + distance, side="right")
    counts = until - np.arange(len(prints)) - 1
    a = np.repeat(np.arange(len(prints)), counts)
    b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + a + 1
    if part.min() != part.max():
        across = part[a] != part[b]
        a, b = a[across], b[across]
    for pivot in range(1, PIVOTS):
        if len(a) < 2 * len(prints):
            break  # verifying is as cheap by now
        close = np.abs(table[a, pivot] - table[b, pivot]) <= distance
        a, b = a[close], b[close]
    close = np.bitwise_count(prints[a] ^ prints[b]) <= distance
    return order[a[close]], order[b[close]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of ``n`` positions reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            break
    return root


def _block_edges(distance: int):
    def step(columns):
        u, v = [], []
        for members in columns[0]:
            prints = np.array([m["print"] for m in members], np.int64)
            if len(prints) > 1:
                root = forest(len(prints), *near(prints.view(np.uint64), np.array([m["part"] for m in members]), distance))
                moved = np.flatnonzero(root != np.arange(len(root)))
                u += prints[moved].tolist()
                v += prints[root[moved]].tolist()
        return {"u": u, "v": v}

    return step


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK, per_key: int = PER_KEY) -> DataFrame:
    """Edges (u, v) that connect just those distinct fingerprints (column print) that chains of links connect.

    Fingerprints are cut into m segments of bits; two that differ in at most ``distance`` bits agree on m - ``distance``
    segments at least, so each choice of so many is a key, and every link has a key in common. m follows the number of
    fingerprints, which keeps the fingerprints of a key few at any size; any m finds all links. A key with more
    than ``block`` fingerprints is dealt into parts, and each pair of parts is one block, so no task holds more
    than two parts at once. A block's pairs are found by pivot distances; it returns a spanning forest of them, at
    most one edge for each of its fingerprints, never all pairs.
    """
    n = prints.count()
    m = next((m for m in range(distance + 1, 17) if n <= per_key << (64 * (m - distance) // m)), 16)
    at = [64 * i // m for i in range(m + 1)]
    masks = [sum(((1 << at[i + 1]) - (1 << at[i])) for i in chosen) for chosen in combinations(range(m), m - distance)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("print").bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("value")) for i, mask in enumerate(masks)]))
    keyed = prints.select("print", keys.alias("key"))
    crowded = cut(keyed.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    if crowded.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.struct("print", F.lit(0).alias("part")).alias("member"))
    else:
        parts = F.coalesce("parts", F.lit(1))
        dealt = (
            keyed.join(crowded, "key", "left")
            .select("key", "print", parts.alias("parts"), F.pmod(F.xxhash64("print"), parts).cast("int").alias("part"))
            .select("key", "print", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.struct("print", "part").alias("member"))
        )
    blocks = dealt.groupBy("key", "i", "j").agg(F.collect_list("member").alias("members")).filter(F.size("members") > 1)
    # in a block of one part, that part alone has pairs; a block of two parts compares across them
    return map_rows(blocks, ["members"], lambda: _block_edges(distance), "u long, v long")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK, per_key: int = PER_KEY) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links),
    text_md5 (a null text as empty; it tells rows that share an id apart), root (the component's least fingerprint as a number).

    Equal fingerprints are one node, however many rows share it. A text without words, null or empty, has fingerprint 0
    and links like any other. A row with a null doc_id is linked too; its component's id is the least id that isn't null,
    or null if there is none. Repeated rows repeat in the result; an empty table gives none.
    """
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("print"), distance, block, per_key))
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut(rooted.join(least, "root").select("print", "component_id", "root"))
    return prints.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "text_md5", "root")
