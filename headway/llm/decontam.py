"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut, map_rows

#: Words in a k-gram, and words of a shared span that is always found.
GRAM, SPAN = 5, 10
#: 64-bit words of a filter at least and at most (16 MB).
LEAST, MOST = 1 << 10, 1 << 21

#: Bytes of UTF-8: A-Z in lower case, and a space for what is in no word, [\x00-\x2f\x3a-\x60\x7b-\x7f]. Those of other characters are 128 and more.
_LOWER = bytes(range(256)).lower()
_CUTS = bytes(b if b >= 128 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in _LOWER)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words in UTF-8, with A-Z in lower case; null has none."""
    text = text or b""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_CUTS).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words, from the words' hashes."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h + words[i : i + n] + np.uint64(0x632BE59BD9B4E019))
    return h


def window_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The same for the k words from each of ``starts``."""
    h = np.full(len(starts), k, np.uint64)
    for i in range(k):
        h = _mixed(h + words[starts + i] + np.uint64(0x632BE59BD9B4E019))
    return h


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minimum of each window of hashes, the rightmost of equal ones; each position once."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    best, low = at.copy(), hashes[:n]
    for i in range(1, window):
        here = hashes[i : i + n] <= low
        best, low = np.where(here, at + i, best), np.where(here, hashes[i : i + n], low)
    return best[np.r_[True, best[1:] != best[:-1]]]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


class Filter:
    """A set of 64-bit hashes in a table of fixed size: a hash that was put in is always found, another one seldom."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, np.uint64(64 - (len(table).bit_length() - 1))

    def has(self, h: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        bits = one << (h & np.uint64(63)) | one << (h >> np.uint64(6) & np.uint64(63))
        return self.table[h >> self.shift] & bits == bits


def filter_of(hashes: DataFrame, column: str) -> Filter:
    """The filter of a column of longs. Tasks put their rows together by place in the table, of which there are at most MOST."""
    size = LEAST
    while size < min(hashes.count(), MOST):
        size *= 2
    place = F.shiftrightunsigned(column, 64 - (size.bit_length() - 1)).cast("int")
    bits = F.expr(f"shiftleft(1L, cast({column} & 63 AS INT)) | shiftleft(1L, cast(shiftrightunsigned({column}, 6) & 63 AS INT))")
    rows = hashes.select(place.alias("place"), bits.alias("bits")).groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size, np.int64)
    table[rows.column("place").to_numpy()] = rows.column("bits").to_numpy()
    return Filter(table.view(np.uint64))


def _second(words: list[bytes], starts: np.ndarray, size: int) -> np.ndarray:
    """A second hash, independent of the first, of the windows of ``size`` words at ``starts``."""
    known: dict[bytes, int] = {}
    inside = [[known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w, 77)) for w in words[p : p + size]] for p in starts.tolist()]
    h = np.full(len(starts), size, np.uint64)
    for column in np.array(inside, np.uint64).reshape(len(starts), size).T:
        h = _mixed(h * np.uint64(0xD1342543DE82EF95) + column)
    return h


def _windows(items: DataFrame, gram: int, span: int) -> DataFrame:
    """For each text (g, text): its fingerprints, its windows' hashes and their size."""

    def step(c):
        out = {k: [] for k in ("g", "prints", "size", "windows")}
        for g, text in zip(*c):
            words = words_of(text)
            size = min(span, len(words))
            if size:
                h = word_hashes(words)
                grams = gram_hashes(h, gram)
                first, second = gram_hashes(h, size), _second(words, np.arange(len(words) - size + 1), size)
                prints = np.unique(grams[winnow(grams, span - gram + 1)]) if size == span else np.zeros(0, np.uint64)
                rows = [{"h1": a, "h2": b} for a, b in zip(first.view(np.int64).tolist(), second.view(np.int64).tolist())]
                for k, v in zip(out, (g, prints.view(np.int64).tolist(), size, rows)):
                    out[k].append(v)
        return out

    return map_rows(items, ["g", "text"], lambda: step, "g long, prints array<long>, size int, windows array<struct<h1:long,h2:long>>")


def _candidates(docs: DataFrame, prints: Filter, windows: Filter, short: list[int], gram: int, span: int, with_span: bool) -> DataFrame:
    """doc_id, text_md5, n_words and, as ``found``, the windows that the filters let pass: hashes, size, starts."""
    shared = docs.sparkSession.sparkContext.broadcast((prints, windows))

    def make():
        prints, windows = shared.value

        def spots(h):
            """(size, starts) of the windows to be looked up."""
            if with_span and len(h) >= span:
                grams = gram_hashes(h, gram)
                at = winnow(grams, span - gram + 1)
                at = at[prints.has(grams[at])]
                # extend each hit to every window of words that its k-gram lies in
                around = np.unique((at[:, None] - np.arange(span - gram + 1)[None, :]).ravel())
                around = around[(around >= 0) & (around <= len(h) - span)]
                if len(around):
                    yield span, around, window_hashes(h, around, span)
            for size in short:
                if len(h) >= size:
                    yield size, np.arange(len(h) - size + 1), gram_hashes(h, size)

        def step(c):
            out = {"doc_id": c[0], "text_md5": c[1], "n_words": [], "found": []}
            for text in c[2]:
                words, found = words_of(text), {}
                for size, starts, first in spots(word_hashes(words)):
                    here = np.flatnonzero(windows.has(first))
                    if len(here):
                        second = _second(words, starts[here], size).view(np.int64).tolist()
                        for a, b, p in zip(first[here].view(np.int64).tolist(), second, starts[here].tolist()):
                            found.setdefault((a, b, size), []).append(p)
                out["n_words"].append(len(words))
                out["found"].append([{"h1": a, "h2": b, "size": n, "starts": p} for (a, b, n), p in found.items()])
            return out

        return step

    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.col("text").cast("binary").alias("text"))
    return map_rows(rows, ["doc_id", "text_md5", "text"], make, "doc_id long, text_md5 string, n_words long, found array<struct<h1:long,h2:long,size:int,starts:array<int>>>")


def _merged(hits: DataFrame) -> DataFrame:
    """(row, spans): starts and ends of the runs of words that the hits (size, starts) cover."""

    def step(c):
        spans = []
        for found in c[1]:
            start = np.concatenate([np.array(x["starts"], np.int64) for x in found])
            end = start + np.repeat([x["size"] for x in found], [len(x["starts"]) for x in found])
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
            spans.append(np.stack([start[first], reach[np.r_[first[1:] - 1, len(start) - 1]]], 1).ravel().tolist())
        return {"row": c[0], "spans": spans}

    return map_rows(hits, ["row", "hits"], lambda: step, "row long, spans array<int>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_md5, n_words, n_hit, spans (starts and ends of runs of hit words), items (item_ids
    as strings, sorted).

    A word is hit if it lies in an occurrence of ``span`` consecutive words of an item, or of a whole shorter item.
    Both sides are winnowed: of each window of k-gram hashes the least is kept, so that a shared span of ``span``
    words shares a fingerprint. The items' fingerprints and windows go out as two filters of bounded size, however large the benchmark is.
    A document's fingerprint that its filter knows is extended to the windows of words it lies in, and those that
    their filter knows become rows, one for each document and distinct window, which meet the items' windows in a join by two
    independent 64-bit hashes. So filters only spare work: a full one lets more rows into the join, which decides.
    Items of equal text are one, and equal sets of items are named once, so neither copies of items nor of documents make pairs.

    Null and empty texts have no words and no hits; items without words never occur. Repeated rows repeat in the result; ``text_md5``
    (a null text as empty) tells rows that share an id apart. Items that
    repeat an item_id count once; a null item_id is left out of ``items`` but its words are hit. Empty tables are allowed on both sides.
    """
    texts = benchmark.filter("text IS NOT NULL").groupBy("text").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    texts = cut(texts).withColumn("g", F.monotonically_increasing_id())  # numbered after the cut, so they stay what they are
    made = cut(_windows(texts, gram, span))
    each = made.select("g", "size", F.explode("windows").alias("w")).select("g", "size", "w.*")
    windows = cut(each.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("g")).alias("gs")).withColumn("named", F.md5(F.to_json(F.struct("gs")))))
    sizes = sorted(r["size"] for r in made.select("size").distinct().collect())  # at most `span`
    prints = filter_of(made.select(F.explode("prints").alias("h1")).distinct(), "h1")
    seen = cut(_candidates(docs, prints, filter_of(windows.select("h1"), "h1"), [n for n in sizes if n < span], gram, span, span in sizes))
    rows = seen.withColumn("row", F.monotonically_increasing_id())
    hits = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("w")).select("row", "w.*").join(windows.select("h1", "h2", "named"), ["h1", "h2"])
    hits = cut(hits.groupBy("row").agg(F.collect_list(F.struct("size", "starts")).alias("hits"), F.collect_set("named").alias("sets")))
    flat: Column = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    sets = windows.select("named", "gs").distinct().select("named", F.explode("gs").alias("g")).join(texts.select("g", "ids"), "g").groupBy("named").agg(flat.alias("ids"))
    items = hits.select("row", F.explode("sets").alias("named")).join(sets, "named").groupBy("row").agg(flat.alias("items"))
    out = rows.select("row", "doc_id", "text_md5", "n_words").join(_merged(hits), "row", "left").join(items, "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<int>"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: x - a)  # ends minus starts, as the signs alternate
    return out.select("doc_id", "text_md5", "n_words", hit.alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS span FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS span FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, span)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
