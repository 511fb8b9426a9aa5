"""Phrase collocation mining: frequent contiguous phrases by pattern growth, scored by their weakest cut."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut
from headway.llm.decontam import Filter, filter_of
from headway.operators.ranking import numbered_by

#: Occurrences that make a phrase a candidate, words of the longest phrase, per cent of a phrase that a longer one must reach to swallow it, phrases
#: returned for each language.
LEAST, LONGEST, SWALLOW, TOP = 10, 3, 50, 2000
#: Words that a task looks at before it hands over pointers, and distinct words that it counts or remembers at most.
CHUNK, REMEMBERED = 1_500_000, 1_000_000
#: Pointers of a part of a hot prefix: a share of all words, within bounds; so there are at most 2**20 hot prefixes.
PART_SHARE, PART_MOST, HOT_SHARE = 1 << 12, 4_000_000, 1 << 20

#: Bytes in place of bytes: A-Z in lower case, the ends of pieces as one full stop, a tab as a space.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_END = b"."


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with ``b"."`` wherever a piece ends; no byte of a longer UTF-8 character is one of those replaced."""
    return text.translate(_BYTES).replace(_END, b" . ").split()


def lang_seed(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{lang}\n{seed}".encode(), 42)


def word_id(lang: Column, word: Column, seed: int) -> Column:
    """XXH64 of the word's bytes, with the language's own seed, as a task forms it too."""
    return F.xxhash64(F.concat(lang, F.lit(f"\n{seed}")), word)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        if text:
            yield lang, text


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f), summed within tasks as far as REMEMBERED words go, then by Spark."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(_END, None)
            words, f = pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())
            for at in range(0, len(words), 10_000):
                part = words.slice(at, 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part.cast(pa.string()), f.slice(at, 10_000)], ["lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in _texts(batch):
                counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > REMEMBERED:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal rows."""
    change = sorted_values[1:] != sorted_values[:-1]
    starts = np.flatnonzero(np.r_[True, change if change.ndim == 1 else change.any(1)])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def _ordered(tails: np.ndarray) -> np.ndarray:
    return np.lexsort(tails.T[::-1])


def grow(prefix: list[int], tails: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """Frequent phrases that begin with ``prefix``, depth first. ``tails`` are the words behind each of its occurrences, in ascending order; a zero ends a
    tail. Each frequent next word makes a longer prefix, onto which the tails behind it are projected."""
    if not len(tails):
        return
    starts, lengths = _runs(tails[:, 0])
    frequent = (lengths >= least) & (tails[starts, 0] != 0)
    for at, n in zip(starts[frequent].tolist(), lengths[frequent].tolist()):
        longer = [*prefix, int(tails[at, 0])]
        yield longer, n
        if tails.shape[1] > 1:
            yield from grow(longer, tails[at : at + n, 1:], least)


def _pointers(texts: DataFrame, seed: int, frequent: Filter, hot: dict[int, int], longest: int) -> DataFrame:
    """(prefix, part, depth, tails, counts): the words behind occurrences of each frequent word, packed.

    A word's occurrences go to one part with all their tails (depth 0), which may end early. Those of a hot word go to several: for each depth once, by
    the hash of the tail of just so many words, and equal tails as one with their count. So all equal tails meet in one part, and
    a hot prefix with a hot next word is a row per chunk.
    """
    shared = texts.sparkSession.sparkContext.broadcast((frequent, hot))
    kinds = pa.schema([("prefix", pa.int64()), ("part", pa.int32()), ("depth", pa.int32()), ("tails", pa.binary()), ("counts", pa.binary())])

    def packed(prefix, part, depth, tails, counts) -> Iterator[pa.RecordBatch]:
        """A row for each run of equal (prefix, part); its tails are a slice of one buffer."""
        if not len(prefix):
            return
        starts, _ = _runs(np.stack([prefix, part], 1))
        ends, n = np.r_[starts, len(prefix)], len(starts)

        def binary(values: np.ndarray, width: int) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

        whole = pa.RecordBatch.from_arrays(
            [pa.array(prefix[starts]), pa.array(part[starts].astype(np.int32)), pa.array(np.full(n, depth, np.int32)), binary(tails, 8 * tails.shape[1]), pa.nulls(n, pa.binary()) if counts is None else binary(counts, 8)],
            schema=kinds,
        )
        for at in range(0, n, 10_000):
            yield whole.slice(at, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = shared.value
        hot_ids = np.array(sorted(hot), np.int64)
        hot_parts = np.array([hot[i] for i in hot_ids.tolist()], np.int64)
        known: dict[str, dict[bytes, int]] = {}

        def ids_of(lang: str, words: list[bytes]) -> np.ndarray:
            ids = known.setdefault(lang, {_END: 0})
            found = list(map(ids.get, words))
            if None in found:
                start, new = lang_seed(lang, seed), list({w for w, i in zip(words, found) if i is None})
                hashes = np.array([xxhash.xxh64_intdigest(w, start) for w in new], np.uint64)
                ids.update(zip(new, np.where(frequent.has(hashes), hashes.view(np.int64), 0).tolist()))
                found = list(map(ids.get, words))
            return np.array([*found, 0], np.int64)

        def flush(pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([*pieces, np.zeros(longest - 1, np.int64)])
            n = len(ids) - longest + 1
            at = np.flatnonzero((ids[:n] != 0) & (ids[1 : n + 1] != 0))
            tails = np.stack([ids[at + k] for k in range(1, longest)], 1)
            for k in range(1, longest - 1):
                tails[tails[:, k - 1] == 0, k] = 0
            prefix = ids[at]
            place = np.minimum(np.searchsorted(hot_ids, prefix), max(0, len(hot_ids) - 1))
            is_hot = hot_ids[place] == prefix if len(hot_ids) else np.zeros(len(prefix), bool)
            order = np.flatnonzero(~is_hot)
            order = order[np.argsort(prefix[order], kind="stable")]
            yield from packed(prefix[order], np.zeros(len(order), np.int64), 0, tails[order], None)
            for depth in range(1, longest if is_hot.any() else 1):
                here = np.flatnonzero(is_hot & (tails[:, depth - 1] != 0))
                rows = np.column_stack([prefix[here], tails[here, :depth]])
                mixed = np.full(len(here), depth, np.uint64)
                for k in range(depth):
                    mixed = (mixed ^ rows[:, k + 1].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(32)
                rows = np.column_stack([rows[:, 0], (mixed % hot_parts[place[here]].astype(np.uint64)).astype(np.int64), rows[:, 1:]])
                rows = rows[_ordered(rows)]
                if len(rows):
                    starts, counts = _runs(rows)
                    rows = rows[starts]
                    yield from packed(rows[:, 0], rows[:, 1], depth, rows[:, 2:], counts)

        pieces, size = [], 0
        for batch in batches:
            for lang, text in _texts(batch):
                pieces.append(ids_of(lang, words_of(text)))
                size += len(pieces[-1])
                if size >= CHUNK:
                    yield from flush(pieces)
                    pieces, size = [], 0
                if sum(map(len, known.values())) > REMEMBERED:
                    known.clear()
        if pieces:
            yield from flush(pieces)

    return texts.mapInArrow(run, "prefix long, part int, depth int, tails binary, counts binary")


def _grown(pointers: DataFrame, least: int, longest: int) -> DataFrame:
    """(ids, a): frequent phrases of two words and more. Rows of one (prefix, part, depth) meet in a task, one group after the other."""
    rows = pointers.repartition("prefix", "part", "depth").sortWithinPartitions("prefix", "part", "depth")

    def of_group(key: tuple, tails: list[bytes], counts: list[bytes]) -> Iterator[tuple[list[int], int]]:
        prefix, _, depth = key
        rows = np.frombuffer(b"".join(tails), np.int64).reshape(-1, depth or longest - 1)
        order = _ordered(rows)
        rows = rows[order]
        if not depth:
            yield from grow([prefix], rows, least)
        elif len(rows):
            starts, _ = _runs(rows)
            sums = np.add.reduceat(np.frombuffer(b"".join(counts), np.int64)[order], starts)
            for at, n in zip(starts[sums >= least].tolist(), sums[sums >= least].tolist()):
                yield [prefix, *rows[at].tolist()], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            now, tails, counts = None, [], []
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for p, part, depth, t, c in zip(*columns):
                    if (p, part, depth) != now:
                        if now:
                            yield now, tails, counts
                        now, tails, counts = (p, part, depth), [], []
                    tails.append(t)
                    counts.append(c)
            if now:
                yield now, tails, counts

        ids, a = [], []
        for group in groups():
            for phrase, n in of_group(*group):
                ids.append(phrase)
                a.append(n)
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(a, pa.int64())], ["ids", "a"])
                ids, a = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(a, pa.int64())], ["ids", "a"])

    return rows.mapInArrow(run, "ids array<long>, a long")


def _cuts(found: DataFrame, words: DataFrame) -> DataFrame:
    """ids, a, and of the cut with the lowest score (of ties, after the fewest words): score, l, r. Sums and products are decimals without fractions."""
    counts = words.select(F.array("id").alias("part"), "f").union(found.select(F.col("ids").alias("part"), F.col("a").alias("f")))
    each = found.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    each = each.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    each = each.join(counts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    each = each.select("ids", "a", F.struct(F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a")), whole("l") * whole("r")).alias("score"), "k", "l", "r").alias("cut"))
    return each.groupBy("ids").agg(F.first("a").alias("a"), F.min("cut").alias("cut")).select("ids", "a", "cut.score", "cut.l", "cut.r")


def _inside(m: int) -> Column:
    """The runs of m words in a phrase."""
    return F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda at: F.slice("ids", at, m))


def _swallowed(found: DataFrame, longest: int, swallow: int) -> DataFrame:
    """The phrases that a longer one holds and comes near in number."""
    longer = None
    for m in range(2, longest):
        here = found.filter(F.size("ids") > m).select(F.explode(_inside(m)).alias("ids"), F.col("a").alias("most"))
        longer = here if longer is None else longer.union(here)
    if longer is None:
        return found.select("ids").limit(0)
    most = longer.groupBy("ids").agg(F.max("most").alias("most"))
    return found.join(most, "ids").filter(F.lit(100) * F.col("most") >= F.lit(swallow) * F.col("a")).select("ids")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, swallow: int = SWALLOW, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are counted first. Then each occurrence of a frequent word is a pointer with the words behind it, up to the first that isn't frequent or ends the
    piece; a task gets the pointers of one first word and grows its phrases to the right, depth first, projecting the pointers onto each frequent next word.
    First words with many pointers are dealt over several tasks (``_pointers``), and none is left out or cut short. In the tasks a word is a
    64-bit hash; the word table shows whether two words share one, and then the hashes are formed anew with another seed, so results are exact.
    Which words are frequent goes out as a filter of bounded size; what it lets pass besides is never frequent and falls away.

    A null text is empty, a null lang ``und``. Repeated rows count each time; doc_id isn't read, so nulls and ties there don't matter. Equal scores and
    counts are ordered by the phrase's bytes, so ranks never depend on the run. A language without a candidate has no rows, nor has an empty table. Columns
    but lang and text are not read.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = cut(_word_counts(texts))
    totals = cut(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    for seed in range(1000):
        words = cut(counted.filter(F.col("f") >= least).withColumn("id", word_id(F.col("lang"), F.col("word"), seed)))
        every = counted.select(word_id(F.col("lang"), F.col("word"), seed).alias("id"))
        if words.isEmpty() or every.groupBy("id").count().filter("count > 1 OR id = 0").isEmpty():
            break
    limit = max(total // HOT_SHARE, min(PART_MOST, total // PART_SHARE), 1)
    hot = {r["id"]: -(-r["f"] // limit) for r in words.filter(F.col("f") > limit).select("id", "f").collect()}  # at most HOT_SHARE rows
    found = cut(_grown(_pointers(texts, seed, filter_of(words.select("id"), "id"), hot, longest), least, longest))
    kept = cut(_cuts(found, words).join(_swallowed(found, longest, swallow), "ids", "left_anti"))
    named = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word", "lang"), "id")
    named = named.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(named, "ids")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = numbered_by(rows, ["lang"], best, "rank").filter(F.col("rank") < top).withColumn("rank", F.col("rank") + 1)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f1 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM pieces) GROUP BY ALL),
f2 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM pieces WHERE len(w) > 1) GROUP BY ALL),
f3 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS p FROM pieces WHERE len(w) > 2) GROUP BY ALL),
c AS (SELECT lang, p AS phrase, f AS a, string_split(p, ' ') AS w FROM f2 WHERE f >= 10 UNION ALL SELECT lang, p, f, string_split(p, ' ') FROM f3 WHERE f >= 10),
f AS (FROM f1 UNION ALL FROM f2),
cuts AS (SELECT c.lang, phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.p = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.p = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE len(w) = 3) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best JOIN n USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""
