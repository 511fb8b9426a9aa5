"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.llm.common import map_rows

#: Dimensions; seed of the letters' vectors; labelled rows of a language that are learned from, about, at most.
DIMENSIONS, SEED, PER_LANGUAGE = 1024, 9, 20_000
#: Labels that are learned at most, the most frequent ones: with PER_LANGUAGE it bounds the sample.
LANGUAGES = 1000
#: Characters, documents and trigrams handled at once.
CHARACTERS, DOCUMENTS, SLICE = 1 << 19, 256, 4096
UNKNOWN = "und"

_SPACE, _BREAK = 32, 0


def is_held_out(doc_id: Column) -> Column:
    """Whether the CRC32 of the id as text leaves 1 on division by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what isn't a letter; 0 is the break between texts."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[0] = _BREAK
    return table


@lru_cache(4096)
def _vector(letter: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, letter]).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The alphabet (letters, ascending), the distinct trigrams as three places in it, and of each occurrence its trigram and its text.

    Runs of other characters are one space, and a text begins and ends with one.
    """
    joined = "\0".join(["", *(t.replace("\0", " ") for t in texts), ""])
    a = _letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    a = a[~((a == _SPACE) & (np.r_[_BREAK, a[:-1]] <= _SPACE))]
    a = a[~((a == _SPACE) & (np.r_[a[1:], _BREAK] == _BREAK))]
    # breaks act as the spaces around a text
    text = np.cumsum(a == _BREAK) - 1
    alphabet, place = np.unique(np.where(a == _BREAK, _SPACE, a), return_inverse=True)
    k = len(alphabet)
    middle = np.flatnonzero(a[1:-1] != _BREAK) + 1
    codes = (place[middle - 1].astype(np.int64) * k + place[middle]) * k + place[middle + 1]
    if k**3 <= 1 << 22:
        seen = np.zeros(k**3, bool)
        seen[codes] = True
        distinct = np.flatnonzero(seen)
        at = np.zeros(k**3, np.int32)
        at[distinct] = np.arange(len(distinct))
        which = at[codes]
    else:
        distinct, which = np.unique(codes, return_inverse=True)
    return alphabet, np.stack([distinct // (k * k), distinct // k % k, distinct % k]), which, text[middle]


def bundled(texts: list[str], dimensions: int) -> np.ndarray:
    """The sum of each text's trigrams' vectors, of which each binds its letters' vectors, the first shifted by two, the second by
    one. Trigrams are bundled SLICE at a time, so memory doesn't grow with their number."""
    alphabet, grams, which, text = trigrams(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(which):
        return out
    letters = np.stack([_vector(int(x), dimensions) for x in alphabet])
    second, first = np.roll(letters, 1, 1), np.roll(letters, 2, 1)
    for at in range(0, grams.shape[1], SLICE):
        a, b, c = grams[:, at : at + SLICE]
        here = slice(None) if grams.shape[1] <= SLICE else np.flatnonzero((which >= at) & (which < at + SLICE))
        counts = np.bincount(text[here] * len(a) + which[here] - at, minlength=len(texts) * len(a)).reshape(len(texts), -1)
        out += counts.astype(np.float32) @ (first[a] * second[b] * letters[c]).astype(np.float32)
    return out


def profiles(texts: list[str], dimensions: int) -> np.ndarray:
    """Each text's vector; a text of more than CHARACTERS is the sum of pieces of so many, so no text takes more memory than these."""
    pieces = [(i, t[p : p + CHARACTERS]) for i, t in enumerate(texts) for p in range(0, max(1, len(t)), CHARACTERS)]
    out = np.zeros((len(texts), dimensions), np.float32)
    for a, b in groups([t for _, t in pieces]):
        np.add.at(out, [i for i, _ in pieces[a:b]], bundled([t for _, t in pieces[a:b]], dimensions))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def groups(texts: list[str]):
    """Ranges of texts to handle at once; a range has a text more than CHARACTERS need at most."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARACTERS or i + 1 - at >= DOCUMENTS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the prototype of each: the sum of its texts' profiles, each scaled to length one.

    Of a language with more than ``per_language`` rows about so many are taken, by a hash of the id, and of more than ``languages`` labels the most
    frequent, ties by name; these bound the sample. Each task adds up its own
    rows, so the rows that are added after it are one a task and language, however frequent a language is.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    share = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    share = docs.sparkSession.createDataFrame(share.collect(), "lang string, count long")
    names = sorted(r["lang"] for r in share.collect())
    if not names:
        return [], np.zeros((0, dimensions), np.float32)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("count") < (1 << 20) * per_language
    taken = known.join(F.broadcast(share), "lang").filter(drawn)  # a row a label, at most `languages`

    def make():
        def step(c):
            total = {n: np.zeros(dimensions) for n in set(c[1])}
            for a, b in groups(c[0]):
                # whole numbers, so that the sum doesn't depend on the order
                vectors = np.rint(unit(profiles(c[0][a:b], dimensions)) * 1e6)
                for name, v in zip(c[1][a:b], vectors):
                    total[name] += v
            return {"lang": list(total), "vector": [v.astype(np.int64).tolist() for v in total.values()]}

        return step

    parts = map_rows(taken, ["text", "lang"], make, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    # a row a language, packed: at most languages x dimensions numbers of eight bytes
    packed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select("lang", F.transform("v", lambda x: x["value"]).alias("v")).toArrow()
    found = {lang: packed.column("v").combine_chunks()[i].values.to_numpy() for i, lang in enumerate(packed.column("lang").to_pylist())}
    table = np.array([found.get(n, np.zeros(dimensions)) for n in names], float)
    return names, unit(table).astype(np.float32)


#: Distinct trigrams that a text needs to be judged, and the cosine that its language must reach, and lead the second by, in deviations of chance
#: (1 / sqrt(dimensions)): unrelated profiles stay under it.
VARIETY, LEAST, LEAD = 25, 4.0, 1.0
#: Verdicts: a language was found; the text says too little, or leans to two; it is in none of the languages.
FOUND, UNSURE, NONE = "found", "unsure", "none"


def verdict_of(text: str, best: float, second: float, dimensions: int) -> str:
    """What a text with letters says: its language, too little, or none of the languages.

    A cosine under LEAST deviations is what chance gives. A text of at least VARIETY distinct trigrams is then in none of the languages; one of fewer, such as a word or the same word over and over, is
    left unjudged. Otherwise a language is found if it leads the second by LEAD deviations.
    """
    deviation = dimensions**-0.5
    if best >= LEAST * deviation:
        return FOUND if best - second >= LEAD * deviation else UNSURE
    low = text.lower()
    return NONE if len({x for x in zip(low, low[1:], low[2:]) if x[1].isalpha()}) >= VARIETY else UNSURE


def marked(docs: DataFrame, model: tuple[list[str], np.ndarray], pred: str = "lang_pred", score: str = "score", verdict: str | None = None) -> DataFrame:
    """The rows of ``docs``, whole, with the language found and its score as two more columns, and if asked for a third with the verdict (``verdict_of``), whose names
    ``docs`` must not have.

    The language is the one whose prototype has the greatest cosine with the text's profile, the first by name of equal ones, and the score that cosine,
    or 0 if negative. A text that is null or has no letter is ``und`` with score 0 and verdict none, and every text is ``und``, with letters unsure, if no
    language was learned. Only the text is read for it. Repeated rows repeat; an empty table gives no rows.
    """
    names, table = model
    dimensions = table.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def found(texts: list[str]) -> tuple[list[str], list[float], list[str]]:
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        letters = [any(x.isalpha() for x in t) for t in texts]
        verdicts = [UNSURE if x else NONE for x in letters]
        for a, b in groups(texts) if names else ():
            cosine = unit(profiles(texts[a:b], dimensions)) @ shared.value.T
            second = np.partition(cosine, -2, 1)[:, -2] if len(names) > 1 else np.full(b - a, -1.0)
            for i, k in enumerate(cosine.argmax(1).tolist()):
                if letters[a + i]:
                    languages[a + i], scores[a + i] = names[k], float(min(1, max(0, cosine[i, k])))
                    if verdict:
                        verdicts[a + i] = verdict_of(texts[a + i], float(cosine[i, k]), float(second[i]), dimensions)
        return languages, scores, verdicts

    more = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(verdict, T.StringType())] if verdict else [])]
    schema = T.StructType([*docs.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = found([t or "" for t in batch.column("text").to_pylist()])
            new = [pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), *([pa.array(made[2], pa.string())] if verdict else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def learned(docs: DataFrame, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """What the rows that aren't held out teach."""
    return learn(docs.filter(~is_held_out(F.col("doc_id"))), dimensions, per_language)


def language_id(docs: DataFrame, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. Learns from the rows that aren't held out, and marks all."""
    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return marked(rows, learned(docs, dimensions, per_language)).drop("text")
