"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut, map_rows

#: Bits of a feature's number; labelled rows learned from, about, at most; learners that are averaged; passes over the rows.
BITS, SAMPLE, LEARNERS, PASSES = 18, 20_000, 4, 8
#: Learning rate and its offset, L1 and L2, chosen on a third of the rows that may be learned from.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.0, 0.1
THRESHOLD = 0.3
#: Words whose hash a task remembers.
REMEMBERED = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_BIGRAM, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: Column) -> Column:
    """Whether the CRC32 of the id as text leaves 2 on division by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Features:
    """The distinct features of a text: words, pairs of neighbours, and pairs with one word between, each hashed. Feature 0 is always on."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _hash(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 10)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        get, add = self.known.get, self._hash
        h = np.fromiter((get(w) or add(w) for w in words), np.uint64, len(words))
        pairs = (h[:-1] * _BIGRAM ^ h[1:]) * _SKIP
        skips = (h[:-2] * _SKIP ^ h[2:]) * _BIGRAM
        return np.unique(np.concatenate([[0], (np.concatenate([h, pairs, skips]) >> self.shift).astype(np.int64)]))


def weights(z: np.ndarray, n: np.ndarray, l1: float = L1) -> np.ndarray:
    """The weights that a learner's state stands for: 0 where L1 outweighs the gradients, else at the coordinate's own rate."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def probability(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def learn_row(z: np.ndarray, n: np.ndarray, features: np.ndarray, label: float, base: float = 0.0) -> None:
    """One step of FTRL-proximal on top of the log odds ``base``."""
    own_z, own_n = z[features], n[features]
    w = weights(own_z, own_n)
    gradient = probability(base + w.sum()) - label
    rate = (np.sqrt(own_n + gradient**2) - np.sqrt(own_n)) / ALPHA
    z[features] = own_z + gradient - rate * w
    n[features] = own_n + gradient**2


@dataclass
class Model:
    """The log odds of a text without known features, the features with a weight, and their weights."""

    base: float
    features: np.ndarray
    weights: np.ndarray


#: Nothing was learned: no text is called toxic, and every score is 0.
NOTHING = Model(-math.inf, np.zeros(0, np.int64), np.zeros(0))


def learn(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, learners: int = LEARNERS, passes: int = PASSES) -> Model:
    """The weights of the features, over the base rate of the labels.

    At most about ``sample`` labelled rows, taken by a hash of the id, are dealt to ``learners``; each starts a pass from the shared state
    and goes through its rows by hash; the states of those that had rows are averaged in a shuffle by feature. The state has 2 ** ``bits`` entries at most. Of several labels
    of one id the greatest counts; null labels and labels without a document don't. Rows that share an id are learned each. Without any labelled row the
    model is ``NOTHING``.
    """
    spark = docs.sparkSession
    labelled = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, labelled.count()))
    taken = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # broadcast: about `sample` rows of two numbers

    def make():
        features = Features(bits)
        return lambda c: {"doc_id": c[0], "label": c[2], "features": [features(t).tolist() for t in c[1]]}

    featured = map_rows(rows, ["doc_id", "text", "label"], make, "doc_id long, label double, features array<int>")
    order = F.xxhash64("doc_id", F.lit(1))
    dealt = cut(featured.withColumn("learner", F.pmod(order, F.lit(learners)).cast("int")).withColumn("rank", order).repartitionById(learners, F.col("learner")).sortWithinPartitions("rank", "features"))
    bad, known = dealt.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if not known:
        return NOTHING
    base = math.log((bad + 0.5) / (known - bad + 0.5))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own_z, own_n = (x.copy() for x in shared.value)
            some = False
            for batch in batches:
                for label, features in zip(batch.column("label").to_pylist(), batch.column("features")):
                    learn_row(own_z, own_n, features.values.to_numpy(), label, base)
                    some = True
            if some:
                moved = np.append(np.flatnonzero(own_n), len(own_n))  # the last row counts the learners
                yield pa.RecordBatch.from_pydict({"feature": pa.array(moved, pa.int32()), "z": np.append(own_z, 1.0)[moved], "n": np.append(own_n, 1.0)[moved]})

        parts = dealt.select("label", "features").mapInArrow(run, "feature int, z double, n double").groupBy("feature").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        at, z, n = parts.column("feature").to_numpy(), np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        z[at], n[at] = parts.column("z").to_numpy(), parts.column("n").to_numpy()
        z, n = z[:-1] / z[-1], n[:-1] / n[-1]
    w = weights(z, n)
    found = np.flatnonzero(w)
    return Model(base, found, w[found])


def score(docs: DataFrame, model: Model, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``score`` is the model's probability that the text is toxic; a null or empty text has that of the base rate and the constant feature, and by the model
    ``NOTHING`` every score is 0. Only the text is read for it. Repeated rows repeat; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, w, model = Features(bits), np.zeros(1 << bits), shared.value
        w[model.features] = model.weights

        def step(c):
            scores = probability(np.array([model.base + w[features(t)].sum() for t in c[1]])) if math.isfinite(model.base) else np.zeros(len(c[1]))
            return {"doc_id": c[0], "held_out": c[2], "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

        return step

    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return map_rows(rows, ["doc_id", "text", "held_out"], make, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, and score all."""
    return score(docs, learn(docs, labels))
