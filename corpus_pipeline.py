"""A corpus from raw documents to packed training sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import decontam, exact, langid, packing, simhash
from headway.llm.common import cut, shared_path
from headway.llm.queries import TOKENIZER, table


def _free(docs: DataFrame, name: str) -> str:
    """The name, or one like it that no column of ``docs`` has."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def _same(docs: DataFrame, digest: Column, keys: DataFrame) -> Column:
    """Whether a row of ``docs`` is one that a key (key_id, key_text) names; null ids are equal. An id alone doesn't name a row, since ids may repeat."""
    return docs["doc_id"].eqNullSafe(keys["key_id"]) & (digest == keys["key_text"])


def _md5(docs: DataFrame) -> Column:
    return F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))


def _without(docs: DataFrame, digest: Column, keys: DataFrame, sift: bool = True) -> DataFrame:
    """The rows that no key (key_id, key_text) names. Rows that are dropped are few beside those that stay, so the keys are theirs.

    With ``sift`` a filter of bounded size (16 MB at most) goes out first: rows that it doesn't know are none of the keys' and stay where they are, and only the others, the dropped ones and a
    few, are shuffled with their texts to meet the keys. A full filter lets more rows into the join, which decides.
    """
    keys = keys.select("key_id", "key_text").distinct()
    named = _same(docs, digest, keys)
    if not sift:
        return docs.join(keys, named, "left_anti")
    known = docs.sparkSession.sparkContext.broadcast(decontam.filter_of(keys.select(F.xxhash64("key_id", "key_text").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(known.value.has(h.to_numpy().view(np.uint64)))

    name = _free(docs, "maybe")
    marked = docs.withColumn(name, maybe(F.xxhash64(docs["doc_id"], digest)))
    return marked.filter(~F.col(name)).union(marked.filter(F.col(name)).join(keys, named, "left_anti")).drop(name)


def _once(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """``docs`` without what repeats: of rows with one id and text that stay, any one. ``kept`` (key_id, key_text) names every row that stays."""
    repeated = cut(kept.groupBy("key_id", "key_text").agg(F.count("*").alias("times")).filter("times > 1"))
    if repeated.isEmpty():
        return docs
    name = _free(docs, "digest")
    many = docs.join(repeated, _same(docs, digest, repeated), "left_semi").withColumn(name, digest).dropDuplicates(["doc_id", name])
    return _without(docs, digest, repeated, sift=False).union(many.drop(name))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the corpus' languages. Those without text or without a letter go, and those with enough text to judge whose profile comes no nearer to any learned
    language than chance does (``langid.verdict_of``): other scripts, other languages, keyboard junk. Texts too short or too uniform to judge stay.

    ``lang`` stays where it is set, and is the language found where it is null and the verdict is sure. In a corpus without labels none can be found: then all
    documents with a letter stay as they are. Rows are judged each by its own text, so rows that share an id don't matter to each other; repeated rows
    repeat, an empty table stays empty, and further columns are kept.
    """
    model = langid.learned(docs)
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score, verdict = _free(docs, "lang_pred"), _free(docs, "score"), _free(docs, "verdict")
    found = langid.marked(docs, model, pred, score, verdict).filter(F.col(verdict) != langid.NONE)
    return found.withColumn("lang", F.coalesce("lang", F.when(F.col(verdict) == langid.FOUND, F.col(pred)))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id; null text equals empty text.

    Of rows that repeat id and text, any one stays; rows that share an id and differ in text are apart. A row with a null id stays only where its whole
    group has none. An empty table stays empty; further columns are kept.
    """
    found = exact.exact_dedup(docs).select(F.col("doc_id").alias("key_id"), F.col("text_sha256").alias("key_text"), "kept")
    digest = F.sha2(exact.normalised(docs["text"]), 256)
    found = cut(found)
    return _once(_without(docs, digest, found.filter("NOT kept"), sift=False), digest, found.filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints, the one with the smallest id; of its rows, if the id repeats, the one whose text has the
    least digest. Null ids come last. An empty table stays empty; further columns are kept."""
    found = cut(simhash.near_dedup(docs).select("root", F.col("doc_id").alias("key_id"), F.col("text_md5").alias("key_text")))
    order = F.struct(F.col("key_id").isNull().alias("none"), "key_id", "key_text")
    # the least row of each component of two and more; rows alone in theirs stay without a look
    first = cut(found.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("n")).filter("n > 1"))
    shared = found.join(first, "root")
    dropped = shared.filter(~F.struct(F.col("key_id").isNull().alias("none"), "key_id", "key_text").eqNullSafe(F.col("k")))
    kept = shared.filter(F.struct(F.col("key_id").isNull().alias("none"), "key_id", "key_text").eqNullSafe(F.col("k")))
    return _once(_without(docs, _md5(docs), cut(dropped)), _md5(docs), kept)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window. A row goes for its own text only, whichever rows share its id; null and empty
    texts stay, repeated rows repeat, an empty table stays empty, and further columns are kept."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    return _without(docs, _md5(docs), cut(found.select(F.col("doc_id").alias("key_id"), F.col("text_md5").alias("key_text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("pack", pack),
]
#: SQL has no tokenizer, fingerprints or cuts; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
