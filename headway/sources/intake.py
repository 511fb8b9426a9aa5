"""Incremental intake of files that a cache fills: a manifest of what was seen, rows of new and changed files, and bad files apart."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.text import MAJOR

#: Files whose names one read is given, and bytes up to which a file counts as an empty answer.
BATCH, EMPTY = 10_000, 2
#: What the manifest holds: a file as it was seen, the batch that took it in, and whether it was read, empty or bad.
SEEN = "path string, length long, modificationTime timestamp, batch string, taken timestamp, state string"


def listing(spark: SparkSession, source: str) -> DataFrame:
    """(path, length, modificationTime) of the files of a folder or pattern; no file is opened. A source without files has none."""
    try:
        return spark.read.format("binaryFile").load(source).select("path", "length", "modificationTime")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """Each file's newest entry."""
    try:
        rows = spark.read.schema(SEEN).parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SEEN)
    newest = F.max_by(F.struct(*[c.split()[0] for c in SEEN.split(", ")]), F.struct("taken", "batch")).alias("m")
    return rows.groupBy("path").agg(newest).select("m.*")


def take_in(spark: SparkSession, source: str, store: str, schema: str) -> int:
    """Read the JSON files that are new or have changed since the last run, and return their number.

    A file is known by path, length and time, so a run over unchanged files opens none. Each batch of files is written under a name of its own, rows first and its part of the manifest last; a batch
    that breaks off has no entry, counts for nothing and is read again. Files that aren't a document of the schema are set apart as bad, with their text. One run at a
    time may write to a store.
    """
    known = manifest(spark, store).select("path", "length", "modificationTime")
    new = listing(spark, source).join(known, ["path", "length", "modificationTime"], "left_anti")
    todo = new.orderBy("path").limit(BATCH).collect()  # names only, BATCH at most
    taken = 0
    while todo:
        batch = uuid.uuid4().hex
        files = spark.read.format("binaryFile").load([r["path"] for r in todo])
        text = F.col("content").cast("string")
        read = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        state = F.when(F.col("length") <= EMPTY, "empty").when(F.col("document").isNull() | F.col("document._corrupt").isNotNull(), "bad").otherwise("read")
        rows = files.select("path", "length", "modificationTime", text.alias("text"), read.alias("document")).withColumn("state", state)
        rows.withColumn("text", F.when(F.col("state") == "bad", F.col("text"))).write.parquet(f"{store}/rows/batch={batch}")
        done = spark.read.parquet(f"{store}/rows/batch={batch}")
        done.select("path", "length", "modificationTime", F.lit(batch).alias("batch"), F.current_timestamp().alias("taken"), "state").write.mode("append").parquet(f"{store}/manifest")
        taken += len(todo)
        new = listing(spark, source).join(manifest(spark, store).select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti") if len(todo) == BATCH else None
        todo = new.orderBy("path").limit(BATCH).collect() if new is not None else []
    return taken


def documents(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """(path, document) of the files as they were last read; what a changed file had before is gone, and so are files that were bad the last time."""
    kind = f"path string, text string, document struct<{schema}>, batch string"
    now = manifest(spark, store).filter("state = 'read'").select("path", "batch")
    return spark.read.schema(kind).parquet(f"{store}/rows").join(now, ["path", "batch"]).select("path", "document")


def bad(spark: SparkSession, store: str) -> DataFrame:
    """(path, text) of the files that couldn't be read."""
    now = manifest(spark, store).filter("state = 'bad'").select("path", "batch")
    return spark.read.schema("path string, text string, batch string").parquet(f"{store}/rows").join(now, ["path", "batch"]).select("path", "text")


#: An answer about map features, and one about articles: the fields that are read.
ELEMENTS = "elements array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>, _corrupt string"
ARTICLES = "articles array<struct<pageid: long, title: string, lat: double, lon: double>>, _corrupt string"


def features(answers: DataFrame) -> DataFrame:
    """(event_id, title, lat, lon, major) of the features in answers (``ELEMENTS``), each once, as the last file by path has it; features without a position go."""
    each = answers.select("path", F.posexplode("document.elements").alias("_i", "e"))
    tag = lambda k: F.nullif(F.try_element_at("e.tags", F.lit(k)), F.lit(""))
    rows = each.select(
        F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("event_id"),
        F.coalesce(tag("name"), tag("construction"), tag("highway"), F.lit("")).alias("title"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"),
        F.coalesce("e.lon", "e.center.lon").alias("lon"),
        F.coalesce(tag("highway").isin(*MAJOR), F.lit(False)).alias("major"),
        F.struct("path", "_i").alias("_k"),
    ).filter("lat IS NOT NULL AND lon IS NOT NULL")
    last = F.max_by(F.struct("title", "lat", "lon", "major"), "_k").alias("x")
    return rows.groupBy("event_id").agg(last).select("event_id", "x.*")


def articles(answers: DataFrame) -> DataFrame:
    """(event_id, title, lat, lon) of the articles in answers (``ARTICLES``), each once by page or else by title, as the last file has it; those without a position go."""
    each = answers.select("path", F.posexplode("document.articles").alias("_i", "a")).select("a.*", F.struct("path", "_i").alias("_k")).filter("lat IS NOT NULL AND lon IS NOT NULL")
    rows = each.withColumn("event_id", F.coalesce(F.col("pageid").cast("string"), "title"))
    return rows.groupBy("event_id").agg(F.max_by(F.struct("title", "lat", "lon"), "_k").alias("x")).select("event_id", "x.*")
