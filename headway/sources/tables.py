"""Readers of the domain's files, all by Spark's own sources."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.sessions import reused

#: The columns of raw validations, all read as text.
VALIDATIONS = "tran_no device_no tran_date_time begin_date_time input_date_time crd_hashcode validation_result tran_type_id place_id good_type pass_route ngpt_route bus_exit_no garage_number".split()


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, sep: str = ",", quoted: bool = True, schema: T.StructType | str | None = None, lenient: bool = True, line_feeds: bool = False) -> DataFrame:
    """A CSV file with a header: quotes doubled inside quotes, a byte order mark dropped, blank cells null, blank rows left out. ``line_feeds`` allows them inside of
    quotes, which makes each file one task. Cells that don't fit the schema are null, or raise if not ``lenient``."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "").option("mode", "PERMISSIVE" if lenient else "FAILFAST")
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", line_feeds) if quoted else reader.option("quote", "")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns]).dropna("all")


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """The first of semicolon and comma that the first line has; one row is read."""
    first = spark.read.text(path).limit(1).collect()
    return ";" if first and ";" in first[0][0] else ","


def _validations(spark: SparkSession, path: str, mode: str):
    return spark.read.option("header", True).option("sep", ";").option("mode", mode).option("enforceSchema", False)


def read_validations(spark: SparkSession, path: str) -> DataFrame:
    """Raw validations as text; malformed lines go. ``malformed`` gives those."""
    return _validations(spark, path, "DROPMALFORMED").option("columnPruning", False).schema(text_schema(VALIDATIONS)).csv(path)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_validations`` leaves out, as ``line``, with what could be read of them."""
    schema = text_schema([*VALIDATIONS, "line"])
    return _validations(spark, path, "PERMISSIVE").option("enforceSchema", True).option("columnNameOfCorruptRecord", "line").option("columnPruning", False).schema(schema).csv(path).filter("line IS NOT NULL")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON documents."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


_FEATURE = "struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"


def geojson_rows(texts: DataFrame) -> DataFrame:
    """Documents (text) of GeoJSON, a feature collection or a bare list of features, as rows: properties, type, and each position: part, seq, lon, lat of every line.

    Coordinates nest to any depth; the innermost pairs are taken in order, and each line string is a part; a point is a line of one. The pattern of a line takes its
    pairs possessively: otherwise Java would go one call deeper for each pair, and lines of some thousand would overflow the stack.
    """
    inner = F.coalesce(F.get_json_object("text", "$.features"), F.trim("text"))
    features = texts.select(F.posexplode(F.from_json(inner, F.lit(f"array<{_FEATURE}>"))).alias("feature", "f"))
    flat = F.regexp_replace("f.geometry.coordinates", r"\s", "")
    flat = F.when(flat.rlike(r"^\[[^\[\]]*\]$"), F.concat(F.lit("["), flat, F.lit("]"))).otherwise(flat)
    lines = features.select("feature", "f.properties", F.col("f.geometry.type").alias("type"), F.posexplode(F.regexp_extract_all(flat, F.lit(r"\[(\[[^\[\]]*\](?:,\[[^\[\]]*\])*+)\]"), 1)).alias("part", "line"))
    spots = lines.select("feature", "properties", "type", "part", F.posexplode(F.regexp_extract_all("line", F.lit(r"\[([^\[\]]*)\]"), 1)).alias("seq", "pair"))
    pair = F.split("pair", ",")
    return spots.select("feature", "properties", "type", "part", "seq", F.get(pair, 0).cast("double").alias("lon"), F.get(pair, 1).cast("double").alias("lat"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The features of GeoJSON files; a file is one document."""
    return geojson_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def unzipped(files: DataFrame, pattern: str) -> DataFrame:
    """The members (name, text) of archives (content) whose name matches a pattern, opened where their bytes are; a byte order mark is dropped."""
    import io
    import zipfile

    import pandas as pd

    def members(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [(n.rpartition("/")[2], z.read(n).decode("utf-8-sig")) for n in z.namelist() if re.search(pattern, n)]
                yield pd.DataFrame(found, columns=["name", "text"])

    return files.select("content").mapInPandas(members, "name string, text string")


def read_zipped_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The features of the first GeoJSON or JSON member, by name, of an archive."""
    found = unzipped(spark.read.format("binaryFile").load(path), r"\.(geo)?json$")
    return geojson_rows(found.agg(F.min_by("text", "name").alias("text")).filter("text IS NOT NULL"))


#: The tables of a feed, the columns that are numbers, and what stands for missing ones.
FEED = ("agency", "routes", "stops", "trips", "stop_times", "calendar", "calendar_dates", "shapes")
NUMBERS = {"stop_lat": "double", "stop_lon": "double", "shape_pt_lat": "double", "shape_pt_lon": "double", "stop_sequence": "int", "shape_pt_sequence": "int", "direction_id": "int", "exception_type": "int", "route_type": "int"}
DEFAULTS = {"direction_id": 0, "route_type": 0}


def feed_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of feeds, archives (content) of CSV files, by name: columns by their header, numbers cast, defaults set.

    The archives are opened once and their cells written to the shared folder; quotes and line feeds inside of them are read as CSV has them.
    """
    import csv
    import io

    import pandas as pd

    def cells(batches):
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"]):
                rows = [[x.strip() for x in r] for r in csv.reader(io.StringIO(text, newline="")) if any(x.strip() for x in r)]
                yield pd.DataFrame({"name": name[:-4], "head": [rows[0]] * (len(rows) - 1), "cells": rows[1:]} if rows else {"name": [], "head": [], "cells": []})

    rows = reused(unzipped(files, r"\.txt$").mapInPandas(cells, "name string, head array<string>, cells array<string>"))
    out = {}
    for r in rows.groupBy("name").agg(F.first("head").alias("head")).collect():  # a row a table
        cell = {c: F.nullif(F.get("cells", i), F.lit("")) for i, c in enumerate(r["head"])}
        cell = {c: x.try_cast(NUMBERS[c]) if c in NUMBERS else x for c, x in cell.items()}
        if r["name"] in FEED:
            out[r["name"]] = rows.filter(F.col("name") == r["name"]).select(*[(F.coalesce(x, F.lit(DEFAULTS[c])) if c in DEFAULTS else x).alias(c) for c, x in cell.items()])
    return out


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A feed as a zip: its tables by name."""
    return feed_tables(spark.read.format("binaryFile").load(path))


def first_of(*sources):
    """The rows of the first source, a function without parameters, that can be read and has any; the last one's error if none can.

    Sources are tried one after the other as in a chain of a service, a file and built-in data. Only what Spark and the system raise for sources that are absent or can't be
    read passes to the next one; any other error is raised.
    """
    error = None
    for source in sources:
        try:
            rows = source()
            if not rows.isEmpty():
                return rows
        except (AnalysisException, Py4JJavaError, SparkRuntimeException, OSError) as e:
            error = e
    raise error or ValueError("no source has rows")


def links(pages: DataFrame, least: int = 25, first: int = 15) -> DataFrame:
    """The links of pages (page_id, html): tags stripped, blanks joined, titles of ``least`` characters at least, each title once a
    page, the first ``first`` of them."""
    pattern = r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("title"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("pos", "x")).select("page_id", "pos", "x.href", F.trim(F.regexp_replace(F.regexp_replace("x.title", r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("title"))
    once = rows.filter(F.length("title") >= least).groupBy("page_id", "title").agg(F.min(F.struct("pos", "href")).alias("m"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("page_id").orderBy("m.pos"))
    return once.select("page_id", rank.alias("rank"), F.col("m.href").alias("href"), "title").filter(F.col("rank") <= first)


def bound(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Columns by the first name that matches each pattern, ignoring case; a pattern without a match raises."""
    out = []
    for alias, pattern in patterns.items():
        name = next((c for c in df.columns if re.search(pattern, c, re.I)), None)
        if name is None:
            raise ValueError(f"no column like {pattern}")
        out.append(F.col(f"`{name}`").alias(alias))
    return df.select(*out)


def unwrapped(payload: Column, element: str) -> Column:
    """The rows of an API answer: a bare list, or one under rows, Rows, data, Data or features; a row's fields may stand under attributes, properties, Cells or cells."""
    places = [payload, *[F.get_json_object(payload, f"$.{k}") for k in ("rows", "Rows", "data", "Data", "features")]]
    rows = F.coalesce(*[F.when(F.ltrim(x).startswith("["), F.from_json(x, F.lit("array<string>"))) for x in places], F.array().cast("array<string>"))
    inner = lambda x: F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("attributes", "properties", "Cells", "cells")], x)
    return F.transform(rows, lambda x: F.from_json(inner(x), F.lit(element)))


def hourly_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Weather archives give one array a variable; as rows."""
    return df.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")
