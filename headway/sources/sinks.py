"""Writers of the domain's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_labels(df: DataFrame, path: str, keys: list[str], sep: str = ";") -> None:
    """A CSV with header, rows in key order over the files, which are as many as the data needs."""
    df.orderBy(*keys).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_rounded(df: DataFrame, path: str, places: int = 2, sep: str = ";") -> None:
    """A CSV with header in which numbers with a fraction are rounded."""
    df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition columns; rows are dealt by these and a salt, so that a hot value fills several files."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(4))
    df.repartition(*by, salt).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_submission(rows: DataFrame, path: str, expected: int) -> int:
    """A submission (route, date, hour, prediction, missing) as CSV in key order; the number of its rows. If a prediction is missing or the
    number of rows isn't the expected one, it raises and leaves the target as it is."""
    n, missing = rows.agg(F.count("*"), F.count_if("missing")).first()
    if missing or n != expected:
        raise ValueError(f"submission of {n} rows, {missing} of them missing; {expected} rows are expected")
    write_labels(rows.select("route", F.col("date").cast("string").alias("date"), "hour", "prediction"), path, ["route", "date", "hour"])
    return n


def with_total(rows: DataFrame, label: str, name: str, sums: list[str]) -> DataFrame:
    """The rows and a last one, named in column ``label``, with sums of some columns and the greatest value of the others; all get a ``_last`` of 0 or 1."""
    total = rows.agg(*[(F.sum(c) if c in sums else F.lit(name) if c == label else F.max(c)).alias(c) for c in rows.columns])
    return rows.withColumn("_last", F.lit(0)).unionByName(total.withColumn("_last", F.lit(1)))


def board_csv(df: DataFrame, path: str, names: dict[str, str], label: str | None = None, total: str = "итого", sums: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """A board for people: columns renamed, semicolons, all cells quoted, lines that end as in Windows, a byte order mark so that spreadsheets read it as UTF-8,
    and with a ``label`` column a last row of totals. A board is one screen of rows, so it is one file."""
    rows = with_total(df, label, total, list(sums)) if label else df.withColumn("_last", F.lit(0))
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in names]
    one = rows.coalesce(1).sortWithinPartitions("_last", *order).select(F.concat_ws(";", *cells).alias("line"))
    head = df.sparkSession.createDataFrame([("\ufeff" + ";".join(names.values()),)], "line string").coalesce(1)
    head.union(one).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as lines of CSV with all cells quoted, commas between, after a line of names."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    head = df.sparkSession.createDataFrame([(0, ",".join(df.columns))], "at int, line string")
    return head.union(df.select(F.lit(1).alias("at"), F.concat_ws(",", *cells).alias("line")))


def zipped_feed(tables: dict[str, DataFrame]) -> DataFrame:
    """A feed as one archive: one row (content). ``direction`` isn't a column of routes files and is left out there. A feed goes to one file, so to one task."""
    import io
    import zipfile

    import pandas as pd

    lines = None
    for name, df in tables.items():
        one = csv_lines(df.drop("direction") if name == "routes" else df).select(F.lit(f"{name}.txt").alias("name"), "at", "line")
        lines = one if lines is None else lines.union(one)

    def pack(batches):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            member, open_ = None, None
            for pdf in batches:
                for name, line in zip(pdf["name"], pdf["line"]):
                    if name != member:
                        if open_:
                            open_.close()
                        member, open_ = name, z.open(name, "w")
                    open_.write((line + "\r\n").encode())
            if open_:
                open_.close()
        yield pd.DataFrame({"content": [out.getvalue()]})

    return lines.coalesce(1).sortWithinPartitions("name", "at", "line").mapInPandas(pack, "content binary")


def zipped_text(texts: DataFrame, member: str) -> DataFrame:
    """Each text as the member of an archive of its own: rows (content)."""
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for pdf in batches:
            made = []
            for text in pdf["text"]:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(member, text)
                made.append(out.getvalue())
            yield pd.DataFrame({"content": made})

    return texts.select("text").mapInPandas(pack, "content binary")


def write_geojson(points: DataFrame, path: str, line: str, order: list[str], properties: list[str]) -> None:
    """Lines of points (lat, lon) as a feature collection in one file, a feature a line of text, with some columns, equal in each line, as properties."""
    spots = F.array_sort(F.collect_list(F.struct(*order, F.array("lon", "lat").alias("_p"))))
    each = points.groupBy(line).agg(F.transform(spots, lambda x: x["_p"]).alias("coordinates"), *[F.first(c).alias(c) for c in properties if c != line])
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry")))
    rows = each.select(F.lit(1).alias("at"), F.col(line).cast("string").alias("key"), feature.alias("text"))
    ends = points.sparkSession.createDataFrame([(0, "", '{"type":"FeatureCollection","features":['), (2, "", "]}")], "at int, key string, text string")
    # a comma stands before each feature but the first
    first = rows.agg(F.min("key").alias("_first"))
    text = F.when((F.col("at") == 1) & (F.col("key") != F.col("_first")), F.concat(F.lit(","), F.col("text"))).otherwise(F.col("text"))
    one = ends.union(rows).join(F.broadcast(first)).select("at", "key", text.alias("text"))
    one.coalesce(1).sortWithinPartitions("at", "key").select("text").write.mode("overwrite").text(path)
