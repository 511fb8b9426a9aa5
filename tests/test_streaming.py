"""The stream gives the batch's counts."""

from pyspark.sql import functions as F

from headway.operators import labels
from headway.plans import bindings as B
from headway.streaming import counts

DIR = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    rows = B.validations(spark, DIR).select("route", "ts", "ok")
    rows.write.parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(0, True)], "route int, ok boolean").selectExpr("route", "TIMESTAMP_NTZ '2030-01-01 00:00:00' AS ts", "ok")
    batch = {tuple(r) for r in counts.interval_counts(rows, 15).collect()}
    stream = lambda: counts.write(counts.interval_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 15), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    stream()
    last.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all windows
    stream()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def stream(spark, rows, source, out, late):
    """What one more run of the stream leaves."""
    made = counts.vehicle_counts(spark.readStream.option("maxFilesPerTrigger", 1).schema(rows.schema).parquet(source), 60, late)
    counts.write(made, f"{out}/rows", f"{out}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def files(rows, path, parts):
    """The rows dealt over files in no order of time."""
    for i in range(parts):
        rows.filter(F.pmod(F.xxhash64("ts", "vehicle"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)


def mover(spark):
    return spark.createDataFrame([(0, True, "v")], "route int, ok boolean, vehicle string").selectExpr("route", "TIMESTAMP_NTZ '2030-01-01 00:00:00' AS ts", "ok", "vehicle")


def test_vehicles_of_a_stream_equal_the_batch(spark, tmp_path):
    """Shuffled files, a restart from the checkpoint in between, and the batch operator in the end."""
    rows = B.validations(spark, DIR).select("route", "ts", "ok", "vehicle")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(rows.filter("route < 4"), source, 2)
    stream(spark, rows, source, out, "60 days")
    files(rows.filter("route >= 4"), source, 2)  # a second query goes on where the first stopped
    mover(spark).write.mode("append").parquet(source)
    stream(spark, rows, source, out, "60 days")
    mover(spark).selectExpr("route", "ts + INTERVAL 1 HOUR AS ts", "ok", "vehicle").write.mode("append").parquet(source)
    got = stream(spark, rows, source, out, "60 days").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in counts.vehicle_counts(rows).collect()}
    hours = {(r["route"], r["start"].date(), r["start"].hour): (r["boardings"], r["active_trams"]) for r in got if r["boardings"]}
    assert hours == {(r["route"], r["date"], r["hour"]): (r["boardings"], r["active_trams"]) for r in labels.with_vehicles(rows).collect()}


def test_late_rows_are_counted_apart(spark, tmp_path):
    rows = B.validations(spark, DIR).select("route", "ts", "ok", "vehicle")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    early, after = rows.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), rows.filter("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    files(after, source, 1)
    stream(spark, rows, source, out, "1 hour")
    files(early, source, 1)  # the watermark has passed all of them
    mover(spark).write.mode("append").parquet(source)
    closed = stream(spark, rows, source, out, "1 hour")
    late = {(r["route"], r["start"]): r["n_late"] for r in counts.late_rows(spark.read.parquet(source), closed).collect()}
    want = {(r["route"], r["start"]): r["n_rows"] for r in counts.vehicle_counts(early).collect()}
    assert late == want and sum(want.values()) == early.count()
