"""Calendar features, and joins of dates with intervals and holidays. Calendars are small dimensions: a few hundred days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.operators import intervals as I

#: Days of a stretch in which marks are looked for.
STRETCH = 64


def parts(day: Column) -> dict[str, Column]:
    """Weekday from Monday 0, day, month, day of year, ISO week, quarter, and whether the month starts or ends."""
    return {
        "dow": F.weekday(day),
        "day": F.dayofmonth(day),
        "month": F.month(day),
        "doy": F.dayofyear(day),
        "week": F.weekofyear(day),
        "quarter": F.quarter(day),
        "month_start": (F.dayofmonth(day) == 1).cast("int"),
        "month_end": (day == F.last_day(day)).cast("int"),
    }


def cycles(day: Column, hour: Column) -> dict[str, Column]:
    """Sine and cosine of hour, weekday, month and day of year, and Fourier terms of the week (3) and the year (2)."""
    out = {}
    for name, x, period in (("hour", hour, 24), ("dow", F.weekday(day), 7), ("month", F.month(day), 12), ("doy", F.dayofyear(day), 365.25)):
        out[f"{name}_sin"], out[f"{name}_cos"] = S.cyclic(x, period)
    for name, x, period, terms in (("week", F.weekday(day) * 24 + hour, 168, 3), ("year", (F.dayofyear(day) - 1) * 24 + hour, 8766, 2)):
        for k in range(1, terms + 1):
            out[f"{name}{k}_sin"], out[f"{name}{k}_cos"] = S.cyclic(x, period / k)
    return out


def flags(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """weekend, holiday, off_day and preholiday (the next day is a holiday) for rows with a date."""
    marked = holidays.select(F.col("date").alias("_h")).distinct()
    eve = marked.select(F.date_sub("_h", 1).alias("_e"))
    rows = days.join(marked, days["date"] == F.col("_h"), "left").join(eve, days["date"] == F.col("_e"), "left")
    weekend, holiday = F.weekday("date") >= 5, F.col("_h").isNotNull()
    return rows.withColumns({"weekend": weekend.cast("int"), "holiday": holiday.cast("int"), "off_day": (weekend | holiday).cast("int"), "preholiday": F.col("_e").isNotNull().cast("int")}).drop("_h", "_e")


def off_days(days: DataFrame, calendars: DataFrame) -> DataFrame:
    """For each date and named calendar (calendar, date), whether it is a weekend or one of the calendar's days. Calendars don't replace each other."""
    names = calendars.select("calendar").distinct().agg(F.array_sort(F.collect_set("calendar")).alias("_c"))  # one row
    marked = calendars.distinct().withColumn("_off", F.lit(1))
    rows = days.join(F.broadcast(names)).select("*", F.explode("_c").alias("calendar")).drop("_c").join(marked, ["calendar", "date"], "left")
    return rows.withColumn("off_day", ((F.weekday("date") >= 5) | F.col("_off").isNotNull()).cast("int")).drop("_off")


def _each_system(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each date with each system of the calendar, of which there are a handful, as ``_at``."""
    systems = intervals.select("system").distinct().agg(F.array_sort(F.collect_set("system")).alias("_s"))  # one row
    return days.join(F.broadcast(systems)).select("*", F.explode("_s").alias("system")).drop("_s").withColumn("_at", I.position(F.col("date")))


def in_interval(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each date and system, whether any of the system's inclusive intervals (system, start, end) holds the date."""
    rows = _each_system(days, intervals)
    held = I.stabbed(rows, intervals.select("system", I.position(F.col("start")).alias("_start"), I.position(F.col("end")).alias("_end")), ["system"])
    return rows.join(held, ["system", "_at"], "left").withColumn("inside", (F.coalesce("n", F.lit(0)) > 0).cast("int")).drop("_at", "n")


def nearest_marks(days: DataFrame, marks: DataFrame, cap: int, keys: list[str] | None = None) -> DataFrame:
    """Days since the last and until the next mark, of the same keys if any, the day itself being 0, at most ``cap``."""
    keys = keys or []
    one = [*keys, "_all"]
    rows, m = ((t.withColumn("_at", I.position(F.col("date"))).withColumn("_all", F.lit(0))) for t in (days, marks))
    near = I.around(rows, m.select(*one, "_at"), one, STRETCH)
    since, until = F.col("_at") - F.col("_last"), F.col("_next") - F.col("_at")
    return near.withColumns({"since": F.coalesce(F.least(since, F.lit(cap)), F.lit(cap)).cast("int"), "until": F.coalesce(F.least(until, F.lit(cap)), F.lit(cap)).cast("int")}).drop("_at", "_last", "_next", "_all")


def interval_distances(days: DataFrame, intervals: DataFrame, cap: int = 21) -> DataFrame:
    """For each date and system: days until the next interval starts and since the last one ended, 0 inside of one, at most ``cap``, and whether it lies
    in the first week after one."""
    rows = in_interval(days, intervals).withColumn("_at", I.position(F.col("date")))
    marks = lambda edge: intervals.select("system", I.position(F.col(edge)).alias("_at"))
    ahead = I.around(rows, marks("start"), ["system"], STRETCH).withColumn("until", F.col("_next") - F.col("_at")).drop("_last", "_next")
    both = I.around(ahead, marks("end"), ["system"], STRETCH).withColumn("since", F.col("_at") - F.col("_last")).drop("_last", "_next", "_at")
    inside = F.col("inside") == 1
    held = {c: F.when(inside, 0).otherwise(F.coalesce(F.least(F.col(c), F.lit(cap)), F.lit(cap))).cast("int") for c in ("until", "since")}
    return both.withColumns(held).withColumn("first_week", (~inside & (F.col("since") <= 7)).cast("int"))


def by_year(holidays: DataFrame) -> DataFrame:
    """Number of holidays a year."""
    return holidays.groupBy(F.year("date").alias("year")).agg(F.count_distinct("date").alias("n"))


def next_holiday(holidays: DataFrame, today: str) -> DataFrame:
    """One row: the first holiday not before a day, and whether the day is one."""
    day = F.lit(today).cast("date")
    return holidays.filter(F.col("date") >= day).agg(F.min("date").alias("date")).withColumn("is_today", F.coalesce(F.col("date") == day, F.lit(False)))


def nearest_name(days: DataFrame, names: DataFrame, reach: int = 3) -> DataFrame:
    """The name of the day itself, else of the nearest named day within ``reach``, the earlier of two as near."""
    spread = names.select("name", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_o"), F.col("date").alias("_n"))
    spread = spread.select("name", F.expr("date_sub(_n, _o)").alias("date"), F.struct(F.abs("_o").alias("far"), F.col("_o").alias("side")).alias("_k"))
    best = spread.groupBy("date").agg(F.min_by("name", "_k").alias("name"))
    return days.join(best, "date", "left")


def day_strings(rows: DataFrame) -> DataFrame:
    """Rows with a first day and a string of 0 and 1, one character a day, as a row a day: date and day_off beside the other columns. Other characters raise."""
    checked = F.when(F.col("marks").rlike("^[01]*$"), F.col("marks")).otherwise(F.raise_error(F.lit("only 0 and 1 may occur")).cast("string"))
    each = rows.withColumn("marks", checked).select("*", F.posexplode(F.split("marks", "")).alias("_i", "_c")).filter("_c <> ''")
    return each.withColumns({"date": F.date_add("first", F.col("_i")), "day_off": F.col("_c").cast("int")}).drop("first", "marks", "_i", "_c")


def day_string(first: str, marks: str, spark) -> DataFrame:
    """One such string."""
    return day_strings(spark.createDataFrame([(first, marks)], "first string, marks string").withColumn("first", F.col("first").cast("date")))


def expand_service(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Dates of each service: its weekdays between start_date and end_date, with exceptions (1 adds, 2 removes)."""
    week = F.array(*[F.col(x) for x in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    days = calendar.withColumn("date", F.explode(F.sequence("start_date", "end_date"))).filter(F.get(week, F.weekday("date")) == 1).select("service_id", "date")
    added = exceptions.filter("exception_type = 1").select("service_id", "date")
    removed = exceptions.filter("exception_type = 2").select("service_id", "date")
    return days.union(added).distinct().join(removed, ["service_id", "date"], "left_anti")


