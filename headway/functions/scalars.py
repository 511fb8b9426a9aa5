"""Column expressions of the domain. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WMO weather codes of snow, rain and fog.
SNOW_CODES, RAIN_CODES, FOG_CODES = (71, 73, 75, 77, 85, 86), (51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 80, 81, 82), (45, 48)
EARTH_M, DEGREE_M = 6_371_000.0, 111_320.0


def successful(result: Column, strict: bool = False) -> Column:
    """Whether a validation counted: the text is ``1`` (strict), or a number equal to 1. Null and garbage: false."""
    if strict:
        return F.coalesce(result == "1", F.lit(False))
    return F.coalesce(F.trim(result).try_cast("double") == 1.0, F.lit(False))


def route_number(text: Column) -> Column:
    """The first run of digits as a number; null where there is none or it is too long."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def tolerant_timestamp(text: Column) -> Column:
    """ISO with a space or ``T``, or dd.MM.yyyy, with or without seconds or a time; anything else is null."""
    clean = F.regexp_replace(F.trim(text), "T", " ")
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy HH", "dd.MM.yyyy")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def interval_start(ts: Column, minutes: Column) -> Column:
    """``HH:MM`` of the interval of so many minutes that holds the time."""
    return F.format_string("%02d:%02d", F.hour(ts), F.floor(F.minute(ts) / minutes).cast("int") * minutes)


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity, as browsers do."""
    return F.floor(x + 0.5)


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """A quotient, or ``default`` where the divisor is null or 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(default).cast("double"))


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def sunday_first(day: Column) -> Column:
    """Weekday with Sunday 0."""
    return F.dayofweek(day) - 1


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane that touches at the first point; null where a coordinate is."""
    return F.hypot((lat2 - lat1) * DEGREE_M, (lon2 - lon1) * DEGREE_M * F.cos(F.radians(lat1)))


def tone(value: Column, usual: Column) -> Column:
    """missing, hot (over 1.15 times the usual), warm (over it) or ok; ok too if nothing usual is known."""
    share = ratio(value, usual)
    return F.when(value.isNull(), "missing").when(usual.isNull() | (usual <= 0), "ok").when(share > 1.15, "hot").when(share > 1, "warm").otherwise("ok")


def density_tone(x: Column) -> Column:
    return F.when(x > 6, "hot").when(x >= 5, "warm").otherwise("ok")


#: WMO weather codes as text, and those that call for an alert.
WEATHER_TEXT = {
    0: "ясно", 1: "преимущественно ясно", 2: "переменная облачность", 3: "пасмурно",
    45: "туман", 48: "туман с изморозью",
    51: "морось", 53: "морось", 55: "сильная морось",
    61: "дождь", 63: "дождь", 65: "сильный дождь",
    71: "снег", 73: "снег", 75: "сильный снег",
    80: "ливень", 81: "ливень", 82: "сильный ливень",
    85: "снежный заряд", 86: "сильный снежный заряд",
    95: "гроза", 96: "гроза с градом", 99: "сильная гроза с градом",
}
ALERTS = (45, 48, 65, 67, 75, 82, 86, 95, 96, 99)
#: Bounding boxes (south, north, west, east) of the city and of the region.
CITY, REGION = (55.4, 56.1, 37.1, 38.0), (54.2, 56.6, 35.2, 40.5)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float], strict: bool = False) -> Column:
    """Whether a point lies in a box, its border included unless ``strict``; null coordinates don't."""
    south, north, west, east = box
    if strict:
        inside = (lat > south) & (lat < north) & (lon > west) & (lon < east)
    else:
        inside = lat.between(south, north) & lon.between(west, east)
    return F.coalesce(inside, F.lit(False))


def weather_text(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in WEATHER_TEXT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("код "), code.cast("string")))


def weather_alert(code: Column) -> Column:
    return F.coalesce(code.isin(*ALERTS), F.lit(False))


def traffic_score(roads: Column, km: Column, accidents_per_km: Column) -> Column:
    """Up to 6 for major roads a kilometre and up to 4 for accidents, to one place; by accidents alone where the roads are unknown."""
    both = F.least(F.lit(6.0), roads / F.greatest(km, F.lit(0.5))) + F.least(F.lit(4.0), accidents_per_km / 3)
    return F.round(F.when(roads.isNull(), F.least(F.lit(10.0), accidents_per_km / 2)).otherwise(both), 1)


def log_level(x: Column) -> Column:
    """log(1 + x) of what is above 0."""
    return F.log1p(F.greatest(F.lit(0.0), x))


def from_log_level(x: Column, most: float = 12.0) -> Column:
    """The inverse, of a level held between 0 and ``most``."""
    return F.expm1(F.least(F.lit(most), F.greatest(F.lit(0.0), x)))


def hour_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """Two hours held between 0 and 23, the earlier first."""
    low, high = (F.least(F.lit(23), F.greatest(F.lit(0), x)) for x in (a, b))
    return F.least(low, high), F.greatest(low, high)


def sine_noise(seed: Column) -> Column:
    """A number from 0 to 1 that looks random: the fraction of a large multiple of the seed's sine."""
    x = F.sin(seed) * 10000
    return x - F.floor(x)


def traffic_tone(score: Column) -> Column:
    return F.when(score >= 6, "hot").when(score >= 4, "warm").otherwise("ok")


def repair_tone(repairs: Column) -> Column:
    """By the number of repairs; ok where it is unknown."""
    return F.when(repairs >= 20, "hot").when(repairs > 0, "warm").otherwise("ok")


def station_tone(accidents: Column, tram_accidents: Column) -> Column:
    return F.when(tram_accidents > 0, "hot").when(accidents > 0, "warm").otherwise("ok")


def load_tone(load: Column) -> Column:
    return F.when(load > 1, "hot").when(load >= 0.8, "warm").otherwise("ok")


def station_load(base: Column, place: Column, n: Column) -> Column:
    """The load of the place-th (from 0) of n stations of a line, least at its ends."""
    at = F.when(n <= 1, 0.5).otherwise(place / F.greatest(n - 1, F.lit(1)))
    return base * (0.62 + 0.72 * F.sin(at * math.pi))


def week_offsets(day: Column, hour: Column) -> tuple[Column, Column]:
    """Hours since the week's and the year's first."""
    return F.weekday(day) * 24 + hour, (F.dayofyear(day) - 1) * 24 + hour


def points(score: Column) -> Column:
    """The bands of a score that earn 0 to 5 points."""
    out = F.lit(5)
    for limit, n in ((0.88, 4), (0.80, 3), (0.70, 2), (0.60, 1), (0.48, 0)):
        out = F.when(score <= limit, n).otherwise(out)
    return out


def weather_kind(precip: Column, snowfall: Column, code: Column) -> Column:
    """snow before rain before fog; clear otherwise."""
    snow = (F.coalesce(snowfall, F.lit(0.0)) > 0) | F.coalesce(code.isin(*SNOW_CODES), F.lit(False))
    rain = (F.coalesce(precip, F.lit(0.0)) >= 0.2) | F.coalesce(code.isin(*RAIN_CODES), F.lit(False))
    return F.when(snow, "snow").when(rain, "rain").when(code.isin(*FOG_CODES), "fog").otherwise("clear")


def coefficient(text: Column) -> Column:
    """A hand-typed factor: a comma may stand for the point; from 0.5 to 2, to three places; else null."""
    x = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((x >= 0.5) & (x <= 2) & ~F.isnan(x), F.round(x, 3))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the text's characters, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic plural form for a count."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tens.between(11, 14), many).when(ones == 1, one).when(ones.between(2, 4), few).otherwise(many)


def horizon_bucket(days: Column) -> Column:
    """The ranges of days ahead by which forecasts are judged."""
    out = F.lit("43-61")
    for last, name in ((42, "29-42"), (28, "15-28"), (14, "8-14"), (7, "1-7")):
        out = F.when(days <= last, name).otherwise(out)
    return out
