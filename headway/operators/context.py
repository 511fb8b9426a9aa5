"""What stands around routes and stations: places near them, stations by name, weather, fleets, and cards of these facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.functions import text as T
from headway.functions.sessions import cut
from headway.operators import geo
from headway.operators.ranking import numbered


def places_near(stops: DataFrame, places: DataFrame, metres: float = 300.0) -> DataFrame:
    """For each route of the stops (route, lat, lon) how many places (id, name, place, lat, lon) lie within so many metres of any of its stops, and the name of the first of
    them by ``place``; 0 and null where there is none."""
    near = geo.within(stops.select("route", "lat", "lon"), places, metres)
    found = near.groupBy("route").agg(F.count_distinct("r_id").alias("n_places"), F.min_by("r_name", F.struct("r_place", "r_id")).alias("example"))
    return stops.select("route").distinct().join(found, "route", "left").withColumn("n_places", F.coalesce("n_places", F.lit(0).cast("long")))


def matched(stops: DataFrame, stations: DataFrame, distance=S.flat_distance) -> DataFrame:
    """For each stop (id, name, route, lat, lon) the station (station, name, routes, lat, lon) of the same normalised name: one that serves the stop's route before others, then the nearest,
    then the first by ``station``. Adds station, serves and metres; stops without a station of their name go.

    Stops meet only the stations that serve their route, one at each position, and those that have none meet the stations of their name. All pairs of such a group are
    looked at, but none is kept: a first pass has the least distance of each stop, by hash, and a second one the first station at that distance.
    """
    named = stations.select(T.normalised(F.col("name")).alias("_n"), "station", "routes", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    first = F.min("station").alias("station")
    serving = named.withColumn("route", F.explode("routes")).groupBy("_n", "route", "_lat", "_lon").agg(first)
    asked = stops.select("id", "route", "lat", "lon", T.normalised(F.col("name")).alias("_n"))
    far = F.coalesce(distance(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), F.lit(float("inf")))

    def best(asked: DataFrame, known: DataFrame, on: list[str], serves: bool) -> DataFrame:
        known = known.hint("merge")  # a file of stations is small to Spark, however many pairs it makes
        least = asked.join(known, on).groupBy("id").agg(F.min(far).alias("metres"))
        at = asked.join(least.hint("merge"), "id").join(known, on).filter(far == F.col("metres"))
        return cut(at.groupBy("id", "metres").agg(first).select("id", "station", F.lit(serves).alias("serves"), "metres"))

    own = best(asked, serving, ["_n", "route"], True)
    others = asked.join(own.select("id").hint("merge"), "id", "left_anti")
    found = own.unionByName(best(others, named.groupBy("_n", "_lat", "_lon").agg(first), ["_n"], False))
    return stops.join(found.hint("merge"), "id").select(*stops.columns, "station", "serves", "metres")


def route_weather(stations: DataFrame, weather: DataFrame) -> DataFrame:
    """A row for each station (station, routes) and route of it whose weather (route, ...) is known."""
    return stations.select("station", F.explode("routes").alias("route")).join(weather, "route")


def most_common(value: Column, n: Column) -> Column:
    """Aggregate over counted values: the one with the greatest count, the least of equals; null values don't count."""
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct((-n).alias("n"), value.alias("v"))))


def station_weather(stations: DataFrame, weather: DataFrame) -> DataFrame:
    """For each station the mean temperature of its routes and the most common weather text, the least of equals; nulls where no route's weather is known."""
    each = route_weather(stations, weather).groupBy("station", "text").agg(F.count("*").alias("_n"), F.sum("temp").alias("_s"), F.count("temp").alias("_c"))
    found = each.groupBy("station").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("temp"), most_common(F.col("text"), F.col("_n")).alias("text"))
    return stations.select("station").join(found, "station", "left")


def network(routes: DataFrame, stops: DataFrame, line: str, order: list[str]) -> DataFrame:
    """One row: number of routes, of stops, and kilometres along the stops of all lines, rounded."""
    km = geo.lengths(stops, [line], order).agg(F.floor(F.coalesce(F.sum("km"), F.lit(0.0)) + 0.5).cast("long").alias("km"))
    return routes.agg(F.count("*").alias("n_routes")).join(stops.agg(F.count("*").alias("n_stops"))).join(km)  # three rows of totals


def density_bands(rows: DataFrame, value: str) -> DataFrame:
    """One row: how many values are under 5, from 5 to 6, and over 6."""
    v = F.col(value)
    return rows.agg(F.count_if(v < 5).alias("low"), F.count_if((v >= 5) & (v <= 6)).alias("middle"), F.count_if(v > 6).alias("high"))


def totals(events: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """The number of events of each of some kinds, as a column each."""
    return events.agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """The place of each row by a total order, without one group for all."""
    return numbered(rows, order, name).withColumn(name, (F.col(name) + 1).cast("int"))


def most(events: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` keys with most rows and their numbers, ties by key."""
    return events.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def by_traffic(routes: DataFrame) -> DataFrame:
    """Routes (route, traffic_score, repairs) by traffic score and, as ``repair_place``, by repairs, unknown ones after none; ties by route."""
    first = ranked(routes, [F.desc("traffic_score"), F.col("route")], "traffic_place")
    return ranked(first, [F.coalesce("repairs", F.lit(-1)).desc(), F.col("route")], "repair_place")


def fleets(registry: Column) -> Column:
    """The routes of a fleet registry as JSON: an array of (route, vehicles, name, vehicle_class)."""
    kind = "routes map<string, struct<vehicles: int, name: string, vehicle_class: string>>"
    return F.transform(F.map_entries(F.from_json(registry, F.lit(kind))["routes"]), lambda e: F.struct(e["key"].alias("route"), e["value"]["vehicles"].alias("vehicles"), e["value"]["name"].alias("name"), e["value"]["vehicle_class"].alias("vehicle_class")))


def with_fleet(routes: DataFrame, fleet: DataFrame) -> DataFrame:
    """``vehicles`` of each route (text); null if the registry doesn't know it, which 0 isn't."""
    return routes.join(fleet.select("route", "vehicles"), "route", "left")


def _number(x: Column) -> Column:
    """A number as people write it: whole ones without a fraction; null as a dash."""
    return F.coalesce(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")), F.lit("—"))


@dataclass(frozen=True)
class Factor:
    """How a card shows a fact: its label, the column, a unit behind the value, a note (a column's text or a fixed one, with ``tail`` behind), the column that must be known for
    the note to stand, what stands in for it otherwise, whether a plus goes before what is above 0, and whether nothing (0, false, unknown) turns the factor off."""

    label: str
    fact: str
    unit: str = ""
    note: str | None = None
    tail: str = ""
    needs: str | None = None
    stand_in: str = ""
    signed: bool = False
    can_be_off: bool = False


#: The labels, units and texts of a route's card, in its order, and its words for yes, no, today and an unknown value.
ROUTE_CARD = (
    Factor("Погода", "temperature", "°", "weather", stand_in="нет данных", signed=True),
    Factor("Ветер", "wind", tail="км/ч"),
    Factor("Праздник", "holiday_today", note="holiday_day", stand_in="нет даты", can_be_off=True),
    Factor("Аварии", "accidents", note="accidents_per_km", tail=" на км", stand_in="— на км"),
    Factor("Ремонт", "repairs", tail="у линии", needs="repairs", stand_in="нет выгрузки", can_be_off=True),
    Factor("Пробки", "traffic_score", tail="из 10", needs="repairs", stand_in="по ДТП"),
    Factor("Места", "poi_count", note="poi_example", stand_in="в радиусе линии", can_be_off=True),
    Factor("Трамвай", "tram_accidents", tail="в описании ДТП", can_be_off=True),
)
YES, NO, TODAY, UNKNOWN = "да", "нет", "сегодня", "—"


def cards(facts: DataFrame, key: str, factors: tuple[Factor, ...]) -> DataFrame:
    """A row per key and factor: place from 1, label, value, note, and whether the factor is off."""
    kinds = dict(facts.dtypes)

    def text(c: str) -> Column:
        return F.col(c) if kinds[c] == "string" else F.when(F.col(c), YES).otherwise(NO) if kinds[c] == "boolean" else _number(F.col(c))

    def shown(i: int, f: Factor) -> Column:
        value = text(f.fact)
        if f.signed:
            value = F.when(F.col(f.fact) > 0, F.concat(F.lit("+"), value)).otherwise(value)
        value = F.when(F.col(f.fact).isNull(), NO if kinds[f.fact] == "boolean" else UNKNOWN).otherwise(F.concat(value, F.lit(f.unit)))
        note = F.concat(F.when(F.col(f.note).isNotNull(), text(f.note)), F.lit(f.tail)) if f.note else F.lit(f.tail)
        if f.needs:
            note = F.when(F.col(f.needs).isNotNull(), note)
        nothing = ~F.col(f.fact) if kinds[f.fact] == "boolean" else F.col(f.fact) == 0
        off = F.coalesce(nothing, F.lit(kinds[f.fact] == "boolean" or f.needs == f.fact)) if f.can_be_off else F.lit(False)
        return F.struct(F.lit(i).alias("place"), F.lit(f.label).alias("label"), value.alias("value"), F.coalesce(note, F.lit(f.stand_in)).alias("note"), off.alias("off"))

    return facts.select(key, F.explode(F.array(*[shown(i, f) for i, f in enumerate(factors, 1)])).alias("x")).select(key, "x.*")


def route_card(facts: DataFrame) -> DataFrame:
    """The factors of each route (``ROUTE_CARD``).

    ``facts`` has route, temperature, weather, wind, holiday_today, next_holiday, accidents, accidents_per_km, repairs, traffic_score, poi_count, poi_examples (joined by
    semicolons) and tram_accidents. Unknown values are dashes.
    """
    examples = F.filter(F.transform(F.split(F.coalesce("poi_examples", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    known = facts.withColumns({"holiday_day": F.when(F.col("holiday_today"), TODAY).otherwise(F.substring("next_holiday", 1, 10)), "poi_example": T.shortened(F.get(examples, 0), 22)})
    return cards(known, "route", ROUTE_CARD)


def station_cards(stops: DataFrame, stations: DataFrame, weather: DataFrame, roads: DataFrame, places: DataFrame, metres: float = 500.0, k: int = 5) -> DataFrame:
    """For each stop (id, name, route, lat, lon): temperature and number of major roads of its station, dashes' nulls where the stop has none, and the names of the ``k``
    nearest places within so many metres."""
    found = matched(stops, stations).select("id", "station").join(station_weather(stations, weather).select("station", "temp"), "station", "left")
    found = found.join(roads.groupBy("station").agg(F.count("*").alias("_roads")), "station", "left").select("id", "station", "temp", F.coalesce("_roads", F.lit(0).cast("long")).alias("roads"))
    near = geo.closest(stops.select("id", "lat", "lon"), ["id"], places, metres, k, ["id"])
    names = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "r_name"))), lambda x: x["r_name"]).alias("places"))
    return stops.select("id").join(found, "id", "left").join(names, "id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))
