"""Distances, lines and spatial joins. Points have lat and lon in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions import scalars as S
from headway.functions.sessions import cut


def cell(x: Column, size: float) -> Column:
    """The grid cell of a coordinate, truncated towards 0."""
    return (x / size).cast("int")


def within(left: DataFrame, right: DataFrame, metres: float, spread: str = "right") -> DataFrame:
    """Pairs of left and right points at most ``metres`` apart, anywhere on the sphere, with ``metres`` between them; right columns come prefixed ``r_``.

    Both sides are put in cells: bands of latitude as high as the radius, whose columns are as wide as the band needs and go round. One side, better the smaller one, is
    given to the cells around its own, so the join is one of equal keys; a crowded cell is what adaptive skew handling splits. Rows without coordinates have no pairs.
    """
    if spread == "right":
        return _ring(left, right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), metres)
    pairs = _ring(right, left.select(*[F.col(c).alias(f"r_{c}") for c in left.columns]), metres)
    return pairs.select(*[F.col(f"r_{c}").alias(c) for c in left.columns], *[F.col(c).alias(f"r_{c}") for c in right.columns], "metres")


def _bands(metres: float) -> tuple:
    """Cells for a radius: (row of a latitude, columns of a row, column of a longitude in so many columns). Bands are as high as the radius, and their columns as
    wide as the band and its neighbours need, going round."""
    angle = min(metres / S.EARTH_M, math.pi)
    size = math.degrees(angle) * 1.001

    def columns(row: Column) -> Column:
        polar = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * size - 90), F.abs((row + 2) * size - 90)))
        share = math.sin(angle / 2) / F.cos(F.radians(polar))
        return F.when(share < 1, F.floor(math.pi / 1.001 / F.asin(F.least(share, F.lit(1.0))))).otherwise(F.lit(1).cast("long"))

    return lambda lat: F.floor((lat + 90) / size), columns, lambda lon, n: F.floor(F.pmod(lon, F.lit(360.0)) / 360 * n)


#: So many points at most are broadcast in their cells, nine rows for each.
_FEW = 20_000


def _ring(left: DataFrame, named: DataFrame, metres: float) -> DataFrame:
    row, columns, column = _bands(metres)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = named.withColumn("_i", F.explode(around)).withColumn("_row", row(F.col("r_lat")) + F.col("_i")).withColumn("_n", columns(F.col("_row")))
    spread = spread.withColumn("_col", F.explode(F.array_distinct(F.transform(around, lambda j: F.pmod(column(F.col("r_lon"), F.col("_n")) + j, F.col("_n")))))).drop("_i", "_n")
    cells = left.withColumn("_row", row(F.col("lat"))).withColumn("_n", columns(F.col("_row"))).withColumn("_col", F.pmod(column(F.col("lon"), F.col("_n")), F.col("_n"))).drop("_n")
    few = named.limit(_FEW + 1).count() <= _FEW  # Spark would judge by the file, which may be small for many rows
    pairs = cells.join(spread.hint("broadcast" if few else "merge"), ["_row", "_col"]).drop("_row", "_col")
    return pairs.withColumn("metres", S.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).filter(F.col("metres") <= metres)


def _vector(lat: Column, lon: Column) -> list[Column]:
    """A point of the unit sphere."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def to_segment(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Metres from p to the nearest point of the arc from a to b, all unit vectors: to the great circle if the foot of the perpendicular lies on the arc, else to the nearer end."""
    n = _cross(a, b)
    length = F.sqrt(_dot(n, n))
    ends = F.least(*[2 * F.asin(F.least(F.lit(1.0), F.sqrt(_dot(d, d)) / 2)) for d in ([x - y for x, y in zip(p, a)], [x - y for x, y in zip(p, b)])])
    beside = (_dot(_cross(n, a), p) >= 0) & (_dot(_cross(b, n), p) >= 0)
    across = F.asin(F.least(F.lit(1.0), F.abs(_dot(p, n)) / length))
    return S.EARTH_M * F.when((length > 0) & beside, across).otherwise(ends)


def segments(points: DataFrame, line: list[str], order: list[str]) -> DataFrame:
    """The arcs (line, _a, _b: unit vectors) between neighbours of each line; a line of one point is an arc of no length. Arcs are shorter than half the equator."""
    w = W.partitionBy(*line).orderBy(*order)
    rows = points.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumns({"_to_lat": F.lead("lat").over(w), "_to_lon": F.lead("lon").over(w), "_n": F.row_number().over(w)})
    rows = rows.filter("_to_lat IS NOT NULL OR _n = 1")
    end = [F.coalesce("_to_lat", "lat"), F.coalesce("_to_lon", "lon")]
    return rows.select(*line, F.array(*_vector(F.col("lat"), F.col("lon"))).alias("_a"), F.array(*_vector(*end)).alias("_b")).distinct()


def _parts(c: str) -> list[Column]:
    return [F.col(c)[i] for i in range(3)]


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that are about to become many, dealt to all shuffle partitions: they are few bytes before, so Spark would leave them to a task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Vectors as columns of numbers that are never null, so that what is compared for each pair stays short code.
_FLAT = {v: [f"{v}{i}" for i in range(3)] for v in ("_a", "_b", "_p")}


def _flat(v: str, parts: list[Column]) -> list[Column]:
    return [F.coalesce(x, F.lit(math.nan)).alias(c) for x, c in zip(parts, _FLAT[v])]


def line_cells(arcs: DataFrame, metres: float) -> tuple[DataFrame, tuple]:
    """Each arc in the cells that it crosses and those around them, once each: marks along it stand no farther apart than the radius, so what lies within it of the
    arc is within one and a half of a mark."""
    bands = row, columns, column = _bands(1.5 * metres)
    angle = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(_dot([x - y for x, y in zip(_parts("_a"), _parts("_b"))], [x - y for x, y in zip(_parts("_a"), _parts("_b"))])) / 2))
    steps = F.greatest(F.lit(1), F.ceil(F.col("_angle") * S.EARTH_M / metres).cast("int"))
    marks = _dealt(arcs, "_a", "_b").withColumn("_angle", angle).withColumn("_steps", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
    share = F.col("_k") / F.col("_steps")
    wa, wb = (F.when(F.col("_angle") > 0, F.sin(x * F.col("_angle")) / F.sin("_angle")).otherwise(y) for x, y in ((1 - share, F.lit(1.0)), (share, F.lit(0.0))))
    at = [wa * x + wb * y for x, y in zip(_parts("_a"), _parts("_b"))]
    marks = marks.withColumns({"_lat": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at[2])))), "_lon": F.degrees(F.atan2(at[1], at[0]))})
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = marks.withColumn("_i", F.explode(around)).withColumn("_row", row(F.col("_lat")) + F.col("_i"))
    spread = spread.withColumn("_m", columns(F.col("_row"))).withColumn("_col", F.explode(F.array_distinct(F.transform(around, lambda j: F.pmod(column(F.col("_lon"), F.col("_m")) + j, F.col("_m"))))))
    others = [c for c in arcs.columns if c not in ("_a", "_b")]
    return spread.select(*others, "_row", "_col", *_flat("_a", _parts("_a")), *_flat("_b", _parts("_b"))).distinct(), bands


def _celled(points: DataFrame, bands: tuple) -> DataFrame:
    row, columns, column = bands
    rows = points.withColumn("_row", row(F.col("lat"))).withColumn("_m", columns(F.col("_row")))
    return rows.withColumn("_col", F.pmod(column(F.col("lon"), F.col("_m")), F.col("_m"))).drop("_m").select("*", *_flat("_p", _vector(F.col("lat"), F.col("lon"))))


def _beside(metres: float) -> Column:
    """Whether ``_p`` is at most so many metres from the arc from ``_a`` to ``_b``, as ``to_segment`` has it. What is farther from the great circle goes first, without
    functions of angles; a little is added, so that the exact distance alone decides."""
    p, a, b = ([F.col(c) for c in _FLAT[v]] for v in ("_p", "_a", "_b"))
    n, pa, pb, ab = _cross(a, b), _dot(p, a), _dot(p, b), _dot(a, b)
    across, length = F.abs(_dot(p, n)), F.sqrt(_dot(n, n))
    most = math.sin(min(metres / S.EARTH_M, math.pi / 2)) * 1.000001
    ends = F.least(*[_dot(d, d) for d in ([x - y for x, y in zip(p, a)], [x - y for x, y in zip(p, b)])])
    # n x a is b - a (a b), and b x n is a - b (a b)
    beside = (pb - pa * ab >= 0) & (pa - pb * ab >= 0) & (length > 0)
    exact = F.when(beside, F.asin(F.least(F.lit(1.0), across / length))).otherwise(2 * F.asin(F.least(F.lit(1.0), F.sqrt(ends) / 2)))
    return (across <= length * most + 1e-12) & (S.EARTH_M * exact <= metres)


def near_lines(points: DataFrame, arcs: DataFrame, metres: float) -> DataFrame:
    """The points at most so many metres from any arc (``segments``), each once: a semi join of equal cells with the exact distance to the arc, anywhere on the sphere.

    Cells are far more rows than the lines that Spark would judge them by, so they are merged, never broadcast.
    """
    spread, bands = line_cells(arcs.select("_a", "_b").distinct(), metres)
    rows, named = _celled(points, bands), spread.withColumnsRenamed({"_row": "_r", "_col": "_c"})
    near = (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c")) & _beside(metres)
    return rows.join(named.hint("merge"), near, "left_semi").select(*points.columns)


def by_line(points: DataFrame, key: str, arcs: DataFrame, line: list[str], metres: float) -> DataFrame:
    """(line, key): the points within so many metres of each line, each once. Cells are merged, never broadcast (``near_lines``)."""
    spread, bands = line_cells(arcs, metres)
    rows = _celled(points.select(key, "lat", "lon"), bands).join(spread.hint("merge"), ["_row", "_col"])
    return rows.filter(_beside(metres)).select(*line, key).distinct()


def _first_radius(points: DataFrame, metres: float, k: int) -> float:
    """``metres``, or a fourth, sixteenth and so on of it: the greatest radius that holds some 16 k points at most where they are densest, by the number in the fullest
    cell. It only says where a search begins, and so how many pairs it looks at."""
    row, columns, column = _bands(metres)
    cells = points.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_row", row(F.col("lat"))).withColumn("_n", columns(F.col("_row")))
    fullest = cells.groupBy("_row", F.pmod(column(F.col("lon"), F.col("_n")), F.col("_n"))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    radius = metres
    while math.pi * fullest * (radius / metres) ** 2 > 16 * k and radius > metres / 4**6:
        radius /= 4
    return radius


def nearest(left: DataFrame, key: str, right: DataFrame, order: list[str]) -> DataFrame:
    """For each left row (by ``key``) the nearest right point, ties by ``order``; right columns come prefixed ``r_``.

    Of right points at one position only the first by ``order`` can win, so the others go. Rings of grid cells are searched outwards, first with a radius for where points
    are densest, then with four times the radius for those still without a neighbour, until all have one or the ring is the whole sphere. Rows without coordinates stay,
    with nulls.
    """
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    first = F.min_by(F.struct(*named.columns), F.struct(*[F.col(f"r_{c}") for c in order])).alias("_first")
    named = cut(named.groupBy(F.col("r_lat").alias("_lat"), F.col("r_lon").alias("_lon")).agg(first).select("_first.*"))
    by = F.struct("metres", *[F.col(f"r_{c}") for c in order])
    keep = F.min_by(F.struct("metres", *named.columns), by).alias("_best")
    todo, best = left.filter("lat IS NOT NULL AND lon IS NOT NULL").select(key, "lat", "lon"), None
    radius = _first_radius(named.select(F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon")), 500.0, 1)
    while True:
        found = cut(_ring(todo, named, radius).groupBy(key).agg(keep).select(key, "_best.*"))
        best = found if best is None else best.unionByName(found)
        todo = cut(todo.join(found.select(key).hint("merge"), key, "left_anti"))
        if radius > 2.1e7 or todo.isEmpty():
            return left.join(best.hint("merge"), key, "left").select(*left.columns, "metres", *named.columns)
        radius *= 4


def closest(left: DataFrame, key: list[str], right: DataFrame, metres: float, k: int, order: list[str]) -> DataFrame:
    """At most ``k`` right points within ``metres`` of each left row, nearest first, with their rank. The left side is taken to be the smaller one.

    Where points are dense, a small radius is searched first; rows that have ``k`` points within it are done, and the others go on with four times the radius.
    """
    w = W.partitionBy(*key).orderBy("metres", *[f"r_{c}" for c in order])
    todo, done, radius = left, None, _first_radius(right, metres, k)
    while True:
        near = within(todo, right, radius, "left").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if radius >= metres:
            return near if done is None else done.unionByName(near)
        near = cut(near)
        full = near.filter(F.col("rank") == k).select(*key).hint("merge")
        some = near.join(full, key, "left_semi")
        done = some if done is None else done.unionByName(some)
        todo = cut(todo.join(full, key, "left_anti"))
        radius = min(4 * radius, metres)


def along(points: DataFrame, line: list[str], order: list[str]) -> DataFrame:
    """The distance from the line's first point by the order: ``step`` from the point before, and ``at``."""
    w = W.partitionBy(*line).orderBy(*order)
    step = S.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("at", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))


def lengths(points: DataFrame, line: list[str], order: list[str]) -> DataFrame:
    """Kilometres of each line."""
    return along(points, line, order).groupBy(*line).agg((F.sum("step") / 1000).alias("km"), F.count("*").alias("n_points"))


def boxes(points: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """The bounding box of each key's points, wider by a margin in degrees on each side."""
    return points.groupBy(*keys).agg((F.min("lat") - margin).alias("south"), (F.max("lat") + margin).alias("north"), (F.min("lon") - margin).alias("west"), (F.max("lon") + margin).alias("east"))


def part_lengths(points: DataFrame, line: str, part: str, order: list[str]) -> DataFrame:
    """Kilometres of each line as the sum of its parts, without the gaps between them, and their number."""
    return lengths(points, [line, part], order).groupBy(line).agg(F.sum("km").alias("km"), F.count("*").alias("n_parts"))


def sampled(points: DataFrame, line: list[str], order: list[str], every: float) -> DataFrame:
    """Points every ``every`` metres along each line from its first, and its last point; segments of length 0 are skipped."""
    w = W.partitionBy(*line).orderBy(*order)
    here = along(points, line, order).withColumns({"_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "_at": F.lag("at").over(w), "_last": F.lead("lat").over(w).isNull()})
    first, last = F.floor(F.col("_at") / every) + 1, F.floor(F.col("at") / every)
    ks = F.when(F.col("_at").isNull(), F.array(F.lit(0).cast("long"))).when((F.col("step") > 0) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    inner = here.withColumn("k", F.explode(ks))
    share = F.when(F.col("step") > 0, (F.col("k") * every - F.col("_at")) / F.col("step"))
    inner = inner.select(*line, (F.col("k") * every).alias("at"), F.when(F.col("_at").isNull(), F.col("lat")).otherwise(F.col("_lat") + (F.col("lat") - F.col("_lat")) * share).alias("lat"), F.when(F.col("_at").isNull(), F.col("lon")).otherwise(F.col("_lon") + (F.col("lon") - F.col("_lon")) * share).alias("lon"))
    ends = here.filter(F.col("_last") & F.col("_at").isNotNull()).select(*line, "at", "lat", "lon")
    return inner.unionByName(ends).dropDuplicates([*line, "at"])


def placed(points: DataFrame, line: str, order: list[str], stops: DataFrame) -> DataFrame:
    """Stops (line, place from 0, n) at equal shares of their line's length."""
    w = W.partitionBy(line).orderBy(*order)
    here = along(points, [line], order)
    segments = here.withColumns({"_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "_at": F.lag("at").over(w), "_seq": F.row_number().over(w), "_last": F.lead("lat").over(w).isNull()})
    # a line of one point is a segment from that point to itself
    segments = segments.filter("_at IS NOT NULL OR _last").withColumns({"_lat": F.coalesce("_lat", "lat"), "_lon": F.coalesce("_lon", "lon"), "_at": F.coalesce("_at", F.lit(0.0))})
    whole = here.groupBy(line).agg(F.max("at").alias("_all"))
    # the last one stands at the end itself, which its share may pass by a rounding
    share = F.when(F.col("place") == F.col("n") - 1, F.col("_all")).otherwise(F.col("_all") * F.col("place") / (F.col("n") - 1))
    wanted = stops.join(whole, line).withColumn("_t", F.when(F.col("n") > 1, share).otherwise(F.lit(0.0)))
    hit = wanted.join(segments, line).filter(F.col("at") >= F.col("_t") - 1e-9).groupBy(line, "place", "n", "_t").agg(F.min_by(F.struct("_lat", "_lon", "lat", "lon", "_at", "step"), "_seq").alias("s"))
    share = F.when(F.col("s.step") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_t") - F.col("s._at")) / F.col("s.step")))).otherwise(0.0)
    return hit.select(line, "place", (F.col("s._lat") + (F.col("s.lat") - F.col("s._lat")) * share).alias("lat"), (F.col("s._lon") + (F.col("s.lon") - F.col("s._lon")) * share).alias("lon"))


def centroids(points: DataFrame, routes: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Mean position by route; routes without points get the default."""
    mean = points.groupBy("route").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return routes.select("route").distinct().join(mean, "route", "left").withColumns({"lat": F.coalesce("lat", F.lit(default[0])), "lon": F.coalesce("lon", F.lit(default[1]))})


def clusters(stops: DataFrame, metres: float = 1600.0) -> DataFrame:
    """Stops (id, name, lat, lon) of one name that a chain of steps of at most ``metres`` joins, as one: cluster (least id), name, mean position, n.

    Least labels move along the pairs until nothing changes. In each round a stop hands the least label it sees to the stop that its own
    label names, and then takes that stop's label, so that whole clusters merge at once; each round is cut off.
    """
    pairs = cut(within(stops.select("id", "name", "lat", "lon"), stops.select("id", "name", "lat", "lon"), metres).filter((F.col("name") == F.col("r_name")) & (F.col("id") != F.col("r_id"))).select("id", F.col("r_id").alias("other")))
    labels = stops.select("id", F.col("id").alias("cluster"))
    while True:
        near = pairs.join(labels.withColumnRenamed("id", "other").withColumnRenamed("cluster", "_c"), "other").groupBy("id").agg(F.min("_c").alias("_c"))
        seen = cut(labels.join(near, "id", "left").select("id", "cluster", F.least("cluster", "_c").alias("low")))
        if seen.filter("low < cluster").isEmpty():
            break
        handed = seen.groupBy(F.col("cluster").alias("id")).agg(F.min("low").alias("_h"))
        moved = cut(seen.join(handed, "id", "left").select("id", F.least("low", "_h").alias("next")))
        named = moved.select(F.col("id").alias("next"), F.col("next").alias("cluster"))
        labels = moved.join(named, "next").select("id", "cluster")
    return stops.join(labels, "id").groupBy("cluster", "name").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def thinned(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Every k-th row of a group from the first, and the last."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"_n": F.row_number().over(w), "_end": F.lead(F.lit(1)).over(w).isNull()}).filter((F.pmod(F.col("_n") - 1, F.lit(k)) == 0) | F.col("_end")).drop("_n", "_end")


def latitude_first(a: Column, b: Column) -> tuple[Column, Column]:
    """Two coordinates in either order as latitude and longitude: in the region, only latitudes are above 50."""
    return F.when(F.abs(a) > 50, a).otherwise(b), F.when(F.abs(a) > 50, b).otherwise(a)
