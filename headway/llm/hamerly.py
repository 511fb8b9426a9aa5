"""Centroid clustering in exact integers, with Hamerly's bounds in place of most distances."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut, shared_path

#: Components of a vector, steps of 1 that a component is cut into, centroids, rounds, and the seed of the first centroids.
WIDTH, STEPS, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Integers up to this magnitude have squared distances of at most 63 bits.
LARGEST = 1 << 27
#: Vectors in a bucket, and buckets at most.
BUCKET, BUCKETS = 2_000, 50_000
#: Bounds are kept in doubles: distances are rounded up or down by this share, which is far above an error of rounding.
SLACK = 1e-12


def whole_vectors(embeddings: DataFrame, width: int = WIDTH, steps: int = STEPS) -> DataFrame:
    """(vec_id, v) of the vectors with ``width`` components, none null or not finite, each component x as floor(steps * x)."""
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    kept = embeddings.filter(F.coalesce((F.size(x) == width) & F.forall(x, finite), F.lit(False)))
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(steps)) * c.cast("double"))).alias("v"))


def _first(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of "seed:vec_id"; null ids come last, ties by components. Each task brings k rows at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return np.einsum("ij,ij->i", gap, gap)


class Centres:
    """The centroids of a round, how far each came from the one before, and half the distance from each to its nearest neighbour."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        moved = np.zeros(len(now)) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(float)) * (1 + SLACK)
        self.moved = moved
        order = np.argsort(-moved, kind="stable")
        self.most = np.full(len(now), moved[order[0]])  # of the others
        self.most[order[0]] = moved[order[1]] if len(now) > 1 else 0.0
        gaps = np.sqrt(((now[:, None] - now[None]) ** 2).sum(2).astype(float))
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(1) / 2 * (1 - SLACK)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of each row (of ties, the first), the squared distance, and that to the second nearest."""
        best, least, second = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        for j, centre in enumerate(self.now):
            d = _squares(x, centre)
            nearer = d < least
            second = np.where(nearer, least, np.minimum(second, d))
            best, least = np.where(nearer, np.int32(j), best), np.where(nearer, d, least)
        return best, least, second

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loosen the bounds by the drift; where they don't decide, take the exact distance to the own centroid, and where that doesn't, scan all."""
        cluster = cluster.copy()
        upper, lower = (upper + self.moved[cluster]) * (1 + SLACK), lower - self.most[cluster]
        lower = np.where(lower > 0, lower * (1 - SLACK), lower)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[cluster]))
        if len(open_):
            upper[open_] = np.sqrt(_squares(x[open_], self.now[cluster[open_]]).astype(float)) * (1 + SLACK)
            open_ = open_[upper[open_] >= np.maximum(lower, self.half[cluster])[open_]]
        if len(open_):
            cluster[open_], least, second = self.scan(x[open_])
            upper[open_] = np.sqrt(least.astype(float)) * (1 + SLACK)
            lower[open_] = np.sqrt(second.astype(float)) * (1 - SLACK)
        return cluster, upper, lower


_STATE = "rid long, cluster int, upper double, lower double, joined long, sums array<long>"


def _vectors_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)


def _round(rows: DataFrame, centres: Centres, width: int) -> DataFrame:
    """The new state of each vector; and, without a rid, for each batch and cluster what it won and lost: vectors and their sum."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        k = len(centres.now)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors_of(batch.column("v"), width)
            was = batch.column("cluster").to_numpy(zero_copy_only=False)
            if batch.column("cluster").null_count:  # the first round
                was = np.full(len(x), -1, np.int32)
                cluster, least, second = centres.scan(x)
                upper, lower = np.sqrt(least.astype(float)) * (1 + SLACK), np.sqrt(second.astype(float)) * (1 - SLACK)
            else:
                cluster, upper, lower = centres.assign(x, was.astype(np.int32), batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            joined, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
            changed = np.flatnonzero(cluster != was)
            for j in range(k):
                won, lost = changed[cluster[changed] == j], changed[was[changed] == j]
                joined[j] = len(won) - len(lost)
                sums[j] = x[won].sum(0) - x[lost].sum(0)
            touched = np.unique(np.r_[cluster[changed], was[changed]])
            touched = touched[touched >= 0]
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), none, pa.nulls(len(x), pa.list_(pa.int64()))],
                ["rid", "cluster", "upper", "lower", "joined", "sums"],
            )
            if len(touched):
                n = len(touched)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.array(touched, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(joined[touched]), pa.array(sums[touched].tolist(), pa.list_(pa.int64()))],
                    ["rid", "cluster", "upper", "lower", "joined", "sums"],
                )

    return rows.select("rid", "v", "cluster", "upper", "lower").mapInArrow(run, _STATE)


def _last(rows: DataFrame, centres: Centres, width: int) -> DataFrame:
    """vec_id, cluster and the exact squared distance after the last assignment."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _vectors_of(batch.column("v"), width)
                cluster, *_ = centres.assign(x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(_squares(x, centres.now[cluster]))], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, "vec_id long, cluster int, distance long")


def _saved(df: DataFrame, buckets: int) -> DataFrame:
    """The rows as a table in the shared folder, in buckets of rid: two such tables meet bucket by bucket, without a shuffle."""
    spark, name = df.sparkSession, f"headway_{uuid.uuid4().hex}"
    df.write.option("path", shared_path(spark, name)).bucketBy(buckets, "rid").sortBy("rid").saveAsTable(name)
    return spark.table(name)


def centroid_clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, steps: int = STEPS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are written once, in buckets of a row number. Beside them stands the state: a vector's cluster, an upper bound on the distance to its centroid and
    a lower bound on that to any other. Each round reads both bucket by bucket, loosens the bounds by how far centroids moved, scans in exact
    integers only the vectors that the bounds leave open, and writes the new state, a tenth of the vectors' size. Centroids follow from sums that
    change only by what vectors that changed sides add and take; Spark adds up a row per batch and cluster. The driver holds k centroids.

    Vectors of another width, a null vector, and those with null or not finite components are left out; the others are all clustered. Fewer
    kept vectors than k make so many centroids, and none makes an empty result. Rows that repeat an id are clustered each; null ids count as the last when the
    first centroids are chosen, and ids that tie are ordered by their vectors. Equal centroids go to the smaller number, so the larger stays empty where it is.
    A component of 2**17 or more in magnitude raises an error, as squared distances would pass 63 bits. Other columns are not read.
    """
    spark = embeddings.sparkSession
    kept = whole_vectors(embeddings, width, steps).withColumn("v", F.transform("v", lambda c: F.when(F.abs(c) < LARGEST, c.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for distances of 63 bits")).cast("int"))))
    rows = cut(kept)
    count = rows.count()
    now = _first(rows, k, seed)
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    buckets = max(1, min(BUCKETS, -(-count // BUCKET)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column("v").flatten().to_numpy(), np.int32).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary())], ["rid", "vec_id", "v"])

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(pack, "rid long, vec_id long, v binary")
    vectors = _saved(numbered.repartition(buckets, "rid"), buckets)
    state = None
    joined, sums = [0] * len(now), [[0] * width for _ in now]
    before = None
    for _ in range(rounds):
        at = vectors.select("rid", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("upper"), F.lit(None).cast("double").alias("lower")) if state is None else vectors.join(state.filter("rid IS NOT NULL"), "rid")
        state = _saved(_round(at, Centres(now, before), width), buckets)
        won = state.filter("rid IS NULL").groupBy("cluster").agg(F.sum("joined").alias("joined"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
        for r in won.collect():  # k rows at most
            joined[r["cluster"]] += r["joined"]
            sums[r["cluster"]] = [a + int(b) for a, b in zip(sums[r["cluster"]], r["sums"])]
        before, now = now, np.array([[s // n for s in total] if n else old.tolist() for n, total, old in zip(joined, sums, now)], np.int64)
    at = vectors.join(state.filter("rid IS NOT NULL"), "rid") if state is not None else vectors.select("*", F.lit(None).cast("int").alias("cluster"))
    found = cut(_last(at, Centres(now, before), width))
    of_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    table = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in of_cluster), digests[r["cluster"]]) for r in of_cluster], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int = ROUNDS) -> str:
    """Each round's assignments and centroids, as tables that follow from the round before."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
a{i} AS MATERIALIZED (SELECT rid, min_by(c, (d, c)) AS cluster, min(d) AS distance FROM (
  SELECT rid, c, CAST(list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d FROM vectors, c{i}) GROUP BY rid)""")
        if i < rounds:
            out.append(f"""
s{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM vectors JOIN a{i} a USING (rid)) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) FILTER (s IS NOT NULL), any_value(m)) AS m
  FROM c{i} LEFT JOIN s{i} ON c = cluster GROUP BY c)""")
    return ",".join(out)


SQL = f"""
WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM vectors QUALIFY c < 8),
{_rounds_sql()},
i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN vectors USING (rid) JOIN i USING (cluster) JOIN c{ROUNDS} ON c = cluster
"""
