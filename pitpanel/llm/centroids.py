"""Centroid clustering of integer vectors in fixed rounds, with Elkan's bounds.

Each vector carries an upper bound of its distance to its centroid and a lower bound for each of the k centroids, in a
table written once a round. When centroids move, bounds move by as much. A centroid is looked at only if neither its
lower bound nor half its distance from the vector's own centroid is above the upper bound; both tests are strict and
all bounds are rounded outwards, so a centroid that might tie is always calculated. Distances are sums of integer
squares, exact in float64 for components below EXACT in size; a slice of vectors beyond that, or with centroids beyond
it, is calculated in Python's integers without bounds.

Sums of a round are those of the round before plus what moved: each task adds up its vectors by cluster, Spark adds up
the tasks' sums (k * 64 numbers, in limbs that no long overflows), and the driver divides k * 64 exact integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Integers of smaller size have squared distances below 2**53 over 64 components (differences below 2**23).
EXACT = 1 << 22
LIMB = 30
MOST_LONG = (1 << 63) - 1
STATE = "vec_id long, v array<double>, cluster int, was int, upper float, lower array<float>"


def root(square) -> float:
    try:
        return math.sqrt(square)
    except OverflowError:
        return math.inf


def up32(x: np.ndarray) -> np.ndarray:
    """float32 numbers that are above x."""
    with np.errstate(over="ignore"):
        return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def down32(x: np.ndarray) -> np.ndarray:
    """float32 numbers that are below x, zero at least."""
    with np.errstate(over="ignore"):
        return np.maximum(np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Centroids:
    """k centroids (lists of Python integers) with half their distances from each other and how far they moved."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None = None):
        self.points = points
        self.narrow = all(abs(x) < EXACT for p in points for x in p)
        self.at = np.array(points, np.float64 if self.narrow else object)
        half = [[math.nextafter(root(sum((x - y) ** 2 for x, y in zip(p, q, strict=True))), 0.0) / 2 for q in points] for p in points]
        self.half = np.array(half)
        moved = [sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) for p, q in zip(points, before or points, strict=True)]
        self.moved = np.array([math.nextafter(root(m), math.inf) if m else 0.0 for m in moved])


def integers(v: np.ndarray) -> np.ndarray:
    """Whole numbers held as float64, as Python integers."""
    return np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v from a centroid, or from one centroid a row."""
    return ((v - c) ** 2).sum(axis=1)


def assign(v: np.ndarray, at: Centroids, cluster: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
    """cluster, distance (exact; -1 where bounds made it needless), upper, lower, number of distances calculated.

    Without a cluster all distances are calculated; with one, bounds are of the centroids before they moved.
    """
    n, k = len(v), len(at.points)
    if n and not (at.narrow and np.abs(v).max() < EXACT):
        wide, points = integers(v), integers(at.at) if at.narrow else at.at
        every = [squares(wide, p) for p in points]
        cluster = np.array([min(range(k), key=lambda j: every[j][i]) for i in range(n)], np.int32)
        best = np.array([every[j][i] for i, j in enumerate(cluster)], object)
        return cluster, best, np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32), n * k
    if cluster is None:
        every = np.stack([squares(v, p) for p in at.at], axis=1) if n else np.zeros((0, k))
        cluster = every.argmin(axis=1).astype(np.int32)
        best = every[np.arange(n), cluster]
        return cluster, best, up32(np.sqrt(best)), down32(np.sqrt(every)), n * k
    cluster, best, looked = cluster.copy(), np.full(n, -1.0), 0
    upper = up32(upper.astype(np.float64) + at.moved[cluster])
    lower = down32(lower.astype(np.float64) - at.moved)

    def asked(rows, j):
        return (cluster[rows] != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= at.half[cluster[rows], j])

    others = np.where(np.eye(k, dtype=bool), np.inf, at.half).min(axis=1)  # half the distance to the nearest other centroid
    near = np.flatnonzero(upper >= others[cluster])
    for j in range(k):
        rows = near[asked(near, j)]
        loose = rows[best[rows] < 0]
        if len(loose):  # make the upper bound exact first; that often settles the question
            best[loose] = squares(v[loose], at.at[cluster[loose]])
            upper[loose] = up32(np.sqrt(best[loose]))
            looked += len(loose)
            rows = rows[asked(rows, j)]
        d = squares(v[rows], at.at[j])
        looked += len(rows)
        lower[rows, j] = down32(np.sqrt(d))
        won = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        rows, d = rows[won], d[won]
        cluster[rows], best[rows], upper[rows] = j, d, up32(np.sqrt(d))
    return cluster, best, upper, lower, looked


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1), kind))


def started(vectors: DataFrame, at: Centroids, dim: int, scale: int) -> DataFrame:
    """STATE rows of vectors (vec_id, embedding) after the first assignment."""

    def run(batches):
        for batch in common.sliced(batches, "centroids"):
            v = np.floor(_matrix(batch.column("embedding"), dim).astype(np.float64) * scale)
            cluster, _, upper, lower, _ = assign(v, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _lists(v, pa.float64()), pa.array(cluster), pa.array(np.full(len(v), -1, np.int32)), pa.array(upper), _lists(lower, pa.float32())],
                names=["vec_id", "v", "cluster", "was", "upper", "lower"],
            )

    return vectors.mapInArrow(run, STATE)


def moved_on(state: DataFrame, at: Centroids, dim: int, last: bool) -> DataFrame:
    """STATE rows after one more assignment, or after the last one vec_id, cluster and distance (a long; larger ones saturate)."""
    k = len(at.points)

    def run(batches):
        for batch in common.sliced(batches, "centroids"):
            v, was = _matrix(batch.column("v"), dim), batch.column("cluster").to_numpy()
            cluster, best, upper, lower, _ = assign(v, at, was, batch.column("upper").to_numpy(), _matrix(batch.column("lower"), k))
            if not last:
                columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster), pa.array(was), pa.array(upper), _lists(lower, pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "was", "upper", "lower"])
                continue
            if best.dtype == object:
                best = np.array([min(b, MOST_LONG) for b in best], np.int64)
            else:
                left = np.flatnonzero(best < 0)
                best[left] = squares(v[left], at.at[cluster[left]])
                best = best.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long" if last else STATE)


def moved_sums(state: DataFrame, k: int, dim: int) -> list[list[int]]:
    """For each cluster the exact sums of the components of vectors that came less those that left, and last their number."""

    def run(batches):
        total = np.zeros((k, dim + 1), object)
        for batch in common.sliced(batches, "centroids"):
            v = _matrix(batch.column("v"), dim)
            v = integers(v) if len(v) and np.abs(v).max() >= EXACT else v.astype(np.int64)
            for column, sign in (("cluster", 1), ("was", -1)):
                own = batch.column(column).to_numpy()
                for j in np.unique(own[own >= 0]):
                    rows = v[own == j]
                    total[j] += np.array([sign * int(x) for x in rows.sum(axis=0)] + [sign * len(rows)], object)
        out: dict[str, list] = {"cluster": [], "place": [], "limb": [], "total": []}
        for j, place in zip(*np.nonzero(total), strict=True):
            rest, limb = int(total[j, place]), 0
            while rest:
                part = rest if -(1 << LIMB) <= rest < 1 << LIMB else rest & ((1 << LIMB) - 1)
                rest = (rest - part) >> LIMB
                for name, value in zip(out, (j, place, limb, part), strict=True):
                    out[name].append(int(value))
                limb += 1
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())]))

    parts = state.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, place int, limb int, total long")
    sums = [[0] * (dim + 1) for _ in range(k)]
    for row in parts.groupBy("cluster", "place", "limb").agg(F.sum("total").alias("total")).collect():  # k * (dim + 1) numbers, in a few limbs
        sums[row.cluster][row.place] += row.total << (LIMB * row.limb)
    return sums


def usable(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and embedding of the vectors with exactly dim components, none null, not finite or too large to be scaled."""
    bad = F.exists("embedding", lambda x: x.isNull() | ~(F.abs(x.cast("double") * scale) < float("inf")))
    return vectors.filter((F.size("embedding") == dim) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row per usable row: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Component x becomes floor(scale * x). The first centroids are the k vectors with the smallest sha256 of
    `seed:vec_id` (a null vec_id counts as nothing; of equal hashes the smaller vector comes first). With fewer than k
    vectors there are as many centroids as vectors. Vectors of another length, null ones and ones with null or
    non-finite components give no row; an empty table gives none. Repeated rows each count and give a row. A centroid
    without vectors stays. Distances and inertias above the greatest long are given as that. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dim, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(order.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = Centroids([[math.floor(x * scale) for x in row.embedding] for row in first])
    k = len(first)
    state, sums = common.materialize(started(rows, at, dim, scale), "vectors"), [[0] * (dim + 1) for _ in range(k)]
    for done in range(rounds):
        sums = [[x + y for x, y in zip(old, new, strict=True)] for old, new in zip(sums, moved_sums(state, k, dim), strict=True)]
        points = [[x // s[-1] for x in s[:-1]] if s[-1] else p for s, p in zip(sums, at.points, strict=True)]
        at = Centroids(points, at.points)
        after = common.materialize(moved_on(state, at, dim, done == rounds - 1), "vectors")
        common.release(state)
        state = after
    own = {row.cluster: int(row.total) for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    every = min(sum(own.values()), MOST_LONG)
    about = [(j, min(own.get(j, 0), MOST_LONG), every, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for j, p in enumerate(at.points)]
    return state.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL: every distance of every round, without bounds."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS near
  FROM (SELECT rid, vec_id, x.v, c, list_sum([CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT) FOR p IN list_zip(x.v, m.v)]) AS d FROM x, c{r} AS m)
  GROUP BY rid
)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT c, i, sum(e) AS s, count(*) AS n
        FROM (SELECT near.c AS c, unnest(range(1, {DIM + 1})) AS i, unnest(v) AS e FROM a{r}) GROUP BY c, i)
  GROUP BY c
), c{r + 1} AS (SELECT c, coalesce(u{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN u{r} USING (c))""")
    return f"""
WITH x AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h LIMIT {k})
),{",".join(steps)}
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance,
       CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS m ON m.c = near.c
"""


ORACLE_OP11 = oracle()
