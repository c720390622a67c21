"""Clustering of vectors of whole numbers around centroids, with distances filtered in a PCA-rotated space.

Components are quantised to floor(scale * x). One pass adds up the moments of all
vectors; their leading principal axes give the rotation. Each vector is stored with
its leading rotated coordinates and the norm of what is left over. The squared
distance of the leading coordinates plus the squared difference of the two norms
never exceeds the distance of vector and centroid, so a centroid whose bound
(less a margin for rounding) is above the exact distance of the most promising one
is out. The others are decided in integers: results don't depend on the rotation.

Each round reads the stored vectors once; a task adds up its vectors per cluster, so
a cluster that holds most vectors is as cheap as any other. Only the centroids
(``k`` rows) and the moments (dims**2 numbers) reach the driver.

Nulls and odd rows: a vector that is null, has another number of components, or has
one that is null, not finite or beyond +-2**26 after quantising (its distance would
not fit a long) is left out. A null id is clustered but never starts a centroid.
Ties go to the smaller cluster number; equal hashes of starting vectors are ordered by
their components. Rows that repeat count each. With fewer vectors than ``k`` there
are fewer centroids; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .storage import stored

LEAD = 12  # rotated coordinates that are kept
LARGEST = 1 << 26
ROWS = 8192  # vectors compared at once


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(_id, q): the vectors that can be clustered, as whole numbers."""
    scaled = F.transform(F.col(vec_col), lambda x: F.lit(scale) * x.cast("double"))
    whole = vectors.select(F.col(id_col).cast("long").alias("_id"), scaled.alias("s")).where(F.size("s") == dims)
    whole = whole.where(F.forall("s", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)))
    return whole.select("_id", F.transform("s", lambda x: F.floor(x).cast("int")).alias("q"))


def _matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), type=kind))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _add_up(rows: DataFrame, keys: list[str], column: str, kind: str) -> DataFrame:
    """Sums of the arrays in ``column`` place by place."""
    places = rows.select(*keys, F.posexplode(column).alias("place", "x"))
    return places.groupBy(*keys, "place").agg(F.sum(F.col("x").cast(kind)).alias("x"))


@dataclass
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # dims x lead, orthonormal columns

    def __call__(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = q - self.mean
        lead = moved @ self.axes
        return lead, np.linalg.norm(moved - lead @ self.axes.T, axis=1)


def fitted_rotation(points: DataFrame, dims: int, lead: int) -> Rotation:
    """Leading principal axes of all vectors."""

    def moments(batches):
        count, total, square = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in _chunks(batches):
            q = _matrix(batch.column("q"), dims, np.float64)
            count, total, square = count + len(q), total + q.sum(0), square + q.T @ q
        if count:
            flat = np.concatenate([[count], total, square.ravel()])[None, :]
            yield pa.RecordBatch.from_arrays([_lists(flat, pa.float64())], names=["m"])

    sums = _add_up(points.select("q").mapInArrow(moments, "m array<double>"), [], "m", "double").collect()
    flat = np.zeros(1 + dims + dims * dims)
    for r in sums:
        flat[r["place"]] = r["x"]
    mean = flat[1 : 1 + dims] / max(1.0, flat[0])
    spread = flat[1 + dims :].reshape(dims, dims) / max(1.0, flat[0]) - np.outer(mean, mean)
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, : min(lead, dims)]))


def rotated(points: DataFrame, rotation: Rotation) -> DataFrame:
    """(_id, q, lead, rest): the leading rotated coordinates and the norm of the remainder beside each vector."""
    dims = len(rotation.mean)

    def rotate(batches):
        for batch in _chunks(batches):
            lead, rest = rotation(_matrix(batch.column("q"), dims, np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("q"), _lists(lead, pa.float64()), pa.array(rest)], names=["_id", "q", "lead", "rest"])

    return stored(points.mapInArrow(rotate, "_id long, q array<int>, lead array<double>, rest double"), "rotated")


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, both exact, for vectors with their rotated coordinates."""
    c_lead, c_rest = rotation(centroids.astype(np.float64))
    length = (lead**2).sum(1) + rest**2
    c_length = (c_lead**2).sum(1) + c_rest**2
    bound = np.maximum((lead**2).sum(1)[:, None] + (c_lead**2).sum(1) - 2 * lead @ c_lead.T, 0) + (rest[:, None] - c_rest) ** 2
    bound -= 1e-9 * (length[:, None] + c_length) + 1e-6  # rounding
    cluster = bound.argmin(1)

    def exact(rows, to) -> np.ndarray:
        apart = q[rows] - centroids[to]
        return (apart * apart).sum(1)

    first = cluster.copy()
    best = exact(slice(None), cluster)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if len(rows):
            d = exact(rows, c)
            better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = d[better], c
    return cluster, best


@dataclass
class Clusters:
    rows: DataFrame  # id, cluster, distance
    centroids: list[list[int]]
    inertia: list[int]  # of each cluster


def cluster_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, k: int, rounds: int, scale: int = 64, seed: int = 1, lead: int = LEAD) -> Clusters:
    """Each vector with its centroid after ``rounds`` rounds and the squared distance to it."""
    spark = vectors.sparkSession
    points = stored(quantised(vectors, id_col, vec_col, dims, scale), "quantised")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    start = points.where("_id is not null").orderBy(drawn, "q").limit(k).collect()
    if not start:  # nothing, or null ids alone
        start = points.orderBy("q").limit(k).collect()
    centroids = np.array([r["q"] for r in start], dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], "_id long, cluster int, distance long").withColumnRenamed("_id", id_col), [], [])
    rotation = fitted_rotation(points, dims, lead)
    kept = rotated(points, rotation)
    width = rotation.axes.shape[1]

    def placed(batch, centroids):
        q = _matrix(batch.column("q"), dims, np.int64)
        cluster, distance = nearest(q, _matrix(batch.column("lead"), width, np.float64), batch.column("rest").to_numpy(), centroids, rotation)
        return q, cluster, distance

    def sums(centroids):
        def add(batches):
            total, count = np.zeros((len(centroids), dims), np.int64), np.zeros((len(centroids), 1), np.int64)
            for batch in _chunks(batches):
                q, cluster, _ = placed(batch, centroids)
                for c in np.unique(cluster):
                    total[c] += q[cluster == c].sum(0)
                    count[c] += np.count_nonzero(cluster == c)
            met = np.flatnonzero(count[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), _lists(np.hstack([total, count])[met], pa.int64())], names=["cluster", "x"])

        return add

    for _ in range(rounds):
        moved = _add_up(kept.select("q", "lead", "rest").mapInArrow(sums(centroids), "cluster int, x array<long>"), ["cluster"], "x", "decimal(38,0)").collect()
        total = {(r["cluster"], r["place"]): int(r["x"]) for r in moved}
        centroids = np.array([[total[c, d] // total[c, dims] if (c, dims) in total else int(old[d]) for d in range(dims)] for c, old in enumerate(centroids)], dtype=np.int64)

    def label(batches):
        for batch in _chunks(batches):
            _, cluster, distance = placed(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["_id", "cluster", "distance"])

    rows = stored(kept.mapInArrow(label, "_id long, cluster int, distance long"), "clustered")
    inertia = {r["cluster"]: int(r["i"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()}
    return Clusters(rows.withColumnRenamed("_id", id_col), centroids.tolist(), [inertia.get(c, 0) for c in range(len(centroids))])


def _per_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def _sql(k: int, dims: int, rounds: int) -> str:
    steps = [
        f"""q AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c, v FROM q QUALIFY c < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(q.v) AS v,
            min({{'d': list_sum(list_transform(range(1, {dims + 1}), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))::BIGINT, 'c': c}}) AS m
            FROM q CROSS JOIN c{i} c GROUP BY r)""")
        steps.append(f"""s{i} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY c, d)""")
        steps.append(f"""c{i + 1} AS (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o
            LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v FROM s{i} GROUP BY c) n ON n.c = o.c)""")
    return "WITH " + ",\n".join(steps) + f"""
        SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON c.c = m.c"""  # fmt: skip


@query("op12_centroids", _sql(16, 64, 3))
def op12(spark, sf_dir) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, k=16, rounds=3)
    if not found.centroids:
        found.centroids, found.inertia = [[]], [0]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    inertia, largest = sum(found.inertia), 2**63 - 1
    fits = [i if i <= largest else None for i in [inertia, *found.inertia]]
    return found.rows.select(
        "vec_id", "cluster", "distance", _per_cluster(fits[1:], "long").alias("cluster_inertia"), F.lit(fits[0]).cast("long").alias("inertia"), _per_cluster(digests, "string").alias("centroid_sha256"),
    )
