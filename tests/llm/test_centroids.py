"""Clustering against plain integer arithmetic, also on odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerloom.llm import centroids

ROWS = "vec_id long, label string, embedding array<double>, cluster string, q int, _id string"


def brute(vectors, dims, k, rounds):
    kept = []
    for vec_id, v in vectors:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) <= centroids.LARGEST for x in v):
            kept.append((vec_id, [math.floor(64 * x) for x in v]))
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    at = [q for _, q in start[:k]]

    def assign():
        out = []
        for i, q in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(q, o)), c) for c, o in enumerate(at))
            out.append((i, c, d, q))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(at)):
            own = [q for _, x, _, q in of if x == c]
            if own:
                at[c] = [sum(col) // len(own) for col in zip(*own)]
    return sorted([r[:3] for r in assign()], key=str), at


def made(dims, n, seed):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centre)]) for i in range(n)]
    v = rows[0][1]
    odd = [None, [], v[:-1], v + [0.0], [None, *v[1:]], [float("nan"), *v[1:]], [float("inf"), *v[1:]], [-1e300, *v[1:]], [2.0**20, *v[1:]], [-(2.0**20), *v[1:]]]
    return rows + [(n + i, o) for i, o in enumerate(odd)] + [rows[1], rows[1], (None, rows[-2][1]), (3, rows[-1][1])]


@pytest.mark.parametrize("dims, n, k, lead", [(8, 300, 6, 3), (8, 300, 6, 8), (64, 200, 16, 12), (4, 2, 16, 2)])
def test_same_as_plain_integers(spark, dims, n, k, lead):
    vectors = made(dims, n, dims + n)
    df = spark.createDataFrame([(i, None, v, "x", 1, None) for i, v in vectors], ROWS)
    got = centroids.cluster_vectors(df, "vec_id", "embedding", dims, k, rounds=3, lead=lead)
    rows, at = brute(vectors, dims, k, 3)
    assert sorted([tuple(r) for r in got.rows.collect()], key=str) == rows
    assert got.centroids == at
    assert got.inertia == [sum(r[2] for r in rows if r[1] == c) for c in range(len(at))]


def test_equal_vectors_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([(i, None, [0.5, 1.0], None, None, None) for i in range(20)], ROWS)
    got = centroids.cluster_vectors(df, "vec_id", "embedding", 2, 4, rounds=2)
    assert {tuple(r)[1:] for r in got.rows.collect()} == {(0, 0)} and got.centroids == [[32, 64]] * 4


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], ROWS)
    assert centroids.cluster_vectors(df, "vec_id", "embedding", 4, 4, 3).rows.collect() == []
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op12(spark, str(tmp_path)).collect() == []


def test_bounds_leave_few_centroids(monkeypatch):
    """The filter is what decides most centroids: with it, far fewer exact distances are made than without."""
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 64, (16, 64))
    q = (centre[rng.integers(0, 16, 5000)] + rng.normal(0, 12, (5000, 64))).astype(np.int64)
    moved = q - q.mean(0)
    axes = np.linalg.eigh(moved.T @ moved)[1][:, ::-1][:, :12]
    rotation = centroids.Rotation(q.mean(0), np.ascontiguousarray(axes))
    lead, rest = rotation(q.astype(float))
    made = []
    plain = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: made.append(x.sum()) or plain(x))
    start = q[:16]
    cluster, best = centroids.nearest(q, lead, rest, start, rotation)
    exact = ((q[:, None, :] - start) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert sum(made) < 0.35 * exact.size
