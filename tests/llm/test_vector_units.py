"""Labels that are divided into units, each compared in one task."""

import os

import numpy as np
import pytest

from ledgerloom.llm import vector_dedup


def vectors(spark, n: int, copies: int, dims: int = 32):
    """``n`` vectors of two labels, and ``copies`` near copies of one of them."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (n, dims))
    near = x[rng.integers(0, n, n)] + rng.normal(0, 0.12, (n, dims))
    x = np.vstack((x, near, x[0] + rng.normal(0, 0.05, (copies, dims)))).astype(np.float32)
    label = np.concatenate((np.arange(n) % 2, rng.integers(0, 2, n), np.zeros(copies))).astype(int)
    rows = [(i, v.tolist(), int(label[i])) for i, v in enumerate(x)]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4), want


@pytest.mark.parametrize("copies,block", [(0, 1024), (700, 100)])
def test_pairs_of_a_divided_label_count_once(spark, monkeypatch, copies, block):
    monkeypatch.setattr(vector_dedup, "UNIT", 32 * 400)
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    df, want = vectors(spark, 2000, copies)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df, leaf=64).collect()}
    found = np.array([got[i] for i in range(len(want))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum() > 100


def test_written_tables_grow_with_the_vectors(spark):
    def written(n: int) -> int:
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        vector_dedup.near_vectors(vectors(spark, n, 0)[0]).collect()
        new = set(os.listdir(folder)) - before
        return sum(os.path.getsize(os.path.join(top, f)) for d in new for top, _, files in os.walk(os.path.join(folder, d)) for f in files)

    folder = vector_dedup.stored.__globals__["shared_dir"](spark).removeprefix("file://")
    small, large = written(500), written(5000)
    # A vector takes 128 bytes, and the trees of the larger label would write it dozens of times.
    assert large < 10 * small + 4 * 10_000 * 128
