"""Groups of near but unequal vectors that are larger than a leaf."""

import numpy as np
import pytest

from ledgerloom.llm import vector_dedup


@pytest.mark.parametrize("others", [0, 500, 3500])
def test_links_of_a_large_group_of_noisy_copies_are_found(spark, others):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, 64)
    x = np.vstack((centre + rng.normal(0, 0.1, (2500, 64)), rng.normal(0, 1, (others, 64)))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9999 * want.sum() > 1_000_000


def test_pairs_of_a_spread_label_stay_together():
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, (6000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(0, 1, (6000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    x = np.vstack((a, b))
    tree = vector_dedup._grow(7, x, 1.0, 512, 0.1, np.sqrt(0.04))
    out = []
    vector_dedup._route(tree, 7, x, np.arange(len(x)), out)
    met = np.zeros(6000, dtype=bool)
    for rows, _ in out:
        met[np.intersect1d(rows, np.arange(6000))] |= np.isin(np.intersect1d(rows, np.arange(6000)) + 6000, rows)
    # The links at the threshold are the hardest; one tree of eight finds nearly all.
    assert met.mean() > 0.998 and max(len(rows) for rows, _ in out) <= 512
    assert sum(len(rows) for rows, _ in out) < 8 * len(x)
