"""Links between embeddings against all pairs, on vectors that have links."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from noema.llm import vectors


def made(common: float, seed: int = 1, n: int = 1500, d: int = 64):
    """Vectors in two labels, with a common direction of so many times the noise, and for a third of them a partner of
    cosine 0.975 to 0.99."""
    rng = np.random.Generator(np.random.PCG64(seed))
    base = rng.standard_normal((n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base[:, 0] += common
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = [base]
    for cosine in (0.975, 0.9805, 0.981, 0.983, 0.985, 0.99):
        own = base[rng.choice(n, n // 18, replace=False)]
        side = rng.standard_normal(own.shape)
        side -= (side * own).sum(1, keepdims=True) * own
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        out.append(cosine * own + np.sqrt(1 - cosine**2) * side)
    return np.concatenate(out) * rng.uniform(0.1, 9, (n + 6 * (n // 18), 1))


def brute(rows):
    """n_links and component of (id, label, vector)."""
    parent, degree = {i: i for i, *_ in rows}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for label in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == label]
        unit = np.array([r[2] for r in own], dtype=float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))):
            a, b = own[a][0], own[b][0]
            degree[a] += 1
            degree[b] += 1
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: (degree[i], root(i)) for i in parent}


@pytest.mark.parametrize("common", [0.0, 1.0, 3.0])
def test_links_of_vectors_with_a_common_direction(spark, common):
    """Recall against brute force is 0.99 or more, however strong the common direction is."""
    rows = [(i, f"l{i % 2}", x.tolist()) for i, x in enumerate(made(common))]
    rows = [(i, f"l{(i if i < 1500 else 0) % 2}", v) for i, _, v in rows]
    wanted = brute(rows)
    frame = spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<double>, label string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame).collect()}
    links = sum(n for n, _ in wanted.values())
    assert links >= 400
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(n for n, _ in found.values()) >= 0.99 * links
    assert sum(found[i] == wanted[i] for i in wanted) >= 0.985 * len(wanted)


def test_a_dense_group_and_cells_of_bounded_size(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    centre = rng.standard_normal(64)
    rows = [(i, "x", (centre + 0.055 * rng.standard_normal(64) * np.linalg.norm(centre) / 8).tolist()) for i in range(700)]
    rows += [(1000 + i, "x", rng.standard_normal(64).tolist()) for i in range(300)]
    wanted = brute(rows)
    assert max(n for n, _ in wanted.values()) > 600
    frame = spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<float>, label string")
    wanted = brute([(i, label, np.array(v, dtype=np.float32)) for i, label, v in rows])
    settings = vectors.Settings(cell=100, block=64)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame, settings).collect()}
    assert found == wanted


def test_odd_lengths_large_components_and_repeated_ids(spark):
    big = [1e300, 2e300, 0.0]
    rows = [(1, big, 5_000_000_000), (2, [1e-300, 2e-300, 0.0], 5_000_000_000), (3, [1.0, 2.0], 5_000_000_000), (4, [2.0, 4.0], 5_000_000_000), (4, [0.0, 0.0, 1.0], 5_000_000_000), (5, [0.0, 0.0, 2.0], 5_000_000_000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame).collect())
    assert found == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (4, 1, 3), (5, 1, 3)]
