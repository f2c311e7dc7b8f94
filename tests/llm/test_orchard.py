"""Clustering against a plain build, and the search against all distances."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import orchard

TYPE = "vec_id long, embedding array<float>"


def plain(rows: list[tuple], k: int, rounds: int, scale: int, dim: int) -> list[tuple]:
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[1]))
    centers = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), c in zip(kept, at) if c == j]
            if own:
                centers[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [nearest(v) for _, v in kept]
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(centers))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, c, d, inertia[c], sum(inertia.values()), shas[c]) for (i, _), (d, c) in zip(kept, found)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def awkward_vectors(dim: int = 6) -> list[tuple]:
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 2, (5, dim))
    rows = [(i, [float(x) for x in centers[i % 5] + rng.normal(0, 0.3, dim)]) for i in range(160)]
    rows += [(200 + i, rows[0][1]) for i in range(80)]  # a third are copies of one vector
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, [0.5] * dim)]  # repeated ids and rows, a NULL id
    rows += [(300, None), (301, []), (302, [1.0] * (dim - 1)), (303, [None] + [0.0] * (dim - 1)), (304, [float("nan")] * dim), (305, [float("-inf")] + [0.0] * (dim - 1))]
    return rows


@pytest.mark.parametrize("k,rounds", [(16, 3), (4, 0), (400, 1)])
def test_clusters_equal_the_plain_build(spark, k, rounds):
    rows = awkward_vectors()
    df = spark.createDataFrame(rows, TYPE).withColumns({"key": F.lit("x"), "cluster": F.lit("x"), "own": F.lit(1)}).repartition(3)
    got = orchard.cluster(df, k=k, rounds=rounds, scale=64, dim=6)
    assert ordered(got.collect()) == ordered(plain(rows, k, rounds, 64, 6))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_empty_tables_and_nothing_usable(spark):
    assert orchard.cluster(spark.createDataFrame([], TYPE)).collect() == []
    assert orchard.cluster(spark.createDataFrame([(1, None), (2, [1.0])], TYPE)).collect() == []


def test_components_without_exact_distances_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        orchard.cluster(spark.createDataFrame([(1, [1e30, 0.0])], TYPE), dim=2).collect()


def test_search_is_exact_and_skips_centroids():
    rng = np.random.default_rng(8)
    centers = rng.integers(-2000, 2000, (40, 5))
    points = centers[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 5))
    search = orchard.Orchard(centers)
    at, best = search.nearest(points)
    every = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert search.computed < 0.5 * every.size


def test_ties_go_to_the_smaller_number_from_every_start():
    centers = np.array([[4, 0], [-4, 0], [0, 4], [0, 4], [0, -4]])
    search = orchard.Orchard(centers)
    points = np.array([[0, 0], [0, 4], [2, 2], [-2, -2]])
    every = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2)
    for start in range(5):
        at, _ = search.nearest(points, np.full(4, start))
        assert at.tolist() == every.argmin(axis=1).tolist()
