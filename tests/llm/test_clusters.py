"""Centroid clustering against whole-number k-means in plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, first int, v string, cluster string"


def plain(rows, k=16, rounds=3, dim=64):
    """Every distance, in Python integers."""
    kept = [(i, [min(max(math.floor(64 * a), -(2**63)), 2**63 - 1) for a in x]) for i, x in rows if x is not None and len(x) == dim and all(a is not None and math.isfinite(a) for a in x)]
    hashed = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    cut = lambda x: min(x, 2**63 - 1)
    inertia = {j: cut(sum(cut(d) for d, c in last if c == j)) for j in range(len(centroids))}
    everything = cut(sum(cut(d) for d, _ in last))
    return [(i, c, cut(d), inertia[c], everything, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, last, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "clash", "y") for i, x in rows], SCHEMA).repartition(3)


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("kind", ["groups", "ties", "few", "one", "huge"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "groups":
        x = rng.normal(size=(400, 64)) / 8 + rng.integers(0, 5, 400)[:, None] / 3
    elif kind == "ties":  # on a coarse grid, with many copies
        x = rng.integers(0, 2, (300, 64)) * (np.arange(64) < 4) / 64.0
    elif kind == "huge":
        x = rng.normal(size=(60, 64)) * 10.0 ** rng.integers(0, 30, 60)[:, None]
    else:
        x = rng.normal(size=({"few": 9, "one": 1}[kind], 64))
    rows = [(i * 5 % 97, a.tolist()) for i, a in enumerate(x)] + [(None, x[0].tolist()), (3, None), (3, [1.0] * 63), (4, []), (5, [float("nan")] * 64), (6, [None] * 64), (7, [float("inf")] + [0.0] * 63)]
    if kind == "one":
        rows = [r for r in rows if r[0] is not None]
    assert key(clusters.centroid_clusters(frame(spark, rows)).collect()) == key(plain(rows))


def test_no_vectors(spark):
    assert clusters.centroid_clusters(frame(spark, [(1, None), (2, [1.0])])).isEmpty()
    assert clusters.centroid_clusters(frame(spark, []), id_col="vec_id").columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_other_parameters(spark):
    rng = np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 3)))]
    for k, rounds in ((5, 9), (40, 2), (3, 0)):
        assert key(clusters.centroid_clusters(frame(spark, rows), k=k, rounds=rounds, dim=3).collect()) == key(plain(rows, k, rounds, 3))


def test_search_computes_few_distances(spark):
    """Bounds and balls leave most distances uncomputed where there are groups."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1000, 64)) / 50 + rng.normal(size=(12, 64))[rng.integers(0, 12, 1000)]
    rows = clusters.grid_vectors(frame(spark, [(i, a.tolist()) for i, a in enumerate(x)])).cache()
    _, _, work = clusters.clustered(rows, clusters.first_centroids(rows, 16), 3)
    assert work[0] < 16 * 1000 and sum(work[1:]) < 0.5 * 3 * 16 * 1000
    again = rows.select("vec_id", F.reverse("v").alias("v"))
    assert clusters.clustered(again, clusters.first_centroids(again, 16), 3)[2] == work


def test_too_many(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST", 3)
    rows = [(i, [float(i)] * 64) for i in range(9)]
    with pytest.raises(ValueError):
        clusters.centroid_clusters(frame(spark, rows))
