"""Centroid clustering of integer vectors by Shallot search.

Components x become integers floor(64 x).  Centroids start as the vectors whose ids
have the smallest salted hashes; in each round every vector goes to its nearest
centroid (ties: the smaller number) and each centroid moves to the floored mean of
its vectors.  A vector remembers its nearest and its second-nearest centroid, an
upper bound on the distance to the one and a lower bound on the distance to all
others.  When centroids move, the bounds move with them; where the upper bound is
still below the lower one, or below half the way to the next centroid, nothing is
computed.  Otherwise both remembered centroids are measured, and the search starts
from the closer one, through its neighbours in order of their distance from it.
Whatever lies farther from it than the vector does plus the second-best distance so
far can't be second best, so the search ends there, and the ball shrinks with every
better centroid found.  Survivors are compared in integers, so ties are exact; bounds
are kept on the safe side of rounding.

Scale.  Vectors, bounds and remembered numbers stay together in one table, which each
round rewrites without a shuffle; sums leave each task as one row per centroid and
component.  Centroids, their sorted neighbours and their sums are all that the driver
sees: at most ``MOST`` of them, an error beyond.  A cluster with a third of all rows
is like any other.

Vectors that are null, of another length, or hold null or non-finite components take
no part and have no row.  Repeated rows are separate vectors, and separate centroids
where their hash is among the smallest (ties: by components); a null id comes last.
Fewer vectors than centroids: each is a centroid.  Components beyond a 64-bit number
are cut off at its ends, and so are distances and their sums; on the way they are
exact at any size.  Other columns play no part, whatever their names.  No rows: no rows.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored

CLUSTERS, ROUNDS, DIM, SEED, GRID = 16, 3, 64, 1, 64.0
MOST = 4096
LONG = 2**63
SMALL = 1 << 26  # squared distances of such components are exact in 64 bits up to 512 components
UP, DOWN = 1 + 1e-9, 1 - 1e-9  # rounding of a bound is far below


def grid_vectors(vectors: DataFrame, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding", grid: float = GRID) -> DataFrame:
    """(vec_id, v): components floor(grid * x) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda a: a.cast("double"))
    fine = F.coalesce(F.size(vec_col) == dim, F.lit(False)) & ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    whole = F.transform(x, lambda a: F.when(F.abs(a * grid) < 2.0**63, F.floor(a * grid)).otherwise(F.when(a > 0, F.lit(LONG - 1)).otherwise(F.lit(-LONG))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def _small(*arrays: np.ndarray) -> bool:
    return all(a.size == 0 or (a.max() < SMALL and a.min() > -SMALL) for a in arrays) and arrays[0].shape[-1] <= 512


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as integers of any size."""
    if not _small(x, y):
        x, y = x.astype(object), y.astype(object)
    return np.square(x - y).sum(-1) if x.size else np.zeros(len(x), np.int64)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


class Neighbours:
    """Centroids, and for each one the others in order of distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        far = np.array([_root(squared(centroids, np.broadcast_to(c, centroids.shape))) for c in centroids]).reshape(k, k)
        np.fill_diagonal(far, -1)  # itself first, also before equals
        self.order = np.argsort(far, axis=1, kind="stable")
        self.far = np.take_along_axis(far, self.order, 1) * DOWN
        self.half = self.far[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        moved = _root(squared(centroids, before)) * UP if before is not None else np.zeros(k)
        self.moved = moved
        self.others_moved = np.array([np.delete(moved, c).max(initial=0) for c in range(k)])

    def kept(self, first: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Which vectors can't have another nearest centroid, by their bounds alone."""
        return (upper < lower) | (upper < self.half[first])

    def search(self, v: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second nearest, their squared distances, and how many distances each vector took."""
        n, k = len(v), len(self.centroids)
        best, d_best = first.copy(), squared(v, self.centroids[first])
        if k == 1:
            return best, np.full(n, -1, best.dtype), d_best, d_best, np.ones(n, np.int64)
        other, d_other = second.copy(), squared(v, self.centroids[second])
        swap = (d_other < d_best) | ((d_other == d_best) & (other < best))
        best, other = np.where(swap, other, best), np.where(swap, best, other)
        d_best, d_other = np.where(swap, d_other, d_best), np.where(swap, d_best, d_other)
        start, seen = best.copy(), other.copy()
        reach = _root(d_best) * UP
        open_, done = np.arange(n), np.full(n, 2)
        for step in range(1, k):
            s = start[open_]
            open_ = open_[self.far[s, step] <= reach[open_] + _root(d_other[open_]) * UP]
            if not len(open_):
                break
            c = self.order[start[open_], step]
            new = c != seen[open_]
            which, c = open_[new], c[new]
            d = squared(v[which], self.centroids[c])
            done[which] += 1
            nearer = (d < d_best[which]) | ((d == d_best[which]) & (c < best[which]))
            i = which[nearer]
            other[i], d_other[i] = best[i], d_best[i]
            best[i], d_best[i] = c[nearer], d[nearer]
            next_ = ~nearer & (d < d_other[which])
            other[which[next_]], d_other[which[next_]] = c[next_], d[next_]
        return best, other, d_best, d_other, done


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assign(near: Neighbours):
    """One round: bounds follow the centroids, and what they can't settle is searched.  ``work``: distances computed for the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = near.centroids.shape[1]
        for batch in batches:
            v = _vectors(batch.column(1), dim)
            first, second = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            upper = batch.column(4).to_numpy(zero_copy_only=False) + near.moved[first]
            lower = batch.column(5).to_numpy(zero_copy_only=False) - near.others_moved[first]
            todo = np.flatnonzero(~near.kept(first, upper * UP, lower * DOWN))
            work = np.zeros(len(v), np.int64)
            if len(todo):
                best, other, d_best, d_other, done = near.search(v[todo], first[todo], second[todo])
                first[todo], second[todo] = best, other
                upper[todo] = _root(d_best) * UP
                lower[todo] = _root(d_other) * DOWN if len(near.centroids) > 1 else np.inf
                work[todo] = done
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x) for x in (first.astype(np.int32), second.astype(np.int32), upper, lower, work))], ["vec_id", "v", "first", "second", "upper", "lower", "work"])

    return run


def _whole(values: list[int]) -> pa.Array:
    return pa.array([decimal.Decimal(x) for x in values], pa.decimal128(38, 0))


def _sums(k: int, dim: int):
    """Count and component sums of each cluster, one set of rows for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            v, first = _vectors(batch.column(0), dim), batch.column(1).to_numpy(zero_copy_only=False)
            n += np.bincount(first, minlength=k)
            order = np.argsort(first, kind="stable")
            present, at = np.unique(first[order], return_index=True)
            part = v[order] if _small(v) and len(v) < 1 << 36 else v[order].astype(object)
            if len(present):
                total[present] += np.add.reduceat(part, at, axis=0).astype(object)
        c = np.flatnonzero(n)
        yield pa.record_batch({"c": np.repeat(c, dim + 1), "i": np.tile(np.arange(-1, dim), len(c)), "s": _whole([x for j in c.tolist() for x in (int(n[j]), *map(int, total[j]))])})

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means; a centroid without vectors stays."""
    k, dim = centroids.shape
    sums = np.zeros((k, dim + 1), object)
    rows = state.select("v", "first").mapInArrow(_sums(k, dim), "c long, i long, s decimal(38,0)").groupBy("c", "i").agg(F.sum("s").alias("s"))
    for r in rows.collect():  # clusters times components
        sums[r.c, r.i + 1] = int(r.s)
    return np.array([[int(x) // int(s[0]) for x in s[1:]] if s[0] else c.tolist() for s, c in zip(sums, centroids, strict=True)], np.int64)


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(2).to_numpy(zero_copy_only=False)
            d = np.minimum(squared(_vectors(batch.column(1), centroids.shape[1]), centroids[first]), LONG - 1).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def clustered(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """State of (vec_id, v) after ``rounds`` moves and a last assignment, the final centroids, and the distances computed in each assignment."""
    k = len(centroids)
    if k > MOST:
        raise ValueError(f"{k} centroids, each with the order of all others, would be copied to every task; at most {MOST}")
    state = rows.select("vec_id", "v", F.lit(0).alias("first"), F.lit(min(1, k - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    near, work = Neighbours(centroids), []
    for turn in range(rounds + 1):
        state = stored(state.select("vec_id", "v", "first", "second", "upper", "lower").mapInArrow(_assign(near), "vec_id long, v array<long>, first int, second int, upper double, lower double, work long"))
        work.append(state.agg(F.sum("work")).first()[0] or 0)
        if turn < rounds:
            near = Neighbours(moved_centroids(state, near.centroids), near.centroids)
    return state, near.centroids, work


def centroid_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part."""
    spark = vectors.sparkSession
    rows = stored(grid_vectors(vectors, dim, id_col, vec_col))
    start = first_centroids(rows, k, seed)
    if not len(start):
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, centroids, _ = clustered(rows, start, rounds)
    found = state.select("vec_id", "v", "first").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long")
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}  # one row a cluster
    cut = lambda x: min(x, LONG - 1)
    of_all = cut(sum(sums.values()))
    facts = [(c, cut(d), of_all, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
