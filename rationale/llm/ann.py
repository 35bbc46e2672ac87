"""Approximate nearest neighbours: hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample of rows (``SAMPLE``, those with the least
hashes of their ids): k-means splits each
node into ``BRANCHES`` until a node holds ``LEAF`` sample rows or fewer.  Every row is then sent
down to its leaf.  A query walks the tree with a priority queue that holds the
unopened nodes by distance to their centres, and so ranks the leaves.  How many
leaves are opened is calibrated: for a bounded set of rows the true neighbours
among all rows are found, and visits widen until they hold the target recall.

Scale.  The tree has a bounded size, so a query reads a share of all rows that
calibration decides and that hardly falls as the table grows.  Rows are grouped by leaf, and a leaf with
many rows is split into parts, as is a leaf that many queries visit; a group is
one part of rows and one part of queries.  Only the k best of each group travel
on.  Distances are exact and in double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of different lengths have no distance, so each length is searched
by itself.  Distances hold at any size of the components.  Repeated ids are
separate candidates, but a query skips rows with its own id, and a repeated query
is one query for each of its rows.  Other columns play no part, whatever their
names.  No rows: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored

SAMPLE = 20_000
BRANCHES = 8
LEAF = 100
CALIBRATION = 200
RECALL = 0.95
PART = 20_000


class Tree:
    """Centres of all nodes; children of inner nodes; leaf numbers of the others."""

    def __init__(self, rows: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 11):
        self.centres, self.children, self.leaf_of = [rows.mean(0)], [[]], [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        work = [(0, rows)]
        while work:
            node, own = work.pop()
            parts = self._split(own, branches, rng) if len(own) > leaf else []
            if len(parts) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for part in parts:
                self.centres.append(part.mean(0))
                self.children.append([])
                self.leaf_of.append(-1)
                self.children[node].append(len(self.centres) - 1)
                work.append((len(self.centres) - 1, part))
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
        scale = np.abs(rows).max() or 1.0
        if not 1e-100 < scale < 1e100:
            return [rows]  # squares would overflow or vanish
        centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(10):
            near = (np.square(centres).sum(1) - 2 * rows @ centres.T).argmin(1)
            centres = np.array([rows[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        near = (np.square(centres).sum(1) - 2 * rows @ centres.T).argmin(1)
        return [rows[near == j] for j in range(len(centres)) if (near == j).any()]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest child at every node."""
        out = np.empty(len(rows), np.int64)
        work = [(0, np.arange(len(rows)))]
        while work:
            node, at = work.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            c = self.centres[self.children[node]]
            near = (np.square(c).sum(1) - 2 * rows[at] @ c.T).argmin(1)
            work += [(child, at[near == j]) for j, child in enumerate(self.children[node]) if (near == j).any()]
        return out

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a best-bin-first walk opens."""
        distance = np.square(self.centres - query).sum(1)
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf_of[node])
            for child in self.children[node]:
                heapq.heappush(queue, (distance[child], child))
        return out


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query but its own, ties to smaller ids, by exact distances."""
    found = []
    largest = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    unit = 1.0 if 1e-100 < largest < 1e100 else largest or 1.0  # squares neither overflow nor vanish
    near_rows = rows / unit
    of_rows = np.square(near_rows).sum(1)
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256] / unit
        of_queries = np.square(q).sum(1)
        rough = of_rows + of_queries[:, None] - 2 * q @ near_rows.T
        rough[query_ids[a : a + 256, None] == row_ids] = np.inf
        m = min(k, len(rows))
        bar = np.partition(rough, m - 1, axis=1)[:, m - 1] + 1e-12 * (of_queries + of_rows.max(initial=0))  # what rounding may hide
        for i, b in enumerate(bar):
            near = np.flatnonzero((rough[i] <= b) & np.isfinite(rough[i]))
            exact = unit * np.sqrt(np.square(near_rows[near] - q[i]).sum(1))
            order = np.lexsort((row_ids[near], exact))[:k]
            found.append(pd.DataFrame({"query_id": query_ids[a + i], "vec_id": row_ids[near][order], "score": exact[order], "row": near[order]}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "row": np.zeros(0, np.int64)})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with v as doubles, of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda a: a.cast("double"))
    fine = F.col(vec_col).isNotNull() & ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))) & F.exists(x, lambda a: a != 0)
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def _to_leaves(tree: Tree):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(leaf=tree.assign(_matrix(f.v)))

    return run


def _true_neighbours(asked: np.ndarray, ids: np.ndarray, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                got = nearest(asked, ids, _matrix(f.v), f.vec_id.to_numpy(), k)
                yield got.assign(leaf=f.leaf.to_numpy()[got.row.to_numpy()])[["query_id", "vec_id", "score", "leaf"]]

    return run


def _walk(tree: Tree, visits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bins = [tree.best_bins(q, visits) for q in _matrix(f.v)] if len(f) else []
            yield f.assign(leaf=bins).explode("leaf").dropna(subset="leaf").astype({"leaf": "int64"})

    return run


def _search(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return nearest(_matrix(queries.v), queries.vec_id.to_numpy(), _matrix(rows.v), rows.vec_id.to_numpy(), k)[["query_id", "vec_id", "score"]]

    return run


def calibrated_visits(tree: Tree, rows: DataFrame, asked: list, k: int, recall: float) -> int:
    """Leaves to open so that the true neighbours of the rows asked about are found with ``recall``."""
    points = np.array([r.v for r in asked], float)
    ids = np.array([r.vec_id for r in asked])
    near = rows.mapInPandas(_true_neighbours(points, ids, k), "query_id long, vec_id long, score double, leaf long")
    near = near.selectExpr("query_id", "leaf", "row_number() over (partition by query_id order by score, vec_id) as rank").where(f"rank <= {k}").collect()
    order = {i: {leaf: n for n, leaf in enumerate(tree.best_bins(p, tree.leaves), 1)} for i, p in zip(ids.tolist(), points, strict=True)}
    needed = sorted(order[r.query_id][r.leaf] for r in near)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else tree.leaves


def least_hashes(points: DataFrame, n: int, most: int) -> list:
    """About ``most`` of n rows, those with the least hashes of their ids: a bar on the hash leaves few more in all partitions together."""
    code = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 40))
    bar = int((1 << 40) * min(1.0, 1.2 * most / n)) + 1
    return points.where(code <= bar).orderBy(code, "vec_id").limit(most).collect() if n > most else points.collect()


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by ``every``."""
    points = usable(vectors, id_col, vec_col)
    sizes = points.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).where("asked > 0").orderBy("width").collect()
    found = [_of_one_length(points.where(F.size("v") == r.width), r.n, r.asked, k, every, recall, sample) for r in sizes]
    return reduce(DataFrame.union, found) if found else points.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0d as score").where("false")


def _of_one_length(points: DataFrame, n: int, n_asked: int, k: int, every: int, recall: float, sample: int) -> DataFrame:
    kind = "query_id long, vec_id long, score double"
    tree = Tree(np.array([r.v for r in least_hashes(points, n, sample)], float))
    rows = stored(points.mapInPandas(_to_leaves(tree), "vec_id long, v array<double>, leaf long"))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    known = {r.vec_id: r for r in least_hashes(asked, n_asked, CALIBRATION)}
    visits = calibrated_visits(tree, rows, list(known.values()), k, recall)
    visiting = asked.mapInPandas(_walk(tree, visits), "vec_id long, v array<double>, leaf long")

    def parts(df: DataFrame) -> DataFrame:
        """Parts by leaf: as many rows as the tree has leaves."""
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))

    row_parts, query_parts = parts(rows).withColumnRenamed("parts", "row_parts"), parts(visiting).withColumnRenamed("parts", "query_parts")
    both = stored(row_parts.join(query_parts, "leaf"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        split = df.join(F.broadcast(both.select("leaf", F.col(f"{own}_parts").alias(f"{own}_own"), F.col(f"{other}_parts").alias(f"{own}_other"))), "leaf")
        split = split.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(f"{own}_own")))
        return split.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{own}_other") - 1))).groupBy("leaf", "row", "query")

    found = dealt(visiting, "query", "row").cogroup(dealt(rows, "row", "query")).applyInPandas(_search(k), kind)
    numbered = found.selectExpr("query_id", "row_number() over (partition by query_id order by score, vec_id) as rank", "vec_id", "score")
    return numbered.where(f"rank <= {k}")
