"""Exact top-k by inner product, aggregating sorted lists without random access.

Each component of the candidates is one sorted list.  A query reads its lists
from the end that its weight favours, a chunk of all lists at a time.  What has
been read of a candidate gives its lower bound (every unread list at its worst
entry) and its upper bound (every unread list at the entry now reached).  An
outsider whose upper bound stays below the k-th lower bound cannot qualify;
reading stops when few others are left, and those get their final scores.  All
queries of a block read in step, so the bounds of all pairs after a chunk are two
matrix products: of the weights, split by sign, with the components, cut off at
the entries reached.

Scale.  Candidates and queries are dealt out in blocks of a fixed number of rows;
every query block meets every candidate block once, and leaves its k best there.
So work and shuffle grow with queries times candidates, divided by the block.
The lists of a candidate block are sorted once for each query block, a small part
of the products.

Vectors that are null, empty or hold null or non-finite components take no part;
vectors of another length meet only their like; repeated ids are separate
candidates, but a query skips rows with its own id, and a repeated query answers
once for each of its rows.  Components beyond a 64-bit number are cut off at its
ends, and so are scores; sums on the way are exact at any size.  Other columns
play no part, whatever their names.  No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
STEP = 128  # queries that read in step
READ = (16, 8, 4, 2, 1)  # the lists are read to a 16th, an 8th and so on
FEW = 4  # times k candidates are few
GRID = 256.0
EXACT = 2.0**53  # integers up to here are exact as doubles
LONG = 2**63


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, v): components floor(256 x) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda a: a.cast("double"))
    fine = F.col(vec_col).isNotNull() & ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    grid = F.transform(x, lambda a: F.when(F.abs(a) < 2.0**54, F.floor(a * GRID)).otherwise(F.when(a > 0, F.lit(LONG - 1)).otherwise(F.lit(-LONG))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vec_col).alias("dim"), grid.alias("v"))


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, matrix: np.ndarray):
        self.values = matrix.astype(float)
        self.sorted = np.sort(self.values, axis=0)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What each list is known to hold of each candidate after ``depth`` entries: at least, at most.

        The first half of the columns is for positive weights, which read from the top, the second for negative ones.
        """
        v, n = self.values, len(self.values)
        top, bottom = self.sorted[n - depth], self.sorted[depth - 1]
        least = np.hstack([np.where(v >= top, v, self.sorted[0]), np.where(v <= bottom, v, self.sorted[-1])])
        return least, np.hstack([np.maximum(v, top), np.minimum(v, bottom)])


def qualified(lists: Lists, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Candidates that may be among the k best of each query, by reading the lists until few are left."""
    n = len(ids)
    found = [np.zeros(0, np.int64)] * len(queries)
    steps = [(a, min(a + STEP, len(queries))) for a in range(0, len(queries), STEP)]
    reading = [np.arange(a, b) for a, b in steps]
    for depth in sorted({max(1, n // part) for part in READ}):
        if not any(map(len, reading)):
            break
        least, most = lists.bounds(depth)
        for s, which in enumerate(reading):
            if not len(which):
                continue
            weight = np.hstack([np.maximum(queries[which], 0), np.minimum(queries[which], 0)])
            lower, upper = weight @ least.T, weight @ most.T
            mine = own[which][:, None] == ids
            lower[mine] = upper[mine] = -np.inf
            bar = np.partition(lower, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
            left = (upper >= bar) & ~mine
            done = (left.sum(1) <= FEW * k) | (depth == n)
            for i in np.flatnonzero(done):
                found[which[i]] = np.flatnonzero(left[i])
            reading[s] = which[~done]
    return found


def _search(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and rows.num_rows:
            d = key[0].as_py()
            ids, own = (t.column("vec_id").to_numpy() for t in (rows, queries))
            matrix, asked = (t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d) for t in (rows, queries))
            size = d * np.abs(matrix.astype(float)).max() * np.abs(asked.astype(float)).max()
            exact = size < EXACT
            found = qualified(Lists(matrix), ids, asked.astype(float), own, k) if exact else [np.flatnonzero(ids != i) for i in own]
            if not exact:  # whole numbers of any size
                matrix, asked = matrix.astype(object), asked.astype(object)
            for i, left in enumerate(found):
                score = matrix[left] @ asked[i] if len(left) else np.zeros(0, np.int64)
                if not exact:
                    score = np.array([min(max(s, -LONG), LONG - 1) for s in score], np.int64)
                order = np.lexsort((ids[left], ~score))[:k]
                out.append((np.full(len(order), own[i]), ids[left][order], score[order]))
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": q, "vec_id": i, "score": s})

    return run


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by ``every``."""
    rows = quantised(vectors, id_col, vec_col).where("dim > 0")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    of_rows, of_asked = max(1, -(-n // block)), max(1, -(-m // block))

    def dealt(df: DataFrame, own: str, parts: int, other: str, times: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))

    keys = ["dim", "row_block", "query_block"]
    left = dealt(asked, "query_block", of_asked, "row_block", of_rows).groupBy(*keys)
    right = dealt(rows, "row_block", of_rows, "query_block", of_asked).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    numbered = found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return numbered.where(f"rank <= {k}")
