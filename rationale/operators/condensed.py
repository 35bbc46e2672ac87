"""Condensed nearest neighbours: a part of the rows by whose nearest one every row keeps its label."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rationale.sources.scratch import stored

BLOCK = 8192


def nearest_of(rows: DataFrame, chosen: DataFrame, block: int = BLOCK) -> DataFrame:
    """(r_id, d, near_id, near_label): the nearest of ``chosen`` (r_id, r_label, z) for each of ``rows``; ties go to the smaller id.

    Both are dealt out in blocks of a bounded size; each pair of blocks leaves one
    row for each of its rows.
    """
    parts = {"row": -(-rows.count() // block) or 1, "ask": -(-chosen.count() // block) or 1}

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        return d.select("r_id", "r_label", "z").withColumn(own, F.pmod(F.xxhash64("r_id"), F.lit(parts[own]))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[other] - 1).cast("long")))).groupBy("row", "ask")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"r_id": [], "d": [], "near_id": [], "near_label": []})
        b = b.sort_values("r_id", kind="stable")
        x, y = np.stack(a.z.to_list()), np.stack(b.z.to_list())
        best = np.empty(len(x), int)
        d = np.empty(len(x))
        for at in range(0, len(x), 256):
            square = sum(np.square(x[at : at + 256, i, None] - y[None, :, i]) for i in range(x.shape[1]))
            best[at : at + 256] = square.argmin(1)
            d[at : at + 256] = square.min(1)
        return pd.DataFrame({"r_id": a.r_id.to_numpy(), "d": d, "near_id": b.r_id.to_numpy()[best], "near_label": b.r_label.to_numpy()[best]})

    kind, label = (rows.schema[c].dataType.simpleString() for c in ("r_id", "r_label"))
    pairs = dealt(rows, "row", "ask").cogroup(dealt(chosen, "ask", "row")).applyInPandas(search, f"r_id {kind}, d double, near_id {kind}, near_label {label}")
    return pairs.groupBy("r_id").agg(F.min(F.struct("d", "near_id", "near_label")).alias("m")).select("r_id", "m.*")


def condensed(df: DataFrame, key: str, columns: list[str], label: str, block: int = BLOCK) -> DataFrame:
    """(key, label, round): rows such that the nearest of them has the label of any row of ``df``.

    Round 0 takes the row with the least id of each label.  Then, in each round, of
    the rows in a kept row's cell whose label differs from the kept one's, the one
    nearest to it joins (ties: the smaller id), in all cells at once; only distances
    to the rows that joined last are computed.  It ends when no row is misjudged.

    Rows with a null key, label or value, or a value that isn't finite, play no part.
    Of rows with equal values the one with the least id stands for all, so where they
    contradict each other its label counts.  An empty table gives no rows.
    """
    z = F.array(*[F.col(c).cast("double") + 0.0 for c in columns])
    usable = reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < float("inf") for c in columns], F.col(key).isNotNull() & F.col(label).isNotNull())
    rows = df.where(usable).select(F.col(key).alias("r_id"), F.col(label).alias("r_label"), z.alias("z"))
    rows = stored(rows.groupBy("z").agg(F.min(F.struct("r_id", "r_label")).alias("m")).select("m.*", "z"))
    first = rows.groupBy("r_label").agg(F.min(F.struct("r_id", "z")).alias("m")).select("m.r_id", "r_label", "m.z")
    joined = stored(first.withColumn("round", F.lit(0)))
    out, added, state, turn = joined, joined, None, 0
    while not added.isEmpty():
        now = nearest_of(rows, added, block)
        if state is None:
            state = stored(rows.join(now, "r_id"))
        else:
            near = F.least(F.struct("d", "near_id", "near_label"), F.struct(F.col("e").alias("d"), F.col("e_id").alias("near_id"), F.col("e_label").alias("near_label")))
            now = now.toDF("r_id", "e", "e_id", "e_label")
            state = stored(state.join(now, "r_id").select("r_id", "r_label", "z", near.alias("m")).select("r_id", "r_label", "z", "m.*"))
        turn += 1
        wrong = state.where("r_label <> near_label")
        added = stored(wrong.groupBy("near_id").agg(F.min(F.struct("d", "r_id", "r_label", "z")).alias("m")).select("m.r_id", "m.r_label", "m.z", F.lit(turn).alias("round")))
        out = out.unionByName(added)
    return out.select(F.col("r_id").alias(key), F.col("r_label").alias(label), "round")
