"""Dealing narrow rows out over all tasks before each of them becomes many."""

from __future__ import annotations

from pyspark.sql import DataFrame

FEW, MANY = 2_000, 500_000  # rows a task

def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt out by its keys over as many tasks as a shuffle has.

    A small file is read by one or two tasks, however many rows are made of each of its
    own.  Rows that are made afterwards stay together by key, so that aggregates, windows
    and joins by key need no further shuffle.  The number is given, or small partitions
    would be put together again by the size they have before they grow; where ``rows``
    are counted, few take fewer tasks and very many more.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if rows is not None:
        tasks = max(min(tasks, rows // FEW + 1), rows // MANY + 1)
    return df.repartition(tasks, *keys)
