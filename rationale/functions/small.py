"""Broadcasts of tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def small(df: DataFrame, what: str, most: int = MOST_ROWS) -> DataFrame:
    """``df`` to be broadcast beside every row of another table; an error if it has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what} of more than {most} rows would be copied to every task; take a sample or cluster centres of it")
    return F.broadcast(df)


def beside(df: DataFrame) -> DataFrame:
    """``df`` to be joined to a larger table: broadcast if its rows, counted, are few; sorted otherwise, as the size of a compressed file says too little."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df.hint("merge")


def apart(df: DataFrame, rows: int, hint: str = "merge") -> DataFrame:
    """``df`` to be joined by key: left to Spark where ``rows`` are few; else never broadcast, as the size of a compressed file, or of a shuffle, says too little."""
    return df if rows <= MOST_ROWS else df.hint(hint)
