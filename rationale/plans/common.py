"""What the query modules share: tables, the models that are explained, and the list of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

# Black boxes as SQL text, valid in any engine.
PART_MODEL = "CASE WHEN (p_size > 25 AND p_retailprice > 950) OR p_size < 5 THEN 'Y' ELSE 'N' END"
PART_SCORE = "(0.03 * p_size - 0.002 * p_retailprice + 0.0001 * p_size * p_retailprice)"
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_FEATURES = ["p_size", "p_retailprice"]


def query(name: str, sql: str | None = None):
    """Registers a function (spark, read) under ``name``, with SQL that gives the same rows."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = (run, sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0 made 0, for comparison between engines."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
