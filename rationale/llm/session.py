"""Tables of a query and intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rationale.sources.scratch import stored

__all__ = ["stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
