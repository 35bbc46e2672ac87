"""Stateless operators on a stream: scoring, bins and rules are applied to a streaming DataFrame as to a batch.

The black box, the bin edges and the rules are static; a stream of rows meets
them by broadcast (a stream-static join), so there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rationale.operators.bins import discretize
from rationale.operators.score import score


def scored_stream(rows: DataFrame, model: str, bins: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the model's label (a SQL expression) and the bin number of each column."""
    labelled = score(rows, model)
    return discretize(labelled.withColumns({f"{c}_bin": F.col(c) for c in columns}), bins.withColumn("feature", F.concat("feature", F.lit("_bin"))), [f"{c}_bin" for c in columns])


def label_counts(labelled: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Labels by event-time window: how the model's decisions drift."""
    return labelled.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "label").agg(F.count("*").alias("n"))
