"""Applying the black box, and what its labels give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score(df: DataFrame, model, output: str = "label", columns: list[str] | None = None, kind: str = "string") -> DataFrame:
    """``df`` with the model's output.

    A string is a SQL expression, an object with ``transform`` a Spark ML model;
    anything else has ``predict``, or is called, on pandas batches.
    """
    if isinstance(model, str):
        return df.withColumn(output, F.expr(model))
    if hasattr(model, "transform"):
        return model.transform(df).withColumnRenamed("prediction", output)
    predict: Callable = model.predict if hasattr(model, "predict") else model
    used = columns or df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{output: predict(f[used])})

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != output]
    return df.mapInPandas(run, ", ".join([*rest, f"`{output}` {kind}"]))


def one_vs_rest(neigh: DataFrame, key: str, label: str = "label") -> DataFrame:
    """The instance's own class c stays, others become ~c."""
    own = neigh.where("rep = 0").select(key, F.col(label).alias("own"))
    return neigh.join(own, key).withColumn(label, F.when(F.col(label) == F.col("own"), F.col("own")).otherwise(F.concat(F.lit("~"), "own")))


def label_indicator(df: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    return df.withColumns({f"is_{c}": F.coalesce((F.col(label) == c).cast("int"), F.lit(0)) for c in classes})


def top_labels(df: DataFrame, key: str, proba: str, k: int) -> DataFrame:
    """(key, class_index, p, rank): the k most probable classes, ties to the smaller index."""
    long = df.select(key, F.posexplode(proba).alias("class_index", "p"))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "class_index"))).where(F.col("rank") <= k)


def next_best_class(neigh: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, next_class): the most frequent class in the neighbourhood other than the instance's (ties: smaller name)."""
    own = neigh.where("rep = 0").select(key, F.col(label).alias("own"))
    counts = neigh.groupBy(key, label).agg(F.count("*").alias("n")).join(own, key).where(F.col(label) != F.col("own"))
    first = Window.partitionBy(key).orderBy(F.desc("n"), label)
    return counts.withColumn("r", F.row_number().over(first)).where("r = 1").select(key, F.col(label).alias("next_class"))
