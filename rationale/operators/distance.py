"""Distances between rows, and the weights that follow."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.order import percentiles
from rationale.functions.special import kernel

from .profile import long_form


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def euclidean(columns: list[str], scale: dict | None = None, other: str = "x0_") -> Column:
    """Distance to the original row carried beside each row; divided by scale_ columns unless scales are given."""
    return F.sqrt(_sum([F.pow(F.coalesce((F.col(c) - F.col(other + c)) / (F.lit(float(scale[c])) if scale else F.nullif(F.col(f"scale_{c}"), F.lit(0.0))), F.lit(0.0)), F.lit(2.0)) for c in columns]))


def kernel_weights(neigh: DataFrame, distance: str, n_features: int, width: float | None = None) -> DataFrame:
    return neigh.withColumn("weight", kernel(F.col(distance), float(width or 0.75 * n_features**0.5)))


def cosine_mask(kept_share: Column) -> Column:
    """Cosine distance (times 100) between a 0/1 mask and all ones."""
    return 100 * (1 - F.sqrt(kept_share))


def inverse_weights(df: DataFrame, key: str, distance: str) -> DataFrame:
    """Sum of distances over the distance, normalised to 1 for each instance."""
    w = Window.partitionBy(key)
    raw = F.sum(distance).over(w) / (F.col(distance) + 1e-8)
    return df.withColumn("raw_w", raw).withColumn("weight", F.col("raw_w") / F.sum("raw_w").over(w)).drop("raw_w")


def percentile_weights(df: DataFrame, key: str, distance: str, levels: dict[int, float]) -> DataFrame:
    """Rows of a distance band share the band's percentage; a band holds distances up to its percentile and beyond the last."""
    cuts = sorted(levels)
    edges = df.groupBy(key).agg(F.percentile(distance, F.array(*[F.lit(c / 100) for c in cuts])).alias("cuts"))
    banded = df.join(edges, key).withColumn("band", F.least(F.size(F.filter("cuts", lambda c: c < F.col(distance))), F.lit(len(cuts) - 1)))
    share = F.element_at(F.array(*[F.lit(levels[c] / 100) for c in cuts]), F.col("band") + 1)
    return banded.withColumn("weight", share / F.count("*").over(Window.partitionBy(key, "band"))).drop("cuts", "band")


def simple_match(columns: list[str], other: str = "x0_") -> Column:
    """Share of unequal values."""
    return _sum([(~F.col(c).eqNullSafe(F.col(other + c))).cast("double") for c in columns]) / len(columns)


def _variance(parts: list[Column]) -> Column:
    mean = _sum(parts) / len(parts)
    return _sum([F.pow(p - mean, F.lit(2.0)) for p in parts]) / len(parts)


def normalized_euclidean(columns: list[str], other: str = "x0_") -> Column:
    """Half the variance of the difference over the sum of variances, across features."""
    x, y = [F.col(c).cast("double") for c in columns], [F.col(other + c).cast("double") for c in columns]
    both = _variance(x) + _variance(y)
    return F.coalesce(0.5 * _variance([a - b for a, b in zip(x, y, strict=True)]) / F.nullif(both, F.lit(0.0)), F.lit(0.0))


def mixed_distance(discrete: list[str], continuous: list[str], other: str = "x0_") -> Column:
    """Match and variance distance by the shares of discrete and continuous features; the class counts as discrete."""
    nd, nc = len(discrete) + 1, len(continuous)
    return (nd * simple_match(discrete, other) + nc * normalized_euclidean(continuous, other)) / (nd + nc)


def range_scaled_sq(columns: list[str], other: str = "x0_") -> Column:
    """Mean squared difference by the range (min_ and max_ columns); a constant feature adds nothing."""
    return _sum([F.coalesce(F.pow((F.col(c) - F.col(other + c)) / F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0)), F.lit(2.0)), F.lit(0.0)) for c in columns]) / len(columns)


def mad_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mad_ columns: median absolute deviations from the median."""
    long = long_form(df, columns)
    medians = percentiles(long, "value", [0.5], ("feature",)).select("feature", F.col("percentiles")[0].alias("m"))
    gaps = long.join(F.broadcast(medians), "feature").select("feature", F.abs(F.col("value") - F.col("m")).alias("gap"))
    mads = percentiles(gaps, "gap", [0.5], ("feature",)).select("feature", F.col("percentiles")[0].alias("mad"))
    return mads.groupBy().pivot("feature", columns).agg(F.first("mad")).select(*[F.col(c).alias(f"mad_{c}") for c in columns])


def mad_distance(columns: list[str], other: str = "x0_") -> Column:
    return _sum([F.coalesce(F.abs(F.col(c) - F.col(other + c)) / F.nullif(F.col(f"mad_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def scaled_l1(columns: list[str], other: str = "x0_") -> Column:
    """Sum of absolute differences by the deviation (scale_ columns); a constant feature adds nothing."""
    return _sum([F.coalesce(F.abs(F.col(c) - F.col(other + c)) / F.nullif(F.col(f"scale_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def quadratic_form(columns: list[str], mean: np.ndarray, precision: np.ndarray, prefix: str = "") -> Column:
    d = [F.col(prefix + c) - float(m) for c, m in zip(columns, mean, strict=True)]
    return _sum([float(precision[i, j]) * d[i] * d[j] for i in range(len(columns)) for j in range(len(columns))])


def density_ratio(columns: list[str], mean: np.ndarray, cov: np.ndarray, other: str = "x0_") -> Column:
    """Normal density at the start (``other``) over that at the row; a singular covariance uses its pseudo-inverse."""
    precision = np.linalg.pinv(np.asarray(cov, float))
    return F.exp(0.5 * (quadratic_form(columns, mean, precision) - quadratic_form(columns, mean, precision, other)))


def leaf_weights(leaves: DataFrame, instance_leaves: DataFrame, row_key: str) -> DataFrame:
    """(instance_id, row_key, weight): over trees, 1 / (rows in the leaf) for rows in the instance's leaf.

    ``leaves`` has (tree, leaf, row_key), ``instance_leaves`` (instance_id, tree, leaf).
    """
    sizes = leaves.groupBy("tree", "leaf").agg((1 / F.count("*")).alias("w"))
    return instance_leaves.join(sizes, ["tree", "leaf"]).join(leaves, ["tree", "leaf"]).groupBy("instance_id", row_key).agg(F.sum("w").alias("weight"))
