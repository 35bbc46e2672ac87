"""Which family of distributions fits a feature, and draws from the one that does."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rationale.functions.draws import normal, uniform
from rationale.functions.order import percentiles
from rationale.functions.small import small

from .profile import long_form

FAMILIES = ("uniform", "normal", "exponential", "laplace", "lognormal", "gamma")


@F.pandas_udf(StructType([StructField("shape", DoubleType()), StructField("log_gamma", DoubleType())]))
def gamma_shape(s: pd.Series) -> pd.DataFrame:
    """The gamma distribution's most likely shape for a log of the mean less the mean of the logs, by Newton's method."""
    s = s.to_numpy(float)
    ok = np.isfinite(s) & (s > 1e-12)
    s = np.where(ok, s, 1.0)
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(8):
        x, psi, slope = k.copy(), np.zeros(len(k)), np.zeros(len(k))
        for _ in range(8):
            psi, slope, x = psi - 1 / x, slope + 1 / x**2, x + 1
        f = 1 / x**2
        psi += np.log(x) - 1 / (2 * x) - f * (1 / 12 - f * (1 / 120 - f / 252))
        slope += 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f / 42))
        k = np.maximum(k - (np.log(k) - psi - s) / (1 / k - slope), k / 4)
    return pd.DataFrame({"shape": np.where(ok, k, np.nan), "log_gamma": [math.lgamma(v) for v in k]})


def fit_families(df: DataFrame, columns: list[str], families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(feature, family, a, b, sse, best): most likely parameters, and squared errors of the density against a histogram.

    Parameters: least value and range (uniform), mean and deviation (normal), least value
    and mean above it (exponential), median and mean distance from it (laplace), mean and
    deviation of the logs (lognormal), shape and scale (gamma); the last two where all
    values are above 0.  Bins as in ``histogram_bins``, the error is summed over their
    middles in units of the range.  Ties of ``best`` go by name.  A feature of one value is
    of the family ``constant``; nulls, NaN and infinities don't count, and a feature without
    values has no rows.  All values are read twice, for moments and for the histogram.
    """
    rows = long_form(df, columns).where(F.abs("value") < float("inf"))
    x, log = F.col("value"), F.log("value")
    s = rows.groupBy("feature").agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg(log).alias("mean_log"), F.stddev_pop(log).alias("std_log"))
    s = s.join(percentiles(rows, "value", [0.25, 0.5, 0.75], ("feature",)), "feature")
    wide = 2 * (F.col("percentiles")[2] - F.col("percentiles")[0]) / F.pow("n", F.lit(1 / 3))
    bins = F.when(wide > 0, F.greatest(F.ceil((F.col("hi") - F.col("lo")) / wide), F.ceil(F.log2("n")) + 1)).otherwise(F.ceil(F.sqrt("n"))).cast("long")
    s = s.select("*", F.col("percentiles")[1].alias("median"), bins.alias("bins"), gamma_shape(F.when(F.col("lo") > 0, F.log("mean") - F.col("mean_log"))).alias("g"), (F.col("hi") - F.col("lo")).alias("range")).drop("percentiles")
    s = small(s, "features")
    bin_ = F.least(F.floor((x - F.col("lo")) / F.nullif("range", F.lit(0.0)) * F.col("bins")), F.col("bins") - 1).cast("long")
    counts = rows.join(s.select("feature", "lo", "range", "bins", "median"), "feature").groupBy("feature", F.coalesce(bin_, F.lit(0).cast("long")).alias("bin")).agg(F.count("*").alias("k"), F.sum(F.abs(x - F.col("median"))).alias("off"))
    off = counts.groupBy("feature").agg(F.sum("off").alias("off"))
    at = s.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1))).join(off, "feature").join(counts.drop("off"), ["feature", "bin"], "left")
    at = at.withColumn("t", F.col("lo") + (F.col("bin") + 0.5) * F.col("range") / F.col("bins")).withColumn("y", F.coalesce("k", F.lit(0)) * F.col("bins") / F.col("n")).withColumn("off", F.col("off") / F.col("n"))
    t, positive = F.col("t"), F.col("lo") > 0
    bell = lambda z, width: F.exp(-z * z / 2) / (width * math.sqrt(2 * math.pi))
    shape, scale = F.col("g.shape"), F.col("mean") / F.col("g.shape")
    above = F.col("mean") - F.col("lo")
    known: dict[str, tuple[Column, Column, Column]] = {
        "uniform": (F.col("lo"), F.col("range"), 1 / F.nullif("range", F.lit(0.0))),
        "normal": (F.col("mean"), F.col("std"), bell((t - F.col("mean")) / F.col("std"), F.col("std"))),
        "exponential": (F.col("lo"), above, F.exp(-(t - F.col("lo")) / above) / above),
        "laplace": (F.col("median"), F.col("off"), F.exp(-F.abs(t - F.col("median")) / F.col("off")) / (2 * F.col("off"))),
        "lognormal": (F.col("mean_log"), F.col("std_log"), F.when(positive, bell((F.log(t) - F.col("mean_log")) / F.col("std_log"), F.col("std_log")) / t)),
        "gamma": (shape, scale, F.when(positive & ~F.isnan(shape), F.exp((shape - 1) * F.log(t / scale) - t / scale - F.col("g.log_gamma")) / scale)),
    }
    spread = at.where(F.col("range") > 0)
    fits = spread.select("feature", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), a.alias("a"), b.alias("b"), F.pow(F.col("y") - p * F.col("range"), F.lit(2.0)).alias("e")) for f, (a, b, p) in known.items() if f in families])))
    fits = fits.where(F.col("e").isNotNull()).groupBy("feature", "family").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("e").alias("sse"))
    fits = fits.unionByName(s.where(F.col("range") == 0).select("feature", F.lit("constant").alias("family"), F.col("lo").alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("sse")))
    return fits.withColumn("best", F.row_number().over(Window.partitionBy("feature").orderBy("sse", "family")) == 1)


def family_draw(family: str, a: float, b: float, seed: int, key: Column, feature: int) -> Column:
    """A keyed draw; gamma draws by transformed normals, the first of 10 that is accepted (each is with a chance above 0.95)."""
    u = uniform(seed, key, 0, feature)
    if family == "uniform":
        return a + b * u
    if family == "normal":
        return a + b * normal(seed, key, 0, feature)
    if family == "exponential":
        return a - b * F.log(u)
    if family == "laplace":
        return a + b * F.when(u < 0.5, F.log(2 * u)).otherwise(-F.log(2 - 2 * u))
    if family == "lognormal":
        return F.exp(a + b * normal(seed, key, 0, feature))
    if family == "gamma":
        d = (a if a >= 1 else a + 1) - 1 / 3
        tries = []
        for i in range(1, 11):
            z = normal(seed + 1, key, i, feature)
            v = F.pow(1 + z / math.sqrt(9 * d), F.lit(3.0))
            tries.append(F.when((v > 0) & (F.log(uniform(seed + 3, key, i, feature)) < z * z / 2 + d * (1 - v + F.log(v))), d * v))
        return b * F.coalesce(*tries, F.lit(d)) * (F.lit(1.0) if a >= 1 else F.pow(u, F.lit(1 / a)))
    return F.lit(a)


def fitted_sample(fits: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(rep, <feature>...): n rows, each feature drawn by itself from its best family; ``fits`` as ``fit_families`` gives it."""
    best = sorted(fits.where("best").collect(), key=lambda r: r.feature)  # one row for each feature
    draws = fits.sparkSession.range(n).withColumnRenamed("id", "rep")
    return draws.select("rep", *[family_draw(r.family, r.a, r.b, seed, F.col("rep"), i).alias(r.feature) for i, r in enumerate(best)])
