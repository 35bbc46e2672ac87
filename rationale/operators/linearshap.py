"""Linear Shapley values for correlated features.

The value of a coalition is the model's mean given its features, under a normal law
with the background's means and covariances.  That is linear in the row, so all
attributions are one matrix times the row less the means, and the matrix is the mean
over orders of the features of what each feature adds when it joins those before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FEATURES = 256
ALIKE = 1e-9


def order_of(number: int, p: int) -> np.ndarray:
    """The permutation with that number, among p!."""
    left, out = list(range(p)), []
    for k in range(p, 0, -1):
        number, i = divmod(number, k)
        out.append(left.pop(i))
    return np.array(out)


def joined(cov: np.ndarray, coef: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Row i: the change of the coalition's linear form when feature i joins those before it in ``order``.

    The inverse covariance of a coalition grows by one row and column at a time.
    """
    p = len(coef)
    out, before, inverse = np.zeros((p, p)), np.zeros(p), np.zeros((0, 0))
    for k, i in enumerate(order):
        inside, outside = order[: k + 1], order[k + 1 :]
        d = cov[order[:k], i]
        t = inverse @ d
        left = cov[i, i] - t @ d  # variance that those before don't explain
        grown = np.empty((k + 1, k + 1))
        grown[:k, :k] = inverse + np.outer(t, t) / left
        grown[:k, k] = grown[k, :k] = -t / left
        grown[k, k] = 1 / left
        inverse = grown
        form = np.zeros(p)
        form[inside] = coef[inside] + (coef[outside] @ cov[np.ix_(outside, inside)]) @ inverse
        out[i] = form - before
        before = form
    return out


def transform(spark: SparkSession, cov: np.ndarray, coef: np.ndarray, orders: int = 5040, seed: int = 1) -> np.ndarray:
    """Mean of ``joined`` over all orders, if there are no more than ``orders``, else over as many pairs of a keyed random order and its reverse."""
    p = len(coef)
    every = p < 13 and factorial(p) <= orders
    n = factorial(p) if every else max(orders // 2, 1)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for f in frames:
            for number in f["id"]:
                order = order_of(int(number), p) if every else np.random.default_rng([seed, int(number)]).permutation(p)
                total += joined(cov, coef, order)
                if not every:
                    total += joined(cov, coef, order[::-1])
        yield pd.DataFrame({"i": np.repeat(np.arange(p), p), "j": np.tile(np.arange(p), p), "v": total.ravel()})

    out = np.zeros((p, p))
    for r in spark.range(n).mapInPandas(summed, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # features squared
        out[r.i, r.j] = r.v / (n if every else 2 * n)
    return out


def correlated_linear_shap(instances: DataFrame, background: DataFrame, key: str, features: list[str], coef: dict[str, float], intercept: float = 0.0, orders: int = 5040, seed: int = 1) -> DataFrame:
    """(key, base, phi_<feature>...): Shapley values of intercept + sum of coef * feature, conditional on correlated features.

    They add up to the prediction less ``base``, the prediction at the means.  Features
    that are the same but for place and scale are one player and share its value
    equally; a feature without variance has 0, as what it adds is in the base.  What
    is left of collinearity is met with 1e-6 of variance.  Rows and background rows
    with nulls are left out of the sums and have null values.
    """
    if len(features) > MOST_FEATURES:
        raise ValueError(f"{len(features)} features; at most {MOST_FEATURES}")
    p = len(features)
    xs = [F.col(f).cast("double") for f in features]
    known = background.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)]).na.drop()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = known.agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    if row.n < 2:
        raise ValueError("covariances need at least two background rows")
    mean, cov, b = np.array([row[f"m{i}"] for i in range(p)]), np.zeros((p, p)), np.array([float(coef.get(f, 0.0)) for f in features])
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    sd = np.sqrt(np.diag(cov))
    players: list[list[int]] = []
    for i in np.flatnonzero(np.diag(cov) > 1e-8):
        same = [g for g in players if abs(cov[i, g[0]]) >= (1 - ALIKE) * sd[i] * sd[g[0]]]
        if same:
            same[0].append(int(i))
        else:
            players.append([int(i)])
    first = [g[0] for g in players]
    # a member moves with the first of its group by this factor
    slope = {i: cov[i, g[0]] / cov[g[0], g[0]] for g in players for i in g}
    total = np.array([sum(b[i] * slope[i] for i in g) for g in players])
    small_cov = cov[np.ix_(first, first)]
    if len(first) and np.linalg.eigvalsh(small_cov).min() < 1e-7:
        small_cov = small_cov + 1e-6 * np.eye(len(first))
    t = transform(instances.sparkSession, small_cov, total, orders, seed) if first else np.zeros((0, 0))
    moved = [F.col(features[g[0]]).cast("double") - float(mean[g[0]]) for g in players]
    phi = {}
    for k, g in enumerate(players):
        value = sum((float(t[k, m]) * d for m, d in enumerate(moved)), F.lit(0.0)) / len(g)
        phi |= dict.fromkeys(g, value)
    nothing = F.when(F.greatest(*[x.isNull().cast("int") for x in xs], F.lit(0), F.lit(0)) == 1, None).otherwise(F.lit(0.0))
    return instances.select(key, F.lit(float(b @ mean + intercept)).alias("base"), *[(phi.get(i, F.lit(0.0)) + nothing).alias(f"phi_{f}") for i, f in enumerate(features)])
