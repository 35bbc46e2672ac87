"""What a linear model predicts for a row if the row's own most, or least, important features had never existed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import centred, moments
from .shapley import MOST_FEATURES


def kept_mask(features: list[str], k: int | Column, keep: bool = False) -> Column:
    """Bits of the features that stay: all but the k with the largest phi_<feature>, or just those; ties to the first, null as 0."""
    ranked = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(f"phi_{f}").cast("double"), F.lit(0.0))).alias("s"), F.lit(i).alias("i"), F.lit(1 << i).cast("long").alias("bit")) for i, f in enumerate(features)]))
    top = F.aggregate(F.slice(ranked, F.lit(1), k if isinstance(k, Column) else F.lit(k)), F.lit(0).cast("long"), lambda a, s: a + s["bit"])
    return top if keep else F.lit((1 << len(features)) - 1).cast("long") - top


def masked_fits(train: DataFrame, masks: DataFrame, features: list[str], y: str, alpha: float = 0.0) -> DataFrame:
    """(r_mask, r_intercept, r_coef): ridge regression of ``train`` on the features of each mask.

    The training table is read once, for its moments; a mask's fit leaves rows and
    columns of the moment matrix out.  A feature without a spread, or one that is a
    sum of others, takes the least-norm coefficient.  Rows with a null play no part;
    without any row there is no fit.
    """
    p = len(features)
    whole = train.select(*[F.col(c).cast("double").alias(c) for c in [*features, y]], F.lit(1.0).alias("r_one")).dropna()
    m = moments(whole, [], features, y, "r_one").where("m[0] > 0")

    @F.pandas_udf("array<double>")
    def solved(mask: pd.Series, m: pd.Series) -> pd.Series:
        _, mx, my, xx, xy, _ = (a[0] for a in centred(np.array([m.iloc[0]]), p))
        on = (mask.to_numpy()[:, None] >> np.arange(p) & 1).astype(float)
        spread = np.sqrt(np.where(np.diag(xx) > 1e-12 * np.maximum(mx * mx, 1e-300), np.diag(xx), np.inf))
        scaled = (xx + alpha * np.eye(p)) / spread[:, None] / spread
        coef = (np.linalg.pinv(scaled * on[:, :, None] * on[:, None, :], rcond=1e-12, hermitian=True) @ (xy / spread * on)[:, :, None])[:, :, 0] / spread
        return pd.Series(list(np.column_stack([my - coef @ mx, coef])))

    fits = masks.select("r_mask").distinct().join(F.broadcast(m)).select("r_mask", solved("r_mask", "m").alias("f"))
    return fits.select("r_mask", F.col("f")[0].alias("r_intercept"), F.slice("f", 2, p).alias("r_coef"))


def refit_predictions(train: DataFrame, rows: DataFrame, features: list[str], y: str, k: int | Column, keep: bool = False, alpha: float = 0.0) -> DataFrame:
    """``rows`` with ``prediction``: the model is fitted again without (``keep``: with nothing but) each row's k most important features.

    ``rows`` has features and phi_<feature>.  Rows that leave out the same features
    share one fit.  A row with a null among the features that stay has no prediction.
    """
    asked = rows.withColumn("r_mask", kept_mask(features, k, keep))
    fits = masked_fits(train, asked, features, y, alpha)
    fits = F.broadcast(fits) if len(features) <= MOST_FEATURES else fits  # 2**16 masks at most
    terms = [F.when(F.getbit("r_mask", F.lit(i)) == 1, F.col("r_coef")[i] * F.col(f)).otherwise(0.0) for i, f in enumerate(features)]
    return asked.join(fits, "r_mask", "left").select(*rows.columns, sum(terms, F.col("r_intercept")).alias("prediction"))
