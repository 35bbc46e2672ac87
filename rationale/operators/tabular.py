"""Linear explanations of rows whose numeric features are binned: which bins speak for the prediction?"""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.draws import uniform
from rationale.functions.special import normal_cdf

from .bins import bin_names, bin_stats, discretize
from .distance import kernel_weights
from .linear import local_ridge, select_features
from .neighbours import lime_sample
from .profile import category_frequencies
from .score import score


def _quantile(p: pd.Series) -> pd.Series:
    """Of the standard normal; expressions would need a bisection for each value."""
    return p.clip(1e-15, 1 - 1e-15).map(NormalDist().inv_cdf, na_action="ignore").astype("float64")


def binned_neighbourhood(instances: DataFrame, training: DataFrame, key: str, features: list[str], edges: DataFrame, categories: list[str], n: int, seed: int = 1) -> DataFrame:
    """(key, rep, features..., categories..., same_<column>...): draws by the training rows' shares of bins and categories.

    A drawn bin becomes a value from the normal of the training values in it, cut off at
    the bin's ends; ``same_`` says whether bin or category is the instance's.  rep 0 is
    the instance itself.  Nothing is shuffled but the training rows' counts.
    """
    columns = [*features, *categories]
    texts = lambda df: discretize(df, edges, features).select(*([key] if key in df.columns else []), *[F.col(c).cast("string").alias(c) for c in columns])
    shares = category_frequencies(texts(training.select(*columns)), columns).where("value is not null")
    one = training.sparkSession.range(1).select(F.lit(1).alias("r_one"))
    drawn = lime_sample(texts(instances.select(key, *columns)), one, shares, key, [], columns, n, seed=seed)
    # the distribution at the ends of each bin is worked out once a bin, not once a draw
    ends = [normal_cdf((F.col(end) - F.col("mean")) / F.col("std")).alias(f"p_{end}") for end in ("lo", "hi")]
    lists = bin_stats(training, edges, features).select("*", *ends).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "mean", "std", "lo", "hi", "p_lo", "p_hi"))).alias("s"))
    stats = lists.agg(F.map_from_entries(F.collect_list(F.struct("feature", "s"))).alias("r_stats"))
    own = instances.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_own_{c}") for c in features])
    rows = drawn.join(F.broadcast(stats)).join(own.hint("shuffle_hash"), F.col(key) == F.col("r_key"))
    quantile, values = F.pandas_udf(_quantile, "double"), []
    for i, c in enumerate(features):
        s = F.get(F.col("r_stats")[F.lit(c)], F.col(c).cast("int"))
        u = uniform(seed + 1, F.col(key), F.col("rep"), i)
        drawn_value = F.least(F.greatest(s["mean"] + s["std"] * quantile(s["p_lo"] + u * (s["p_hi"] - s["p_lo"])), s["lo"]), s["hi"])
        values.append(F.when(F.col("rep") == 0, F.col(f"r_own_{c}").cast("double")).otherwise(drawn_value).alias(c))
    return rows.select(key, "rep", *values, *categories, *[f"same_{c}" for c in columns])


def explain_tabular(instances: DataFrame, training: DataFrame, key: str, features: list[str], edges: DataFrame, categories: list[str], model, n: int = 5000, k: int | None = None, alpha: float = 1.0, width: float | None = None, seed: int = 1) -> DataFrame:
    """(key, feature, name, weight, rank): a ridge fit on what each draw shares with the instance, with the names of its bins.

    ``model`` gives a number for each row; ``k`` features are chosen first (all without
    it), the others have no row.  Weights of rows fall with the root of the number of
    features that differ.  Categories are named ``feature=value``.  ``key`` is unique.
    """
    columns = [*features, *categories]
    same = [f"same_{c}" for c in columns]
    rows = score(binned_neighbourhood(instances, training, key, features, edges, categories, n, seed), model, "r_y", columns, "double")
    apart = F.sqrt(sum((1 - F.col(s) for s in same), F.lit(0)).cast("double"))
    rows = kernel_weights(rows.withColumn("r_d", apart), "r_d", len(columns), width).select(key, "rep", *same, F.col("r_y"), "weight")
    if k is not None and k < len(columns):
        chosen = select_features(rows, [key], same, "r_y", "weight", k)
        # a constant column has weight 0
        rows = rows.join(chosen, key).select(key, "rep", *[F.when(F.array_contains("chosen", s), F.col(s)).otherwise(0).alias(s) for s in same], "r_y", "weight")
    fits = local_ridge(rows, [key], same, "r_y", "weight", alpha)
    long = fits.select(key, *[F.col(f"coef_{s}").alias(c) for s, c in zip(same, columns, strict=True)]).unpivot([key], columns, "feature", "weight")
    if k is not None and k < len(columns):
        long = long.join(chosen, key).where(F.array_contains("chosen", F.concat(F.lit("same_"), F.col("feature")))).drop("chosen")
    placed = discretize(instances.select(key, *features), edges, features).unpivot([key], features, "feature", "bin")
    named = placed.join(F.broadcast(bin_names(edges)), ["feature", "bin"], "left").select(key, "feature", "name")
    if categories:
        named = named.union(instances.select(key, *[F.col(c).cast("string").alias(c) for c in categories]).unpivot([key], categories, "feature", "v").select(key, "feature", F.concat("feature", F.lit("="), F.coalesce("v", F.lit("null")))))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("weight")), "feature"))
    return long.join(named, [key, "feature"]).select(key, "feature", "name", "weight", rank.alias("rank"))
