"""Profiling and cleaning of feature tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from rationale.functions.draws import draw_code, uniform
from rationale.functions.order import percentiles


def long_form(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """(keys..., feature, value) of numeric columns as doubles."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), columns, "feature", value)


def infer_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """(ord, feature, kind, is_discrete): whole numbers count as double when they are features; the target is discrete."""
    rows = []
    for f in df.schema.fields:
        kind = "integer" if isinstance(f.dataType, IntegralType) else "double" if isinstance(f.dataType, FractionalType) else "string"
        rows.append((f.name, kind, kind == "string" or f.name == target))
    rows.sort(key=lambda r: r[0] == target)
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, feature string, kind string, is_discrete boolean")


def detect_categorical(df: DataFrame, threshold: int = 10) -> DataFrame:
    """(feature, n_distinct, all_numeric, is_categorical, finite_numeric), in one pass."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    parts = [F.struct(F.lit(c).alias("feature"), F.count_distinct(c).alias("n_distinct"), F.coalesce(F.bool_and(F.expr(f"try_cast(`{c}` as double)").isNotNull() | F.col(c).isNull()), F.lit(True)).alias("all_numeric")) for c in df.columns]
    rows = text.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    few = F.col("n_distinct") <= threshold
    return rows.select("*", (few | ~F.col("all_numeric")).alias("is_categorical"), (few & F.col("all_numeric")).alias("finite_numeric"))


def feature_stats(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., feature, mean, std, min, max), ignoring nulls and NaN; std divides by n."""
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")) for c in columns]
    grouped = df.select(*by, *clean).groupBy(*by).agg(F.array(*parts).alias("a"))
    return grouped.select(*by, F.inline("a"))


def covariance(df: DataFrame, columns: list[str], mode: str = "full") -> DataFrame:
    """Sample covariance as (i, j, value), in one aggregate; ``diagonal`` leaves the rest 0."""
    pairs = list(combinations_with_replacement(columns, 2))
    parts = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), (F.covar_samp(a, b) if a == b or mode == "full" else F.lit(0.0)).alias("value")) for a, b in pairs]
    upper = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return upper.union(upper.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def standardize_categorical_variance(cov: DataFrame, categorical: list[str], v: float = 0.3334) -> DataFrame:
    """Diagonal of categorical columns becomes v squared; beside it, v squared c_ij over the root of the old c_ii, once for each categorical side."""
    diagonal = cov.where("i = j").select(F.col("i").alias("k"), "value")
    old = cov.join(F.broadcast(diagonal.withColumnsRenamed({"k": "i", "value": "cii"})), "i").join(F.broadcast(diagonal.withColumnsRenamed({"k": "j", "value": "cjj"})), "j")
    in_i, in_j = F.col("i").isin(categorical), F.col("j").isin(categorical)
    scaled = F.col("value") * F.when(in_i, v * v / F.sqrt("cii")).otherwise(1.0) * F.when(in_j, v * v / F.sqrt("cjj")).otherwise(1.0)
    return old.select("i", "j", F.when((F.col("i") == F.col("j")) & in_i, v * v).otherwise(scaled).alias("value"))


def dev_scale(stats: DataFrame, factor: float) -> DataFrame:
    """Scales divided by ``factor`` (statistics or long covariance)."""
    return stats.withColumns({c: F.col(c) / factor for c in ("std", "value") if c in stats.columns})


def category_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n, share)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    return long.groupBy("feature", "value").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))


def impute_mode(df: DataFrame, columns: list[str], marker: str = "?") -> DataFrame:
    """Nulls and ``marker`` become the most frequent other value (ties: the smaller)."""
    clean = df.withColumns({c: F.when(F.col(c).cast("string") != marker, F.col(c)) for c in columns})
    counts = category_frequencies(clean, columns).where("value is not null").groupBy("feature").agg(F.max("n").alias("n"))
    top = category_frequencies(clean, columns).where("value is not null").join(counts.select("feature", "n"), ["feature", "n"]).groupBy("feature").agg(F.min("value").alias("mode"))
    wide = top.groupBy().pivot("feature", columns).agg(F.first("mode"))
    modes = wide.select(*[F.col(c).alias(f"mode_{c}") for c in columns])
    return clean.join(F.broadcast(modes), how="left").select(*[F.coalesce(F.col(c), F.col(f"mode_{c}").cast(clean.schema[c].dataType)).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_incomplete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns)


def drop_incomplete_columns(df: DataFrame) -> DataFrame:
    """Columns with a null anywhere go."""
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not missing[c]])


def map_unseen(df: DataFrame, reference: DataFrame, columns: list[str], unknown: str = "unknown") -> DataFrame:
    """Categories that the reference doesn't hold become ``unknown``."""
    for c in columns:
        seen = reference.select(F.col(c).alias(f"seen_{c}")).where(F.col(c).isNotNull()).distinct()
        df = df.join(seen, F.col(c) == F.col(f"seen_{c}"), "left").withColumn(c, F.when(F.col(c).isNull() | F.col(f"seen_{c}").isNotNull(), F.col(c)).otherwise(unknown)).drop(f"seen_{c}")
    return df


def threshold_labels(df: DataFrame, score: str, cut: float, below: str = "low", above: str = "high") -> DataFrame:
    return df.withColumn("label", F.when(F.col(score) < cut, below).otherwise(above))


def percentile_labels(df: DataFrame, score: str, share: float) -> DataFrame:
    """Label 1 at the exact percentile or above."""
    cut = percentiles(df.select(score), score, [share]).select(F.col("percentiles")[0].alias("cut"))
    return df.join(F.broadcast(cut)).withColumn("label", (F.col(score) >= F.col("cut")).cast("int")).drop("cut")


def outcome_labels(df: DataFrame, column: str, outcomes: dict[str, int]) -> DataFrame:
    pairs = [x for k, v in outcomes.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn("label", F.create_map(*pairs)[F.col(column)])


def stay_days(start: str, end: str):
    """Whole days between two dates, whichever comes first."""
    return F.abs(F.datediff(F.col(end), F.col(start)))


def split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 1) -> DataFrame:
    """With ``is_train``: the keyed draw decides, so no sort and no driver."""
    return df.withColumn("is_train", uniform(seed, F.col(key)) < ratio)


def shrink(df: DataFrame, key: str, n: int, seed: int = 2) -> DataFrame:
    """The n rows that come first in a keyed shuffle."""
    return df.orderBy(draw_code(seed, F.col(key)), key).limit(n)


def subsample(df: DataFrame, key: str, seeds: list[int], share: float = 1 / 3) -> DataFrame:
    """One keyed sample for each seed, with ``run``."""
    runs = F.explode(F.array(*[F.struct(F.lit(i).alias("run"), (uniform(s, F.col(key)) < share).alias("keep")) for i, s in enumerate(seeds)]))
    return df.select("*", runs.alias("r")).where("r.keep").select(*df.columns, "r.run")


def train_scaled(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores of both sets by the training mean and deviation; nulls become 0. Adds ``is_train``."""
    stats = train.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    scaled = {c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return both.join(F.broadcast(stats)).withColumns(scaled).select(*both.columns)


def correlations(cov: DataFrame) -> DataFrame:
    """(i, j, value) from a long covariance; null where a feature is constant."""
    d = cov.where("i = j")
    di, dj = d.select("i", F.col("value").alias("cii")), d.select("j", F.col("value").alias("cjj"))
    return cov.join(F.broadcast(di), "i").join(F.broadcast(dj), "j").select("i", "j", (F.col("value") / F.nullif(F.sqrt(F.col("cii") * F.col("cjj")), F.lit(0.0))).alias("value"))


def correlation_labels(cov: DataFrame) -> DataFrame:
    """Strength marks of each correlation: ++ + . - --"""
    r = F.col("value")
    mark = F.when(r >= 0.6, "++").when(r >= 0.2, "+").when(r <= -0.6, "--").when(r <= -0.2, "-").otherwise(".")
    return correlations(cov).select("i", "j", mark.alias("mark"))


def redundant_groups(cov: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(feature, group_id): features with correlation 1 share the least name among them."""
    same = correlations(cov).where(F.abs(F.col("value") - 1) <= tolerance)
    return same.groupBy(F.col("i").alias("feature")).agg(F.min("j").alias("group_id"))


def histogram_bins(df: DataFrame, column: str) -> DataFrame:
    """Number of bins: the larger of Freedman-Diaconis and Sturges; the root of n where the first isn't finite."""
    x = F.col(column).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).join(F.broadcast(percentiles(df.select(x.alias("x")), "x", [0.25, 0.75]).withColumnRenamed("percentiles", "q")))
    width = 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow("n", F.lit(1 / 3))
    fd = F.ceil((F.col("hi") - F.col("lo")) / F.nullif(width, F.lit(0.0)))
    bins = F.when(width > 0, F.greatest(fd, F.ceil(F.log2("n")) + 1)).otherwise(F.ceil(F.sqrt("n")))
    return s.select(F.lit(column).alias("feature"), bins.cast("long").alias("bins"))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """With ``code``: rank of the value among the sorted distinct values, from 0."""
    order = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = order.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left")


def kmeans_background(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """(bg_id, columns..., w): k centres weighted by cluster size, each coordinate moved to the nearest value seen."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    model = KMeans(k=k, seed=seed, featuresCol="v").fit(VectorAssembler(inputCols=columns, outputCol="v").transform(df))
    sizes = model.transform(VectorAssembler(inputCols=columns, outputCol="v").transform(df)).groupBy(F.col("prediction").alias("bg_id")).agg(F.count("*").alias("w"))
    centres = df.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "bg_id int, " + ", ".join(f"c_{c} double" for c in columns))
    spread = df.select(*columns).distinct().join(F.broadcast(centres))  # k centres beside each row
    snapped = spread.groupBy("bg_id").agg(*[F.min_by(F.col(c).cast("double"), F.struct(F.abs(F.col(c) - F.col(f"c_{c}")), F.col(c))).alias(c) for c in columns])
    return snapped.join(sizes, "bg_id")


def cluster_stats(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """Statistics by cluster, for clusters that a column names."""
    return feature_stats(df, columns, (cluster,))


def assign_clusters(df: DataFrame, columns: list[str], k: int, method: str = "kmeans", seed: int = 1) -> DataFrame:
    """With ``cluster``, by k-means or a mixture of gaussians."""
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="features_v").transform(df)
    kind = KMeans if method == "kmeans" else GaussianMixture
    return kind(k=k, seed=seed, featuresCol="features_v", predictionCol="cluster").fit(v).transform(v).select(*df.columns, "cluster")


def all_of(conditions: list):
    return reduce(lambda a, b: a & b, conditions)
