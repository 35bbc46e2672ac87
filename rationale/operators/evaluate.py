"""Measures of explanations: fidelity, stability, rank overlap, counterfactual scores, masking benchmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.draws import draw_code
from rationale.functions.order import running
from rationale.functions.small import small


# Fidelity -------------------------------------------------------------------
def fidelity(scored: DataFrame, keys: list[str], bb: str, surrogate: str, weight: str | None = None) -> DataFrame:
    """(keys..., value): weighted share of rows on which both agree."""
    w = F.col(weight) if weight else F.lit(1.0)
    return scored.groupBy(*keys).agg((F.sum(F.when(F.col(bb).eqNullSafe(F.col(surrogate)), w).otherwise(0.0)) / F.sum(w)).alias("value"))


def fidelity_summary(values: DataFrame, method: str = "method", weighting: str = "weighting") -> DataFrame:
    """(method, weighting, mean, variance, n, hit_rate) for each pair, each method and all; failures are null."""
    return values.groupingSets([[F.col(method), F.col(weighting)], [F.col(method)], []], method, weighting).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.count("value").alias("n"), F.avg("hit").alias("hit_rate"))


def constant_baseline(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Rows with ``predicted``: always the instance's own class."""
    own = rows.where("rep = 0").select(key, F.col(label).alias("predicted"))
    return rows.join(own, key)


# Stability over runs: (instance_id, run, feature, weight, rank) --------------
def _pairs(df: DataFrame, on: list[str], value: str, same: bool = False) -> DataFrame:
    """(on..., run1, v1, run2, v2): pairs of runs, from one list of each group's runs; no table is joined to itself, as its size would be guessed too low."""
    runs = df.where(" and ".join(f"{c} is not null" for c in on)).groupBy(*on).agg(F.collect_list(F.struct("run", F.col(value).alias("v"))).alias("runs"))
    first = runs.select(*on, "runs", F.inline("runs").alias("run1", "v1"))
    return first.select(*on, "run1", "v1", F.inline("runs").alias("run2", "v2")).where("run1 <= run2" if same else "run1 < run2")


def jaccard(a: str, b: str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def loose_stability(runs: DataFrame, k: int) -> DataFrame:
    """(instance_id, value): mean Jaccard of the k // 2 first features over pairs of runs."""
    top = runs.where(F.col("rank") <= k // 2).groupBy("instance_id", "run").agg(F.collect_set("feature").alias("s"))
    return _pairs(top, ["instance_id"], "s").groupBy("instance_id").agg(F.avg(jaccard("v1", "v2")).alias("value"))


def rank_stability(runs: DataFrame, k: int = 5) -> DataFrame:
    """(rank, value): share of pairs of runs with the same feature at a rank."""
    return _pairs(runs.where(F.col("rank") <= k), ["instance_id", "rank"], "feature").groupBy("rank").agg(F.avg((F.col("v1") == F.col("v2")).cast("double")).alias("value"))


def variance_stability(runs: DataFrame) -> DataFrame:
    """(instance_id, value): mean over features of the variance of importance among the leading half of each run.

    A feature's mean is its sum over all runs by their number; its squared
    deviations are those of runs that have it in their leading half, over the
    number of runs less one.  Null with a single run.
    """
    of = runs.groupBy("instance_id").agg(F.count_distinct("feature").alias("features"), F.count_distinct("run").alias("runs"))
    top = runs.join(of, "instance_id").where(F.col("rank") <= F.floor(F.col("features") / 2))
    sums = top.groupBy("instance_id", "feature", "runs").agg(F.count("*").alias("n"), F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    mean = F.col("s") / F.col("runs")
    deviation = (F.col("q") - 2 * mean * F.col("s") + F.col("n") * mean * mean) / F.nullif(F.col("runs") - 1, F.lit(0))
    return sums.groupBy("instance_id").agg(F.avg(deviation).alias("value"))


def elbow(importance: DataFrame, tolerance: float = 0.1, start: int = 5) -> DataFrame:
    """(instance_id, k): leading features before the ratio of neighbours is within ``tolerance`` of 1, from ``start`` on."""
    after = F.lead("weight").over(Window.partitionBy("instance_id").orderBy("rank"))
    flat = importance.withColumn("ratio", after / F.nullif(F.col("weight"), F.lit(0.0))).where((F.col("rank") >= start) & (F.col("ratio") >= 1 - tolerance))
    first = flat.groupBy("instance_id").agg(F.min("rank").alias("flat_at"))
    sizes = importance.groupBy("instance_id").agg(F.max("rank").alias("n"))
    return sizes.join(first, "instance_id", "left").select("instance_id", F.coalesce("flat_at", "n").alias("k"))


def random_rankings(instances: DataFrame, features: list[str], runs: int, seed: int = 1) -> DataFrame:
    """(instance_id, run, feature, rank): keyed shuffles, as a baseline for stability."""
    rows = instances.select("instance_id", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    coded = rows.select("*", F.explode(F.array(*[F.struct(draw_code(seed, F.col("instance_id"), F.col("run"), i).alias("c"), F.lit(f).alias("feature")) for i, f in enumerate(features)])).alias("x"))
    return coded.select("instance_id", "run", "x.feature", F.row_number().over(Window.partitionBy("instance_id", "run").orderBy("x.c", "x.feature")).alias("rank"))


def rule_stability(rules: DataFrame) -> DataFrame:
    """(instance_id, jaccard, identical, size_deviation) over pairs of runs, a run with itself included."""
    sets = rules.groupBy("instance_id", "run").agg(F.array_sort(F.collect_set("feature")).alias("s"))
    return _pairs(sets, ["instance_id"], "s", True).groupBy("instance_id").agg(F.avg(jaccard("v1", "v2")).alias("jaccard"), F.avg((F.col("v1") == F.col("v2")).cast("double")).alias("identical"), F.avg(F.abs(F.size("v1") - F.size("v2"))).alias("size_deviation"))


# Overlap with the truth, and between rankings --------------------------------
def overlap_scores(df: DataFrame, true: str, found: str, where: Column | None = None) -> DataFrame:
    """Sample averages of precision, recall, F1, F0.5 and Jaccard of array columns."""
    both, t, f = F.size(F.array_intersect(true, found)).cast("double"), F.size(true), F.size(found)
    p, r = F.coalesce(both / F.nullif(f, F.lit(0)), F.lit(0.0)), F.coalesce(both / F.nullif(t, F.lit(0)), F.lit(0.0))

    def f_beta(b2: float) -> Column:
        return F.coalesce((1 + b2) * p * r / F.nullif(b2 * p + r, F.lit(0.0)), F.lit(0.0))

    rows = df.where(where) if where is not None else df
    return rows.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f_beta(1)).alias("f1"), F.avg(f_beta(0.25)).alias("f05"), F.avg(jaccard(true, found)).alias("jaccard"))


def rank_overlap(df: DataFrame, key: str, a: str, b: str, p: float = 0.9) -> DataFrame:
    """(key, k, overlap, average_overlap, rbo_min, rbo_ext) of two ranked arrays without ties.

    One row is exploded for each depth up to the longer list; agreement at a
    depth is the common prefix over the depth.
    """
    s, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    d = df.select(key, a, b, s.alias("s"), long.alias("l"), F.explode(F.sequence(F.lit(1), long)).alias("d"))
    d = d.withColumn("x", F.size(F.array_intersect(F.slice(a, F.lit(1), F.least("d", F.size(a))), F.slice(b, F.lit(1), F.least("d", F.size(b))))).cast("double"))
    at_s, at_l = F.max(F.when(F.col("d") == F.col("s"), F.col("x"))), F.max(F.when(F.col("d") == F.col("l"), F.col("x")))
    pd_ = F.pow(F.lit(p), F.col("d"))
    sums = d.groupBy(key).agg(
        F.first("s").alias("s"), F.first("l").alias("l"), at_s.alias("xs"), at_l.alias("xl"),
        F.sum(F.when(F.col("d") <= F.col("s"), F.col("x") / F.col("d"))).alias("ao"),
        F.sum((F.col("x") / F.col("d")) * pd_).alias("all_p"),
        F.sum(F.when(F.col("d") > F.col("s"), (F.col("d") - F.col("s")) / F.col("d") * pd_)).alias("tail_d"),
        F.sum(F.when(F.col("d") <= F.col("s"), F.col("x") / F.col("d") * pd_)).alias("short_p"),
    )
    xs, xl, ns, nl = (F.col(c) for c in ("xs", "xl", "s", "l"))
    ext = (1 - p) / p * (F.col("all_p") + xs / ns * F.coalesce("tail_d", F.lit(0.0))) + ((xl - xs) / nl + xs / ns) * F.pow(F.lit(p), nl)
    minimum = (1 - p) / p * (F.col("short_p") + xs * (-np.log(1 - p)) - xs * F.coalesce(_log_part(p, ns), F.lit(0.0)))
    return sums.select(key, ns.alias("k"), (xs / ns).alias("overlap"), (F.col("ao") / ns).alias("average_overlap"), minimum.alias("rbo_min"), ext.alias("rbo_ext"))


def tied_rank_overlap(df: DataFrame, key: str, a: str, b: str, p: float = 0.9) -> DataFrame:
    """(key, rbo_min, rbo_res, rbo_ext) of two rankings given as arrays of groups; the members of a group share its rank.

    A depth counts groups. Agreement at a depth is twice the common members over
    the members of both; overlap is agreement times the depth, the length of the
    shorter ranking at most. rbo_res is what deeper ranks could add to rbo_min.
    """
    rows = df.select(key, F.least(F.size(a), F.size(b)).alias("s"), F.greatest(F.size(a), F.size(b)).alias("l"), a, b).where("s > 0")
    d = rows.withColumn("d", F.explode(F.sequence(F.lit(1), F.col("l"))))
    upto = [F.array_distinct(F.flatten(F.slice(c, F.lit(1), F.col("d")))) for c in (a, b)]
    d = d.withColumn("g", 2.0 * F.size(F.array_intersect(*upto)) / (F.size(upto[0]) + F.size(upto[1]))).withColumn("x", F.col("g") * F.least("d", "s")).withColumn("pd", F.pow(F.lit(p), F.col("d")))
    at = lambda c: F.max(F.when(F.col("d") == F.col(c), F.col("x")))
    sums = d.groupBy(key).agg(
        F.first("s").alias("s"), F.first("l").alias("l"), at("s").alias("xs"), at("l").alias("xl"),
        F.sum(F.col("pd") * F.col("g")).alias("all_g"),
        F.sum(F.when(F.col("d") <= F.col("s"), F.col("pd") / F.col("d") * F.col("x"))).alias("short_x"),
        F.sum(F.when(F.col("d") > F.col("s"), F.col("pd") * (F.col("d") - F.col("s")) / F.col("d"))).alias("beyond"),
    )
    s, long, xs, xl = (F.col(c) for c in ("s", "l", "xs", "xl"))
    part = lambda n: F.coalesce(_log_part(p, n), F.lit(0.0))
    low = (1 - p) / p * (F.col("short_x") - xs * part(s) - xs * float(np.log(1 - p)))
    f = F.ceil(F.round(long + s - xl, 9)).cast("int")
    res = F.pow(F.lit(p), s) + F.pow(F.lit(p), long) - F.pow(F.lit(p), f) - (1 - p) / p * (s * (part(f) - part(s)) + long * (part(f) - part(long)) + xl * (-float(np.log(1 - p)) - part(f)))
    ext = (1 - p) / p * (F.col("all_g") + xs / s * F.coalesce("beyond", F.lit(0.0))) + F.pow(F.lit(p), long) * ((xl - xs) / long + xs / s)
    return sums.select(key, low.alias("rbo_min"), res.alias("rbo_res"), ext.alias("rbo_ext"))


def _log_part(p: float, n: Column) -> Column:
    """Sum of p^d / d for d up to n."""
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, d: acc + F.pow(F.lit(p), d) / d)


def rank_occurrence(explanations: DataFrame, k: int = 3, nothing: str = "Nothing shown") -> DataFrame:
    """(rank, feature, share): how often a feature has a rank by |weight|; zero weights count as nothing."""
    n = explanations.agg(F.count_distinct("instance_id").alias("n"))
    r = F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc(F.abs("weight")), "feature"))
    top = explanations.withColumn("rank", r).where(F.col("rank") <= k).withColumn("feature", F.when(F.col("weight") == 0, nothing).otherwise(F.col("feature")))
    return top.groupBy("rank", "feature").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("rank", "feature", (F.col("c") / F.col("n")).alias("share"))


def cumulative_occurrence(occurrence: DataFrame, feature: str) -> DataFrame:
    """(rank, share): up to each rank."""
    return occurrence.where(F.col("feature") == feature).select("rank", F.sum("share").over(Window.partitionBy("feature").orderBy("rank")).alias("share"))


# Counterfactuals -------------------------------------------------------------
def counterfactual_scores(candidates: DataFrame, instance: str = "instance_id", k: int = 5) -> DataFrame:
    """One row a instance: hit_, dist_, dens_ for up to k candidates, any_hit, hits; -1 where there is none or nothing changed.

    ``candidates`` has (instance, k, hit, changed, distance, density_ratio).
    """
    tried = F.col("changed")
    pick = lambda c, i: F.coalesce(F.max(F.when((F.col("k") == i) & tried, F.col(c).cast("double"))), F.lit(-1.0))
    every = [pick(c, i).alias(f"{a}_{i}") for i in range(1, k + 1) for c, a in (("hit", "hit"), ("distance", "dist"), ("density_ratio", "dens"))]
    return candidates.groupBy(instance).agg(*every, F.coalesce(F.max(F.when(tried, F.col("hit"))), F.lit(0)).alias("any_hit"), F.coalesce(F.sum(F.when(tried, F.col("hit"))), F.lit(0)).cast("long").alias("hits"))


def counterfactual_summary(wide: DataFrame, method: str, columns: list[str]) -> DataFrame:
    """(method, tries, mean of each column where it isn't -1; median for density, and the deviation)."""
    out = []
    for c in columns:
        v = F.when(F.col(c) != -1, F.col(c))
        out += [(F.median(v) if c.startswith("dens") else F.avg(v)).alias(c), F.stddev_pop(v).alias(f"{c}_std")]
    return wide.groupBy(method).agg(F.count_if(F.col(columns[0]) != -1).alias("tries"), *out)


def region_counts(scores: DataFrame, distance: str = "distance", density: str = "density_ratio") -> DataFrame:
    """(distance_band, density_band, n) with totals of either (cube); bands of distance and log10 density."""
    d, r = F.col(distance), F.log10(density)
    near = F.when(d <= 1, "0-1").when(d <= 3, "1-3").when(d <= 6, "3-6")
    dense = F.when(r <= 2, "0-2").when(r <= 5, "2-5").when(r <= 20, "5-20")
    banded = scores.select(near.alias("distance_band"), dense.alias("density_band")).where("distance_band is not null and density_band is not null")
    return banded.cube("distance_band", "density_band").agg(F.count("*").alias("n"))


def wide_to_long(wide: DataFrame, ids: list[str], k: int, names: tuple[str, ...] = ("hit", "dist", "dens")) -> DataFrame:
    """(ids..., k, names...) from columns name_k."""
    return wide.select(*ids, F.inline(F.array(*[F.struct(F.lit(i).alias("k"), *[F.col(f"{a}_{i}").alias(a) for a in names]) for i in range(1, k + 1)])))


def leaf_fidelity(rows: DataFrame, key: str) -> DataFrame:
    """(key, hit, accuracy, f1, leaf_accuracy) of rows (rep, bb 0/1, surrogate 0/1, in_leaf)."""
    agree = (F.col("bb") == F.col("surrogate")).cast("double")
    tp, fp, fn = (F.count_if((F.col("bb") == b) & (F.col("surrogate") == s)) for b, s in ((1, 1), (0, 1), (1, 0)))
    return rows.groupBy(key).agg(F.max(F.when(F.col("rep") == 0, agree)).alias("hit"), F.avg(agree).alias("accuracy"), F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1"), F.avg(F.when(F.col("in_leaf"), agree)).alias("leaf_accuracy"))


def counterfactual_fairness(rows: DataFrame, key: str) -> DataFrame:
    """(key, flip_share, instance_flip) of leaf rows with labels before and after a change."""
    flip = (F.col("before") != F.col("after")).cast("double")
    return rows.groupBy(key).agg(F.avg(flip).alias("flip_share"), F.max(F.when(F.col("rep") == 0, flip)).alias("instance_flip"))


# Masking benchmarks: rows carry phi_<f> beside each feature -------------------
def ranked_features(features: list[str], absolute: bool = True) -> Column:
    """Feature names by falling attribution; ties by place."""
    value = lambda f: F.abs(f"phi_{f}") if absolute else F.col(f"phi_{f}")
    order = F.array_sort(F.array(*[F.struct((-value(f)).alias("s"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(features)]))
    return F.transform(order, lambda s: s["f"])


def masked(df: DataFrame, features: list[str], ks: list[int], keep: bool, absolute: bool = True) -> DataFrame:
    """For each k: the k first features stay and others become the mean (``keep``), or the other way round."""
    means = df.agg(*[F.avg(f).alias(f"mean_{f}") for f in features])
    rows = df.withColumn("order", ranked_features(features, absolute)).join(F.broadcast(means)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = {f: F.array_position("order", f) <= F.col("k") for f in features}
    return rows.withColumns({f: F.when(inside[f] if keep else ~inside[f], F.col(f).cast("double")).otherwise(F.col(f"mean_{f}")) for f in features}).drop("order", *[f"mean_{f}" for f in features])


def resampled(df: DataFrame, background: DataFrame, key: str, features: list[str], k: int, keep: bool) -> DataFrame:
    """(key, bg_id, features...): masked features come from each background row (a small table)."""
    order = ranked_features(features)
    rows = df.withColumn("order", order).join(small(background.select("bg_id", *[F.col(f).alias(f"bg_{f}") for f in features]), "a background"))
    inside = {f: F.array_position("order", f) <= k for f in features}
    return rows.select(key, "bg_id", *[F.when(inside[f] if keep else ~inside[f], F.col(f).cast("double")).otherwise(F.col(f"bg_{f}")).alias(f) for f in features])


def imputed(df: DataFrame, key: str, features: list[str], k: int, keep: bool, mean: np.ndarray, cov: np.ndarray) -> DataFrame:
    """(key, features...): masked features at their normal mean given the others."""

    def run(frames):
        for f in frames:
            x, phi = f[features].to_numpy(float), np.abs(f[[f"phi_{c}" for c in features]].to_numpy(float))
            first = np.argsort(np.argsort(-phi, axis=1, kind="stable"), axis=1) < k
            seen = first if keep else ~first
            for pattern in np.unique(seen, axis=0) if len(seen) else []:
                rows = (seen == pattern).all(1)
                o, m = np.flatnonzero(pattern), np.flatnonzero(~pattern)
                if len(m) and len(o):
                    x[np.ix_(rows, m)] = mean[m] + (x[np.ix_(rows, o)] - mean[o]) @ np.linalg.pinv(cov[np.ix_(o, o)]) @ cov[np.ix_(o, m)]
                elif len(m):
                    x[np.ix_(rows, m)] = mean[m]
            yield pd.DataFrame({key: f[key], **{c: x[:, i] for i, c in enumerate(features)}})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in features], *[f"phi_{c}" for c in features]).mapInPandas(run, f"{key} long, " + ", ".join(f"{c} double" for c in features))


def batch_retrain(train: DataFrame, test: DataFrame, features: list[str], label: str, k: int, keep: bool) -> DataFrame:
    """One row with R2 of a linear model fitted once to masked training rows, on masked test rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=features, outputCol="v")
    a, b = (v.transform(masked(d, features, [k], keep)) for d in (train, test))
    out = LinearRegression(featuresCol="v", labelCol=label).fit(a).transform(b)
    return r_squared(out, label, "prediction")


def local_accuracy(df: DataFrame, features: list[str], prediction: str, base: float) -> DataFrame:
    """(mean_gap, spread): prediction less base and the sum of attributions."""
    gap = F.col(prediction) - base - sum((F.col(f"phi_{f}") for f in features), F.lit(0.0))
    return df.agg(F.avg(F.abs(gap)).alias("mean_gap"), F.stddev_pop(gap).alias("spread"))


def r_squared(df: DataFrame, y: str, prediction: str) -> DataFrame:
    return df.agg((1 - F.sum(F.pow(F.col(y) - F.col(prediction), F.lit(2.0))) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))


def roc_auc(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """Area under the curve from sums by distinct score, so ties count half; the sums are added up over ranges of scores."""
    by = df.groupBy(F.col(prediction).alias("s")).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    up_to = running(by, ["s"], {"up_to": F.col("neg")})
    return up_to.agg((F.sum(F.col("pos") * (F.col("up_to") - F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def accuracy(df: DataFrame, y: str, prediction: str, cut: float = 0.5) -> DataFrame:
    return df.agg(F.avg(((F.col(prediction) >= cut).cast("int") == F.col(y)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, bb: str, surrogate: str) -> DataFrame:
    return df.groupBy(F.col(bb).alias("bb"), F.col(surrogate).alias("surrogate")).agg(F.count("*").alias("n"))


def runtime_summary(df: DataFrame, by: str, seconds: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(seconds).alias("least"), F.avg(seconds).alias("mean"), F.max(seconds).alias("most"))
