"""Shapley attributions from coalitions of features.

Instances meet masks and a small background table by broadcast; predictions are
averaged over the background before anything is shuffled.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.draws import draw_code, uniform
from rationale.functions.order import numbered, running
from rationale.functions.small import small
from rationale.functions.special import t_tail
from rationale.functions.spread import spread

from .paths import homotopy
from .score import score


MOST_FEATURES = 16


def mask_table(spark, p: int) -> DataFrame:
    """(mask, size): all coalitions of p features, which are copied to every task: at most 16 features."""
    if p > MOST_FEATURES:
        raise ValueError(f"{p} features have 2**{p} coalitions; kernel_shap takes a part of them")
    return spark.range(1 << p).select(F.col("id").alias("mask"), F.bit_count("id").alias("size"))


def kernel_masks(spark, p: int, nsamples: int | None = None, seed: int = 1) -> DataFrame:
    """(mask, w): small and large coalitions in full while the budget lasts, the rest drawn in complement pairs; weights sum to 1.

    Built once for p features on the driver, with ``nsamples`` rows at most.
    """
    budget = nsamples or 2 * p + 2048
    full = (1 << p) - 1
    weights = {s: (p - 1) / (s * (p - s)) for s in range(1, p)}
    total = sum(weights.values())
    out: dict[int, float] = {}
    rest = dict(weights)
    for s in range(1, p // 2 + 1):
        sizes = {s, p - s}
        if sum(comb(p, k) for k in sizes) > budget - len(out):
            break
        for k in sizes:
            for c in combinations(range(p), k):
                out[sum(1 << i for i in c)] = weights[k] / total / comb(p, k)
            rest.pop(k)
    left = budget - len(out)
    if rest and left > 1:
        rng = np.random.default_rng(seed)
        small = [s for s in rest if s <= p - s]
        share = np.array([rest[s] * (2 if s != p - s else 1) for s in small])
        drawn: dict[int, int] = {}
        for s in rng.choice(small, left // 2, p=share / share.sum()):
            m = int(sum(1 << int(i) for i in rng.choice(p, s, replace=False)))
            for x in (m, full ^ m):
                drawn[x] = drawn.get(x, 0) + 1
        scale = sum(rest.values()) / total / sum(drawn.values())
        for x, n in drawn.items():
            out[x] = out.get(x, 0.0) + n * scale
    norm = sum(out.values())
    return spark.createDataFrame([(m, w / norm) for m, w in sorted(out.items())] or [(0, 1.0)], "mask long, w double")


def coalition_values(instances: DataFrame, background: DataFrame, masks: DataFrame, key: str, features: list[str], model, weight: str | None = None) -> DataFrame:
    """(key, mask, v): mean prediction when masked-in features are the instance's and others the background's."""
    names = [F.col(f).alias(f"bg_{f}") for f in features] + ([F.col(weight).alias("bg_weight")] if weight else [F.lit(1.0).alias("bg_weight")])
    rows = spread(instances.select(key, *[F.col(f).cast("double").alias(f) for f in features]), key).join(F.broadcast(masks.select("mask"))).join(small(background.select(*names), "a background"))
    mixed = rows.select(key, "mask", "bg_weight", *[F.when(F.getbit("mask", F.lit(i)) == 1, F.col(f)).otherwise(F.col(f"bg_{f}").cast("double")).alias(f) for i, f in enumerate(features)])
    scored = score(mixed, model, "prediction", features, "double")
    return scored.groupBy(key, "mask").agg((F.sum(F.col("prediction") * F.col("bg_weight")) / F.sum("bg_weight")).alias("v"))


def shap_exact(instances: DataFrame, background: DataFrame, key: str, features: list[str], model) -> DataFrame:
    """(key, phi_<feature>...) over all coalitions."""
    p = len(features)
    values = coalition_values(instances, background, mask_table(instances.sparkSession, p), key, features, model)
    w = F.array(*[F.lit(factorial(s) * factorial(p - s - 1) / factorial(p)) for s in range(p)])
    size = F.bit_count("mask")
    part = [F.when(F.getbit("mask", F.lit(i)) == 1, F.col("v") * F.element_at(w, F.greatest(size, F.lit(1)))).otherwise(-F.col("v") * F.element_at(w, F.least(size + 1, F.lit(p)))) for i in range(p)]
    return values.groupBy(key).agg(*[F.sum(x).alias(f"phi_{f}") for f, x in zip(features, part, strict=True)])


def varying_features(instances: DataFrame, background: DataFrame, key: str, features: list[str], tolerance: float = 1e-7) -> DataFrame:
    """(key, varying): names of features in which some background row differs."""
    rows = instances.select(key, *features).join(small(background.select(*[F.col(f).alias(f"bg_{f}") for f in features]), "a background"))
    flags = rows.groupBy(key).agg(*[F.max((F.abs(F.col(f) - F.col(f"bg_{f}")) > tolerance).cast("int")).alias(f) for f in features])
    return flags.select(key, F.filter(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in features]), lambda x: x.isNotNull()).alias("varying"))


def kept_features(z: np.ndarray, y: np.ndarray, w: np.ndarray, total: float, select: str | int) -> list[int]:
    """Columns of the coalitions ``z`` that explain their values ``y``.

    Each coalition stands twice, as what it adds to none and as what it lacks of all,
    so that the sum is fitted too.  A number takes the features that enter a
    least-angle path first; ``aic`` or ``bic`` take the breakpoint of the lasso path
    with the best trade of squared error, in units of the noise that all features
    leave, for features.  Ties go to fewer features.
    """
    p, size = z.shape[1], z.sum(1)
    root = np.sqrt(np.concatenate([w * (p - size), w * size]))
    x = np.vstack([z, z - 1]) * root[:, None]
    t = np.concatenate([y, y - total]) * root
    if not isinstance(select, str):
        return sorted([entered for _, entered, *_ in homotopy(x.T @ x, x.T @ t, lasso=False) if entered is not None][:select])
    x, t = x - x.mean(0), t - t.mean()
    xx, xy, yy = x.T @ x, x.T @ t, float(t @ t)
    coefs = [step[-1] for step in homotopy(xx, xy)]
    left = np.array([max(yy - 2 * c @ xy + c @ xx @ c, 0.0) for c in coefs])
    used = [np.flatnonzero(np.abs(c) > 1e-9 * np.abs(c).max(initial=0.0)) for c in coefs]
    noise = max(left[-1] / max(len(t) - p - 1, 1), 1e-12 * yy / len(t), 1e-300)
    price = {"aic": 2.0, "bic": np.log(len(t))}[select]
    cost = np.round(left / noise + price * np.array([len(u) for u in used]), 9)
    return used[int(np.lexsort(([len(u) for u in used], cost))[0])].tolist()


def kernel_shap(instances: DataFrame, background: DataFrame, key: str, features: list[str], model, masks: DataFrame | None = None, link: str = "identity", weight: str | None = None, select: str | int | None = None) -> DataFrame:
    """(key, phi_<feature>...): weighted least squares on coalition values, bound to add up to f(x) - f0; the last feature is eliminated.

    With ``select`` (``aic``, ``bic`` or a number) each instance is fitted on the
    features of its own that ``kept_features`` finds; the others have 0, as all have
    if none is found.
    """
    p, spark = len(features), instances.sparkSession
    full = (1 << p) - 1
    masks = masks if masks is not None else kernel_masks(spark, p)
    ends = spark.createDataFrame([(0,), (full,)], "mask long")
    values = coalition_values(instances, background, masks.select("mask").union(ends).distinct(), key, features, model, weight)
    linked = F.log(F.col("v") / (1 - F.col("v"))) if link == "logit" else F.col("v")
    packed = values.withColumn("v", linked).join(F.broadcast(masks), "mask", "left").groupBy(key).agg(F.collect_list(F.struct("mask", "v", F.coalesce("w", F.lit(0.0)).alias("w"))).alias("s"))

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        out = []
        for rows in s:
            m, v, w = (np.array([r[k] for r in rows]) for k in ("mask", "v", "w"))
            f0, f1 = v[m == 0][0], v[m == full][0]
            use = (m != 0) & (m != full)
            z = (m[use, None] >> np.arange(p) & 1).astype(float)
            kept = list(range(p)) if select is None else kept_features(z, v[use] - f0, w[use], f1 - f0, select)
            phi = np.zeros(p)
            if kept:
                *first, last = kept
                x = z[:, first] - z[:, [last]]
                a = x.T * w[use]
                phi[first] = np.linalg.lstsq(a @ x, a @ (v[use] - f0 - z[:, last] * (f1 - f0)), rcond=None)[0] if first else []
                phi[last] = f1 - f0 - phi.sum()
            out.append(phi.tolist())
        return pd.Series(out)

    fits = packed.select(key, solve("s").alias("phi"))
    return fits.select(key, *[F.col("phi")[i].alias(f"phi_{f}") for i, f in enumerate(features)])


def sampling_shap(instances: DataFrame, background: DataFrame, key: str, features: list[str], model, n: int, seed: int = 1) -> DataFrame:
    """(key, feature, phi, variance): keyed permutations and background rows; f with less f without each feature."""
    p = len(features)
    lists = small(background, "a background").agg(F.count("*").alias("m"), *[F.transform(F.array_sort(F.collect_list(F.struct("bg_id", F.col(f).alias("v")))), lambda s: s["v"]).alias(f"bg_{f}") for f in features])
    rows = spread(instances.select(key, *[F.col(f).cast("double").alias(f) for f in features]), key).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).join(F.broadcast(lists))
    pick = (F.floor(uniform(seed, F.col(key), F.col("rep"), 50) * F.col("m")) + 1).cast("int")
    codes = F.array(*[draw_code(seed + 1, F.col(key), F.col("rep"), i) for i in range(p)])
    rows = rows.withColumn("codes", codes).withColumn("pick", pick).withColumn("mine", F.element_at("codes", F.col("j") + 1))
    side = rows.withColumn("on", F.explode(F.array(F.lit(0), F.lit(1))))
    own = lambda i: (F.col("codes")[i] < F.col("mine")) | ((F.col("codes")[i] == F.col("mine")) & (F.col("on") == 1))
    mixed = side.select(key, "rep", "j", "on", *[F.when(own(i), F.col(f)).otherwise(F.element_at(f"bg_{f}", F.col("pick")).cast("double")).alias(f) for i, f in enumerate(features)])
    scored = score(mixed, model, "prediction", features, "double")
    diff = scored.groupBy(key, "rep", "j").agg(F.sum(F.when(F.col("on") == 1, F.col("prediction")).otherwise(-F.col("prediction"))).alias("d"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j") + 1)
    return diff.groupBy(key, name.alias("feature")).agg(F.avg("d").alias("phi"), F.var_pop("d").alias("variance"))


def allocate_samples(first: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, feature, n): a second round in proportion to variance, in even numbers."""
    share = F.col("variance") / F.nullif(F.sum("variance").over(Window.partitionBy(key)), F.lit(0.0))
    return first.select(key, "feature", (F.floor(F.coalesce(share, F.lit(0.0)) * budget / 2) * 2).cast("long").alias("n"))


def samples_for_error(first: DataFrame, key: str, error: float, z: float = 1.96) -> DataFrame:
    """(key, n): draws that bring the summed error below ``error``."""
    return first.groupBy(key).agg(F.ceil(z * z * F.sum("variance") / (error * error)).cast("long").alias("n"))


def efficiency_correction(phis: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, feature, phi): the gap to the total is spread by variance; ``totals`` has (key, total)."""
    w = Window.partitionBy(key)
    v = F.col("variance") / F.nullif(F.max("variance").over(w), F.lit(0.0)) * 1e6
    v = F.coalesce(v, F.lit(1.0))
    rows = phis.join(totals, key).withColumn("v", v).withColumn("gap", F.col("total") - F.sum("phi").over(w))
    return rows.select(key, "feature", (F.col("phi") + F.col("gap") * (F.col("v") - F.col("v") * F.sum("v").over(w) / (1 + F.sum("v").over(w)))).alias("phi"))


def permutation_shap(instances: DataFrame, background: DataFrame, key: str, features: list[str], model) -> DataFrame:
    """(key, phi_<feature>...): features are filled in forward and in reverse; both steps are averaged."""
    p, spark = len(features), instances.sparkSession
    prefix = [(1 << i) - 1 for i in range(p + 1)]
    suffix = [((1 << p) - 1) ^ m for m in prefix]
    masks = spark.createDataFrame([(m,) for m in sorted({*prefix, *suffix})], "mask long")
    values = coalition_values(instances, background, masks, key, features, model)
    at = lambda m: F.max(F.when(F.col("mask") == m, F.col("v")))
    return values.groupBy(key).agg(*[(((at(prefix[i + 1]) - at(prefix[i])) + (at(suffix[i]) - at(suffix[i + 1]))) / 2).alias(f"phi_{f}") for i, f in enumerate(features)])


def linear_shap(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """phi_<feature> = (x - mean) * coefficient, beside the columns."""
    means = df.agg(*[F.avg(f).alias(f"mean_{f}") for f in coefficients])
    return df.join(F.broadcast(means)).withColumns({f"phi_{f}": (F.col(f) - F.col(f"mean_{f}")) * c for f, c in coefficients.items()}).drop(*[f"mean_{f}" for f in coefficients])


def attribution_rows(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, feature, phi)."""
    return df.select(key, *[F.col(f"phi_{f}").alias(f) for f in features]).unpivot(key, features, "feature", "phi")


def global_importance(attributions: DataFrame) -> DataFrame:
    """(feature, importance, rank) by mean |phi|."""
    sums = attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def interactions(df: DataFrame, feature: str, others: list[str], order_key: str, nan_indicators: bool = False) -> DataFrame:
    """(other, strength, rank): rows sorted by the feature are cut in runs; |correlation| of its phi with another feature is summed over runs.

    With ``nan_indicators``, a feature's nulls count too: the stronger of its
    value (nulls as its mean) and of an indicator of null is taken.
    """
    n = df.count()
    size = max(1, min(50, n // 10))
    rows = df.select(*dict.fromkeys([feature, order_key, f"phi_{feature}", *others]))
    if nan_indicators:
        means = df.agg(*[F.avg(o).alias(f"mean_{o}") for o in others])
        rows = rows.join(F.broadcast(means)).select(feature, order_key, f"phi_{feature}", *[F.coalesce(F.col(o).cast("double"), f"mean_{o}").alias(f"value_{o}") for o in others], *[F.col(o).isNull().cast("double").alias(f"null_{o}") for o in others])
        runs = numbered(rows, [feature, order_key], "i").withColumn("run", F.floor(F.col("i") / size))
        strength = lambda c: F.abs(F.coalesce(F.nanvl(F.corr(f"phi_{feature}", c), F.lit(0.0)), F.lit(0.0)))
        per = runs.groupBy("run").agg(*[strength(f"{k}_{o}").alias(f"{k}_{o}") for o in others for k in ("value", "null")])
        sums = per.agg(*[F.sum(f"{k}_{o}").alias(f"{k}_{o}") for o in others for k in ("value", "null")])
        total = sums.select(F.inline(F.array(*[F.struct(F.lit(o).alias("other"), F.coalesce(F.greatest(f"value_{o}", f"null_{o}"), F.lit(0.0)).alias("strength")) for o in others])))
        return total.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "other")))
    runs = numbered(rows, [feature, order_key], "i").withColumn("run", F.floor(F.col("i") / size))
    per = runs.groupBy("run").agg(*[F.corr(f"phi_{feature}", o).alias(o) for o in others])
    long = per.select(*[F.abs(F.when(~F.isnan(o), F.col(o))).alias(o) for o in others]).unpivot([], others, "other", "r")
    total = long.groupBy("other").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("strength"))
    return total.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "other")))


def monitor(df: DataFrame, group: str, time: str, value: str, step: int = 50, n_features: int = 1) -> DataFrame:
    """(group, cut, t, p, flagged): two-sample t at every ``step`` rows in time; the best cut of each group, flagged below .05 / n_features."""
    x = F.col(value)
    whole = df.groupBy(F.col(group).alias("r_group")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    up_to = running(df.select(group, time, value), [time], {"i": F.lit(1).cast("long"), "s1": x, "q1": x * x}, (group,))
    rows = up_to.join(whole, F.col(group).eqNullSafe(F.col("r_group")))
    cuts = rows.where((F.col("i") % step == 0) & (F.col("i") >= 2) & (F.col("n") - F.col("i") >= 2))
    n1, n2 = F.col("i").cast("double"), (F.col("n") - F.col("i")).cast("double")
    m1, m2 = F.col("s1") / n1, (F.col("s") - F.col("s1")) / n2
    within = (F.col("q1") - n1 * m1 * m1) + (F.col("q") - F.col("q1") - n2 * m2 * m2)
    t = (m1 - m2) / F.nullif(F.sqrt(within / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), F.lit(0.0))
    best = cuts.withColumn("t", t).groupBy(group).agg(F.max_by(F.struct("i", "t", "n"), F.struct(F.abs("t"), -F.col("i"))).alias("b"))
    out = best.select(group, F.col("b.i").alias("cut"), F.col("b.t").alias("t"), (F.col("b.n") - 2).cast("double").alias("df"))
    return out.withColumn("p", t_tail("t", "df")).withColumn("flagged", F.col("p") < 0.05 / n_features).drop("df")


def partial_dependence(df: DataFrame, key: str, feature: str, features: list[str], model, points: int = 100, ice: bool = False) -> DataFrame:
    """(x, mean), or (key, x, prediction) of single rows, over a grid between the feature's ends."""
    ends = df.agg(F.min(F.col(feature).cast("double")).alias("lo"), F.max(F.col(feature).cast("double")).alias("hi"))
    grid = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / max(points - 1, 1))).alias("x"))
    rows = df.select(key, *features).join(F.broadcast(grid)).withColumn(feature, F.col("x"))
    scored = score(rows, model, "prediction", features, "double")
    return scored.select(key, "x", "prediction") if ice else scored.groupBy("x").agg(F.avg("prediction").alias("mean"))


def partial_dependence_2d(df: DataFrame, key: str, two: tuple[str, str], features: list[str], model, points: int = 20) -> DataFrame:
    """(x, y, mean)."""
    a, b = two
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in two for k, f in (("lo", F.min), ("hi", F.max))])
    step = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col(f"lo_{c}") + i * (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / max(points - 1, 1)))
    grid = ends.select("*", step(a).alias("x")).select("x", step(b).alias("y"))
    rows = df.select(key, *features).join(F.broadcast(grid)).withColumn(a, F.col("x")).withColumn(b, F.col("y"))
    return score(rows, model, "prediction", features, "double").groupBy("x", "y").agg(F.avg("prediction").alias("mean"))


def attribution_pca(df: DataFrame, key: str, features: list[str], k: int = 2) -> DataFrame:
    """(key, pc): projection of the attributions on their first components."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=[f"phi_{f}" for f in features], outputCol="v").transform(df)
    return PCA(k=k, inputCol="v", outputCol="c").fit(v).transform(v).select(key, vector_to_array("c").alias("pc"))
