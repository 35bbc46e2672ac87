"""Local linear surrogates, from weighted moments.

A neighbourhood is reduced to one array of moments for each instance and label
in a single grouped aggregate (partial sums before the shuffle); every fit and
every selection of features is then solved from the moments, many at a time.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moments(neigh: DataFrame, keys: list[str], features: list[str], y: str, w: str) -> DataFrame:
    """(keys..., m): sums of w, wx, wy, wyy, wxy, and wx_i x_j for i <= j."""
    x = [F.col(c).cast("double") for c in features]
    wt, t = F.col(w).cast("double"), F.col(y).cast("double")
    parts = [wt, *[wt * a for a in x], wt * t, wt * t * t, *[wt * a * t for a in x], *[wt * x[i] * x[j] for i, j in combinations_with_replacement(range(len(x)), 2)]]
    sums = neigh.groupBy(*keys).agg(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select(*keys, F.array(*[F.col(f"s{i}") for i in range(len(parts))]).alias("m"))


def centred(m: np.ndarray, p: int) -> tuple[np.ndarray, ...]:
    """For a batch of moments: weights, means of x and y, centred Sxx, Sxy, Syy."""
    sw, sx, sy, syy, sxy = m[:, 0], m[:, 1 : 1 + p], m[:, 1 + p], m[:, 2 + p], m[:, 3 + p : 3 + 2 * p]
    xx = np.zeros((len(m), p, p))
    for k, (i, j) in enumerate(combinations_with_replacement(range(p), 2)):
        xx[:, i, j] = xx[:, j, i] = m[:, 3 + 2 * p + k]
    mx, my = sx / sw[:, None], sy / sw
    return sw, mx, my, xx - sw[:, None, None] * mx[:, :, None] * mx[:, None, :], sxy - sw[:, None] * mx * my[:, None], syy - sw * my**2


def _solve(m: pd.Series, p: int, alpha: float) -> list[np.ndarray]:
    _, mx, my, xx, xy, yy = centred(np.array(m.tolist()), p)
    coef = np.linalg.solve(xx + alpha * np.eye(p), xy[:, :, None])[:, :, 0]
    left = yy - 2 * (coef * xy).sum(1) + np.einsum("ni,nij,nj->n", coef, xx, coef)
    r2 = np.where(yy > 1e-12, 1 - left / np.where(yy > 1e-12, yy, 1), 0.0)
    return list(np.column_stack([my - (mx * coef).sum(1), coef, r2]))


def local_ridge(neigh: DataFrame, keys: list[str], features: list[str], y: str, w: str, alpha: float = 1.0) -> DataFrame:
    """(keys..., intercept, coef_<feature>..., r2): weighted ridge regression; the intercept isn't penalised."""
    p = len(features)

    @F.pandas_udf("array<double>")
    def solved(m: pd.Series) -> pd.Series:
        return pd.Series(_solve(m, p, alpha))

    fits = moments(neigh, keys, features, y, w).select(*keys, solved("m").alias("f"))
    return fits.select(*keys, F.col("f")[0].alias("intercept"), *[F.col("f")[i + 1].alias(f"coef_{c}") for i, c in enumerate(features)], F.col("f")[p + 1].alias("r2"))


def local_prediction(fits: DataFrame, neigh: DataFrame, keys: list[str], key: str, features: list[str]) -> DataFrame:
    """(keys..., r2, local_pred): the fit's value at the instance itself."""
    own = neigh.where("rep = 0").select(key, *features)
    value = sum((F.col(f"coef_{c}") * F.col(c) for c in features), F.col("intercept"))
    return fits.join(own, key).select(*keys, "r2", value.alias("local_pred"))


def _forward(xx, xy, yy, k: int, alpha: float) -> list[int]:
    used: list[int] = []
    for _ in range(min(k, len(xy))):
        best, gain = None, -np.inf
        for j in range(len(xy)):
            if j in used:
                continue
            s = [*used, j]
            coef = np.linalg.solve(xx[np.ix_(s, s)] + alpha * np.eye(len(s)), xy[s])
            score = 2 * coef @ xy[s] - coef @ xx[np.ix_(s, s)] @ coef
            if score > gain:
                best, gain = j, score
        used.append(best)
    return used


def _lasso(xx, xy, yy, k: int) -> list[int]:
    """Features of the smallest penalty on the path that keeps at most k, from its exact breakpoints."""
    from .paths import homotopy

    chosen: list[int] = []
    for _, entered, _, _, coef in homotopy(xx, xy):
        now = [j for j in np.flatnonzero(coef) if j != entered]
        if len(now) > k:
            break
        chosen = now or chosen
    return [int(j) for j in chosen]


def select_features(neigh: DataFrame, keys: list[str], features: list[str], y: str, w: str, k: int, method: str = "auto", x0: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(keys..., chosen): names of k features. ``highest_weights`` ranks |coef * x0| of a ridge fit with penalty 0.01 (|coef| without x0)."""
    p = len(features)
    if method == "auto":
        method = "forward_selection" if k <= 6 else "highest_weights"
    if method == "none":
        return neigh.select(*keys).distinct().withColumn("chosen", F.array(*[F.lit(c) for c in features]))
    m = moments(neigh, keys, features, y, w)
    m = m.join(x0.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("x0")), key) if x0 is not None else m.withColumn("x0", F.array(*[F.lit(1.0)] * p))

    @F.pandas_udf("array<int>")
    def pick(m: pd.Series, at: pd.Series) -> pd.Series:
        _, _, _, xx, xy, yy = centred(np.array(m.tolist()), p)
        out = []
        for i in range(len(m)):
            if method == "forward_selection":
                out.append(_forward(xx[i], xy[i], yy[i], k, 0.0001))
            elif method == "lasso_path":
                out.append(_lasso(xx[i], xy[i], yy[i], k))
            else:
                coef = np.linalg.solve(xx[i] + 0.01 * np.eye(p), xy[i])
                out.append(list(np.argsort(-np.abs(coef * np.asarray(at[i])), kind="stable")[:k]))
        return pd.Series(out)

    names = F.array(*[F.lit(c) for c in features])
    return m.select(*keys, F.transform(pick("m", "x0"), lambda i: F.element_at(names, i + 1)).alias("chosen"))


def explanation_rows(fits: DataFrame, keys: list[str], features: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """(keys..., feature, weight, rank) by falling |weight|, ties by name."""
    long = fits.select(*keys, *[F.col(f"coef_{c}").alias(c) for c in features]).unpivot(keys, features, "feature", "weight")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("weight")), "feature"))
    out = long.withColumn("rank", rank)
    return out.replace(names, subset=["feature"]) if names else out


def mirrored(explanations: DataFrame) -> DataFrame:
    """Regression: weights for the value (label 1) and against it (label 0)."""
    return explanations.withColumn("label", F.lit(1)).unionByName(explanations.withColumn("weight", -F.col("weight")).withColumn("label", F.lit(0)))


def surrogate_predict(rows: DataFrame, fits: DataFrame, features: list[str], key: str, label: str = "label") -> DataFrame:
    """(key, row columns..., predicted): the label whose linear model gives the most (ties: smaller label)."""
    value = sum((F.col(f"coef_{c}") * F.col(c) for c in features), F.col("intercept"))
    scored = rows.join(fits, key).withColumn("v", value)
    names = [c for c in rows.columns]
    first = Window.partitionBy(*names).orderBy(F.desc("v"), label)
    return scored.withColumn("r", F.row_number().over(first)).where("r = 1").select(*names, F.col(label).alias("predicted"))


def selection_test(neigh: DataFrame, key: str, features: list[str], y: str, w: str, z_alpha: float = 1.959963984540054) -> DataFrame:
    """(key, first, second, n, statistic, stable, suggested): are the two features most correlated with y told apart?

    The statistic is the mean over the deviation of the mean of the difference
    of their products with centred y; too small a one suggests more rows.
    """
    stats = neigh.groupBy(key).agg(F.avg(y).alias("my"), *[F.avg(c).alias(f"m_{c}") for c in features], *[F.corr(c, y).alias(f"r_{c}") for c in features], *[F.stddev_samp(c).alias(f"d_{c}") for c in features])
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(F.coalesce(f"r_{c}", F.lit(0.0)))).alias("s"), F.lit(c).alias("c")) for c in features]))
    top = stats.withColumn("top", ranked).select("*", F.col("top")[0]["c"].alias("first"), F.col("top")[1]["c"].alias("second"))

    def product(which: str):
        out = None
        for c in features:
            term = (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"d_{c}"), F.lit(0.0)) * (F.col(y) - F.col("my")) * F.signum(F.col(f"r_{c}"))
            out = F.when(F.col(which) == c, term) if out is None else out.when(F.col(which) == c, term)
        return F.coalesce(out, F.lit(0.0))

    both = neigh.join(top, key).withColumn("diff", product("first") - product("second"))
    test = both.groupBy(key, "first", "second").agg(F.count("*").alias("n"), (F.avg("diff") / F.nullif(F.sqrt(F.var_samp("diff") / F.count("*")), F.lit(0.0))).alias("statistic"))
    stable = F.coalesce(F.abs("statistic") >= z_alpha, F.lit(True))
    return test.select("*", stable.alias("stable"), F.when(~stable, F.ceil(F.col("n") * F.pow(z_alpha / F.greatest(F.abs("statistic"), F.lit(1e-3)), F.lit(2.0)))).otherwise(F.col("n")).cast("long").alias("suggested"))


def stable_explain(instances: DataFrame, make_neighbourhood, key: str, features: list[str], y: str, w: str, n0: int, n_max: int = 10_000, k: int | None = None) -> DataFrame:
    """(key, n, stable, coef_...): rows are drawn again for instances whose first ``k`` choices (all, without it) aren't told from their runners-up.

    ``make_neighbourhood(instances, n)`` gives the scored neighbourhood; ``n`` is a
    column, as each instance asks for its own number: what its first failing test
    suggests, at least a quarter more than before and at most twice as many.  At
    ``n_max`` rows an instance is explained as it is, with ``stable`` false.
    """
    from rationale.functions.small import MOST_ROWS, apart
    from rationale.sources.scratch import stored

    from .paths import tested_path

    open_, done = instances.withColumn("r_rows", F.lit(min(n0, n_max)).cast("long")), None
    while True:
        neigh = stored(make_neighbourhood(open_, F.col("r_rows")))
        tests = tested_path(neigh, [key], features, y, w).where(F.col("step") < (k or len(features)))
        first = tests.groupBy(key).agg(F.min_by(F.struct("stable", "suggested"), F.struct("stable", "step")).alias("t"))
        rows = open_.limit(MOST_ROWS + 1).count()
        first = stored(first.select(key, F.col("t.stable").alias("stable"), F.col("t.suggested").alias("suggested")).join(apart(open_.select(key, "r_rows"), rows), key))
        final = first.where(F.col("stable") | (F.col("r_rows") >= n_max))
        of_final = neigh.join(apart(final.select(key), rows, "shuffle_hash"), key, "left_semi")
        fits = stored(local_ridge(of_final, [key], features, y, w).join(apart(final.select(key, F.col("r_rows").alias("n"), "stable"), rows), key))
        done = fits if done is None else done.unionByName(fits)
        more = first.where(~F.col("stable") & (F.col("r_rows") < n_max))
        size = F.least(F.greatest("suggested", F.ceil(F.col("r_rows") * 1.25)), 2 * F.col("r_rows"), F.lit(n_max)).cast("long").alias("r_rows")
        open_ = stored(open_.drop("r_rows").join(apart(more.select(key, size), rows), key))
        if open_.isEmpty():
            return done


def maple(rows: DataFrame, weights: DataFrame, features: list[str], y: str, row_key: str, alpha: float = 1e-3) -> DataFrame:
    """(instance_id, intercept, coef_...): ridge on real rows with forest-leaf weights."""
    return local_ridge(weights.join(rows, row_key), ["instance_id"], features, y, "weight", alpha)


def importance(explanations: DataFrame) -> DataFrame:
    """(feature, importance): root of the sum of |weight| over instances."""
    return explanations.groupBy("feature").agg(F.sqrt(F.sum(F.abs("weight"))).alias("importance"))


def submodular_pick(explanations: DataFrame, k: int, key: str = "instance_id") -> DataFrame:
    """(round, key): greedy cover of important features; the largest id wins ties. Covered features leave each round."""
    from rationale.sources.scratch import stored

    worth = stored(importance(explanations))
    has = explanations.where("weight <> 0").select(key, "feature").distinct()
    picked, spark = [], explanations.sparkSession
    for _ in range(k):
        gains = has.join(worth, "feature").groupBy(key).agg(F.round(F.sum("importance"), 9).alias("gain"))
        best = gains.orderBy(F.desc("gain"), F.desc(key)).first()
        if best is None:
            break
        picked.append((len(picked) + 1, best[0]))
        worth = worth.join(has.where(F.col(key) == best[0]).select("feature"), "feature", "left_anti")
    return spark.createDataFrame(picked, f"round int, {key} long")


def text_ridge(masks: DataFrame, key: str, words: str, y: str, weight: str, alpha: float = 1.0) -> DataFrame:
    """(key, word, weight, rank): ridge regression of a score on which words of a text a mask keeps, a weight for each word.

    ``masks`` has one row for each mask of a text, with the kept words as an
    array; a group is the masks of one text. The regression is solved in the
    space of the masks, so a text of many words costs no matrix over its words.
    """
    kind = masks.schema[key].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        kept = table.column(words).combine_chunks()
        coded = kept.flatten().dictionary_encode()
        vocabulary = np.array(coded.dictionary.to_pylist(), object)
        place = np.empty(len(vocabulary), np.int64)
        place[np.argsort(vocabulary)] = np.arange(len(vocabulary))
        x = np.zeros((len(kept), len(vocabulary)), np.float32)
        sizes = pc.fill_null(pc.list_value_length(kept), 0).to_numpy(zero_copy_only=False)
        x[np.repeat(np.arange(len(kept)), sizes), place[coded.indices.to_numpy(zero_copy_only=False)]] = 1
        w, t = (table.column(c).to_numpy() for c in (weight, y))
        root = np.sqrt(w)
        left = (x - w @ x / w.sum()) * root[:, None]
        right = (t - w @ t / w.sum()) * root
        coef = left.T @ np.linalg.solve(left @ left.T + alpha * np.eye(len(x)), right)
        order = np.lexsort((np.arange(len(coef)), -np.abs(coef).round(9)))
        named = np.sort(vocabulary)[order]
        return pa.table({key: pa.repeat(table.column(key)[0], len(coef)), "word": pa.array(named, pa.string()), "weight": coef[order], "rank": np.arange(1, len(coef) + 1, dtype=np.int32)})

    rows = masks.select(key, F.col(words), F.col(y).cast("double").alias(y), F.col(weight).cast("double").alias(weight))
    return rows.groupBy(key).applyInArrow(solve, f"{key} {kind}, word string, weight double, rank int")
