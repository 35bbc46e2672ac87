"""Neighbourhoods: perturbed rows around every instance, keyed by (instance, rep); rep 0 is the instance itself.

Instances are dealt out by key (``spread``) and rows made by exploding a sequence
beside each, so no made row is shuffled; draws depend on (seed, instance, rep,
feature) alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from rationale.functions.draws import MODULUS, bound, cauchy, codes_of, draw_code, normal, uniform, with_students
from rationale.functions.order import numbered
from rationale.functions.small import small
from rationale.functions.special import normal_quantiles
from rationale.functions.spread import spread
from rationale.sources.scratch import stored


def stats_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mean_, scale_, min_ and max_ columns, to be broadcast."""
    return df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("scale", F.stddev_pop), ("min", F.min), ("max", F.max))])


def _draw(dist: str, seed: int, key: Column, rep: Column, i: int) -> Column:
    if dist == "uniform":
        return 4 * uniform(seed, key, rep, i) - 2
    return {"range": uniform, "standard-normal": normal, "cauchy": cauchy}[dist](seed, key, rep, i)


def repeated(instances: DataFrame, n: int | Column) -> DataFrame:
    return instances.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n))))


def perturb(instances: DataFrame, stats: DataFrame, key: str, columns: list[str], n: int | Column, dist: str = "uniform", seed: int = 1) -> DataFrame:
    """(key, rep, columns..., x0_columns...): draw * scale + row; ``range`` draws from the training range instead. ``n`` may be a column."""
    rows = repeated(spread(instances.select(key, F.lit(n).cast("int").alias("r_n"), *[F.col(c).cast("double").alias(c) for c in columns]), key), F.col("r_n")).join(F.broadcast(stats))
    if dist == "t":
        rows = with_students(rows, seed, F.col(key), F.col("rep"), [f"r_d_{i}" for i in range(len(columns))])
    out = []
    for i, c in enumerate(columns):
        draw = F.col(f"r_d_{i}") if dist == "t" else _draw(dist, seed, F.col(key), F.col("rep"), i)
        x = F.col(f"min_{c}") + draw * (F.col(f"max_{c}") - F.col(f"min_{c}")) if dist == "range" else F.col(c) + F.col(f"scale_{c}") * draw
        out.append(F.when(F.col("rep") == 0, F.col(c)).otherwise(x).alias(c))
    return rows.select(key, "rep", *out, *[F.col(c).alias(f"x0_{c}") for c in columns])


def perturb_normal(instances: DataFrame, cov: np.ndarray, key: str, columns: list[str], n: int, seed: int = 1) -> DataFrame:
    """Multivariate normal around each row: independent normals times the Cholesky factor (p by p, on the driver), or a root of a singular covariance."""
    try:
        lower = np.linalg.cholesky(np.asarray(cov, float))
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(np.asarray(cov, float))
        lower = vectors * np.sqrt(np.maximum(values, 0))
    rows = repeated(spread(instances.select(key, *[F.col(c).cast("double").alias(c) for c in columns]), key), n)
    z = [normal(seed, F.col(key), F.col("rep"), i) for i in range(len(columns))]
    step = [sum((float(lower[i, j]) * z[j] for j in range(len(columns))), F.lit(0.0)) for i in range(len(columns))]
    return rows.select(key, "rep", *[F.when(F.col("rep") == 0, F.col(c)).otherwise(F.col(c) + s).alias(c) for c, s in zip(columns, step, strict=True)], *[F.col(c).alias(f"x0_{c}") for c in columns])


def bounded(x: Column, lo: Column, hi: Column, method: str = "lazy", centre: Column | None = None, passes: int = 8) -> Column:
    """Values beyond the bounds: clamped, or (``absolute``) folded back into half of the range.

    ``distribute`` moves them to either side of ``centre`` (the mean, or the
    instance's own value) by half their rest, again while they stay outside, and
    clamps what ``passes`` moves haven't brought inside.
    """
    if method == "lazy":
        return F.least(F.greatest(x, lo), hi)
    r = F.nullif(hi - lo, F.lit(0.0))
    if method == "distribute":
        move = lambda v, _: F.when(v < lo, centre + F.pmod(v, r) / 2).when(v > hi, centre - F.pmod(v, r) / 2).otherwise(v)
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), x.cast("double"), move)
        return F.least(F.greatest(moved, lo), hi)
    return F.when(x > hi, hi - F.pmod(x, r) / 2).when(x < lo, lo + F.pmod(x, r) / 2).otherwise(x)


def balanced(rounds: DataFrame, key: str, n: int, own: str = "own", per_round: int = 0) -> DataFrame:
    """Half rows of the instance's class and half others, of the first rounds that hold enough.

    ``rounds`` holds rows (key, round, rep, own boolean) of all rounds.  Per
    instance the least round is taken by which both classes have n / 2 rows (all
    rounds if none), then n / 2 of each class by rep.
    """
    half = n // 2
    per = rounds.groupBy(key, "round").agg(F.count_if(own).alias("a"), F.count_if(~F.col(own)).alias("b"))
    run = Window.partitionBy(key).orderBy("round")
    enough = per.withColumn("a", F.sum("a").over(run)).withColumn("b", F.sum("b").over(run))
    last = enough.groupBy(key).agg(F.coalesce(F.min(F.when((F.col("a") >= half) & (F.col("b") >= half), F.col("round"))), F.max("round")).alias("last"))
    place = Window.partitionBy(key, own).orderBy("round", "rep")
    return rounds.join(last, key).where("round <= last").withColumn("r", F.row_number().over(place)).where(F.col("r") <= half).drop("r", "last")


def class_balanced(rounds: DataFrame, key: str, n: int, label: str = "label") -> DataFrame:
    """As many rows of every class that an instance's rounds show, n over their number each, of the first rounds that hold enough.

    ``rounds`` holds rows (key, round, rep, label) of all rounds; where a class
    never gets enough rows, all rounds are used and it keeps what it has.
    """
    classes = rounds.select(key, label).distinct()
    share = classes.groupBy(key).agg(F.floor(n / F.count("*")).alias("share"))
    per = rounds.groupBy(key, label, "round").agg(F.count("*").alias("c"))
    enough = per.withColumn("c", F.sum("c").over(Window.partitionBy(key, label).orderBy("round"))).join(share, key)
    first = enough.groupBy(key, label).agg(F.min(F.when(F.col("c") >= F.col("share"), F.col("round"))).alias("at"), F.max("round").alias("end"))
    last = first.groupBy(key).agg(F.when(F.count("at") == F.count("*"), F.max("at")).otherwise(F.max("end")).alias("last"))
    place = Window.partitionBy(key, label).orderBy("round", "rep")
    return rounds.join(last, key).join(share, key).where("round <= last").withColumn("r", F.row_number().over(place)).where("r <= share").drop("r", "last", "share")


def clustered_perturb(instances: DataFrame, cluster_scales: DataFrame, key: str, cluster: str, columns: list[str], n: int, seed: int = 1) -> DataFrame:
    """Perturb with the scales of the row's cluster: (cluster, scale_columns...)."""
    rows = repeated(instances.join(cluster_scales, cluster), n)
    return rows.select(key, cluster, "rep", *[F.when(F.col("rep") == 0, F.col(c).cast("double")).otherwise(F.col(c) + F.col(f"scale_{c}") * normal(seed, F.col(key), F.col("rep"), i)).alias(c) for i, c in enumerate(columns)])


def cumulative(frequencies: DataFrame) -> DataFrame:
    """(feature, value, lo, hi): the stretch of (0, 1] that draws each value."""
    run = Window.partitionBy("feature").orderBy("value")
    return frequencies.withColumn("hi", F.sum("share").over(run)).select("feature", "value", (F.col("hi") - F.col("share")).alias("lo"), "hi")


def lookup_map(stretches: DataFrame) -> DataFrame:
    """One row: feature -> its stretches in order."""
    lists = stretches.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("hi", "value"))).alias("s"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("feature", "s"))).alias("draw_of"))


def drawn_value(u: Column, feature: str) -> Column:
    s = F.col("draw_of")[F.lit(feature)]
    return F.coalesce(F.filter(s, lambda e: e["hi"] >= u)[0]["value"], F.element_at(s, -1)["value"])


def lime_sample(instances: DataFrame, stats: DataFrame, frequencies: DataFrame, key: str, numeric: list[str], categorical: list[str], n: int, around: bool = False, seed: int = 1) -> DataFrame:
    """(key, rep, numeric..., categorical..., same_categorical...): normals around the mean or the row; categories by frequency."""
    rows = repeated(spread(instances.select(key, *numeric, *categorical), key), n).join(F.broadcast(stats)).join(F.broadcast(lookup_map(cumulative(frequencies))))
    original = F.col("rep") == 0
    out = [F.when(original, F.col(c).cast("double")).otherwise((F.col(c) if around else F.col(f"mean_{c}")) + F.col(f"scale_{c}") * normal(seed, F.col(key), F.col("rep"), i)).alias(c) for i, c in enumerate(numeric)]
    for i, c in enumerate(categorical, len(numeric)):
        value = F.when(original, F.col(c)).otherwise(_drawn_once(uniform(seed, F.col(key), F.col("rep"), i), c))
        out += [value.alias(c), (value == F.col(c)).cast("int").alias(f"same_{c}")]
    return rows.select(key, "rep", *out)


def _drawn_once(u: Column, c: str) -> Column:
    """The draw is bound, or it would be worked out for every category anew."""
    return bound(u, lambda x: drawn_value(x, c))


def proximity_shares(bins: DataFrame) -> DataFrame:
    """(feature, bin, other, lo, hi): shares by exp(-|bin - other| / 2) for each bin of a feature with ``n_bins``."""
    grid = bins.select("feature", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"), "n_bins").select("feature", "bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("other"))
    weight = F.exp(-0.5 * F.abs(F.col("bin") - F.col("other")))
    share = grid.withColumn("share", weight / F.sum(weight).over(Window.partitionBy("feature", "bin")))
    run = Window.partitionBy("feature", "bin").orderBy("other")
    return share.withColumn("hi", F.sum("share").over(run)).select("feature", "bin", "other", (F.col("hi") - F.col("share")).alias("lo"), "hi")


def proximity_sample(instances: DataFrame, shares: DataFrame, key: str, columns: list[str], n: int, seed: int = 1) -> DataFrame:
    """(key, rep, feature, bin): bins drawn near the instance's own."""
    long = repeated(instances.select(key, *[F.col(c).cast("int").alias(c) for c in columns]), n).unpivot([key, "rep"], columns, "feature", "own")
    place = F.when(F.col("feature") == columns[0], 0)
    for i, c in enumerate(columns[1:], 1):
        place = place.when(F.col("feature") == c, i)
    lists = shares.groupBy("feature", F.col("bin").alias("own")).agg(F.array_sort(F.collect_list(F.struct("hi", "other"))).alias("s"))
    u = long.join(F.broadcast(lists), ["feature", "own"]).withColumn("u", uniform(seed, F.col(key), F.col("rep"), place))
    pick = bound(F.col("u"), lambda u: F.coalesce(F.filter("s", lambda e: e["hi"] >= u)[0]["other"], F.element_at("s", -1)["other"]))
    return u.select(key, "rep", "feature", F.when(F.col("rep") == 0, F.col("own")).otherwise(pick).alias("bin"))


def lhs_sample(instances: DataFrame, stats: DataFrame, key: str, columns: list[str], n: int, seed: int = 1) -> DataFrame:
    """Latin hypercube: per instance and feature each of n strata is used once, in keyed order.

    An instance's strata are sorted within its own row, so the n rows are neither shuffled nor sorted.
    """

    def mixed(keys: np.ndarray, i: int, seed: int) -> np.ndarray:
        return (keys % MODULUS)[:, None] * 16807 + np.arange(1, n + 1) * 7919 + (i * 104729 + seed * 31 + 1)

    def strata(i: int):
        @F.pandas_udf(StructType([StructField("s", ArrayType(IntegerType())), StructField("z", ArrayType(DoubleType()))]))
        def of(keys: pd.Series) -> pd.DataFrame:
            keys = keys.to_numpy("int64")
            place = np.argsort(np.argsort(codes_of(mixed(keys, i, seed)), axis=1, kind="stable"), axis=1).astype("int32")
            z = normal_quantiles((place + (codes_of(mixed(keys, i, seed + 1)) + 0.5) / float(MODULUS)) / n)
            return pd.DataFrame({"s": list(place), "z": list(z)})

        return of(F.col(key).cast("bigint")).alias(f"r_{i}")

    p = len(columns)
    known = spread(instances.select(key), key).where(F.col(key).isNotNull()).select(key, *[strata(i) for i in range(p)])
    rows = known.select(key, F.inline(F.arrays_zip(F.sequence(F.lit(1), F.lit(n)), *[F.col(f"r_{i}.{x}") for x in "sz" for i in range(p)])).alias("rep", *[f"stratum_{c}" for c in columns], *[f"r_z{i}" for i in range(p)]))
    return rows.join(F.broadcast(stats)).select(key, "rep", *[f"stratum_{c}" for c in columns], *[(F.col(f"mean_{c}") + F.col(f"scale_{c}") * F.col(f"r_z{i}")).alias(c) for i, c in enumerate(columns)])


def marginal_sample(df: DataFrame, key: str, numeric: list[str], categorical: list[str], n: int, seed: int = 1) -> DataFrame:
    """(rep, columns...): categories uniform over their values, numbers normal, whole ones cut."""
    stats = stats_row(df, numeric)
    values = df.agg(*[F.array_sort(F.collect_set(c)).alias(f"values_{c}") for c in categorical])
    draws = df.sparkSession.range(n).withColumnRenamed("id", "rep").join(F.broadcast(stats)).join(F.broadcast(values))
    out = []
    for i, c in enumerate(numeric):
        x = F.col(f"mean_{c}") + F.col(f"scale_{c}") * normal(seed, F.col("rep"), 0, i)
        out.append((F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double") if "int" in dict(df.dtypes)[c] else x).alias(c))
    for i, c in enumerate(categorical, len(numeric)):
        a = F.col(f"values_{c}")
        out.append(F.element_at(a, (F.floor(uniform(seed, F.col("rep"), 0, i) * F.size(a)) + 1).cast("int")).alias(c))
    return draws.select("rep", *out)


NEAR_BLOCK = 8192
EVOLVED = 16_384  # rows that evolve side by side


def closest_rows(df: DataFrame, instances: DataFrame, key: str, columns: list[str], label: str, k: int = 100, diff_ratio: float = 0.1, block: int = NEAR_BLOCK) -> DataFrame:
    """(instance_id, key, label, distance): the k nearest rows; if a class has too small a share, its nearest replace the last ones.

    Places, with as many rows of each class as can be among the nearest, and places
    asked for are dealt out in blocks of a fixed size; each pair of
    blocks leaves the k nearest, and the nearest of each class, of its instances.
    """
    extra = int(k * diff_ratio)
    scale = stats_row(df, columns).first()
    width = np.array([float(scale[f"scale_{c}"] or 1.0) for c in columns])
    z = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(key).alias("r_id"), F.col(label).cast("string").alias("r_label"), z.alias("z"))
    # of rows at one place and of one class only the first can be among the nearest: further ones come after them
    same = Window.partitionBy("z", "r_label").orderBy("r_id")
    rows = stored(rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= max(k, extra, 1)).drop("r"))
    # instances at one place have the same nearest rows, which are sought once
    own = stored(instances.select(F.col(key).alias("instance_id"), z.alias("z")))
    asked = stored(own.groupBy("z").agg(F.count("*").alias("r_n")).select(F.monotonically_increasing_id().alias("r_id"), "z"))
    parts = {"row": -(-rows.count() // block) or 1, "ask": -(-asked.count() // block) or 1}

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        return d.withColumn(own, F.pmod(F.xxhash64("r_id"), F.lit(parts[own]))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[other] - 1).cast("long")))).groupBy("row", "ask")

    def search(queries: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(near):
            x, ids, labels = np.stack(near.z.to_list()), near.r_id.to_numpy(), near.r_label.to_numpy()
            by_class = [np.flatnonzero(near.r_label.isna().to_numpy() if c is None else labels == c) for c in near.r_label.where(near.r_label.notna(), None).unique()]
            for i, q in zip(queries.r_id, queries.z, strict=True):
                d = np.sqrt(np.square((x - q) / width).sum(1))  # differences first: rows as far apart have the same distance to the last digit
                order = lambda at: at[np.lexsort((ids[at], d[at]))]  # noqa: B023, E731
                cut = lambda at, m: order(at[d[at] <= np.partition(d[at], m - 1)[m - 1]])[:m] if len(at) > m > 0 else order(at)[:m]  # noqa: B023, E731
                best = np.unique(np.concatenate([cut(np.arange(len(d)), k), *(cut(at, extra) for at in by_class)]))
                found.append(pd.DataFrame({"r_ask": i, "r_id": ids[best], "r_label": labels[best], "distance": d[best]}))
        return pd.concat(found) if found else pd.DataFrame({"r_ask": [], "r_id": [], "r_label": [], "distance": []})

    kind = rows.schema["r_id"].dataType.simpleString()
    pairs = dealt(asked, "ask", "row").cogroup(dealt(rows, "row", "ask")).applyInPandas(search, f"r_ask long, r_id {kind}, r_label string, distance double")
    pairs = pairs.select("r_ask", F.col("r_id").alias(key), F.col("r_label").alias(label), "distance")
    order = ("distance", key)
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("r_ask").orderBy(*order))).withColumn("rc", F.row_number().over(Window.partitionBy("r_ask", label).orderBy(*order))).where((F.col("r") <= k) | (F.col("rc") <= extra))
    share = ranked.where(F.col("r") <= k).groupBy("r_ask", label).agg(F.count("*").alias("n"))
    every = ranked.select("r_ask", label).distinct().join(share, ["r_ask", label], "left").where(F.coalesce("n", F.lit(0)) < extra).groupBy("r_ask").agg(F.min(label).alias("rare"))
    joined = ranked.join(every, "r_ask", "left")
    near = F.col("r") <= F.when(F.col("rare").isNull(), k).otherwise(k - extra)
    found = joined.where(near | ((F.col(label) == F.col("rare")) & (F.col("rc") <= extra))).select("r_ask", key, label, "distance")
    return own.join(asked.withColumnRenamed("r_id", "r_ask"), "z").join(found, "r_ask").select("instance_id", key, label, "distance")


def genetic_neighbourhood(instances: DataFrame, predict, key: str, columns: list[str], scales: dict[str, float], population: int = 200, generations: int = 10, eta: float = 2.0, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """(key, rep, columns..., fitness): per instance, evolution of rows that are near and keep, or leave, its class.

    ``predict`` takes a numpy matrix and gives labels.  Tournament of three, two-point crossover, mutation
    0.2; those above the largest gap in fitness are kept.  ``predict`` labels each row of the matrix by itself: the
    instances of a batch evolve side by side, each by its own draws.
    """
    width, p, half = np.array([scales[c] for c in columns]), len(columns), generations + 1

    def drawn(k: int) -> list[np.ndarray]:
        """All draws of an instance, which don't depend on its rows, in the order of its generations."""
        rng, out = np.random.default_rng(abs(hash((seed, k))) % (1 << 32)), []
        for _ in range(2):
            out.append([rng.normal(size=(population, p))])
            for _ in range(generations):
                out.append([rng.integers(0, population, (population, 3)), rng.permutation(population), rng.integers(0, p + 1, (population, 2)), rng.random((population, 1)), rng.random((population, p)), rng.normal(size=(population, p))])
        return out

    def evolve(ids: np.ndarray, x0: np.ndarray) -> pd.DataFrame:
        b, every = len(ids), np.arange(len(ids))[:, None]
        draws = [[np.stack(x) for x in zip(*of, strict=True)] for of in zip(*map(drawn, ids.tolist()), strict=True)]
        own, at = np.asarray(predict(x0))[:, None], x0[:, None]
        rows_of, fitness_of, kept = [], [], []
        for side, keep in enumerate((True, False)):
            (first,), *later = draws[side * half : (side + 1) * half]
            rows = at + width * first

            def fitness(z, keep=keep):
                d = np.sqrt((((z - at) / width) ** 2).mean(2))
                near = np.where(d >= eta, 0.0, 1 - d / eta)
                return alpha * np.where(d > 0, near, 0.0) + alpha * ((np.asarray(predict(z.reshape(-1, p))).reshape(b, population) == own) == keep)

            for rivals, order, cut, mate, change, more in later:
                f = fitness(rows)
                best = f[every[:, :, None], rivals].argmax(2)[:, :, None]
                parents = rows[every, np.take_along_axis(rivals, best, 2)[:, :, 0]]
                mates = parents[every, order]
                cut = np.sort(cut, axis=2)
                between = (np.arange(p) >= cut[:, :, :1]) & (np.arange(p) < cut[:, :, 1:])
                rows = np.where(between & (mate < 0.5), mates, parents)
                rows = np.where(change < 0.2, rows + width * more, rows)
            f = fitness(rows)
            order = np.argsort(-f, axis=1, kind="stable")
            f = np.take_along_axis(f, order, 1)
            gap = np.argmax(-np.diff(f, axis=1), axis=1) + 1 if population > 1 else np.ones(b, int)
            rows_of.append(rows[every, order])
            fitness_of.append(f)
            kept.append(np.arange(population) < gap[:, None])
        kept = np.concatenate(kept, 1)
        m, n = np.concatenate(rows_of, 1)[kept], kept.sum(1)
        rep = np.arange(1, len(m) + 1) - np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame({key: np.repeat(ids, n), "rep": rep, **{c: m[:, i] for i, c in enumerate(columns)}, "fitness": np.concatenate(fitness_of, 1)[kept]})

    def run(batches):
        together = max(1, EVOLVED // population)
        for batch in batches:
            ids, x0 = np.array([int(k) for k in batch[key]], "int64"), batch[columns].to_numpy(float)
            for a in range(0, len(ids), together):
                yield evolve(ids[a : a + together], x0[a : a + together])

    once = spread(instances.select(key, *columns), key).dropDuplicates([key])
    return once.mapInPandas(run, f"{key} long, rep long, " + ", ".join(f"{c} double" for c in columns) + ", fitness double")


def fitness_gap(scored: DataFrame, key: str, fitness: str = "fitness") -> DataFrame:
    """(key, cut): the lowest fitness above the largest gap of each group."""
    ahead = F.lead(fitness).over(Window.partitionBy(key).orderBy(F.desc(fitness)))
    gaps = scored.withColumn("gap", F.col(fitness) - ahead).where("gap is not null")
    return gaps.groupBy(key).agg(F.max_by(fitness, F.struct("gap", fitness)).alias("cut"))


def oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Minority rows are repeated up to the largest class: ``copy`` counts from 0."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("most"))
    ranked = numbered(df, [key], "r", (label,)).join(counts, label).join(F.broadcast(top))
    copies = F.floor(F.col("most") / F.col("n")) + F.when(F.col("r") < F.col("most") % F.col("n"), 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1))).drop("r", "n", "most")


def conditional_sample(data: DataFrame, key: str, column: str, lo: float, hi: float, n: int, seed: int = 1) -> DataFrame:
    """(rep, key, value): bootstrap rows; a value outside (lo, hi] is drawn anew from rows inside, else uniformly from the range."""
    rows = data.select(F.col(key), F.col(column).cast("double").alias("v"))
    placed = numbered(rows.withColumn("code", draw_code(seed, F.col(key))), ["code", key], "i").drop("code")
    inside = rows.where((F.col("v") > lo) & (F.col("v") <= hi)).withColumn("code", draw_code(seed + 1, F.col(key)))
    inside = numbered(inside, ["code", key], "j").select("j", F.col("v").alias("w"))
    sizes = rows.agg(F.count("*").alias("n_all"), F.count_if((F.col("v") > lo) & (F.col("v") <= hi)).alias("n_in"))
    picks = data.sparkSession.range(n).withColumnRenamed("id", "rep").join(F.broadcast(sizes))
    picks = picks.withColumn("i", F.floor(uniform(seed + 2, F.col("rep")) * F.col("n_all"))).withColumn("j", F.floor(uniform(seed + 3, F.col("rep")) * F.greatest("n_in", F.lit(1))))
    joined = picks.join(placed, "i").join(inside, "j", "left")
    redraw = F.coalesce("w", F.lit(lo) + uniform(seed + 4, F.col("rep")) * (hi - lo))
    return joined.select("rep", key, F.when((F.col("v") > lo) & (F.col("v") <= hi), F.col("v")).otherwise(redraw).alias("value"))


def noise_pairs(df: DataFrame, key: str, columns: list[str], std: float = 0.3, multiplier: int = 1, seed: int = 1) -> DataFrame:
    """Real rows labelled 1 and noised copies labelled 0."""
    real = df.select(key, F.lit(0).alias("rep"), *[F.col(c).cast("double").alias(c) for c in columns], F.lit(1).alias("label"))
    copies = repeated(df.select(key, *columns), multiplier).where("rep > 0")
    noised = copies.select(key, "rep", *[(F.col(c) + std * normal(seed, F.col(key), F.col("rep"), i)).alias(c) for i, c in enumerate(columns)], F.lit(0).alias("label"))
    return real.unionByName(noised)


def substitution_set(df: DataFrame, background: DataFrame, key: str, columns: list[str], seed: int = 1) -> DataFrame:
    """(key, columns..., label): each feature is replaced from a keyed background row with chance 1/2; label 1 if the result is a real row.

    ``background`` has bg_id 0 .. m-1 and is to be small.
    """
    lists = small(background, "a background").agg(F.count("*").alias("m"), *[F.transform(F.array_sort(F.collect_list(F.struct("bg_id", F.col(c).alias("v")))), lambda s: s["v"]).alias(f"bg_{c}") for c in columns])
    rows = df.select(key, *columns).join(F.broadcast(lists))
    pick = (F.floor(uniform(seed, F.col(key), 1) * F.col("m")) + 1).cast("int")
    mixed = rows.select(key, *[F.when(uniform(seed, F.col(key), 2, i) < 0.5, F.element_at(f"bg_{c}", pick)).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)])
    real = df.select(*columns).distinct().withColumn("real", F.lit(1))
    return mixed.join(real, columns, "left").select(key, *columns, F.coalesce("real", F.lit(0)).alias("label"))


def permutation_pairs(df: DataFrame, background: DataFrame, key: str, columns: list[str], multiplier: int = 1, seed: int = 1) -> DataFrame:
    """(key, rep, feature, on_columns..., off_columns...): a keyed order of features; those after a keyed feature come from another row, with and without that feature."""
    lists = small(background, "a background").agg(F.count("*").alias("m"), *[F.transform(F.array_sort(F.collect_list(F.struct("bg_id", F.col(c).alias("v")))), lambda s: s["v"]).alias(f"bg_{c}") for c in columns])
    rows = repeated(df.select(key, *columns), multiplier).where("rep > 0").join(F.broadcast(lists))
    code = [draw_code(seed, F.col(key), F.col("rep"), i) for i in range(len(columns))]
    chosen = F.floor(uniform(seed + 1, F.col(key), F.col("rep")) * len(columns)).cast("int")
    pick = (F.floor(uniform(seed + 2, F.col(key), F.col("rep")) * F.col("m")) + 1).cast("int")
    rows = rows.withColumn("chosen", chosen).withColumn("codes", F.array(*code)).withColumn("mine", F.element_at("codes", F.col("chosen") + 1))
    on = [F.when((F.col("codes")[i] > F.col("mine")), F.element_at(f"bg_{c}", pick)).otherwise(F.col(c)).alias(f"on_{c}") for i, c in enumerate(columns)]
    off = [F.when(F.col("codes")[i] >= F.col("mine"), F.element_at(f"bg_{c}", pick)).otherwise(F.col(c)).alias(f"off_{c}") for i, c in enumerate(columns)]
    return rows.select(key, "rep", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("chosen") + 1).alias("feature"), *on, *off)


def simulate(ids: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """(key, a, b, z, y): for each id a point of one of two gaussian clusters z, and a polynomial class rule y."""
    r = ids.select(key).withColumn("z", (uniform(seed, F.col(key)) < 0.5).cast("int") + 1)
    shift = F.when(F.col("z") == 1, -1.5).otherwise(1.5)
    rows = r.select(key, (shift + normal(seed + 1, F.col(key))).alias("a"), (shift * 0.5 + normal(seed + 3, F.col(key))).alias("b"), "z")
    return rows.withColumn("y", polynomial_rule(F.col("a"), F.col("b")))


def polynomial_rule(a: Column, b: Column) -> Column:
    return (a * a - a * b + b > 1).cast("int")


