"""Encoding, bins and baskets of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rationale.functions.order import numbered, percentiles, running
from rationale.sources.scratch import stored

from .profile import long_form


# Encoding -------------------------------------------------------------------
def one_hot(df: DataFrame, spec: dict[str, list]) -> DataFrame:
    """Columns ``f=v`` with 0 or 1; values that the spec doesn't name are all 0."""
    hot = [F.coalesce((F.col(f) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{f}={v}") for f, values in spec.items() for v in values]
    return df.select(*[c for c in df.columns if c not in spec], *hot)


def ordinal(df: DataFrame, spec: dict[str, list]) -> DataFrame:
    """Place of each value in its list, null if absent."""
    place = lambda f, values: F.when(F.col(f).isin(values), F.array_position(F.array(*[F.lit(v) for v in values]), F.col(f)) - 1)
    return df.withColumns({f: place(f, values) for f, values in spec.items()})


def decoded_category(columns: list[str], values: list) -> Column:
    """The value whose one-hot is largest; the first wins a tie."""
    a = F.array(*[F.col(f"`{c}`") for c in columns])
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.array_position(a, F.array_max(a)).cast("int"))


def decode(df: DataFrame, spec: dict[str, list]) -> DataFrame:
    hot = {f: [f"{f}={v}" for v in values] for f, values in spec.items()}
    gone = {c for columns in hot.values() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone], *[decoded_category(hot[f], values).alias(f) for f, values in spec.items()])


def nearest_allowed(x: Column, values: list[float]) -> Column:
    """The allowed value nearest to x; the first wins a tie."""
    pairs = F.array(*[F.struct(F.abs(x - F.lit(float(v))).alias("d"), F.lit(i).alias("ord"), F.lit(float(v)).alias("v")) for i, v in enumerate(values)])
    return F.array_min(pairs)["v"]


def rescale_categorical(df: DataFrame, spec: dict[str, list]) -> DataFrame:
    """One-hots become column means; the active one its mean plus the others' sum over the number of values."""
    hot = {f: [f"{f}={v}" for v in values] for f, values in spec.items()}
    every = [c for columns in hot.values() for c in columns]
    means = df.agg(*[F.avg(f"`{c}`").alias(f"mean {c}") for c in every])
    out = {}
    for columns in hot.values():
        total = sum((F.col(f"`mean {c}`") for c in columns), F.lit(0.0))
        for c in columns:
            m = F.col(f"`mean {c}`")
            out[c] = F.when(F.col(f"`{c}`") == 1, m + (total - m) / len(columns)).otherwise(m)
    return df.join(F.broadcast(means)).withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns])


# Bins -----------------------------------------------------------------------
def quantile_edges(df: DataFrame, columns: list[str], shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., feature, edges): exact percentiles, equal ones once; features without values have none."""
    found = percentiles(long_form(df, columns, by), "value", shares, (*by, "feature"))
    return found.select(*by, "feature", F.array_distinct("percentiles").alias("edges"))


def quartile_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    return quantile_edges(df, columns, [0.25, 0.5, 0.75])


def decile_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    return quantile_edges(df, columns, [i / 10 for i in range(1, 10)])


def kbins(df: DataFrame, columns: list[str], n_bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Inner edges of n quantile bins."""
    return quantile_edges(df, columns, [i / n_bins for i in range(1, n_bins)], by)


def stats_bins(edges: dict[str, list[float]], df: DataFrame) -> DataFrame:
    """Edges that are given, as a table."""
    return df.sparkSession.createDataFrame([(f, sorted(set(map(float, e)))) for f, e in edges.items()], "feature string, edges array<double>")


def entropy_bins(df: DataFrame, columns: list[str], label: str, max_depth: int = 3) -> DataFrame:
    """(feature, edges): cuts that lower class entropy most, ``max_depth`` levels deep; the median if there is none.

    Values are counted by (feature, value, class) first; each level is one
    prefix sum inside the nodes, over ranges of values, and one best cut a node.
    """
    counts = df.select(F.col(label).alias("y"), *columns).transform(lambda d: long_form(d, columns, ("y",))).where("value is not null").groupBy("feature", "value", "y").agg(F.count("*").alias("n"))
    nodes, cuts = stored(counts.withColumn("node", F.lit(1))), None
    for _ in range(max_depth):
        every = nodes.select("feature", "node", "value").distinct()
        grid = every.join(nodes.select("feature", "node", "y").distinct(), ["feature", "node"]).join(nodes, ["feature", "node", "value", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        whole = nodes.groupBy("feature", "node", "y").agg(F.sum("n").alias("all"))
        sums = running(grid, ["value"], {"left": F.col("n")}, ("feature", "node", "y")).join(whole, ["feature", "node", "y"])
        per = sums.groupBy("feature", "node", "value").agg(F.sum("left").alias("nl"), F.sum("all").alias("na"), F.sum(_nlogn("left")).alias("sl"), F.sum(_nlogn(F.col("all") - F.col("left"))).alias("sr"), F.sum(_nlogn("all")).alias("sa"))
        nr = F.col("na") - F.col("nl")
        gain = (_nlogn("na") - F.col("sa")) - (_nlogn("nl") - F.col("sl")) - (_nlogn(nr) - F.col("sr"))
        placed = numbered(per.withColumn("gain", gain), ["value"], "i", ("feature", "node"))
        after = placed.select("feature", "node", (F.col("i") - 1).alias("i"), F.col("value").alias("next"))
        scored = placed.where("gain > 1e-9").join(after, ["feature", "node", "i"])
        best = scored.groupBy("feature", "node").agg(F.max_by(F.struct("value", "next"), F.struct("gain", F.expr("-value"))).alias("b")).select("feature", "node", ((F.col("b.value") + F.col("b.next")) / 2).alias("cut"))
        best = stored(best)
        cuts = best if cuts is None else cuts.union(best)
        nodes = stored(nodes.join(best, ["feature", "node"]).withColumn("node", F.col("node") * 2 + (F.col("value") > F.col("cut")).cast("int")).drop("cut"))
    medians = quantile_edges(df, columns, [0.5])
    found = cuts.groupBy("feature").agg(F.array_sort(F.collect_set("cut")).alias("found"))
    return medians.join(found, "feature", "left").select("feature", F.coalesce("found", "edges").alias("edges"))


def _nlogn(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def bin_of(x: Column, edges: Column) -> Column:
    """Number of edges below x: bins are open to the left and closed to the right."""
    return F.size(F.filter(edges, lambda e: e < x))


def edges_map(bins: DataFrame) -> DataFrame:
    """All edges as one row with a map by feature; as small as the list of features."""
    return bins.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("edges_of"))


def discretize(df: DataFrame, bins: DataFrame, columns: list[str]) -> DataFrame:
    """Values become bin numbers."""
    return df.join(F.broadcast(edges_map(bins))).withColumns({c: bin_of(F.col(c), F.col("edges_of")[F.lit(c)]) for c in columns}).drop("edges_of")


def bin_names(bins: DataFrame) -> DataFrame:
    """(feature, bin, name) with two decimals."""
    b = bins.select("feature", "edges", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    lo = F.when(F.col("bin") > 0, F.element_at("edges", F.greatest(F.col("bin"), F.lit(1))))
    hi = F.when(F.col("bin") < F.size("edges"), F.element_at("edges", F.least(F.col("bin") + 1, F.size("edges"))))
    name = F.when(F.col("bin") == 0, F.format_string("%s <= %.2f", "feature", hi)).when(F.col("bin") == F.size("edges"), F.format_string("%s > %.2f", "feature", lo)).otherwise(F.format_string("%.2f < %s <= %.2f", lo, "feature", hi))
    return b.select("feature", "bin", name.alias("name"))


def bin_bounds(bins: DataFrame) -> DataFrame:
    """(feature, bin, lo, hi): null where a bin is open."""
    b = bins.select("feature", "edges", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    return b.select("feature", "bin", F.when(F.col("bin") > 0, F.col("edges")[F.col("bin") - 1]).alias("lo"), F.when(F.col("bin") < F.size("edges"), F.col("edges")[F.col("bin")]).alias("hi"))


def bin_stats(df: DataFrame, bins: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, bin, mean, std, lo, hi): std plus 1e-11; 0 in empty bins; outer bins end at the data."""
    placed = long_form(df, columns).join(F.broadcast(bins), "feature").withColumn("bin", bin_of(F.col("value"), F.col("edges")))
    sums = placed.groupBy("feature", "bin").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    ends = placed.groupBy("feature").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    every = bin_bounds(bins).join(sums, ["feature", "bin"], "left").join(ends, "feature")
    return every.select("feature", "bin", F.coalesce("mean", F.lit(0.0)).alias("mean"), (F.coalesce("std", F.lit(0.0)) + 1e-11).alias("std"), F.coalesce("lo", "least").alias("lo"), F.coalesce("hi", "most").alias("hi"))


def bin_centres(df: DataFrame, bins: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, bin, centre): the middle of each bin, for decoding."""
    return bin_stats(df, bins, columns).select("feature", "bin", ((F.col("lo") + F.col("hi")) / 2).alias("centre"))


def undiscretize(df: DataFrame, stats: DataFrame, columns: list[str], key: str, seed: int = 5) -> DataFrame:
    """Bin numbers become draws from the bin's normal, cut off at its edges, by bisection of the normal distribution function."""
    from rationale.functions.draws import uniform
    from rationale.functions.special import truncated_normal

    long = df.select(key, *[F.col(c).cast("int").alias(c) for c in columns]).unpivot([key], columns, "feature", "bin")
    drawn = long.join(F.broadcast(stats), ["feature", "bin"]).withColumn("value", truncated_normal(uniform(seed, F.col(key), F.col("bin"), F.hash("feature")), "mean", "std", "lo", "hi"))
    return drawn.groupBy(key).pivot("feature", columns).agg(F.first("value"))


def items(columns: list[str], n_of: dict[str, int]) -> Column:
    """Item numbers of a discretised row: each feature's bins follow the last feature's."""
    starts, at = [], 0
    for c in columns:
        starts.append(at)
        at += n_of[c]
    return F.array(*[(F.col(c) + F.lit(s)).cast("int") for c, s in zip(columns, starts, strict=True)])


def with_negated(present: Column, n_encoded: int) -> Column:
    """The items, and those that are absent moved up by the number of items."""
    absent = F.array_except(F.sequence(F.lit(0), F.lit(n_encoded - 1)), present)
    return F.concat(present, F.transform(absent, lambda x: x + n_encoded))
