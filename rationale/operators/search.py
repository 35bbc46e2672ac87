"""Counterfactuals by a bounded search with trust regions, all rows in lockstep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rationale.functions.draws import uniform
from rationale.functions.small import beside
from rationale.functions.spread import spread
from rationale.sources.scratch import stored

from .score import score

SHORTER = 4  # radii that are tried in one round, each half of the one before


def search_counterfactuals(instances: DataFrame, bounds: DataFrame, model, key: str, features: list[str], target: str | Column, starts: int = 8, most_draws: int = 1000, tolerance: float = 1e-3, price: float = 1e6, seed: int = 1) -> DataFrame:
    """(key, cf_<feature>..., distance, starts): of each row, the nearest values found that the model gives the target class.

    Least squares: ``price`` times the squared miss of the target (0 or 1) and, by
    feature, the squared change in units of its range.  ``bounds`` is one row with
    lo_<feature> and hi_<feature>, within which all values stay; ``target`` is a class
    or a column of ``instances``.

    A row starts from keyed draws within the bounds; those of the target class go on.
    Rows without one draw twice as many again, ``most_draws`` in all.
    In each round a point tries steps towards the row itself, in all features and in
    single ones, as long as its radius, a half, a quarter and an eighth of it.  The
    best that lowers the cost is taken and the radius doubles; if none does, the
    radius is a sixteenth.  A point is done when steps down to ``tolerance`` (of a
    range) have been tried in vain.  One scoring call
    serves the points of all rows that are still open.

    ``starts`` counts a row's points of the target class; rows without one have nulls.
    A row that has the target class itself, within the bounds, is its own answer if the
    search gets there.  Null features or a null target: nulls.  Ids must be unique.
    """
    ends = bounds.select(*[F.col(f"{e}_{f}").cast("double").alias(f"{e}_{f}") for f in features for e in ("lo", "hi")])
    width = {f: F.col(f"hi_{f}") - F.col(f"lo_{f}") for f in features}
    aim = (F.lit(target) if isinstance(target, str) else target).cast("string").alias("aim")
    unit = lambda f: F.when(width[f] > 0, (F.col(f).cast("double") - F.col(f"lo_{f}")) / width[f]).otherwise(0.0)
    value = lambda f, u: F.least(F.col(f"lo_{f}") + u * width[f], F.col(f"hi_{f}"))
    own = instances.select(F.col(key).alias("r_id"), aim, *[F.col(f) for f in features]).dropna().join(F.broadcast(ends))
    own = own.select("r_id", "aim", F.array(*[unit(f) for f in features]).alias("x0"))

    def costed(points: DataFrame) -> DataFrame:
        """Points of the unit cube with ``cost``."""
        at = points.join(F.broadcast(ends)).withColumns({f: value(f, F.col("x")[i]) for i, f in enumerate(features)})
        scored = score(at, model, "r_label", features)
        far = F.aggregate(F.zip_with("x", "x0", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        miss = F.when(F.col("r_label").cast("string") == F.col("aim"), 0.0).otherwise(1.0)
        return scored.withColumn("cost", price * miss + far).select(*points.columns, "cost")

    open_, left, drawn = None, spread(own, "r_id"), 0
    while open_ is None or drawn < most_draws and not left.isEmpty():
        more = min(drawn + starts if open_ is None else 2 * drawn + starts, most_draws)
        begun = left.withColumn("start", F.explode(F.sequence(F.lit(drawn + 1), F.lit(more))))
        begun = begun.withColumn("x", F.array(*[uniform(seed, F.xxhash64("r_id"), F.col("start"), i) for i in range(len(features))]))
        hits = stored(costed(begun).where(F.col("cost") < price).withColumn("radius", F.lit(0.5)))
        open_, drawn = hits if open_ is None else open_.unionByName(hits), more
        left = stored(left.join(beside(hits.select("r_id").distinct()), "r_id", "left_anti"))
    done = open_.where("radius < 0")
    gap = F.zip_with("x0", "x", lambda a, b: F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)) - b)
    span = F.sqrt(F.aggregate("gap", F.lit(0.0), lambda a, b: a + b * b))

    def toward(which: int, share: float) -> Column:
        """A step as long as the share of the radius, in all features (0) or one, and not beyond the row."""
        long = F.col("radius") * share
        if which == 0:
            return F.transform("gap", lambda g: g * F.least(F.lit(1.0), long / F.greatest("span", F.lit(1e-300))))
        return F.transform("gap", lambda g, i: F.when(i == which - 1, F.signum(g) * F.least(F.abs(g), long)).otherwise(0.0))

    steps = F.array(*[toward(w, 0.5**h) for w in range(len(features) + 1) for h in range(SHORTER)])
    point = ["r_id", "start", "aim", "x0", "radius", "was", "x_was"]
    while not open_.isEmpty():
        # dealt out by row, the steps of a point stay in its task; their costs are numbers side by side, so they are hashed and neither shuffled nor sorted
        tried = spread(open_.withColumnRenamed("cost", "was").withColumnRenamed("x", "x_was"), "r_id").withColumn("x", F.col("x_was")).withColumn("gap", gap).withColumn("span", span)
        tried = tried.select(*point, F.posexplode(steps).alias("n", "step")).select(*point, "n", F.zip_with("x_was", "step", lambda a, b: a + b).alias("x"))
        each = range(SHORTER * (len(features) + 1))
        best = costed(tried).groupBy(*point).agg(*[F.max(F.when(F.col("n") == n, F.col("cost"))).alias(f"cost_{n}") for n in each])
        best = best.select(*point, F.least(*[F.struct(F.col(f"cost_{n}").alias("cost"), F.lit(n).alias("n")) for n in each]).alias("m"), F.col("x_was").alias("x"))
        step = steps[F.col("m.n")]
        best = best.withColumn("gap", gap).withColumn("span", span).select(*point, F.struct("m.cost", F.zip_with("x_was", step, lambda a, b: a + b).alias("x")).alias("m"))
        better = F.col("m.cost") < F.col("was") - 1e-15
        moved = best.select("r_id", "aim", "x0", "start", F.when(better, F.col("m.x")).otherwise(F.col("x_was")).alias("x"), F.when(better, F.col("m.cost")).otherwise(F.col("was")).alias("cost"), F.when(better, F.least(F.lit(0.5), 2 * F.col("radius"))).otherwise(F.col("radius") / 2**SHORTER).alias("radius"))
        moved = stored(moved)
        done = done.unionByName(moved.where(F.col("radius") <= tolerance / 2))
        open_ = moved.where(F.col("radius") > tolerance / 2)
    nearest = spread(done.select("r_id", "cost", "start", "x"), "r_id").groupBy("r_id").agg(F.min(F.struct("cost", "start", "x")).alias("m"), F.count("*").alias("starts")).join(F.broadcast(ends))
    found = nearest.select(F.col("r_id").alias(key), *[value(f, F.col("m.x")[i]).alias(f"cf_{f}") for i, f in enumerate(features)], F.sqrt("m.cost").alias("distance"), "starts")
    return instances.select(key).join(found, key, "left").select(key, *[f"cf_{f}" for f in features], "distance", F.coalesce("starts", F.lit(0)).alias("starts"))
