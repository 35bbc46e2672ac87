"""Hierarchies of features or rows: complete linkage, the order of its leaves, Owen values over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.order import numbered
from rationale.functions.small import small
from rationale.sources.scratch import stored

from .score import score

MOST_LEAVES = 62  # features of a hierarchy, as bits of a long


def complete_linkage(distances: DataFrame) -> DataFrame:
    """(step, node, left, right, height, size): clusters merged by the largest distance between their items, least first.

    ``distances`` has one row (i, j, d) for each pair of items, in either order
    (several: the largest counts).  Items keep their ids; step s from 0 makes the node
    s + the largest id + 1, and left < right.  Equal distances go by the least items
    of both clusters.

    Two clusters that are each other's nearest stay so whatever else is merged, since
    a merge never brings anything closer; so all such pairs merge in one round, and
    the order of their heights is that of merging one by one.  A round is a few
    aggregates over the pairs that are left.
    """
    pairs = distances.where("i <> j").select(F.least("i", "j").cast("long").alias("a"), F.greatest("i", "j").cast("long").alias("b"), F.col("d").cast("double").alias("d"))
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("d").alias("d"), F.count_if(F.col("d").isNull()).alias("nulls")))
    items = stored(pairs.select(F.col("a").alias("x")).union(pairs.select("b")).distinct())
    n, top = items.agg(F.count("*"), F.max("x")).first()
    if pairs.where("nulls = 0 and not isnan(d)").count() != n * (n - 1) // 2:
        raise ValueError("each pair of items needs a distance")
    pairs, sizes, merges = pairs.drop("nulls"), items.withColumn("n", F.lit(1).cast("long")), None
    while not pairs.isEmpty():
        nearest = F.min(F.struct("d", "a", "b")).alias("k")
        best = pairs.select(F.col("a").alias("x"), "d", "a", "b").union(pairs.select("b", "d", "a", "b")).groupBy("x").agg(nearest)
        mutual = best.groupBy("k").count().where("count = 2").select("k.*")
        of = lambda c: sizes.select(F.col("x").alias(c), F.col("n").alias(f"n_{c}"))
        found = stored(mutual.join(of("a"), "a").join(of("b"), "b").select("d", "a", "b", (F.col("n_a") + F.col("n_b")).alias("size")))
        merges = found if merges is None else merges.union(found)
        moved = found.select(F.col("b").alias("x"), F.col("a").alias("to"))
        grown = sizes.join(moved, "x", "left_anti").join(found.select(F.col("a").alias("x"), "size"), "x", "left")
        sizes = stored(grown.select("x", F.coalesce("size", "n").alias("n")))
        ends = pairs.join(moved.select(F.col("x").alias("a"), F.col("to").alias("a_to")), "a", "left").join(moved.select(F.col("x").alias("b"), F.col("to").alias("b_to")), "b", "left")
        ends = ends.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"), "d").where("a <> b")
        pairs = stored(ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d")))
    if merges is None:
        merges = pairs.select("d", "a", "b", F.lit(0).cast("long").alias("size"))
    steps = stored(numbered(merges, ["d", "a", "b"], "step").withColumn("node", F.col("step") + (top or 0) + 1))
    # a cluster goes by its least item: its last node is the last merge under that name
    earlier = steps.withColumn("own", F.lag("node").over(Window.partitionBy("a").orderBy("step")))
    absorbed = steps.groupBy(F.col("a").alias("b")).agg(F.max("node").alias("other"))
    both = earlier.join(absorbed, "b", "left").withColumns({"own": F.coalesce("own", "a"), "other": F.coalesce("other", "b")})
    return both.select("step", "node", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), F.col("d").alias("height"), "size")


def leaf_order(merges: DataFrame, distances: DataFrame) -> DataFrame:
    """(place, item): the leaves of a tree of merges, turned so that neighbours at each joint are as close as can be.

    A merge puts left before right, right before left, left reversed before right or
    left before right reversed: whichever has the closest items at the joint (ties: in
    that order).  All merges whose parts are ready are done in one round; distances as
    of ``complete_linkage``.
    """
    near = distances.select("i", "j", "d").union(distances.select("j", "i", "d")).groupBy("i", "j").agg(F.max("d").alias("d"))
    inner = merges.select("node")
    ends = merges.select(F.explode(F.array("left", "right")).alias("node"))
    ready = stored(ends.join(inner, "node", "left_anti").select("node", F.array("node").alias("items")))
    left = merges
    while not left.isEmpty():
        side = lambda c: ready.select(F.col("node").alias(c), F.col("items").alias(f"{c}_items"))
        now = stored(left.select("node", "left", "right").join(side("left"), "left").join(side("right"), "right"))
        a, b = F.col("left_items"), F.col("right_items")
        first, last = (lambda x: F.element_at(x, 1)), (lambda x: F.element_at(x, -1))
        ways = [(last(a), first(b), F.concat(a, b)), (first(a), last(b), F.concat(b, a)), (first(a), first(b), F.concat(F.reverse(a), b)), (last(a), last(b), F.concat(a, F.reverse(b)))]
        joints = now.select("node", F.explode(F.array(*[F.struct(F.lit(w).alias("way"), i.alias("i"), j.alias("j")) for w, (i, j, _) in enumerate(ways)])).alias("w")).select("node", "w.*")
        best = joints.join(near, ["i", "j"]).groupBy("node").agg(F.min(F.struct("d", "way"))["way"].alias("way"))
        order = F.coalesce(*[F.when(F.col("way") == w, x) for w, (_, _, x) in enumerate(ways)])
        joined = now.join(best, "node").select("node", order.alias("items"))
        used = now.select(F.explode(F.array("left", "right")).alias("node"))
        ready = stored(ready.join(used, "node", "left_anti").union(joined))
        left = stored(left.join(now.select("node"), "node", "left_anti"))
    return ready.select(F.posexplode("items").alias("place", "item"))


def owen_values(instances: DataFrame, background: DataFrame, key: str, features: list[str], model, hierarchy: DataFrame, tolerance: float = -1.0, weight: str | None = None) -> DataFrame:
    """(key, phi_<feature>...): Owen values over a hierarchy of features; they add up to f(x) less the background's mean.

    ``hierarchy`` has (node, left, right) of merges, features being 0, 1, ... in their
    order.  A node is opened in a context: the features outside it that are the
    instance's.  Its halves are then two players, whose marginal values with and
    without each other are two contexts of either half.  All nodes that are open, of
    all instances, are scored in one call a level.  Where a half is worth the same in
    both contexts, up to ``tolerance``, it is opened in one of them alone, for both.
    Contexts double with each level: at most 2**depth a feature.  ``key`` is unique.
    """
    p, full = len(features), (1 << len(features)) - 1
    if p > MOST_LEAVES:
        raise ValueError(f"{p} features; at most {MOST_LEAVES}")
    members = {i: 1 << i for i in range(p)}
    rows = []
    for r in hierarchy.select("node", "left", "right").orderBy("node").collect():  # one fewer than the features
        members[r.node] = members[r.left] | members[r.right]
        rows.append((r.node, r.left, r.right, members[r.left], members[r.right]))
    root = rows[-1][0] if rows else 0
    if members[root] != full:
        raise ValueError("the last node of the hierarchy must hold every feature")
    spark = instances.sparkSession
    halves = F.broadcast(spark.createDataFrame(rows, "r_node long, r_l long, r_r long, r_l_mask long, r_r_mask long"))
    n_of = F.col(weight).cast("double") if weight else F.lit(1.0)
    behind = stored(background.select(*[F.col(f).cast("double").alias(f"r_bg{i}") for i, f in enumerate(features)], n_of.alias("r_bg_weight")))
    at_background = score(behind.select(*[F.col(f"r_bg{i}").alias(f) for i, f in enumerate(features)], "r_bg_weight"), model, "r_v", features, "double").agg(F.sum(F.col("r_v") * F.col("r_bg_weight")) / F.sum("r_bg_weight")).first()[0]
    xs = [f"r_x{i}" for i in range(p)]  # names of their own, as features may have any
    at_instance = score(instances.select(F.col(key).alias("r_key"), *[F.col(f).cast("double").alias(f) for f in features]), model, "r_f11", features, "double")
    state = ["r_key", *xs, "r_context", "r_f00", "r_f11", "r_w"]
    start = {"r_node": F.lit(root).cast("long"), "r_context": F.lit(0).cast("long"), "r_f00": F.lit(at_background).cast("double"), "r_w": F.lit(1.0)}
    open_ = stored(at_instance.select("r_key", *[F.col(f).alias(x) for f, x in zip(features, xs, strict=True)], "r_f11").withColumns(start).select("r_node", *state))
    leaves = open_.where(F.col("r_node") < p)
    open_ = open_.where(F.col("r_node") >= p)
    behind = small(behind, "a background")
    carried = ["r_node", *state, "r_l", "r_r", "r_l_mask", "r_r_mask"]
    while not open_.isEmpty():
        asked = open_.join(halves, "r_node").withColumn("r_side", F.explode(F.array(F.lit(0), F.lit(1))))
        inside = F.col("r_context").bitwiseOR(F.when(F.col("r_side") == 0, F.col("r_l_mask")).otherwise(F.col("r_r_mask")))
        mixed = asked.withColumn("r_m", inside).join(behind).select(*carried, "r_side", "r_bg_weight", *[F.when(F.getbit("r_m", F.lit(i)) == 1, F.col(x)).otherwise(F.col(f"r_bg{i}")).alias(f) for i, (f, x) in enumerate(zip(features, xs, strict=True))])
        scored = score(mixed, model, "r_v", features, "double")
        mean = lambda s: F.sum(F.when(F.col("r_side") == s, F.col("r_v") * F.col("r_bg_weight"))) / F.sum(F.when(F.col("r_side") == s, F.col("r_bg_weight")))
        at = ["r_key", "r_node", "r_context"]
        values = stored(scored.groupBy(*at).agg(*[F.first(c).alias(c) for c in carried if c not in at], mean(0).alias("r_f10"), mean(1).alias("r_f01")))
        with_it, without = F.col("r_f11") - F.col("r_f01"), F.col("r_f10") - F.col("r_f00")
        both = F.abs(with_it - without) > tolerance  # the same for either half

        def child(node: str, context: Column, low: str, high: str, share: Column) -> Column:
            return F.struct(F.col(node).alias("r_node"), context.alias("r_context"), F.col(low).alias("r_f00"), F.col(high).alias("r_f11"), (F.col("r_w") * share).alias("r_w"))

        def contexts(node: str, other_mask: str, alone: str, beside: str) -> Column:
            """Without the other half first, then with it; a single feature has both, as their values are known."""
            double = both | (F.col(node) < p)
            first = child(node, F.col("r_context"), "r_f00", alone, F.when(double, 0.5).otherwise(1.0))
            return F.when(double, F.array(first, child(node, F.col("r_context").bitwiseOR(F.col(other_mask)), beside, "r_f11", F.lit(0.5)))).otherwise(F.array(first))

        both_halves = F.concat(contexts("r_l", "r_r_mask", "r_f10", "r_f01"), contexts("r_r", "r_l_mask", "r_f01", "r_f10"))
        opened = stored(values.select("r_key", *xs, F.explode(both_halves).alias("r_c")).select("r_c.r_node", "r_key", *xs, *[f"r_c.{c}" for c in state if c not in ("r_key", *xs)]))
        leaves = leaves.union(opened.where(F.col("r_node") < p))
        open_ = opened.where(F.col("r_node") >= p)
    worth = F.col("r_w") * (F.col("r_f11") - F.col("r_f00"))
    return leaves.groupBy(F.col("r_key").alias(key)).agg(*[F.sum(F.when(F.col("r_node") == i, worth).otherwise(0.0)).alias(f"phi_{f}") for i, f in enumerate(features)])
