"""Shapley attributions of decision trees, from tables of their paths.

A leaf is the set of conditions on its path, one interval for each feature.  Which of
them a row meets is a bit mask, and everything that a leaf adds to an attribution
follows from that mask, so weights are worked out once for each (leaf, mask) that
occurs, and rows look theirs up.  A background of any size shrinks to counts of masks
by leaf before it meets anything.

Scale.  Rows meet leaves by broadcast (checked, see ``small``) and their sums are
complete within a task; a table of weights has at most 2**m rows for a leaf with m
features, whatever the number of rows.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rationale.functions.small import small
from rationale.sources.scratch import stored

LEAF = ("tree", "rule_id")
LONGEST = 62  # features of a path, as bits of a long


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(tree, rule_id, attr, lo, hi, nulls, share): the conditions of each leaf, lo exclusive and hi inclusive.

    ``nodes`` has (tree, node, attr, edge, n) with the root 1 and the children 2k (up
    to the edge) and 2k + 1; a leaf has no attr.  ``n`` counts the training rows of a
    node, and ``share`` is the part of them that goes on along all tests of the
    feature.  A null goes left where ``null_left`` is there and true, else right;
    ``nulls`` tells whether it would come to the leaf.  A node deeper than 62 is an
    error of the numbering.
    """
    null_left = F.col("null_left") if "null_left" in nodes.columns else F.lit(False)
    tests = nodes.where("attr is not null").select("tree", F.col("node").alias("parent"), "attr", "edge", F.col("n").cast("double").alias("n_parent"), F.coalesce(null_left, F.lit(False)).alias("null_left"))
    sizes = nodes.select("tree", F.col("node").alias("child"), F.col("n").cast("double").alias("n_child"))
    leaves = nodes.where("attr is null and node > 1").select("tree", F.col("node").cast("long").alias("rule_id"))
    steps = leaves.withColumn("up", F.explode(F.sequence(F.lit(1), F.floor(F.log2("rule_id")).cast("int"))))
    steps = steps.select("tree", "rule_id", F.expr("shiftright(rule_id, up - 1)").alias("child"), F.expr("shiftright(rule_id, up)").alias("parent"))
    right = F.col("child") % 2 == 1
    tested = steps.join(tests, ["tree", "parent"]).join(sizes, ["tree", "child"])
    ends = (F.max(F.when(right, F.col("edge"))).alias("lo"), F.min(F.when(~right, F.col("edge"))).alias("hi"), F.min(F.col("null_left") != right).alias("nulls"), F.product(F.coalesce(F.try_divide("n_child", "n_parent"), F.lit(0.0))).alias("share"))
    return tested.groupBy(*LEAF, "attr").agg(*ends)


def node_counts(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """``nodes`` with ``n``: how many of the rows come to each node."""
    ones = nodes.drop("n").withColumn("n", F.lit(1))
    paths = tree_paths(ones)
    bare = ones.where("attr is null and node = 1").select(F.col("tree"), F.lit(1).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("boolean").alias("nulls"), F.lit(None).cast("double").alias("share"))
    packed = stored(_packed(paths.unionByName(bare), features))
    hits = _masks(rows, packed, [], features).where("mask = full").groupBy(*LEAF).agg(F.count("*").alias("n"))
    up = hits.withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.log2("rule_id")).cast("int")), lambda k: F.call_function("shiftright", F.col("rule_id"), k))))
    counts = up.groupBy("tree", "node").agg(F.sum("n").alias("n"))
    return stored(ones.drop("n").join(counts, ["tree", "node"], "left").withColumn("n", F.coalesce("n", F.lit(0))))


def _packed(conditions: DataFrame, features: list[str]) -> DataFrame:
    """(tree, rule_id, conds, full): the conditions of a leaf as one array, each with the place of its feature and its bit."""
    place = F.coalesce(*[F.when(F.col("attr") == f, F.lit(i)) for i, f in enumerate(features)])
    lists = conditions.withColumn("f", place).groupBy(*LEAF).agg(F.array_sort(F.collect_list(F.when(F.col("attr").isNotNull(), F.struct("f", "lo", "hi", "nulls", "share")))).alias("c"))
    conds = F.transform("c", lambda c, k: F.struct(c["f"].alias("f"), c["lo"].alias("lo"), c["hi"].alias("hi"), c["nulls"].alias("nulls"), c["share"].alias("share"), F.call_function("shiftleft", F.lit(1).cast("long"), k).alias("bit")))
    return lists.select(*LEAF, conds.alias("conds")).withColumn("full", F.aggregate("conds", F.lit(0).cast("long"), lambda a, c: a + c["bit"]))


def _checked(leaves: DataFrame, features: list[str]) -> int:
    """The longest path; paths must test known features alone, and few enough."""
    longest, unknown = leaves.agg(F.max(F.size("conds")), F.max(F.exists("conds", lambda c: c["f"].isNull()).cast("int"))).first()
    if unknown:
        raise ValueError(f"a path tests a feature that isn't among {features}")
    if (longest or 0) > LONGEST:
        raise ValueError(f"a path with {longest} features; at most {LONGEST}")
    return longest or 0


def _masks(rows: DataFrame, leaves: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """(keep..., tree, rule_id, full, mask) of each row and leaf: the bits of the conditions that the row meets."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    beside = rows.select(*keep, values.alias("r_x")).join(small(leaves.select(*LEAF, "conds", "full"), "a list of leaves"))

    def bit(c: Column) -> Column:
        v = F.get("r_x", c["f"])
        meets = (c["lo"].isNull() | (v > c["lo"])) & (c["hi"].isNull() | (v <= c["hi"]))
        return F.when(F.when(v.isNull(), F.coalesce(c["nulls"], F.lit(False))).otherwise(meets), c["bit"]).otherwise(F.lit(0).cast("long"))

    return beside.select(*keep, *LEAF, "full", F.aggregate("conds", F.lit(0).cast("long"), lambda a, c: a + bit(c)).alias("mask"))


def _looked_up(masks: DataFrame, weights: DataFrame, key: str, features: list[str], base: Column) -> DataFrame:
    """(key, base, phi_<feature>...): the weights of each row's masks, added up."""
    found = masks.join(weights, [*LEAF, "mask"], "left")
    each = lambda i: F.sum(F.coalesce(F.aggregate(F.filter("parts", lambda p: p["f"] == i), F.lit(0.0), lambda a, p: a + p["phi"]), F.lit(0.0)))
    return found.groupBy(key).agg(*[each(i).alias(f"phi_{f}") for i, f in enumerate(features)]).select(key, base.alias("base"), *[f"phi_{f}" for f in features])


def tree_shap(instances: DataFrame, background: DataFrame, conditions: DataFrame, values: DataFrame, key: str, features: list[str], weight: str | None = None) -> DataFrame:
    """(key, base, phi_<feature>...): interventional Shapley values of an ensemble, exact for every background row.

    ``conditions`` as of ``tree_paths`` (lo, hi; ``nulls`` and ``share`` may be null),
    ``values`` with (tree, rule_id, value), of which each row gets one of each tree.
    A coalition comes to a leaf if it holds all features that only the instance meets
    and none of those that only the background row meets, a and b in number: that is
    value / (a * C(a + b, a)) for the one kind and -value / (b * C(a + b, b)) for the
    other, and nothing if both fail one.  ``key`` is unique; no background: nulls.
    """
    n_of = F.col(weight).cast("double") if weight else F.lit(1.0)
    leaves, valued = stored(_packed(conditions, features)), values.select(*LEAF, F.col("value").cast("double").alias("value"))
    longest = _checked(leaves, features)
    others = _masks(background.withColumn("r_n", n_of), leaves, ["r_n"], features).groupBy(*LEAF, "full", F.col("mask").alias("b_mask")).agg(F.sum("r_n").alias("b_n"))
    total = background.agg(F.sum(n_of)).first()[0]
    masks = _masks(instances, leaves, [key], features).drop("full")
    others = stored(others)
    base = others.where("b_mask = full").join(valued, list(LEAF)).agg(F.sum(F.col("b_n") * F.col("value"))).first()[0]
    fact = F.array(*[F.lit(float(factorial(i))) for i in range(longest + 1)])
    pairs = masks.select(*LEAF, "mask").distinct().join(others, list(LEAF)).join(valued, list(LEAF)).join(F.broadcast(leaves.select(*LEAF, "conds")), list(LEAF))
    mine, theirs = F.col("mask").bitwiseAND(F.bitwise_not("b_mask")), F.col("b_mask").bitwiseAND(F.bitwise_not("mask"))
    pairs = pairs.where(F.col("mask").bitwiseOR(F.col("b_mask")) == F.col("full")).withColumns({"mine": mine, "theirs": theirs}).withColumns({"a": F.bit_count("mine"), "b": F.bit_count("theirs")})
    share = F.col("value") * F.col("b_n") / F.lit(total).cast("double")
    up = share * F.get(fact, F.col("a") - 1) * F.get(fact, "b") / F.get(fact, F.col("a") + F.col("b"))
    down = -share * F.get(fact, "a") * F.get(fact, F.col("b") - 1) / F.get(fact, F.col("a") + F.col("b"))
    each = pairs.select(*LEAF, "mask", "mine", "theirs", up.alias("up"), down.alias("down"), F.explode("conds").alias("c"))
    phi = F.when(F.col("mine").bitwiseAND(F.col("c.bit")) != 0, F.col("up")).when(F.col("theirs").bitwiseAND(F.col("c.bit")) != 0, F.col("down"))
    weights = each.groupBy(*LEAF, "mask", F.col("c.f").alias("f")).agg(F.sum(phi).alias("phi")).where("phi is not null").groupBy(*LEAF, "mask").agg(F.collect_list(F.struct("f", "phi")).alias("parts"))
    single = valued.join(leaves.select(*LEAF), list(LEAF), "left_anti").agg(F.sum("value")).first()[0] or 0.0  # trees of one leaf
    return _looked_up(masks, weights, key, features, F.lit(None if not total else (base or 0.0) / total + single).cast("double"))


def tree_shap_paths(instances: DataFrame, conditions: DataFrame, values: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, base, phi_<feature>...): Shapley values where a feature outside the coalition goes both ways, by the shares of training rows.

    A leaf is worth value * product of (1 if met else 0, for features of the coalition;
    share, for the others).  Over coalitions of the other features of the path that is
    a polynomial, whose coefficient of t**k belongs to coalitions of k; it is multiplied
    up factor by factor for each feature of each mask that occurs.
    """
    leaves, valued = stored(_packed(conditions, features)), values.select(*LEAF, F.col("value").cast("double").alias("value"))
    _checked(leaves, features)
    masks = _masks(instances, leaves, [key], features).drop("full")
    seen = masks.select(*LEAF, "mask").distinct().join(F.broadcast(leaves), list(LEAF)).join(valued, list(LEAF))
    met = lambda c: F.when(F.col("mask").bitwiseAND(c["bit"]) != 0, 1.0).otherwise(0.0)
    none = F.array(F.lit(0.0))
    m = F.size("conds")

    def times(poly: Column, c: Column) -> Column:
        return F.zip_with(F.concat(poly, none), F.concat(none, poly), lambda u, v: u * c["share"] + v * met(c))

    def summed(poly: Column) -> Column:
        """Coefficients by their weights k! (m - 1 - k)! / m!."""
        # the weight of k follows from that of k - 1: * k / (m - k)
        start = F.struct(F.lit(0.0).alias("sum"), (1.0 / m).alias("w"), F.lit(0).alias("k"))
        return F.aggregate(poly, start, lambda s, x: F.struct((s["sum"] + x * s["w"]).alias("sum"), F.when(s["k"] + 1 < m, s["w"] * (s["k"] + 1) / (m - 1 - s["k"])).otherwise(0.0).alias("w"), (s["k"] + 1).alias("k")), lambda s: s["sum"])

    def part(c: Column) -> Column:
        rest = F.aggregate(F.filter("conds", lambda o: o["bit"] != c["bit"]), F.array(F.lit(1.0)), times)
        return F.struct(c["f"].alias("f"), (F.col("value") * (met(c) - c["share"]) * summed(rest)).alias("phi"))

    weights = seen.select(*LEAF, "mask", F.transform("conds", part).alias("parts"))
    worth = F.aggregate("conds", F.lit(1.0), lambda a, c: a * c["share"]) * F.col("value")
    base = leaves.join(valued, list(LEAF)).agg(F.sum(worth)).first()[0] or 0.0
    single = valued.join(leaves.select(*LEAF), list(LEAF), "left_anti").agg(F.sum("value")).first()[0] or 0.0
    return _looked_up(masks, weights, key, features, F.lit(base + single))
