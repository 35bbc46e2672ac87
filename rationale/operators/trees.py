"""Tree rules and counterfactual changes: interval conditions (rule_id, attr, lo, hi, eq), lo exclusive and hi inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.small import small
from rationale.functions.spread import spread

from .bins import _nlogn
from .profile import long_form


def local_tree(neigh: DataFrame, key: str, features: list[str], label: str, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(key, rule_id, attr, lo, hi, eq, class): one tree for each instance, split at bin edges, all trees level by level.

    ``edges`` has (feature, edges). Rows are counted by (instance, node, feature,
    edge, class); the best gain of each node splits it (ties: feature, edge).
    """
    from rationale.sources.scratch import stored

    rows = neigh.select(key, "rep", F.col(label).alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).withColumn("node", F.lit(1).cast("long"))
    conds = None
    for _ in range(depth):
        long = rows.unpivot([key, "rep", "y", "node"], features, "feature", "value").join(F.broadcast(edges.select("feature", F.explode("edges").alias("edge"))), "feature")
        per = long.groupBy(key, "node", "feature", "edge", "y").agg(F.count_if(F.col("value") <= F.col("edge")).alias("l"), F.count("*").alias("a"))
        gains = per.groupBy(key, "node", "feature", "edge").agg(F.sum("l").alias("nl"), F.sum("a").alias("na"), F.sum(_nlogn("l")).alias("sl"), F.sum(_nlogn(F.col("a") - F.col("l"))).alias("sr"), F.sum(_nlogn("a")).alias("sa"))
        gain = F.round((_nlogn("na") - F.col("sa")) - (_nlogn("nl") - F.col("sl")) - (_nlogn(F.col("na") - F.col("nl")) - F.col("sr")), 9)
        best = F.row_number().over(Window.partitionBy(key, "node").orderBy(F.desc("gain"), "feature", "edge"))
        splits = stored(gains.withColumn("gain", gain).where("gain > 0 and nl > 0 and nl < na").withColumn("r", best).where("r = 1").select(key, "node", "feature", "edge"))
        joined = rows.join(splits, [key, "node"], "left")
        value = F.coalesce(*[F.when(F.col("feature") == c, F.col(c)) for c in features])
        child = F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (value > F.col("edge")).cast("long"))
        step = splits.select(key, F.col("node").alias("parent"), F.col("feature").alias("attr"), "edge")
        conds = step if conds is None else conds.unionByName(step)
        rows = spread(stored(joined.withColumn("node", child).select(key, "rep", "y", "node", *features)), key)
    leaves = rows.groupBy(key, "node", "y").agg(F.count("*").alias("n")).groupBy(key, F.col("node").alias("rule_id")).agg(F.max_by("y", F.struct("n", "y")).alias("class"))
    path = leaves.withColumn("up", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.log2("rule_id")).cast("int")))))
    path = path.withColumn("child", F.expr("shiftright(rule_id, up - 1)")).withColumn("parent", F.expr("shiftright(rule_id, up)"))
    tests = path.join(conds, [key, "parent"])
    right = F.col("child") % 2 == 1
    return path_rule(tests.select(key, "rule_id", "class", "attr", F.when(right, F.col("edge")).alias("lo"), F.when(~right, F.col("edge")).alias("hi"), F.lit(None).cast("string").alias("eq")), [key, "rule_id", "class"])


def path_rule(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated tests of one attribute become one interval."""
    return conditions.groupBy(*keys, "attr").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.first("eq", ignorenulls=True).alias("eq"))


def _holds(value, text):
    return (F.col("lo").isNull() | (value > F.col("lo"))) & (F.col("hi").isNull() | (value <= F.col("hi"))) & (F.col("eq").isNull() | (text == F.col("eq")))


def tree_assign(rows: DataFrame, conditions: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, rule_id): rules whose conditions a row meets, all of them."""
    long = long_form(rows, features, (key,)).withColumnRenamed("feature", "attr")
    need = conditions.groupBy("rule_id").agg(F.count("*").alias("need"))
    hit = long.join(small(conditions, "a list of conditions"), "attr").where(_holds(F.col("value"), F.col("value").cast("string"))).groupBy(key, "rule_id").agg(F.count("*").alias("m"))
    return hit.join(need, "rule_id").where("m = need").select(key, "rule_id")


def covered(rows: DataFrame, conditions: DataFrame, key: str, features: list[str], label: str, wanted: DataFrame) -> DataFrame:
    """(rule_id, coverage, precision): share of rows that a rule holds for, and of those with its class (rule_id, class)."""
    n = rows.agg(F.count("*").alias("n"))
    hits = tree_assign(rows, conditions, key, features).join(rows.select(key, label), key).join(wanted, "rule_id")
    sums = hits.groupBy("rule_id").agg(F.count("*").alias("c"), F.avg((F.col(label) == F.col("class")).cast("double")).alias("precision"))
    return sums.join(F.broadcast(n)).select("rule_id", (F.col("c") / F.col("n")).alias("coverage"), "precision")


def counterfactual_deltas(fact: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rule_id, attr, lo, hi, eq, changes) of the paths that ask for the fewest changes beyond the factual rule of their instance.

    A condition counts where the fact doesn't imply it, an interval with two such
    sides twice. Both tables have ``keys``, which name the instance.
    """
    f = fact.select(*keys, "attr", F.col("lo").alias("flo"), F.col("hi").alias("fhi"), F.col("eq").alias("feq"))
    j = others.join(fact.select(*keys).distinct(), keys, "left_semi").join(f, [*keys, "attr"], "left")
    lo = F.col("lo").isNotNull() & (F.col("flo").isNull() | (F.col("flo") < F.col("lo")))
    hi = F.col("hi").isNotNull() & (F.col("fhi").isNull() | (F.col("fhi") > F.col("hi")))
    eq = F.col("eq").isNotNull() & ~F.col("eq").eqNullSafe(F.col("feq"))
    rows = j.select(*keys, "rule_id", "attr", F.when(lo, F.col("lo")).alias("lo"), F.when(hi, F.col("hi")).alias("hi"), F.when(eq, F.col("eq")).alias("eq"), (lo.cast("int") + hi.cast("int") + eq.cast("int")).alias("n"))
    total = rows.groupBy(*keys, "rule_id").agg(F.sum("n").alias("changes"))
    least = total.groupBy(*keys).agg(F.min("changes").alias("changes"))
    return rows.where("n > 0").join(total.join(least, [*keys, "changes"]), [*keys, "rule_id"]).drop("n")


def apply_delta(rows: DataFrame, deltas: DataFrame, key: str, features: list[str], step: float = 1.0) -> DataFrame:
    """(key, rule_id, features...): beyond t becomes t + step, up to t becomes t."""
    wide = deltas.groupBy("rule_id").agg(*[F.first(F.when(F.col("attr") == f, F.coalesce(F.col("lo") + step, F.col("hi"))), ignorenulls=True).alias(f"new_{f}") for f in features])
    return rows.select(key, *features).join(small(wide, "a list of changes")).select(key, "rule_id", *[F.coalesce(f"new_{f}", F.col(f).cast("double")).alias(f) for f in features])


def class_totals(applicable: DataFrame, group: str = "g") -> DataFrame:
    """(g, tid, class, total, rank): sums of log_p times confidence; the lowest total is the class."""
    sums = applicable.groupBy(group, "tid", "class").agg(F.round(F.sum(F.col("log_p") * F.col("confidence")), 9).alias("total"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(group, "tid").orderBy("total", "class")))


def next_rule(rules: DataFrame, tx: DataFrame, wanted: str, used: DataFrame | None = None, restricted: list[int] | None = None, group: str = "g") -> DataFrame:
    """(g, tid, rule_id): the strongest rule of the wanted class that doesn't hold yet, isn't used and asks for no restricted item.

    Baskets of a group with the same items and the same used rules are one
    basket, so rules meet distinct baskets alone.
    """
    open_ = rules.where(F.col("class") == wanted).select(group, "rule_id", "items", "log_p", "confidence")
    kinds = tx.select(group, "tid", F.array_sort("items").alias("own"))
    if used is not None:
        gone = used.groupBy(group, "tid").agg(F.array_sort(F.collect_set("rule_id")).alias("gone"))
        kinds = kinds.join(gone, [group, "tid"], "left")
        kinds = kinds.withColumn("gone", F.coalesce("gone", F.array().cast(gone.schema["gone"].dataType)))
    same = [c for c in kinds.columns if c != "tid"]
    pairs = kinds.select(*same).distinct().join(open_, group)
    missing = F.array_except("items", "own")
    pairs = pairs.where(F.size(missing) > 0)
    if restricted:
        pairs = pairs.where(~F.arrays_overlap(missing, F.array(*[F.lit(i) for i in restricted])))
    if used is not None:
        pairs = pairs.where(~F.array_contains("gone", F.col("rule_id")))
    best = pairs.groupBy(*same).agg(F.min_by("rule_id", F.struct(F.round(F.col("log_p") * F.col("confidence"), 9), "rule_id")).alias("rule_id"))
    return kinds.join(best, same).select(group, "tid", "rule_id")


def apply_rule(tx: DataFrame, chosen: DataFrame, rules: DataFrame, item_features: DataFrame, n_encoded: int, group: str = "g") -> DataFrame:
    """(g, tid, items): a feature's active item becomes the rule's; a negated item moves to the next bin, else the one before."""
    f = item_features.select("item", "feature")
    ends = item_features.groupBy("feature").agg(F.max("item").alias("last"))
    asked = chosen.join(rules.select(group, "rule_id", F.explode("items").alias("x")), [group, "rule_id"]).withColumn("item", F.col("x") % n_encoded).join(F.broadcast(f), "item").join(F.broadcast(ends), "feature")
    target = F.when(F.col("x") < n_encoded, F.col("item")).otherwise(F.when(F.col("item") < F.col("last"), F.col("item") + 1).otherwise(F.col("item") - 1))
    change = asked.withColumn("target", target).groupBy(group, "tid", "feature").agg(F.max("target").alias("target"))
    own = tx.select(group, "tid", F.explode("items").alias("item")).join(F.broadcast(f), "item")
    moved = own.join(change, [group, "tid", "feature"], "left").select(group, "tid", F.coalesce("target", "item").cast("int").alias("item"))
    return moved.groupBy(group, "tid").agg(F.array_sort(F.collect_set("item")).alias("items"))


def rule_counterfactuals(tx: DataFrame, rules: DataFrame, item_features: DataFrame, predict, wanted: str, n_encoded: int, changes: int = 3, restricted: list[int] | None = None, group: str = "g", n: int = 1) -> DataFrame:
    """(g, tid, k, items, rules): up to ``n`` counterfactuals of each basket, and the rules that made them, in their order.

    A search starts from the basket itself and applies up to ``changes`` rules, one
    after another, until the black box gives the wanted class.  What a counterfactual
    used is not used again for its basket; a search that fails gives up its first rule
    alone.  A basket is done with its n-th counterfactual, or when no rule is left to
    start with.  All open baskets search together; ``predict(df)`` adds ``label`` to
    rows with items, and keeps their other columns.
    """
    from rationale.sources.scratch import stored

    own = [group, "tid"]
    start = stored(tx.select(*own, "items").withColumn("k", F.lit(0)))
    used = stored(rules.join(start, group).select(*own, "rule_id").limit(0))
    none = F.array().cast(f"array<{rules.schema['rule_id'].dataType.simpleString()}>")
    done = None
    while True:
        open_, tried, hits = start.select(*own, "items", none.alias("rules")), used, None
        for step in range(changes):
            chosen = next_rule(rules, open_.select(*own, "items"), wanted, tried, restricted, group)
            chosen = stored(chosen.join(open_.select(*own, F.col("items").alias("before"), "rules"), own).withColumn("rules", F.concat("rules", F.array("rule_id"))))
            tried = tried.unionByName(chosen.select(*own, "rule_id"))
            moved = apply_rule(chosen.select(*own, F.col("before").alias("items")), chosen.select(*own, "rule_id"), rules, item_features, n_encoded, group)
            moved = stored(predict(moved).join(chosen.select(*own, "rules"), own))
            hit = moved.where(F.col("label") == wanted).select(*own, "items", "rules")
            hits = hit if hits is None else hits.unionByName(hit)
            # a basket without another rule ends its search where it is
            stuck = open_.where(F.size("rules") > 0).join(chosen.select(*own), own, "left_anti").select(*own, "items", "rules")
            lost = stuck if step == 0 else lost.unionByName(stuck)
            open_ = moved.where(~F.col("label").eqNullSafe(wanted)).select(*own, "items", "rules")
        lost = lost.unionByName(open_)
        found = stored(hits.join(start.select(*own, "k"), own).select(*own, (F.col("k") + 1).alias("k"), "items", "rules"))
        done = found if done is None else done.unionByName(found)
        given_up = found.select(*own, F.explode("rules").alias("rule_id")).unionByName(lost.select(*own, F.get("rules", F.lit(0)).alias("rule_id")))
        used = stored(used.unionByName(given_up))
        going = found.select(*own, "k").unionByName(lost.join(start.select(*own, "k"), own).select(*own, "k")).where(F.col("k") < n)
        start = stored(start.drop("k").join(going, own))
        if start.isEmpty():
            return done


def random_counterfactual(instances: DataFrame, draws: DataFrame, key: str, features: list[str], label: str, wanted: str, distance) -> DataFrame:
    """(key, feature, old, new): the closest draw with the wanted label (``distance`` uses x0_ columns), as changes. ``draws`` is small."""
    asked = spread(instances.select(key, *[F.col(f).cast("double").alias(f"x0_{f}") for f in features]), key)
    pairs = asked.join(small(draws.where(F.col(label) == wanted).select("rep", *features), "a list of draws")).withColumn("d", distance)
    best = pairs.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"x0_{f}") for f in features], *features), F.struct("d", "rep")).alias("b")).select(key, "b.*")
    return best.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x0_{f}").alias("old"), F.col(f).cast("double").alias("new")) for f in features]))).where("old <> new")
