"""Association-rule surrogates: mining, pruning, classifying with and explaining by significant rules.

Baskets are rows (g, tid, items array<int>, class); g names the instance (or
run) that a set of baskets belongs to, so many surrogates are mined at once and
every join and aggregate is keyed by g.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.order import numbered
from rationale.functions.small import beside
from rationale.functions.special import log_binomial, log_factorial
from rationale.functions.spread import spread
from rationale.sources.scratch import stored


def split_prune(tx: DataFrame, group: str = "g", order: str = "tid") -> DataFrame:
    """With ``is_prune``: every third basket of a group, the first among them; a group may be of any size."""
    return numbered(tx, [order], "r_place", (group,)).withColumn("is_prune", F.col("r_place") % 3 == 0).drop("r_place")


def class_sizes(tx: DataFrame, group: str = "g") -> DataFrame:
    """(g, class, n_class, n)."""
    return tx.groupBy(group, "class").agg(F.count("*").alias("n_class")).withColumn("n", F.sum("n_class").over(Window.partitionBy(group)))


def blocks(tx: DataFrame, group: str = "g", order: str = "tid") -> DataFrame:
    """(g, block, items, classes): up to 64 baskets of a group as bitmaps, one for each item and each class among them.

    Baskets are numbered by sorted ranges, so a group may be of any size; repeated
    items of a basket are one bit.
    """
    placed = numbered(tx.select(group, order, "class", "items"), [order], "r_place", (group,))
    rows = placed.select(group, F.floor(F.col("r_place") / 64).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("r_place") % 64).cast("int")).alias("bit"), "class", "items")
    own = [group, "block"]
    items = rows.select(*own, "bit", F.explode("items").alias("x")).groupBy(*own, "x").agg(F.bit_or("bit").alias("bits")).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("x", "bits"))).alias("items"))
    classes = rows.groupBy(*own, "class").agg(F.bit_or("bit").alias("bits")).groupBy(*own).agg(F.collect_list(F.struct("class", "bits")).alias("classes"))
    return items.join(classes, own)


def candidate_counts(tx: DataFrame, length: int, group: str = "g", allowed: DataFrame | None = None, packed: DataFrame | None = None) -> DataFrame:
    """(g, items, class, n_items, n_both, n_class, n): support of each ordered itemset, alone and with each class.

    The bitmaps of its items in a block, taken together, are the baskets that hold it:
    an itemset is met once a block, not once a basket, and counted by bits.
    ``allowed`` (g, items) keeps itemsets whose first items are listed; ``packed`` are
    the ``blocks`` of ``tx``, where they are known.
    """
    packed = blocks(tx, group) if packed is None else packed
    out = packed.select(group, "classes", F.col("items").alias("b"), F.posexplode("items").alias("i", "s")).select(group, "classes", "b", "i", F.array("s.x").alias("items"), "s.bits")
    for _ in range(length - 1):
        tail = F.slice("b", F.col("i") + 2, F.size("b"))
        out = out.select(group, "classes", "b", "i", "items", "bits", F.posexplode(tail).alias("j", "s"))
        out = out.select(group, "classes", "b", (F.col("i") + F.col("j") + 1).alias("i"), F.concat("items", F.array("s.x")).alias("items"), F.col("bits").bitwiseAND(F.col("s.bits")).alias("bits")).where("bits <> 0")
    if allowed is not None:
        out = out.withColumn("head", F.slice("items", 1, length - 1)).join(allowed.select(group, F.col("items").alias("head")), [group, "head"], "left_semi").drop("head")
    per = out.select(group, "items", "bits", F.explode("classes").alias("c")).select(group, "items", F.col("c.class").alias("class"), F.bit_count(F.col("bits").bitwiseAND(F.col("c.bits"))).alias("n"))
    both = per.where("n > 0").groupBy(group, "items", "class").agg(F.sum("n").alias("n_both"))
    alone = both.withColumn("n_items", F.sum("n_both").over(Window.partitionBy(group, "items")))
    return alone.join(class_sizes(tx, group), [group, "class"])


def fisher_log_p(counts: DataFrame) -> DataFrame:
    """With ``log_p``: log of the right tail of the hypergeometric distribution.

    The first term comes from log factorials, each next one from its ratio to the
    one before.  Terms further than 12 deviations from the mode and from the
    first are left out: they don't reach the last digit of a double.
    """
    both, a, c, n = (F.col(x).cast("double") for x in ("n_both", "n_items", "n_class", "n"))
    mode = F.floor((a + 1) * (c + 1) / (n + 2))
    spread = F.ceil(12 * F.sqrt(a * c / n * (n - a) / n * (n - c) / F.greatest(n - 1, F.lit(1.0)))) + 50
    first = F.greatest(F.greatest(both, mode - spread), a + c - n)
    last = F.least(F.least(a, c), F.greatest(both, mode) + spread)
    start = log_binomial(c, F.col("first")) + log_binomial(n - c, a - F.col("first")) - log_binomial(n, a)
    ratio = lambda k: (c - k) * (a - k) / ((k + 1) * (n - c - a + k + 1))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * ratio(k)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.when(F.col("last") > F.col("first"), F.sequence(F.col("first").cast("long"), F.col("last").cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(steps, zero, add, lambda s: s["sum"])
    rows = counts.withColumn("first", first).withColumn("last", last)
    return rows.withColumn("log_p", start + F.log(total)).drop("first", "last")


def pss_filter(counts: DataFrame, alpha: float = 0.001) -> DataFrame:
    """Itemsets that could still become significant: more frequent than the class, or a lower bound of p within alpha."""
    a, c, n = F.col("n_items"), F.col("n_class"), F.col("n")
    bound = log_factorial(c) + log_factorial(n - a) - log_factorial(n) - log_factorial(F.greatest(c - a, F.lit(0)))
    return counts.where((a > c) | (bound <= F.log(F.lit(alpha))))


def minimal_rules(rules: DataFrame, longer: DataFrame, group: str = "g") -> DataFrame:
    """Longer rules that don't extend a rule of confidence 1 with the same class."""
    done = rules.where("n_both = n_items").select(group, "class", F.col("items").alias("sub"))
    subs = longer.withColumn("sub", F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.array_except("items", F.array(F.element_at("items", i))))))
    extended = subs.join(done, [group, "class", "sub"]).select(group, "class", "items").distinct()
    return longer.join(extended, [group, "class", "items"], "left_anti")


def non_redundant(previous: DataFrame, longer: DataFrame, group: str = "g") -> DataFrame:
    """Longer rules all of whose one-shorter parts are in ``previous`` (with min_log_p), none minimal, with a log_p below all of theirs.

    The result carries min_log_p, the least log_p of a rule and its parts.
    """
    size = F.size("items")
    subs = longer.withColumn("sub", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.array_except("items", F.array(F.element_at("items", i))))))
    known = previous.select(group, "class", F.col("items").alias("sub"), "min_log_p", (F.col("n_both") < F.col("n_items")).alias("open"))
    judged = subs.join(known, [group, "class", "sub"]).groupBy(group, "class", "items").agg(F.count("*").alias("k"), F.bool_and("open").alias("open"), F.min("min_log_p").alias("below"))
    kept = longer.join(judged, [group, "class", "items"]).where((F.col("k") == size) & F.col("open") & (F.col("log_p") < F.col("below")))
    return kept.withColumn("min_log_p", F.least("log_p", "below")).drop("k", "open", "below")


def as_rules(counts: DataFrame) -> DataFrame:
    """Support of the antecedent and confidence of each counted rule."""
    return counts.select("*", (F.col("n_items") / F.col("n")).alias("support"), (F.col("n_both") / F.col("n_items")).alias("confidence"))


def mine(tx: DataFrame, group: str = "g", max_len: int = 3, alpha: float = 0.001) -> DataFrame:
    """Significant, minimal, non-redundant rules up to a length, level by level; each level is written once."""
    found, previous, allowed, packed = None, None, None, stored(blocks(tx, group))
    for length in range(1, max_len + 1):
        counts = candidate_counts(tx, length, group, allowed, packed)
        level = fisher_log_p(pss_filter(counts, alpha))
        level = level.withColumn("min_log_p", F.col("log_p")) if previous is None else non_redundant(previous, level, group)
        level = stored(level)
        good = as_rules(level.where(F.col("log_p") <= F.log(F.lit(alpha))))
        found = good if found is None else found.unionByName(good)
        previous = level
        allowed = level.where("n_both < n_items").select(group, "items").distinct()
    return found.select(group, "items", "class", "support", "confidence", "log_p")


def applicable(rules: DataFrame, tx: DataFrame, group: str = "g") -> DataFrame:
    """(rules..., tid, tx_class): rules all of whose items a basket holds.

    A rule meets the baskets with its first item and is tested there, so nothing is
    counted by rule and basket; rows stay together by basket where rules are few.
    """
    asked = rules.withColumn("r_head", F.get("items", F.lit(0))).transform(beside)
    own = spread(tx.select(group, "tid", F.col("class").alias("tx_class"), F.col("items").alias("r_own")), group, "tid")
    met = own.withColumn("r_head", F.explode(F.array_distinct("r_own"))).join(asked, [group, "r_head"]).where(F.forall("items", lambda x: F.array_contains("r_own", x)))
    return met.select(group, "tid", "rule_id", *[c for c in rules.columns if c not in (group, "rule_id")], "tx_class")


def importance(rules: DataFrame, tx: DataFrame, group: str = "g") -> DataFrame:
    """Rules with ``importance``: baskets that vote for them, each for its applicable rule of its own class with the highest confidence, then support."""
    # the order of rules is one for all baskets of a group, so a basket's choice is a least number
    ranked = stored(rules.withColumn("r_vote", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), F.desc("support"), "rule_id"))))
    own = applicable(ranked, tx, group).where("class = tx_class").groupBy(group, "tid").agg(F.min("r_vote").alias("r_vote"))
    votes = own.groupBy(group, "r_vote").agg(F.count("*").alias("importance")).join(ranked.select(group, "r_vote", "rule_id"), [group, "r_vote"])
    return rules.join(votes.select(group, "rule_id", "importance"), [group, "rule_id"])


def sequential_cover(rules: DataFrame, prune_tx: DataFrame, min_conf: float = 0.5, group: str = "g") -> DataFrame:
    """(g, rule_id, place): the rule best on the uncovered rows is taken again and again, in all groups at once.

    The first round ranks by training confidence, later ones by confidence on
    what is left; ties by log_p, then id.  A round is one aggregate, a choice
    for each group and an anti-join; a group ends when no rule reaches
    ``min_conf`` or no row is left, so it takes as many rounds as the longest
    list has rules.
    """
    rest = stored(applicable(rules, prune_tx, group).select(group, "rule_id", "tid", (F.col("class") == F.col("tx_class")).cast("double").alias("ok"), "confidence", "log_p"))
    done, place = None, 0
    while True:
        place += 1
        by = rest.groupBy(group, "rule_id").agg(F.round(F.avg("confidence" if place == 1 else "ok"), 12).alias("c"), F.first("log_p").alias("p"))
        best = by.where(F.col("c") >= min_conf).groupBy(group).agg(F.min_by("rule_id", F.struct(-F.col("c"), "p", "rule_id")).alias("rule_id"))
        top = stored(best.withColumn("place", F.lit(place).cast("long")))
        if top.isEmpty():
            break
        done = top if done is None else done.unionByName(top)
        gone = rest.join(top.select(group, "rule_id"), [group, "rule_id"]).select(group, "tid").distinct()
        rest = stored(rest.join(top.select(group), group, "left_semi").join(gone, [group, "tid"], "left_anti"))
    return top.drop("place").withColumn("place", F.lit(0).cast("long")) if done is None else done


def classify(tx: DataFrame, rules: DataFrame, hrs: int = 1, truncate: bool = False, group: str = "g") -> DataFrame:
    """(g, tid, predicted): class scores of applicable rules by importance and log_p (1, least wins), confidence (2, most) or both (3, least).

    Baskets without a rule get the group's majority class (ties: the first by name). ``truncate`` drops fractions of scores.
    """
    value = {1: F.col("importance") * F.col("log_p"), 2: F.col("importance") * F.col("confidence"), 3: F.col("importance") * F.col("log_p") * F.col("confidence")}[hrs]
    sums = applicable(stored(rules), tx, group).groupBy(group, "tid", "class").agg(F.sum(value).alias("v"))
    v = F.when(F.col("v") >= 0, F.floor("v")).otherwise(F.ceil("v")) if truncate else F.round("v", 9)
    first = Window.partitionBy(group, "tid").orderBy(F.desc(v) if hrs == 2 else F.asc(v), "class")
    won = sums.withColumn("r", F.row_number().over(first)).where("r = 1").select(group, "tid", F.col("class").alias("won"))
    majority = class_sizes(tx, group).groupBy(group).agg(F.min_by("class", F.struct(-F.col("n_class"), "class")).alias("majority"))
    return tx.select(group, "tid").join(won, [group, "tid"], "left").join(beside(stored(majority)), group).select(group, "tid", F.coalesce("won", "majority").alias("predicted"))


def rule_text(rules: DataFrame, item_names: DataFrame, n_encoded: int, group: str = "g") -> DataFrame:
    """With ``text``: conditions by item, negated ones as ~( ... ), then the class. ``item_names`` has (item, feature, lo, hi, value)."""
    long = rules.select(group, "rule_id", "class", F.posexplode("items").alias("i", "x")).withColumn("item", F.col("x") % n_encoded)
    named = long.join(F.broadcast(item_names), "item")
    f = F.concat(F.lit("'"), "feature", F.lit("'"))
    plain = F.when(F.col("value").isNotNull(), F.concat(f, F.lit(" = '"), "value", F.lit("'"))).when(F.col("lo").isNull(), F.concat(f, F.lit(" < "), F.format_string("%.2f", "hi"))).when(F.col("hi").isNull(), F.concat(F.format_string("%.2f", "lo"), F.lit(" <= "), f)).otherwise(F.concat(F.format_string("%.2f", "lo"), F.lit(" <= "), f, F.lit(" <= "), F.format_string("%.2f", "hi")))
    text = F.when(F.col("x") >= n_encoded, F.concat(F.lit("~( "), plain, F.lit(" )"))).otherwise(plain)
    lists = named.withColumn("t", text).groupBy(group, "rule_id", "class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), ", ").alias("c"))
    return lists.select(group, "rule_id", F.concat("c", F.lit(" -> "), "class").alias("text"))


def rule_order() -> list[Column]:
    """Short rules first, then confidence times support, log_p, support, confidence."""
    return [F.size("items").asc(), F.desc(F.round(F.col("confidence") * F.col("support"), 12)), F.asc("log_p"), F.desc("support"), F.desc("confidence"), F.asc("rule_id")]


def rule_sort(rules: DataFrame, group: str = "g") -> DataFrame:
    return rules.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*rule_order())))


def _touched(rules: DataFrame, basket: DataFrame, item_features: DataFrame, group: str) -> DataFrame:
    """(g, rule_id, class, feature, need, m): features of each rule, with how many of its items hold."""
    held = basket.select(group, F.col("items").alias("own"))
    counted = rules.join(held, group).withColumn("m", F.size(F.array_intersect("items", "own"))).withColumn("need", F.size("items"))
    return counted.select(group, "rule_id", "class", "support", "confidence", "log_p", "need", "m", F.explode("items").alias("item")).join(F.broadcast(item_features), "item").drop("item").distinct()


def feature_importance(rules: DataFrame, basket: DataFrame, classes: DataFrame, item_features: DataFrame, group: str = "g") -> DataFrame:
    """(g, feature, weight): supports of rules of the own or the next class that have one item, or half of them held.

    ``classes`` has (g, own, next); ``item_features`` (item, feature).
    """
    t = _touched(rules, basket, item_features, group).join(classes, group).where("class = own or class = next").where("need = 1 or m >= need / 2")
    return t.groupBy(group, "feature").agg(F.sum("support").alias("weight"))


def feature_importance_weighted(rules: DataFrame, basket: DataFrame, classes: DataFrame, item_features: DataFrame, group: str = "g") -> DataFrame:
    """(g, feature, weight): (2m + 1) / (2L + 2) times |log_p| up to 100, negative for other classes, normalised to 1."""
    t = _touched(rules, basket, item_features, group).join(classes, group)
    w = (2 * F.col("m") + 1) / (2 * F.col("need") + 2) * F.least(F.abs("log_p"), F.lit(100.0)) * F.when(F.col("class") == F.col("own"), 1).otherwise(-1)
    sums = t.groupBy(group, "feature").agg(F.sum(w).alias("weight"))
    return sums.withColumn("weight", F.col("weight") / F.nullif(F.sum(F.abs("weight")).over(Window.partitionBy(group)), F.lit(0.0)))


def feature_tiers(rules: DataFrame, basket: DataFrame, classes: DataFrame, item_features: DataFrame, group: str = "g") -> DataFrame:
    """(g, feature, tier, value): 1 support from applied rules of the own class, 2 place among other applied rules, 3 rules one item short."""
    t = _touched(rules, basket, item_features, group).join(classes, group)
    first = t.where("m = need and class = own").groupBy(group, "feature").agg(F.sum("support").alias("value")).withColumn("tier", F.lit(1))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("support"), "rule_id", "feature")).cast("double")
    second = t.where("m = need and class <> own").withColumn("value", place).groupBy(group, "feature").agg(F.min("value").alias("value")).withColumn("tier", F.lit(2))
    third = t.where("m = need - 1").groupBy(group, "feature").agg(F.sum("support").alias("value")).withColumn("tier", F.lit(3))
    every = first.unionByName(second).unionByName(third)
    return every.withColumn("r", F.row_number().over(Window.partitionBy(group, "feature").orderBy("tier"))).where("r = 1").select(group, "feature", "tier", "value")


def contrast_rules(rules: DataFrame, item_features: DataFrame, max_dev: float = 0.0005, group: str = "g") -> DataFrame:
    """(g, rule1, rule2, class1, class2): rules of two classes over the same features whose p-values differ by ``max_dev`` at most."""
    keyed = rules.select(group, "rule_id", "class", "log_p", F.explode("items").alias("item")).join(F.broadcast(item_features), "item").groupBy(group, "rule_id", "class", "log_p").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("fs"))
    a, b = (keyed.select(group, "fs", F.col("rule_id").alias(f"rule{i}"), F.col("class").alias(f"class{i}"), F.exp("log_p").alias(f"p{i}")) for i in (1, 2))
    return a.join(b, [group, "fs"]).where(f"class1 < class2 and abs(p1 - p2) <= {max_dev}").select(group, "rule1", "rule2", "class1", "class2")


def explain_rules(instances: DataFrame, make_neighbourhood, to_baskets, item_features: DataFrame, key: str, tries: int = 10, alpha: float = 0.001, min_conf: float = 0.5, max_len: int = 3) -> DataFrame:
    """(key, feature, weight, attempt): neighbourhoods are split, mined, and their rules chosen by sequential cover of the pruning part.

    Instances on which the surrogate disagrees with the black box are tried again
    with other draws, ``tries`` times at most; those that never agree have one row
    without feature and attempt. Groups whose rules cover nothing keep all of them.

    ``make_neighbourhood(instances, seed)`` gives rows with rep and label;
    ``to_baskets(rows)`` gives (g, tid, items, class) with tid 0 the instance.
    """
    open_, done = instances, None
    for turn in range(1, tries + 1):
        if turn > 1 and open_.isEmpty():
            break
        tx = stored(split_prune(to_baskets(make_neighbourhood(open_, turn))))
        training, pruning = tx.where("not is_prune").drop("is_prune"), tx.where("is_prune").drop("is_prune")
        rules = stored(mine(training, "g", max_len, alpha).withColumn("rule_id", F.xxhash64("g", "items", "class")))
        cover = stored(sequential_cover(rules, pruning, min_conf).select("g", "rule_id"))
        kept = stored(rules.join(cover, ["g", "rule_id"], "left_semi").unionByName(rules.join(cover.select("g").distinct(), "g", "left_anti")))
        own = tx.where("tid = 0").drop("is_prune")
        predicted = classify(own, importance(kept, training))
        agreed = stored(predicted.join(own.select("g", "class"), "g").where("predicted = class").select("g", F.col("class").alias("own")))
        others = agreed.join(tx.groupBy("g", "class").agg(F.count("*").alias("n")), "g", "left")
        classes = others.groupBy("g", "own").agg(F.max_by(F.when(F.col("class") != F.col("own"), F.col("class")), F.when(F.col("class") != F.col("own"), F.col("n")).otherwise(-1)).alias("next"))
        got = stored(feature_importance(kept, own, classes, item_features).withColumn("attempt", F.lit(turn)))
        done = got if done is None else done.unionByName(got)
        open_ = stored(open_.join(agreed.select(F.col("g").alias(key)), key, "left_anti"))
    never = open_.select(F.col(key).alias("g"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("int").alias("attempt"))
    return done.unionByName(never).withColumnRenamed("g", key)
