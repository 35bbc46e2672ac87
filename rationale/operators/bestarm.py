"""Anchors by best-arm identification: only contested candidates draw again.

A candidate of an instance is a set of its features (a bit mask), held at the
instance's bin or category while the others come from a background row.  Its
precision is the share of such draws with the instance's label.  All instances go
through the same rounds together: in each, an instance whose best candidates aren't
yet told from the rest asks for draws of two of them, the worst of the best by its
lower bound and the best of the rest by its upper one.  So a round is one scoring
call, which shrinks as instances are decided; batches grow by ``growth`` a round, so
rounds are few.

Draws are keyed by instance, candidate and number: the same on every partitioning.

Where a candidate has few possible draws (``COUNTED``: background rows times the values
of the bins held), all of them are counted instead, once for all instances that hold the
same: its precision is then known, and nothing is left to chance.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from rationale.functions.draws import MODULUS, codes_of, uniform
from rationale.functions.small import beside, small
from rationale.functions.special import kl_bound, kl_bounds
from rationale.functions.spread import spread
from rationale.sources.scratch import stored

from .bins import bin_of
from .score import score

Draw = Callable[[DataFrame], DataFrame]
COUNTED = 10_000  # possible draws of a candidate up to which each is taken once


def _bin(x: Column, edges: Column) -> Column:
    """A name of the bin; nulls are a bin of their own, and so are all values without edges."""
    return F.when(x.isNull(), "").otherwise(F.coalesce(bin_of(x, edges), F.lit(0)).cast("string"))


def _added(arms: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """``arms`` with the draws of ``hits`` (key, arm, size, hits); ``n`` is how many there are."""
    both = arms.select(key, "arm", "n", "positives").union(hits.select(key, "arm", "size", "hits"))
    return both.groupBy(key, "arm").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def _contested(top: int, epsilon: float, delta: float, t: int):
    """Of all arms of each key, the two that are to be told apart: the worst of the best and the best of the rest."""

    @F.pandas_udf(StructType([StructField("arm", ArrayType(LongType())), StructField("n", ArrayType(LongType()))]))
    def two(arms: pd.Series, ns: pd.Series, hits: pd.Series) -> pd.DataFrame:
        lens = arms.str.len().to_numpy("int64")
        arm, n, positives = (np.concatenate([*x, np.zeros(0, "int64")]).astype("int64") for x in (arms, ns, hits))
        row = np.repeat(np.arange(len(lens)), lens)
        mean, level = positives / n, np.log(405.5 * lens[row] * t**1.1 / delta)
        beta = (level + np.log(level)) / n
        lower, upper = kl_bounds(mean, beta, False), kl_bounds(mean, beta, True)
        by = np.lexsort((arm, -mean, row))
        inside = np.empty(len(by), bool)
        inside[by] = np.arange(len(by)) - np.repeat(np.cumsum(lens) - lens, lens) < top
        ends = []
        for side, order in ((inside, np.lexsort((n, arm, lower, row))), (~inside, np.lexsort((-n, arm, -upper, row)))):
            order = order[side[order]]
            first = np.full(len(lens), -1)
            first[row[order][::-1]] = order[::-1]
            ends.append(first)
        low, high = ends
        open_ = (lens > top) & (upper[high] - lower[low] > epsilon) if len(arm) else np.zeros(len(lens), bool)
        pick = lambda x: [[x[i], x[j]] if o else [] for i, j, o in zip(low, high, open_, strict=True)]
        return pd.DataFrame({"arm": pick(arm), "n": pick(n)})

    return two("arms", "ns", "hits")


def best_arms(arms: DataFrame, key: str, draw: Draw, top: int, epsilon: float = 0.1, delta: float = 0.05, batch: int = 100, growth: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """The ``top`` arms of each key by their means, up to ``epsilon`` with confidence 1 - ``delta``, and all arms as they were left.

    ``arms`` has (key, arm, n, positives) with what was drawn so far; ``draw`` turns
    (key, arm, n, size) into (key, arm, size, hits) for draws n + 1 to n + size.  Arms
    without draws get one batch; equal means go by the smaller arm.  The arms of a key
    are one row, with the two that it asks for, so that a round is one job.  A key that
    is decided leaves, though the bounds of later rounds are wider: else the rounds, and
    with them the batches, would grow with the number of keys.
    """
    arms = stored(arms.select(key, "arm", F.col("n").cast("long").alias("n"), F.col("positives").cast("long").alias("positives")))
    asked = arms.where("n = 0").select(key, "arm", "n", F.lit(batch).cast("long").alias("size"))
    size, t, done = float(batch), 1, None
    while True:
        added = _added(arms, draw(asked), key)
        lists = added.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("arm", "n", "positives"))).alias("of"))
        lists = lists.select(key, "of", *[F.col(f"of.{c}").alias(k) for c, k in (("arm", "arms"), ("n", "ns"), ("positives", "hits"))])
        state = stored(lists.select(key, "of", _contested(top, epsilon, delta, t).alias("two")))
        told = state.where("size(two.arm) = 0").select(key, F.inline("of"))
        done = told if done is None else done.union(told)
        state = state.where("size(two.arm) > 0")
        if state.isEmpty():
            by_mean = Window.partitionBy(key).orderBy(F.desc(F.col("positives") / F.col("n")), "arm")
            return done.withColumn("r_rank", F.row_number().over(by_mean)).where(F.col("r_rank") <= top).select(key, "arm", "n", "positives"), done
        arms = state.select(key, F.inline("of"))
        asked = state.select(key, F.inline(F.arrays_zip("two.arm", "two.n")).alias("arm", "n")).withColumn("size", F.lit(int(size)).cast("long"))
        size, t = size * growth, t + 1


def settled(arms: DataFrame, key: str, draw: Draw, threshold: float, epsilon: float = 0.05, delta: float = 0.05, batch: int = 100, growth: float = 1.5) -> DataFrame:
    """``arms`` with ``accepted``: drawn until each is told to reach the threshold, up to ``epsilon``, or not to."""
    size, beta = float(batch), F.log(F.lit(1 / delta))
    while True:
        mean = F.col("positives") / F.col("n")
        lower, upper = kl_bound(mean, beta / F.col("n"), False), kl_bound(mean, beta / F.col("n"), True)
        told = stored(arms.select(key, "arm", "n", "positives", mean.alias("r_mean"), lower.alias("r_lower"), upper.alias("r_upper")))
        high = F.col("r_mean") >= threshold
        doubtful = told.where((high & (F.col("r_lower") < threshold - epsilon)) | (~high & (F.col("r_upper") >= threshold + epsilon)))
        if doubtful.isEmpty():
            return told.select(key, "arm", "n", "positives", (high & (F.col("r_lower") > threshold - epsilon)).alias("accepted"))
        arms = _added(told, draw(doubtful.select(key, "arm", "n", F.lit(int(size)).cast("long").alias("size"))), key)
        size *= growth


def best_arm_anchors(instances: DataFrame, background: DataFrame, key: str, features: list[str], edges: DataFrame, categories: list[str], model, threshold: float = 0.95, beam: int = 2, max_size: int = 3, epsilon: float = 0.1, epsilon_stop: float = 0.05, delta: float = 0.05, batch: int = 100, growth: float = 1.5, seed: int = 1) -> DataFrame:
    """(key, anchor, precision, coverage, draws, accepted): the features of the anchor with the largest coverage that keeps the label.

    ``features`` are numeric with (feature, edges), ``categories`` are text.  A numeric
    feature that is held is drawn from the background's values in its bin (its own
    value, if there are none).  Without an accepted anchor the most precise candidate
    is returned.  ``draws`` counts all draws of the instance, or those that its candidates
    have.  ``key`` is a unique whole number; an empty background gives no rows.
    """
    names = [*features, *categories]
    if len(names) > 62:
        raise ValueError("features are the bits of a long: at most 62")
    behind = stored(background.select(*[F.col(f).cast("double").alias(f"r_x{i}") for i, f in enumerate(features)], *[F.col(c).cast("string").alias(f"r_x{i}") for i, c in enumerate(categories, len(features))]))
    if behind.isEmpty() or instances.isEmpty() or not names:
        return instances.sparkSession.createDataFrame([], f"`{key}` long, anchor array<string>, precision double, coverage double, draws long, accepted boolean")
    all_edges = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("m"))
    behind = behind.join(F.broadcast(all_edges)).withColumns({**{f"r_b{i}": _bin(F.col(f"r_x{i}"), F.col("m")[F.lit(f)]) for i, f in enumerate(features)}, **{f"r_b{i}": F.coalesce(f"r_x{i}", F.lit("")) for i in range(len(features), len(names))}}).drop("m")
    places = range(len(names))
    # one row: the background's rows in an order of their own, the sorted values of each numeric feature and where its bins begin
    ordered = F.array_sort(F.collect_list(F.struct(*[f"r_x{i}" for i in places])))
    lists = small(behind, "a background").agg(ordered.alias("r_rows"), *[F.array_sort(F.collect_list(F.struct("r_x%d" % i, f"r_b{i}"))).alias(f"r_v{i}") for i in range(len(features))])
    lists = stored(lists)
    own = score(instances.select(key, *[F.col(f).cast("double").alias(f) for f in features], *[F.col(c).cast("string").alias(c) for c in categories]), model, "r_wanted", names)
    bins = {**{f"r_b{i}": _bin(F.col(f), F.col("m")[F.lit(f)]) for i, f in enumerate(features)}, **{f"r_b{i}": F.coalesce(F.col(c), F.lit("")) for i, c in enumerate(categories, len(features))}}
    own = own.join(F.broadcast(all_edges)).withColumns(bins).select(key, F.col("r_wanted").cast("string").alias("r_wanted"), *[F.col(f).alias(f"r_x{i}") for i, f in enumerate(names)], *[f"r_b{i}" for i in places])
    picked = small(stored(lists.select(F.posexplode("r_rows").alias("r_pick", "r_row")).select("r_pick", *[F.col(f"r_row.r_x{i}").alias(f"r_y{i}") for i in places])), "a background")
    total = picked.count()
    for i in range(len(features)):
        at = lists.select(F.posexplode(f"r_v{i}").alias("r_place", "v")).groupBy(F.col(f"v.r_b{i}").alias(f"r_b{i}")).agg(F.min("r_place").alias(f"r_at{i}"), F.count("*").alias(f"r_n{i}"))
        own = own.join(F.broadcast(at), f"r_b{i}", "left")
    own = stored(own)
    values = [small(stored(lists.select(F.posexplode(f"r_v{i}").alias(f"r_d{i}", "v")).select(f"r_d{i}", F.col(f"v.r_x{i}").alias(f"r_w{i}"))), "a background") for i in range(len(features))]

    @F.pandas_udf(StructType([StructField(f"d{i}", ArrayType(IntegerType())) for i in range(len(features) + 1)]))
    def drawn_places(ids: pd.Series, arm: pd.Series, n: pd.Series, size: pd.Series, *spans: pd.Series) -> pd.DataFrame:
        """A row of the background for each draw, then the place of each numeric feature that is held."""
        arm, start = arm.to_numpy("int64"), (ids.to_numpy("int64") % MODULUS) * 16807 + seed * 31 + 1
        reps = [np.arange(a + 1, a + m + 1) % MODULUS * 7919 for a, m in zip(n, size, strict=True)]

        def places(of: np.ndarray, i: int, first: np.ndarray, width: np.ndarray) -> list:
            out = [None] * len(arm)
            for row in np.flatnonzero(of):
                u = (codes_of(start[row] + reps[row] + (int(arm[row]) * 64 + i) % MODULUS * 104729) + 0.5) / float(MODULUS)
                out[row] = (first[row] + np.floor(u * width[row])).astype("int32")
            return out

        zero, every = np.zeros(len(arm)), np.ones(len(arm), bool)
        found = {"d0": places(every, 63, zero, zero + total)}
        for i in range(len(features)):
            first, width = spans[2 * i].to_numpy(float), spans[2 * i + 1].fillna(0).to_numpy(float)
            found[f"d{i + 1}"] = places((arm >> i & 1 == 1) & (width > 0), i, first, width)
        return pd.DataFrame(found)

    def draw(asked: DataFrame) -> DataFrame:
        rows = spread(asked, key).join(own, key)
        rows = rows.withColumn("r_d", drawn_places(F.col(key).cast("bigint"), "arm", "n", "size", *[f"r_{k}{i}" for i in range(len(features)) for k in ("at", "n")]))
        zipped = F.arrays_zip(*[F.coalesce(f"r_d.d{i}", F.array_repeat(F.lit(None).cast("int"), F.col("size").cast("int"))) for i in range(len(features) + 1)])
        rows = rows.select(key, "arm", "size", "r_wanted", *[f"r_x{i}" for i in places], F.inline(zipped).alias("r_pick", *[f"r_d{i}" for i in range(len(features))])).join(picked, "r_pick")
        for i, of in enumerate(values):
            rows = rows.join(of, f"r_d{i}", "left")

        def value(i: int) -> Column:
            return F.col(f"r_x{i}") if i >= len(features) else F.when(F.col(f"r_d{i}").isNull(), F.col(f"r_x{i}")).otherwise(F.col(f"r_w{i}"))

        mixed = rows.select(F.col(key).alias("r_key"), F.col("arm").alias("r_arm"), F.col("size").alias("r_size"), "r_wanted", *[F.when(F.getbit("arm", F.lit(i)) == 1, value(i)).otherwise(F.col(f"r_y{i}")).alias(f) for i, f in enumerate(names)])
        scored = score(mixed, model, "r_label", names)
        return scored.groupBy(F.col("r_key").alias(key), F.col("r_arm").alias("arm")).agg(F.first("r_size").alias("size"), F.count_if(F.col("r_label").cast("string") == F.col("r_wanted")).alias("hits"))

    widths = [own.agg(F.coalesce(F.max(f"r_n{i}"), F.lit(1))).first()[0] for i in range(len(features))]
    instance, whole, profile = key, own, None
    counting = total * math.prod(sorted(widths)[-max_size:] if max_size else []) <= COUNTED
    if counting:
        # what is held, and so what is counted, is the same for instances with the same bins, categories and label
        key, profile = "r_profile", F.struct("r_wanted", *[f"r_b{i}" for i in places], *[F.when(F.col(f"r_n{i}").isNull(), F.col(f"r_x{i}")) if i < len(features) else F.col(f"r_x{i}") for i in places])
        kinds = own.withColumn("r_of", profile).groupBy("r_of").agg(F.first(F.struct(*[c for c in own.columns if c != instance])).alias("r"))
        own = stored(kinds.select(F.monotonically_increasing_id().alias(key), "r_of", "r.*"))

    def counted(candidates: DataFrame) -> DataFrame:
        """(key, arm, n, positives) of all possible draws."""
        parts = [F.struct(*[F.when(F.getbit("arm", F.lit(i)) == 1, x) for x in ((F.col(f"r_at{i}"), F.col(f"r_n{i}"), F.when(F.col(f"r_n{i}").isNull(), F.col(f"r_x{i}"))) if i < len(features) else (F.col(f"r_x{i}"),))]) for i in places]
        held = candidates.select(key, "arm").join(own, key).select(key, "arm", "r_wanted", F.struct("arm", *[x.alias(f"p{i}") for i, x in enumerate(parts)]).alias("r_s"))
        sets = stored(held.select("r_s").distinct().withColumn("r_set", F.monotonically_increasing_id()))
        rows = spread(sets, "r_set").select("r_set", "r_s.*").join(picked)
        for i, of in enumerate(values):
            first, width = (F.col(f"p{i}.col{j}").cast("int") for j in (1, 2))
            rows = rows.withColumn(f"r_d{i}", F.explode(F.when(width.isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(first, first + width - 1)))).join(of, f"r_d{i}", "left")
        taken = [F.when(F.col(f"r_d{i}").isNull(), F.col(f"p{i}.col3")).otherwise(F.col(f"r_w{i}")) if i < len(features) else F.col(f"p{i}.col1") for i in places]
        mixed = rows.select("r_set", *[F.when(F.getbit("arm", F.lit(i)) == 1, taken[i]).otherwise(F.col(f"r_y{i}")).alias(f) for i, f in enumerate(names)])
        labels = stored(score(mixed, model, "r_label", names).groupBy("r_set", F.col("r_label").cast("string").alias("r_label")).agg(F.count("*").alias("c")))
        wanted = labels.select("r_set", F.col("r_label").alias("r_wanted"), F.col("c").alias("positives"))
        numbered = held.join(sets, "r_s").drop("r_s").join(labels.groupBy("r_set").agg(F.sum("c").alias("n")), "r_set")
        return numbered.join(wanted, ["r_set", "r_wanted"], "left").select(key, "arm", "n", F.coalesce("positives", F.lit(0)).alias("positives"))

    def told(arms: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
        """The ``top`` arms of each key, and all of them."""
        if not counting:
            return best_arms(arms, key, draw, top, epsilon, delta, batch, growth)
        arms = stored(counted(arms))
        by_mean = Window.partitionBy(key).orderBy(F.desc(F.col("positives") / F.col("n")), "arm")
        return arms.withColumn("r_rank", F.row_number().over(by_mean)).where(F.col("r_rank") <= top).drop("r_rank"), arms

    def decided(top: DataFrame) -> DataFrame:
        if not counting:
            return settled(top, key, draw, threshold, epsilon_stop, delta / (1 + (beam - 1) * len(names)), batch, growth)
        return top.withColumn("accepted", F.col("positives") / F.col("n") >= threshold)

    cells = stored(behind.groupBy(*[f"r_b{i}" for i in places]).agg(F.count("*").alias("of")))
    bits = own.select(key, *[f"r_b{i}" for i in places])

    def with_coverage(candidates: DataFrame) -> DataFrame:
        """Of the distinct sets of held bins; (key, arm, coverage)."""
        held = candidates.join(bits, key).withColumn("set", F.array(*[F.when(F.getbit("arm", F.lit(i)) == 1, F.col(f"r_b{i}")) for i in places]))
        sets = held.select("arm", "set").distinct()
        meets = lambda i: F.col("set")[i].isNull() | (F.col("set")[i] == F.col(f"r_b{i}"))
        inside = meets(0)
        for i in places[1:]:
            inside = inside & meets(i)
        counts = sets.join(small(cells, "the background's cells")).where(inside).groupBy("set").agg((F.sum("of") / F.lit(float(total))).alias("coverage"))
        same = held.join(counts.withColumnRenamed("set", "s"), F.col("set").eqNullSafe(F.col("s")), "left")
        return same.select(key, "arm", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))

    candidates = own.select(key, F.explode(F.array(*[F.lit(1 << i).cast("long") for i in places])).alias("arm"))
    chosen_of_all, best, drawn = None, None, None
    for size in range(1, max_size + 1):
        covered = with_coverage(candidates)
        if best is not None:
            covered = covered.join(best.select(key, F.col("coverage").alias("b")), key, "left").where("b is null or coverage > b").drop("b")
        covered = stored(covered)
        if covered.isEmpty():
            break
        arms = covered.select(key, "arm", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("positives"))
        top, left = told(arms, beam)
        final = stored(decided(top).join(covered, [key, "arm"]))
        spent = left.join(final.select(key, "arm", F.col("n").alias("n2")), [key, "arm"], "left").groupBy(key).agg(F.sum(F.coalesce("n2", "n")).alias("draws"))
        drawn = spent if drawn is None else drawn.union(spent)
        chosen_of_all = final if chosen_of_all is None else chosen_of_all.union(final)
        best = stored(chosen_of_all.where("accepted").groupBy(key).agg(F.max_by(F.struct("arm", "n", "positives", "coverage"), F.struct("coverage", (-F.bit_count("arm")).alias("s"), (-F.col("arm")).alias("a"))).alias("b")).select(key, "b.*"))
        candidates = final.select(key, "arm").withColumn("bit", F.explode(F.array(*[F.lit(1 << i).cast("long") for i in places]))).where(F.col("arm").bitwiseAND(F.col("bit")) == 0).select(key, F.col("arm").bitwiseOR(F.col("bit")).alias("arm")).distinct()
    rest = stored(chosen_of_all.join(best, key, "left_anti").select(key, "arm", "n", "positives"))
    if rest.isEmpty():
        fallback = rest
    else:
        fallback, left = told(rest, 1)
        spent = left.withColumnRenamed("n", "n2").join(rest.select(key, "arm", "n"), [key, "arm"]).groupBy(key).agg(F.sum(F.col("n2") - F.col("n")).alias("draws"))
        drawn = drawn.union(spent)
    found = best.select(key, "arm", "n", "positives", "coverage", F.lit(True).alias("accepted")).union(fallback.join(chosen_of_all.select(key, "arm", "coverage"), [key, "arm"]).select(key, "arm", "n", "positives", "coverage", F.lit(False)))
    anchor = F.filter(F.array(*[F.when(F.getbit("arm", F.lit(i)) == 1, F.lit(f)) for i, f in enumerate(names)]), lambda x: x.isNotNull())
    found = found.join(drawn.groupBy(key).agg(F.sum("draws").alias("draws")), key)
    if counting:
        found = whole.select(instance, profile.alias("r_of")).join(beside(stored(found.join(own.select(key, "r_of"), key).drop(key))), "r_of")
    return found.select(instance, anchor.alias("anchor"), (F.col("positives") / F.col("n")).alias("precision"), "coverage", "draws", "accepted")
