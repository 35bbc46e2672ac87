"""Running sums and numbers in an order, without a window over a whole table or a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rationale.sources.scratch import stored


def running(df: DataFrame, order: list[str], sums: dict[str, Column], group: tuple[str, ...] = ()) -> DataFrame:
    """With running sums (of rows up to this one) in the order of columns, within each group.

    Rows are sorted by ranges of group and order; each range adds up for itself,
    on top of the totals of the ranges before it.  A group may span many ranges;
    the totals are one row for each range and group in it.  Rows with equal order
    are taken in any order, so the order should be unique.
    """
    keys = [*group, *order]
    kept = stored(df.withColumns({f"add_{k}": x for k, x in sums.items()}).repartitionByRange(*keys).withColumn("r_part", F.spark_partition_id()))
    totals = kept.groupBy("r_part", *group).agg(*[F.sum(f"add_{k}").alias(f"own_{k}") for k in sums])
    by_range = Window.partitionBy(*group).orderBy("r_part")
    before = totals.select(F.col("r_part").alias("b_part"), *[F.col(g).alias(f"b_{g}") for g in group], *[(F.sum(f"own_{k}").over(by_range) - F.col(f"own_{k}")).alias(f"before_{k}") for k in sums])
    inside = Window.partitionBy("r_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = kept.select("*", *[F.sum(f"add_{k}").over(inside).alias(k) for k in sums])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"b_{g}")) for g in group], F.col("r_part") == F.col("b_part"))
    return local.join(before, same).select(*[F.col(c) for c in df.columns], *[(F.col(k) + F.col(f"before_{k}")).alias(k) for k in sums])


def numbered(df: DataFrame, order: list[str], name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """With ``name``: the place of each row in its group, from 0."""
    return running(df, order, {name: F.lit(1).cast("long")}, group).withColumn(name, F.col(name) - 1)


def percentiles(values: DataFrame, value: str, shares: list[float], group: tuple[str, ...] = ()) -> DataFrame:
    """(group..., percentiles): exact, between neighbours by proportion; nulls don't count.

    Equal values are counted first, and the counts added up in order.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("r_n"))
    up_to = running(counts, [value], {"r_up": F.col("r_n")}, group)
    if group:
        of = up_to.groupBy(*group).agg(F.max("r_up").alias("r_all")).select(*[F.col(g).alias(f"b_{g}") for g in group], "r_all")
        up_to = up_to.join(of, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"b_{g}")) for g in group]))
    else:
        up_to = up_to.join(F.broadcast(up_to.agg(F.max("r_up").alias("r_all"))))
    at = [F.lit(s) * (F.col("r_all") - 1) for s in shares]
    ends = [F.min(F.when(F.col("r_up") > f(p), F.col(value).cast("double"))) for p in at for f in (F.floor, F.ceil)]
    found = up_to.groupBy(*group).agg(F.max("r_all").alias("r_all"), *[e.alias(f"e_{i}") for i, e in enumerate(ends)])
    between = [F.col(f"e_{2 * i}") + (p - F.floor(p)) * (F.col(f"e_{2 * i + 1}") - F.col(f"e_{2 * i}")) for i, p in enumerate(at)]
    return found.select(*group, F.array(*between).alias("percentiles"))
