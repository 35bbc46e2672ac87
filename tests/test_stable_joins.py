"""Explanations in rounds: what has a row an instance stays on the executors."""

from pyspark.sql import functions as F

from rationale.functions import small
from rationale.operators import linear, paths
from rationale.sources import scratch


def test_instances_are_not_broadcast(spark, monkeypatch):
    """F8: no table of the rounds with a row an instance is sent through the driver beyond a number of rows, however small its file seems."""
    plans, stored = [], scratch.stored

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    for module in (small, paths):
        monkeypatch.setattr(module, "MOST_ROWS", 0, raising=False)
    monkeypatch.setattr(scratch, "stored", kept)
    monkeypatch.setattr(paths, "stored", kept)

    def make(instances, n):
        rows = instances.select("id", "gap", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("rep"))
        draw = lambda i: F.hash("id", "rep", F.lit(i)) / F.lit(2.0**31)
        rows = rows.select("id", draw(1).alias("a"), draw(2).alias("b"), "gap", draw(3).alias("e"))
        return rows.select("id", "a", "b", (F.col("a") + F.col("gap") * F.col("b") + 0.2 * F.col("e")).alias("y"), F.lit(1.0).alias("w"))

    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, gap double")
    found = linear.stable_explain(df, make, "id", ["a", "b"], "y", "w", 20, 40, k=1)
    assert {r.id: r.n for r in found.collect()}[1] == 20 and found.count() == 2
    assert len(plans) >= 8 and not any("BroadcastHashJoin" in p for p in plans)
