"""Best-arm anchors against the exact precision of every candidate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.operators import bestarm

EDGES = {"a": [3.0, 6.0], "b": [5.0]}
MODEL = "CASE WHEN (a > 6 AND c = 'x') OR b > 5 AND d = 'p' THEN 'Y' ELSE 'N' END"
NAMES = ["a", "b", "c", "d"]


def label(r):
    return "Y" if (r["a"] > 6 and r["c"] == "x") or (r["b"] > 5 and r["d"] == "p") else "N"


def cell(r):
    return (sum(e < r["a"] for e in EDGES["a"]), sum(e < r["b"] for e in EDGES["b"]), r["c"], r["d"])


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 10)), float(rng.integers(0, 10)), str(rng.choice(list("xyz"))), str(rng.choice(list("pq")))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, d string").repartition(3).cache()
    return df, spark.createDataFrame(list(EDGES.items()), "feature string, edges array<double>")


def precision(mask, x, back):
    """Held bins come from the background's values in the bin, each as likely; labels depend on bins alone."""
    mine = cell(x)
    return sum(label({f: (x if mask >> i & 1 else b)[f] for i, f in enumerate(NAMES)}) == label(x) for b in back) / len(back), sum(all(cell(b)[i] == mine[i] for i in range(4) if mask >> i & 1) for b in back) / len(back)


def test_anchors(spark, made):
    """What is accepted is precise and, among all clear cases, covers most; few draws are spent on the others."""
    df, edges = made
    rows = [r.asDict() for r in df.collect()]
    found = bestarm.best_arm_anchors(df, df, "id", ["a", "b"], edges, ["c", "d"], MODEL, threshold=0.95, beam=3, max_size=3, epsilon=0.15, batch=300, growth=2.0)
    got = {r.id: r for r in found.collect()}
    assert len(got) == 60
    candidates = [m for m in range(1, 16) if bin(m).count("1") <= 3]
    for x in rows:
        r = got[x["id"]]
        exact = {m: precision(m, x, rows) for m in candidates}
        mask = sum(1 << NAMES.index(f) for f in r.anchor)
        assert abs(r.coverage - exact[mask][1]) < 1e-9 and r.accepted
        assert exact[mask][0] > 0.9 and abs(exact[mask][0] - r.precision) < 0.08
        if exact[mask][0] > 0.99:  # of those of one size that are sure
            assert r.coverage >= max(c for m, (p, c) in exact.items() if p == 1 and bin(m).count("1") == 1) if any(p == 1 and bin(m).count("1") == 1 for m, (p, _) in exact.items()) else True
    again = {r.id: r for r in bestarm.best_arm_anchors(df.repartition(5), df.repartition(2), "id", ["a", "b"], edges, ["c", "d"], MODEL, threshold=0.95, beam=3, max_size=3, epsilon=0.15, batch=300, growth=2.0).collect()}
    assert again == got


def test_only_contested_arms_draw(spark):
    """Same best arms as drawing all of them equally often, with fewer draws."""
    truth = {0: 0.95, 1: 0.9, 2: 0.3, 3: 0.25, 4: 0.2, 5: 0.1}
    chance = F.element_at(F.create_map(*[F.lit(x) for kv in truth.items() for x in kv]), F.col("arm").cast("int"))

    def draw(asked):
        rows = asked.withColumn("rep", F.explode(F.sequence(F.col("n") + 1, F.col("n") + F.col("size"))))
        hit = bestarm.uniform(5, F.col("k"), F.col("rep"), F.col("arm")) < chance
        return rows.groupBy("k", "arm").agg(F.first("size").alias("size"), F.count_if(hit).alias("hits"))

    arms = spark.createDataFrame([(k, a, 0, 0) for k in range(5) for a in truth], "k long, arm long, n long, positives long")
    top, left = bestarm.best_arms(arms, "k", draw, 2, epsilon=0.2, batch=40)
    assert all(sorted(r["arm"] for r in top.where(f"k = {k}").collect()) == [0, 1] for k in range(5))
    spent = left.groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    assert all(r.n < 0.7 * r.most * len(truth) for r in spent)
    few = arms.where("arm < 2")
    assert bestarm.best_arms(few, "k", draw, 2)[0].count() == 10  # nothing to tell apart: one batch each


def test_settled(spark):
    arms = spark.createDataFrame([(0, 0, 40, 40), (0, 1, 40, 10)], "k long, arm long, n long, positives long")
    out = bestarm.settled(arms, "k", lambda a: a.select("k", "arm", "size", F.when(F.col("arm") == 0, F.col("size")).otherwise(0).alias("hits")), 0.95)
    assert {r["arm"]: r.accepted for r in out.collect()} == {0: True, 1: False}


def test_edges(spark, made):
    df, edges = made
    args = ("id", ["a", "b"], edges, ["c", "d"], MODEL)
    assert bestarm.best_arm_anchors(df, df.limit(0), *args).isEmpty()
    assert bestarm.best_arm_anchors(df.limit(0), df, *args, max_size=1).isEmpty()
    odd = spark.createDataFrame([(1, None, 50.0, None, "new"), (2, 4.0, 4.0, "y", "q")], "id long, a double, b double, c string, d string")
    got = bestarm.best_arm_anchors(odd, df, *args, max_size=2).collect()
    assert sorted(r.id for r in got) == [1, 2] and all(set(r.anchor) <= set(NAMES) for r in got)
    none = bestarm.best_arm_anchors(df.where("id < 3"), df, *args[:-1], "CASE WHEN rand(1) < 0.5 THEN 'Y' ELSE 'N' END", max_size=1).collect()
    assert len(none) == 3 and not any(r.accepted for r in none)


def test_decided_keys_leave(spark):
    """a key that is told apart draws no more, however many rounds other keys go on and widen their bounds."""
    arms = spark.createDataFrame([(k, arm, 300, hits) for k, of in ((1, (168, 268, 199)), (2, (150, 266, 150))) for arm, hits in zip((1, 2, 4), of, strict=True)], "k long, arm long, n long, positives long")
    asked_of = []

    def draw(asked):
        asked_of.append({r["k"] for r in asked.select("k").distinct().collect()})
        return asked.select("k", "arm", "size", F.floor(F.col("size") / 2).cast("long").alias("hits"))

    top, left = bestarm.best_arms(arms, "k", draw, 2, epsilon=0.2, batch=60, growth=1.0)
    assert len(asked_of) >= 8 and all(1 not in keys for keys in asked_of)
    assert left.where("k = 1").agg(F.sum("n")).first()[0] == 900 and top.count() == 4
