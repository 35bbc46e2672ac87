"""Anchors with few possible draws: all of them are counted."""

from itertools import product

from pyspark.sql import functions as F

from rationale.operators import bestarm

MODEL = "CASE WHEN a > 10 OR c = 'x' THEN 'Y' ELSE 'N' END"


def label(a, c):
    return "Y" if (a is not None and a > 10) or c == "x" else "N"


def test_precisions_are_counted(spark):
    """what is accepted reaches the threshold, and what reaches it is accepted, for any number of instances.

    Holding a <= 10 keeps N in 36 of 40 draws: by draws, some of 400 instances were told to reach 0.93.
    """
    back = [(float(i % 20), "x" if i % 10 == 9 else "yz"[i % 2]) for i in range(40)]
    behind = spark.createDataFrame(back, "a double, c string").repartition(2)
    rows = [(i, float(i % 10), "yzw"[i % 3]) for i in range(400)] + [(1000, 30.0, "y"), (1001, None, None), (1002, 3.0, "x")]
    df = spark.createDataFrame(rows, "id long, a double, c string").repartition(3)
    edges = spark.createDataFrame([("a", [10.0, 25.0])], "feature string, edges array<double>")
    found = bestarm.best_arm_anchors(df, behind, "id", ["a"], edges, ["c"], MODEL, threshold=0.93, beam=2, max_size=2, epsilon=0.15, batch=60, growth=2.0)
    got = {r.id: r for r in found.collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    cell = lambda a: None if a is None else (a > 10) + (a > 25)
    for key, a, c in rows:
        exact = {}
        for mask in (1, 2, 3):
            drawn = [x for x, _ in back if cell(x) == cell(a)] or [a]
            labels = [label(v if mask & 1 else x, c if mask & 2 else y) for (x, y), v in product(back, drawn)]
            covers = sum((not mask & 1 or cell(x) == cell(a)) and (not mask & 2 or y == (c or "")) for x, y in back) / 40
            exact[mask] = labels.count(label(a, c)) / len(labels), covers
        mask = sum(1 << "ac".index(f) for f in got[key].anchor)
        assert abs(got[key].precision - exact[mask][0]) < 1e-12 and abs(got[key].coverage - exact[mask][1]) < 1e-12
        assert got[key].accepted == (exact[mask][0] >= 0.93) == any(p >= 0.93 for p, _ in exact.values())
        if got[key].accepted:
            assert exact[mask][1] == max(k for p, k in exact.values() if p >= 0.93)


def test_models_called_on_batches(spark):
    """The same anchors from a model that is called on pandas frames."""
    df = spark.range(30).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"))
    edges = spark.createDataFrame([("a", [3.0])], "feature string, edges array<double>")
    args = (df, df, "id", ["a"], edges, ["c"])
    sql = bestarm.best_arm_anchors(*args, "CASE WHEN a > 3 AND c = 'x' THEN 'Y' ELSE 'N' END", max_size=2).collect()
    called = bestarm.best_arm_anchors(*args, lambda f: ((f.a > 3) & (f.c == "x")).map({True: "Y", False: "N"}), max_size=2).collect()
    assert sorted(sql) == sorted(called) and len(sql) == 30
