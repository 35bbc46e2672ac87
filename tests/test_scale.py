"""Steps whose cost was out of proportion to their input: what they leave out of the plan, and that results stay."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.operators import anchors as J
from rationale.operators import evaluate as L
from rationale.operators import linear as G
from rationale.operators import neighbours as E
from rationale.operators import texts as T
from rationale.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_pairs_of_runs_without_a_join(spark):
    """Rankings of a small table are many rows; joined to themselves, they were taken for small and sent through the driver."""
    users = spark.range(200).withColumnRenamed("id", "instance_id")
    runs = L.random_rankings(users, ["a", "b", "c"], 4)
    found = L.rank_stability(runs)
    assert "Join" not in plan(found)
    rows = {(r.instance_id, r["rank"], r.run): r.feature for r in runs.collect()}
    for r in found.collect():
        pairs = [rows[i, r["rank"], a] == rows[i, r["rank"], b] for i in range(200) for a in range(1, 5) for b in range(a + 1, 5)]
        assert r.value == pytest.approx(np.mean(pairs))
    odd = spark.createDataFrame([(1, 1, "a", 1), (1, 2, None, 1), (1, 3, "a", 1), (None, 1, "a", 1), (None, 2, "b", 1)], "instance_id int, run int, feature string, rank int")
    assert [(r["rank"], r.value) for r in L.rank_stability(odd).collect()] == [(1, 1.0)]


def test_beams_once_a_profile(spark):
    """Instances with equal predicates share one search, and all of them get its answer."""
    preds = [(0, "a", "<=", 4.0, None), (1, "a", ">", 4.0, None), (2, "b", "=", None, "x")]
    rows = spark.createDataFrame([(i, float(i % 10), "xy"[i % 3 % 2], "Y" if i % 10 > 4 and i % 3 % 2 == 0 else "N") for i in range(300)], "k long, a double, b string, y string")
    named = spark.createDataFrame(preds, "pred_id int, feature string, op string, value double, text string")
    own = J.predicate_matrix(rows, named, "k", ["a", "b"], ("y",)).where("holds = 1").select("k", "pred_id", F.col("y").alias("wanted")).join(named, "pred_id")
    found = J.anchor_beam(rows.withColumnRenamed("k", "row_key"), own, "row_key", ["a", "b"], "y", "k", max_size=2)
    got = {r.k: r for r in found.collect()}
    assert len(got) == 300 and "Window [row_number() windowspecdefinition(k#" not in plan(found)
    inside = {0: lambda r: r.a <= 4, 1: lambda r: r.a > 4, 2: lambda r: r.b == "x"}
    for r in rows.collect():
        met = [s for s in rows.collect() if all(inside[p](s) for p in got[r.k].preds)] if r.k < 6 else None
        assert all(inside[p](r) for p in got[r.k].preds)
        if met:
            assert got[r.k].precision == pytest.approx(np.mean([s.y == r.y for s in met])) and got[r.k].coverage == pytest.approx(len(met) / 300)
    assert got[5].accepted == (got[5].precision >= 0.95)


def test_masks_by_codes(spark):
    """What stays in the text is what the list of kept words says, without looking each word up in it."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 40}" for j in range(60)) + ", end.") for i in range(20)], "id long, t string")
    for char_level in (False, True):
        found = T.text_mask(docs, "id", "t", 4, bow=False, char_level=char_level, pattern=r"[^a-zA-Z0-9_]+")
        assert "array_contains" not in plan(found)
        texts = {r.id: r.t for r in docs.collect()}
        for r in found.collect():
            parts = list(texts[r.id]) if char_level else re.findall(r"[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+", texts[r.id])
            words = {p for p in parts if char_level or re.match(r"\w", p)}
            assert r.masked == "".join(p if p not in words or p in set(r.kept) else (" " if char_level else "UNKWORDZ") for p in parts)
            assert len(words) - len(r.kept) == r.removed and r.kept == sorted(r.kept)


def test_lasso_of_features_that_enter_together():
    """The second feature enters a hundredth after the first: the exact path still shows the first alone."""
    assert G._lasso(np.eye(2) * 100, np.array([1.0, 0.99]), 1.0, 1) == [0]
    assert G._lasso(np.eye(2) * 100, np.array([0.0, 0.0]), 1.0, 1) == []


def test_equal_distances_are_equal(spark):
    """Rows as far to the left as to the right tie, so the smaller key goes first."""
    rows = spark.createDataFrame([(i, float(i), "p") for i in range(41)], "k long, a double, y string")
    found = E.closest_rows(rows, rows.where("k % 7 = 3"), "k", ["a"], "y", 7, 0.2).collect()
    for q in (10, 17, 24, 31):
        near = sorted((r.distance, r.k) for r in found if r.instance_id == q)
        assert [k for _, k in near] == [q, q - 1, q + 1, q - 2, q + 2, q - 3, q + 3]


def test_surrogates_that_tie(spark, tmp_path):
    """Scores are added as the SQL does, decimals first: where two labels tie, both sides choose the same."""
    spark.sql("select cast(id as bigint) as p_partkey, cast(id as int) as p_size, cast(500 + 25 * id as double) as p_retailprice from range(1, 51)").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.predicted for r in registry.queries()["g6_surrogate_predict"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == dict(con.execute(registry.oracle_sql()["g6_surrogate_predict"]).fetchall())


def test_category_draws_are_bound(spark):
    """The draw isn't part of the test of each category: the filter over categories names no arithmetic."""
    p = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "k long, c string")
    shares = p.groupBy(F.lit("c").alias("feature"), F.col("c").alias("value")).agg((F.count("*") / 30).alias("share"))
    found = E.lime_sample(p, spark.range(1).select(F.lit(1).alias("one")), shares, "k", [], ["c"], 5)
    tests = re.findall(r"\.hi >= (.{12})", plan(found).split("Optimized Logical Plan")[0])
    assert tests and all(t.startswith("lambda") for t in tests)
    assert found.where("rep = 0 and same_c = 0").isEmpty() and found.count() == 180
