"""Explanations over bins: names, shares, values inside bins, and the fit itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.operators import bins, tabular

MODEL = "CASE WHEN a > 4 THEN 2.0 ELSE 0.0 END + CASE WHEN c = 'x' THEN 0.5 ELSE 0.0 END + 0.01 * b"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.gamma(3, 1.5)), float(rng.normal(10, 4)), str(rng.choice(list("xyz"), p=[0.5, 0.3, 0.2]))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string").cache()
    return df, bins.quartile_bins(df, ["a", "b"])


def test_neighbourhood(spark, made):
    df, edges = made
    own = df.where("id < 3")
    rows = tabular.binned_neighbourhood(own, df, "id", ["a", "b"], edges, ["c"], 2000).cache()
    assert rows.count() == 3 * 2001
    first = {r.id: r for r in own.collect()}
    assert all((r.a, r.b, r.c, r.same_a, r.same_b, r.same_c) == (first[r.id].a, first[r.id].b, first[r.id].c, 1, 1, 1) for r in rows.where("rep = 0").collect())
    e = {r.feature: r.edges for r in edges.collect()}
    stats = {(r.feature, r.bin): r for r in bins.bin_stats(df, edges, ["a", "b"]).collect()}
    drawn = rows.where("rep > 0").toPandas()
    for f in "ab":
        bin_ = np.searchsorted(e[f], drawn[f].to_numpy(), "left")
        share = np.bincount(bin_, minlength=4) / len(drawn)
        assert np.allclose(share, 0.25, atol=0.03)
        mine = {i: int(np.searchsorted(e[f], first[i][f], "left")) for i in first}
        assert np.mean((bin_ == drawn.id.map(mine)) == (drawn[f"same_{f}"] == 1)) > 0.999  # an end of a bin may round to the next
        for k in range(4):  # as many values below each quantile of the normal, cut off at the ends, as there should be
            s, x = stats[f, k], np.sort(drawn[f].to_numpy()[bin_ == k])
            cdf = lambda v: 0.5 * (1 + math.erf((v - s["mean"]) / s["std"] / math.sqrt(2)))  # noqa: B023, E731
            lo, hi = cdf(s["lo"]), cdf(s["hi"])
            assert x.min() >= s["lo"] - 1e-9 and x.max() <= s["hi"] + 1e-9
            at = [(cdf(v) - lo) / (hi - lo) for v in x[:: max(len(x) // 20, 1)]]
            assert np.allclose(at, np.arange(len(at)) / len(at), atol=0.06)
    assert np.allclose(drawn.c.value_counts(normalize=True)[["x", "y", "z"]], df.toPandas().c.value_counts(normalize=True)[["x", "y", "z"]], atol=0.03)


def test_explanation(spark, made):
    """The weights are those of a ridge fit on the draws; names are those of the instance's own bins."""
    df, edges = made
    own = df.where("id < 4")
    out = tabular.explain_tabular(own, df, "id", ["a", "b"], edges, ["c"], MODEL, n=600).collect()
    rows = tabular.binned_neighbourhood(own, df, "id", ["a", "b"], edges, ["c"], 600).withColumn("y", F.expr(MODEL)).toPandas()
    e = {r.feature: r.edges for r in edges.collect()}
    for r in own.collect():
        mine = rows[rows.id == r.id]
        x, y = mine[["same_a", "same_b", "same_c"]].to_numpy(float), mine.y.to_numpy()
        d = np.sqrt(3 - x.sum(1))
        w = np.sqrt(np.exp(-(d**2) / (0.75 * math.sqrt(3)) ** 2))
        xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
        coef = np.linalg.solve(xc.T @ (w[:, None] * xc) + np.eye(3), xc.T @ (w * yc))
        got = {o.feature: o for o in out if o.id == r.id}
        assert np.allclose([got[f].weight for f in "abc"], coef)
        assert sorted(got, key=lambda f: -abs(got[f].weight)) == sorted(got, key=lambda f: got[f]["rank"])
        k = int(np.searchsorted(e["a"], r.a, "left"))
        name = f"a <= {e['a'][0]:.2f}" if k == 0 else f"a > {e['a'][2]:.2f}" if k == 3 else f"{e['a'][k - 1]:.2f} < a <= {e['a'][k]:.2f}"
        assert got["a"].name == name and got["c"].name == f"c={r.c}"
    assert all(o["rank"] == 1 for o in out if o.feature == "a")  # what the model looks at most


def test_chosen_features(spark, made):
    df, edges = made
    out = tabular.explain_tabular(df.where("id < 4"), df, "id", ["a", "b"], edges, ["c"], MODEL, n=400, k=1).collect()
    assert len(out) == 4 and all(o.feature == "a" and o["rank"] == 1 for o in out)
    assert tabular.explain_tabular(df.limit(0), df, "id", ["a", "b"], edges, ["c"], MODEL, n=10).isEmpty()
