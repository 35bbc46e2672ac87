"""Least-angle paths, own neighbourhood sizes and correlated linear attributions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.operators import linear, linearshap, paths


def correct(xx, xy, path, lasso=True):
    """Active features are level with the penalty, with its sign; the others are below."""
    for lam, _, _, _, coef in path:
        c = xy - xx @ coef
        assert np.all(np.abs(c) <= lam + 1e-7)
        for j in np.flatnonzero(np.abs(coef) > 1e-10):
            assert abs(abs(c[j]) - lam) < 1e-7 and (not lasso or np.sign(c[j]) == np.sign(coef[j]) or lam < 1e-9)


@pytest.mark.parametrize("seed", range(12))
def test_homotopy(seed):
    rng = np.random.default_rng(seed)
    p = int(rng.integers(1, 8))
    x = rng.normal(size=(40, p)) @ rng.normal(size=(p, p)) + rng.normal(size=(40, 1)) * 2
    y = x @ rng.normal(size=p) + rng.normal(size=40) * 3
    x, y = x - x.mean(0), y - y.mean()
    path = paths.homotopy(x.T @ x, x.T @ y)
    correct(x.T @ x, x.T @ y, path)
    levels = [s[0] for s in path]
    assert levels == sorted(levels, reverse=True) and levels[-1] < 1e-6
    assert np.allclose(path[-1][4], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)
    for (a, *_, u), (b, *_, v) in itertools.pairwise(path):  # linear in between
        correct(x.T @ x, x.T @ y, [((a + b) / 2, None, None, None, (u + v) / 2)])


def test_homotopy_drops_features():
    """Over many random problems some features leave again, and the path stays right."""
    drops = 0
    for seed in range(200):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(30, 5)) @ rng.normal(size=(5, 5))
        y = x @ rng.normal(size=5) + rng.normal(size=30)
        path = paths.homotopy(x.T @ x, x.T @ y)
        drops += sum(s[2] is not None for s in path)
        correct(x.T @ x, x.T @ y, path)
        lar = paths.homotopy(x.T @ x, x.T @ y, lasso=False)
        assert len(lar) == 6 and not any(s[2] is not None for s in lar)
    assert drops > 5


def test_homotopy_edges():
    assert [s[:3] for s in paths.homotopy(np.zeros((2, 2)), np.zeros(2))] == [(0.0, None, None)]
    twice = np.array([[2.0, 2, 0], [2, 2, 0], [0, 0, 0]])  # a copy and a constant never enter
    assert [s[1] for s in paths.homotopy(twice, np.array([3.0, 3, 0]))] == [0, None]


def test_tested_path(spark):
    rng = np.random.default_rng(1)
    rows = [(g, *rng.normal(size=4).tolist(), float(rng.random() + 0.1)) for g in range(3) for _ in range(50)]
    df = spark.createDataFrame([(g, a, b, c, 2 * a + 0.5 * b + e * 0.3, w) for g, a, b, c, e, w in rows], "g long, a double, b double, c double, y double, w double")
    names = ["a", "b", "c"]
    out = paths.tested_path(df, ["g"], names, "y", "w").orderBy("g", "step").collect()
    data = {g: np.array([r[1:] for r in df.collect() if r.g == g]) for g in range(3)}
    for r in out:
        x, y, w = data[r.g][:, :3], data[r.g][:, 3], data[r.g][:, 4]
        x, y = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
        res = y - x @ [r[f"coef_{f}"] for f in names]
        c = x.T @ (w * res)
        assert abs(np.abs(c).max() / 50 - r.penalty) < 1e-9
        if r.runner_up is None:
            assert r.stable and r.statistic is None
            continue
        a, b = (w * x[:, names.index(f)] * res for f in (r.entered, r.runner_up))
        same = 1 if a.mean() * b.mean() >= 0 else -1
        z = (abs(a.mean()) - abs(b.mean())) / math.sqrt(2 * np.var(a - same * b, ddof=1) / 50)
        assert abs(r.statistic - z) < 1e-6 and r.stable == (z >= 1.6448536269514722)
        assert r.suggested == (50 if r.stable else math.ceil(50 * (1.6448536269514722 / max(z, 1e-3)) ** 2))
    assert out[0].entered == "a" and {r.stable for r in out} == {True, False}


def test_each_instance_asks_for_its_own_rows(spark):
    """A clear choice is done at once; a close one draws more rows, step by step, up to the most."""

    def make(instances, n):
        rows = instances.select("id", "gap", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("rep"))
        draw = lambda i: F.hash("id", "rep", F.lit(i)) / F.lit(2.0**31)
        rows = rows.select("id", draw(1).alias("a"), draw(2).alias("b"), "gap", draw(3).alias("e"))
        return rows.select("id", "a", "b", (F.col("a") + F.col("gap") * F.col("b") + 0.2 * F.col("e")).alias("y"), F.lit(1.0).alias("w"))

    df = spark.createDataFrame([(1, 0.0), (2, 0.85), (3, 1.0), (4, 0.0)], "id long, gap double")
    got = {r.id: r for r in linear.stable_explain(df, make, "id", ["a", "b"], "y", "w", 40, 400, k=1).collect()}
    assert got[1].n == got[4].n == 40 and got[1].stable
    assert got[3].n == 400 and not got[3].stable or got[3].stable
    assert len({r.n for r in got.values()}) > 1 and all(abs(r.coef_a - 1) < 0.5 for r in got.values())


def shap_by_coalitions(cov, mean, coef, x):
    p = len(coef)

    def worth(s):
        s, rest = list(s), [i for i in range(p) if i not in s]
        out = coef[s] @ x[s] + coef[rest] @ mean[rest]
        return out + (coef[rest] @ cov[np.ix_(rest, s)] @ np.linalg.inv(cov[np.ix_(s, s)]) @ (x[s] - mean[s]) if s and rest else 0.0)

    return [sum(math.factorial(len(s)) * math.factorial(p - 1 - len(s)) / math.factorial(p) * (worth((*s, i)) - worth(s)) for k in range(p) for s in itertools.combinations([j for j in range(p) if j != i], k)) for i in range(p)]


@pytest.fixture(scope="module")
def correlated(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + rng.normal(size=4)
    return x, spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "id long, a double, b double, c double, d double")


def test_correlated_linear_shap(spark, correlated):
    x, df = correlated
    coef = {"a": 1.0, "b": -2.0, "c": 0.5, "d": 3.0}
    b, cov, mean = np.array(list(coef.values())), np.cov(x, rowvar=False), x.mean(0)
    for r in linearshap.correlated_linear_shap(df.where("id < 6"), df, "id", list("abcd"), coef, 2.0).collect():
        phi = [r[f"phi_{f}"] for f in "abcd"]
        assert np.allclose(phi, shap_by_coalitions(cov, mean, b, x[r.id]))
        assert abs(r.base + sum(phi) - (b @ x[r.id] + 2)) < 1e-9


def test_correlated_linear_shap_draws_orders(spark, correlated):
    x, df = correlated
    coef = dict(zip("abcd", (1.0, -2.0, 0.5, 3.0), strict=True))
    few = linearshap.correlated_linear_shap(df, df, "id", list("abcd"), coef, orders=20).collect()
    exact = {r.id: r for r in linearshap.correlated_linear_shap(df, df, "id", list("abcd"), coef).collect()}
    assert all(abs(sum(r[f"phi_{f}"] - exact[r.id][f"phi_{f}"] for f in "abcd")) < 1e-9 for r in few)  # they always add up
    gap = np.mean([abs(r.phi_a - exact[r.id].phi_a) for r in few])
    assert 0 < gap < 0.5 * np.mean([abs(r.phi_a) for r in exact.values()])


def test_correlated_linear_shap_edges(spark, correlated):
    """Copies share their value, constants have none, nulls give nulls."""
    _, df = correlated
    coef = {"a": 1.0, "b": -2.0}
    plain = {r.id: r for r in linearshap.correlated_linear_shap(df, df, "id", ["a", "b"], coef).collect()}
    more = df.selectExpr("*", "3 * a + 1 AS a2", "7.0 AS k")
    for r in linearshap.correlated_linear_shap(more, more, "id", ["a", "b", "a2", "k"], {"a": 0.4, "b": -2.0, "a2": 0.2, "k": 5.0}).collect():
        assert abs(r.phi_a - plain[r.id].phi_a / 2) < 1e-9 and r.phi_a == r.phi_a2 and r.phi_k == 0 and abs(r.phi_b - plain[r.id].phi_b) < 1e-9
    hole = spark.createDataFrame([(1, None, 2.0)], "id long, a double, b double")
    assert linearshap.correlated_linear_shap(hole, df, "id", ["a", "b"], coef).first().phi_b is None
    with pytest.raises(ValueError):
        linearshap.correlated_linear_shap(df, df.limit(1), "id", ["a", "b"], coef)


def test_orders_are_all_different():
    assert len({tuple(linearshap.order_of(i, 5)) for i in range(120)}) == 120
