"""Features of kernel attributions, refits, kept rows, families and searches against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.operators import condensed, families, refit, search, shapley
from rationale.plans.common import PART_MODEL


def test_kernel_selection(spark):
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(5)]
    schema = ", ".join(f"{n} double" for n in names)
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=5))) for i in range(6)], f"id long, {schema}")
    background = spark.createDataFrame([tuple(map(float, rng.normal(size=5))) for _ in range(8)], schema)
    one = shapley.kernel_shap(rows, background, "id", names, "3 * x2 * x2", select="aic").collect()
    exact = {r.id: r for r in shapley.shap_exact(rows, background, "id", names, "3 * x2 * x2").collect()}
    for r in one:
        assert [r[f"phi_{n}"] for n in names] == pytest.approx([exact[r.id][f"phi_{n}"] if n == "x2" else 0.0 for n in names], abs=1e-9)
    model = "2 * x0 + x1 * x3 - x4"
    full = {r.id: r for r in shapley.kernel_shap(rows, background, "id", names, model).collect()}
    for select in (5, 2, "aic", "bic"):
        for r in shapley.kernel_shap(rows, background, "id", names, model, select=select).collect():
            phi = np.array([r[f"phi_{n}"] for n in names])
            whole = np.array([full[r.id][f"phi_{n}"] for n in names])
            assert phi.sum() == pytest.approx(whole.sum())
            assert select != 5 or phi == pytest.approx(whole)
            assert np.count_nonzero(phi) <= (select if isinstance(select, int) else 5)
            assert phi[2] == pytest.approx(0.0, abs=1e-9)
    same = shapley.kernel_shap(rows, background, "id", names, "1.0", select="bic").collect()
    assert all(r[f"phi_{n}"] == 0 for r in same for n in names)


def test_kept_features_by_plain_search():
    """The criterion's choice is at least as good as any lasso fit of a fine grid of penalties."""
    rng = np.random.default_rng(8)
    p = 4
    z = np.array([[m >> i & 1 for i in range(p)] for m in range(1, 15)], float)
    w = rng.uniform(0.5, 1, len(z))
    y = z @ [2.0, 0.0, -1.0, 0.02] + 0.1 * rng.normal(size=len(z))
    total = 1.1
    size = z.sum(1)
    root = np.sqrt(np.r_[w * (p - size), w * size])
    x = np.vstack([z, z - 1]) * root[:, None]
    t = np.r_[y, y - total] * root
    x, t = x - x.mean(0), t - t.mean()
    noise = np.square(t - x @ np.linalg.lstsq(x, t, rcond=None)[0]).sum() / (len(t) - p - 1)
    best = (np.inf, None)
    for penalty in np.abs(x.T @ t).max() * np.logspace(0, -6, 400):
        c = np.zeros(p)
        for _ in range(300):
            for j in range(p):
                r = x[:, j] @ (t - x @ c) + x[:, j] @ x[:, j] * c[j]
                c[j] = np.sign(r) * max(abs(r) - penalty, 0) / (x[:, j] @ x[:, j])
        best = min(best, (np.square(t - x @ c).sum() / noise + 2 * np.count_nonzero(c), tuple(np.flatnonzero(c))))
    assert tuple(shapley.kept_features(z, y, w, total, "aic")) == best[1]


@pytest.mark.parametrize("keep", [False, True])
def test_refit_equals_a_refit_per_row(spark, keep):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4)) + 3
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=40)
    phi = rng.normal(size=(40, 4)).round(1)
    k = rng.integers(0, 5, 40)
    names = list("abcd")
    rows = [(i, *map(float, x[i]), float(y[i]), *map(float, phi[i]), int(k[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, phi_a double, phi_b double, phi_c double, phi_d double, k int").withColumn("r_one", F.lit("clash"))
    got = {r.id: r.prediction for r in refit.refit_predictions(df, df, names, "y", F.col("k"), keep).collect()}
    for i in range(40):
        order = np.lexsort((np.arange(4), -phi[i]))
        on = sorted(order[: k[i]] if keep else order[k[i] :])
        a = np.column_stack([np.ones(40), x[:, on]])
        assert got[i] == pytest.approx(np.r_[1, x[i, on]] @ np.linalg.lstsq(a, y, rcond=None)[0])


def test_refit_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0, 2.0, 1.0), (2.0, 5.0, 2.0, None, 2.0), (3.0, 5.0, 3.0, 9.0, 1.0), (None, 5.0, 7.0, 1.0, 2.0)], "a double, b double, y double, phi_a double, phi_b double")
    got = [r.prediction for r in refit.refit_predictions(df, df, ["a", "b"], "y", 1).collect()]
    assert got[:3] == pytest.approx([2.0, 2.0, 2.0]) and got[3] is None  # there the null is among what stays
    assert refit.refit_predictions(df.where("y < 0"), df, ["a", "b"], "y", 1).where("prediction is not null").isEmpty()
    assert refit.refit_predictions(df, df.where("y < 0"), ["a", "b"], "y", 1).isEmpty()


def plain_condensed(rows):
    """Rows (id, values, label) that are kept, with their rounds; values are distinct."""
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[1], b[1], strict=True))
    kept = {}
    for r in sorted(rows):
        if r[2] not in [k[2] for k in kept]:
            kept[r] = 0
    turn = 0
    while True:
        turn += 1
        cells = {}
        for r in rows:
            k = min(kept, key=lambda k: (dist(r, k), k[0]))  # noqa: B023
            if k[2] != r[2]:
                cells.setdefault(k, []).append((dist(r, k), r[0], r))
        if not cells:
            return {(k[0], k[2], t) for k, t in kept.items()}
        kept |= {min(c)[2]: turn for c in cells.values()}


@pytest.mark.parametrize("block", [8192, 40])
def test_condensed(spark, block):
    rng = np.random.default_rng(2)
    places = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (220, 2))})
    rows = [(i, (x / 4, y / 4), "abc"[(x * x // 90 + y // 11) % 3]) for i, (x, y) in enumerate(places)]
    table = [(i, *v, c) for i, v, c in rows] + [(0, *rows[0][1], rows[0][2]), (900, *rows[3][1], "z"), (901, None, 1.0, "a"), (902, float("nan"), 1.0, "a"), (903, 1.0, 1.0, None), (None, 1.1, 1.0, "a")]
    df = spark.createDataFrame(table, "id long, x double, y double, label string").withColumn("d", F.lit("clash")).withColumn("round", F.lit("clash"))
    got = condensed.condensed(df, "id", ["x", "y"], "label", block)
    assert got.columns == ["id", "label", "round"]
    assert {tuple(r) for r in got.collect()} == plain_condensed(rows)
    assert condensed.condensed(df.where("id < 0"), "id", ["x", "y"], "label").isEmpty()


def test_counterfactual_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(s), float(p)) for i, (s, p) in enumerate(zip(rng.integers(1, 51, 60), rng.uniform(900, 1000, 60), strict=True))]
    df = spark.createDataFrame([*rows, (98, None, 1.0), (99, 60.0, 2000.0)], "id long, p_size double, p_retailprice double").withColumn("cost", F.lit("clash")).withColumn("start", F.lit("clash"))
    bounds = spark.createDataFrame([(1.0, 50.0, 900.0, 1000.0)], "lo_p_size double, hi_p_size double, lo_p_retailprice double, hi_p_retailprice double")
    aim = F.when(F.expr(PART_MODEL) == "Y", "N").otherwise("Y")
    tolerance = 1e-3
    found = search.search_counterfactuals(df, bounds, PART_MODEL, "id", ["p_size", "p_retailprice"], aim, starts=32, tolerance=tolerance)  # one start in 12 is in the region of small sizes
    got = {r.id: r for r in found.collect()}
    label = lambda s, p: s > 25 and p > 950 or s < 5
    nearest = 0
    assert len(got) == 62 and got[98].cf_p_size is None and got[98].starts == 0 and got[98].distance is None
    assert 1 <= got[99].cf_p_size <= 50 and 900 <= got[99].cf_p_retailprice <= 1000
    for i, s, p in rows:
        r = got[i]
        own = label(s, p)
        at = ((r.cf_p_size - 1) / 49, (r.cf_p_retailprice - 900) / 100)
        home = ((s - 1) / 49, (p - 900) / 100)
        there = lambda u: label(1 + 49 * u[0], 900 + 100 * u[1])
        assert there(at) != own and r.starts >= 1
        assert r.distance == pytest.approx(np.hypot(at[0] - home[0], at[1] - home[1]))
        for j in (0, 1):  # a step of the tolerance towards the row leaves the class, or there is nothing to go
            if abs(home[j] - at[j]) > tolerance:
                step = list(at)
                step[j] += np.sign(home[j] - at[j]) * tolerance
                assert there(step) == own
        grid = np.linspace(0, 1, 401)
        best = min((np.hypot(a - home[0], b - home[1]) for a in grid for b in (home[1], 0.4999, 0.5001) if there((a, b)) != own), default=9)
        best = min([best, *(np.hypot(a - home[0], b - home[1]) for b in grid for a in (home[0], 3.99 / 49, 4.01 / 49, 24.01 / 49, 23.99 / 49) if there((a, b)) != own)])
        assert r.distance > best - 0.01
        nearest += r.distance < best + 0.01
    assert nearest >= 54  # of 60; the rest ends at the boundary of another region
    none = search.search_counterfactuals(df, bounds, PART_MODEL, "id", ["p_size", "p_retailprice"], "no such class", most_draws=40)
    assert none.where("distance is null and starts = 0").count() == 62


def test_families(spark):
    """Drawn data is recognised, with its parameters; what is drawn from the fits is recognised again."""
    true = {"uniform": (2.0, 3.0), "normal": (5.0, 2.0), "exponential": (1.0, 4.0), "laplace": (0.0, 2.0), "lognormal": (0.5, 0.8), "gamma": (2.5, 1.5), "constant": (7.0, 0.0)}
    key = F.col("id")
    df = spark.range(20000).select(*[families.family_draw(f, *ab, 11, key, i).alias(f) for i, (f, ab) in enumerate(true.items())], F.lit(None).cast("double").alias("empty"))
    df = df.unionByName(spark.createDataFrame([(float("nan"),)], "normal double"), True)
    fits = families.fit_families(df, [*true, "empty"])
    best = {r.feature: r for r in fits.where("best").collect()}
    assert sorted(best) == sorted(true)
    for f, (a, b) in true.items():
        assert best[f].family == f and (best[f].a, best[f].b) == pytest.approx((a, b), rel=0.05, abs=0.06)
    small_shape = spark.range(20000).select(families.family_draw("gamma", 0.6, 2.0, 5, key, 0).alias("x"))
    got = families.fit_families(small_shape, ["x"], ("gamma",)).first()
    assert (got.a, got.b) == pytest.approx((0.6, 2.0), rel=0.06)
    assert families.fit_families(df.where("uniform < 0"), ["uniform"]).isEmpty()
    drawn = families.fitted_sample(fits, 5000, 3)
    assert drawn.columns == ["rep", *sorted(true)] and drawn.count() == 5000
    assert drawn.agg(F.avg("gamma")).first()[0] == pytest.approx(3.75, rel=0.05)
