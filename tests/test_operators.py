"""Goldens and invariants that the SQL counterparts don't cover."""

from math import comb, lgamma, log, log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.functions.draws import uniform
from rationale.functions.order import numbered, percentiles, running
from rationale.functions.special import inverse_normal, kl_bound, normal_cdf, t_tail
from rationale.operators import anchors as J
from rationale.operators import bins as C
from rationale.operators import evaluate as L
from rationale.operators import linear as G
from rationale.operators import neighbours as E
from rationale.operators import profile as B
from rationale.operators import rules as H
from rationale.operators import shapley as K
from rationale.operators import texts as T
from rationale.operators import trees as I
from rationale.sources.scratch import clear_scratch, stored
from rationale.streaming.apply import scored_stream

DATA = "/root/testdata/sf0.001"


def test_rank_overlap_by_definition(spark):
    a, b, p = list("abcdefg"), list("bacdxyz"), 0.9
    row = L.rank_overlap(spark.createDataFrame([(1, a, b)], "id int, a array<string>, b array<string>"), "id", "a", "b", p).first()
    x = [len(set(a[:d]) & set(b[:d])) for d in range(1, 8)]
    ext = (1 - p) / p * sum(x[d - 1] / d * p**d for d in range(1, 8)) + x[6] / 7 * p**7
    low = (1 - p) / p * (sum((x[d - 1] - x[6]) / d * p**d for d in range(1, 8)) - x[6] * np.log(1 - p))
    assert row.overlap == pytest.approx(x[6] / 7)
    assert row.average_overlap == pytest.approx(sum(v / d for d, v in enumerate(x, 1)) / 7)
    assert row.rbo_ext == pytest.approx(ext)
    assert row.rbo_min == pytest.approx(low)


def test_rank_overlap_with_ties(spark):
    """Published example values of the measure."""
    rows = [(1, [["a", "c"], ["b"], ["d"]], [["a"], ["b", "c"], ["d"]]), (2, [["a"], ["b"], ["c"]], [["a"], ["b"], ["c"]])]
    got = {r.id: r for r in L.tied_rank_overlap(spark.createDataFrame(rows, "id int, a array<array<string>>, b array<array<string>>"), "id", "a", "b", 0.9).collect()}
    assert (round(got[1].rbo_min, 3), round(got[1].rbo_res, 3), round(got[1].rbo_ext, 3)) == (0.489, 0.477, 0.967)
    assert got[2].rbo_ext == pytest.approx(1) and got[2].rbo_min + got[2].rbo_res == pytest.approx(1)


def test_text_ridge(spark):
    """Weights of words against the normal equations over all words."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(d, [w for w in vocabulary if rep == 0 or rng.random() < 0.6], float(rng.normal()), float(rng.random() + 0.1)) for d in (1, 2) for rep in range(9)]
    got = G.text_ridge(spark.createDataFrame(rows, "d int, kept array<string>, y double, w double"), "d", "kept", "y", "w").collect()
    for d in (1, 2):
        x = np.array([[float(w in kept) for w in vocabulary] for i, kept, _, _ in rows if i == d])
        y, w = (np.array([r[k] for r in rows if r[0] == d]) for k in (2, 3))
        x, y = x - w @ x / w.sum(), y - w @ y / w.sum()
        coef = np.linalg.solve(x.T @ (x * w[:, None]) + np.eye(12), x.T @ (w * y))
        mine = {r.word: (r.weight, r["rank"]) for r in got if r.d == d}
        assert [mine[v][0] for v in vocabulary] == pytest.approx(coef, abs=1e-5)
        assert sorted(mine, key=lambda v: mine[v][1]) == [vocabulary[i] for i in np.argsort(-np.abs(coef))]


def test_sequential_cover(spark):
    """Rounds of Spark against a greedy loop."""
    rng = np.random.default_rng(3)
    tx = [(g, t, sorted(rng.choice(8, 4, replace=False).tolist()), str(rng.choice(["Y", "N"]))) for g in (1, 2) for t in range(60)]
    rules = [(g, 10 * g + i, sorted(rng.choice(8, 2, replace=False).tolist()), str(rng.choice(["Y", "N"])), float(rng.random()), float(-rng.random())) for g in (1, 2) for i in range(9)]
    got = H.sequential_cover(spark.createDataFrame(rules, "g int, rule_id long, items array<int>, class string, confidence double, log_p double"), spark.createDataFrame(tx, "g int, tid int, items array<int>, class string"))
    wanted = []
    for g in (1, 2):
        rest, place = [t for t in tx if t[0] == g], 0
        while True:
            best = []
            for _, i, items, y, c, p in (r for r in rules if r[0] == g):
                hit = [t for t in rest if set(items) <= set(t[2])]
                share = c if place == 0 else np.mean([t[3] == y for t in hit]) if hit else 0
                if hit and round(share, 12) >= 0.5:
                    best.append((-round(share, 12), p, i, {t[1] for t in hit}))
            if not best:
                break
            place += 1
            top = min(best, key=lambda b: b[:3])
            wanted.append((g, top[2], place))
            rest = [t for t in rest if t[1] not in top[3]]
    assert sorted((r.g, r.rule_id, r.place) for r in got.collect()) == sorted(wanted)


def test_fisher_of_large_counts(spark):
    """The tail against sums of integers, where it is short, long or nearly all."""
    rows = [(5, 3, 10, 20), (400, 300, 600, 1000), (400, 180, 600, 1000), (400, 239, 600, 1000), (90, 90, 100, 5000), (30000, 21000, 40000, 60000), (7, 7, 7, 7)]
    out = H.fisher_log_p(spark.createDataFrame(rows, "n_items long, n_both long, n_class long, n long")).collect()
    for r in out:
        a, k, c, n = r.n_items, r.n_both, r.n_class, r.n
        if n <= 5000:
            exact = sum(comb(c, i) * comb(n - c, a - i) for i in range(k, min(a, c) + 1))
            assert r.log_p == pytest.approx(log(exact) - log(comb(n, a)), rel=1e-9, abs=1e-9)
        else:
            lc = lambda x, y: lgamma(x + 1) - lgamma(y + 1) - lgamma(x - y + 1)
            terms = np.array([lc(c, i) + lc(n - c, a - i) - lc(n, a) for i in range(k, min(a, c) + 1)])
            assert r.log_p == pytest.approx(terms.max() + np.log(np.exp(terms - terms.max()).sum()), rel=1e-6)


def test_anchor_text(spark):
    """Two words that decide together: neither alone, both of them do."""
    rng = np.random.default_rng(4)
    rows = [(1, 0, list(range(6)), "Y")]
    for rep in range(1, 400):
        kept = [i for i in range(6) if rng.random() < 0.5]
        rows.append((1, rep, kept, "Y" if {1, 4} <= set(kept) else "N"))
    got = J.anchor_text(spark.createDataFrame(rows, "id int, rep int, kept array<int>, label string"), "id", "label").collect()
    assert len(got) == 1 and got[0].preds == [1, 4] and got[0].accepted and got[0].precision == 1.0
    both = sum({1, 4} <= set(r[2]) for r in rows[1:])
    assert got[0].n == both and got[0].coverage == pytest.approx(both / 399)


def test_deep_entropy_bins(spark):
    """Three levels of cuts against a recursive search."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 60, 500)
    y = np.where((x > 12) ^ (x > 31) ^ (x > 47), 1, 0) ^ (rng.random(500) < 0.1)
    f = lambda v: 0.0 if v == 0 else v * log2(v)

    def cuts(at, depth):
        if depth == 0:
            return []
        best = None
        values = sorted(set(x[at]))
        for a, b in zip(values, values[1:], strict=False):
            left, right = at[x[at] <= a], at[x[at] > a]
            h = [f(len(z)) - sum(f((y[z] == c).sum()) for c in (0, 1)) for z in (at, left, right)]
            gain = h[0] - h[1] - h[2]
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, (a + b) / 2, left, right)
        return [] if best is None else [best[1], *cuts(best[2], depth - 1), *cuts(best[3], depth - 1)]

    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x int, y int")
    assert C.entropy_bins(df, ["x"], "y", 3).first().edges == sorted(set(cuts(np.arange(500), 3)))


def test_bin_names(spark):
    edges = C.stats_bins({"f": [5.1, 5.8, 6.4]}, spark.range(1))
    names = [r.name for r in C.bin_names(edges).orderBy("bin").collect()]
    assert names == ["f <= 5.10", "5.10 < f <= 5.80", "5.80 < f <= 6.40", "f > 6.40"]


def test_token_index(spark):
    docs = spark.createDataFrame([(1, "Please, take your time. Please")], "id int, t string")
    starts = {r.word: r.starts for r in T.token_index(docs, "id", "t").collect()}
    assert starts == {"Please": [0, 24], "take": [8], "your": [13], "time": [18]}
    whole = T.text_mask(docs, "id", "t", 3).where("rep = 0").first()
    assert whole.masked == "Please, take your time. Please" and whole.removed == 0


def test_special_functions(spark):
    r = spark.range(1).select(normal_cdf(F.lit(1.96)).alias("c"), inverse_normal(F.lit(0.975)).alias("i"), kl_bound(0.5, 0.1, True).alias("u"), kl_bound(0.5, 0.1, False).alias("l"), t_tail(F.lit(2.228139), F.lit(10.0)).alias("t")).first()
    assert r.c == pytest.approx(0.975, abs=1e-4)
    assert r.i == pytest.approx(1.95996, abs=1e-3)
    assert 0.5 < r.u < 1 and r.l == pytest.approx(1 - r.u, abs=1e-3)
    assert r.t == pytest.approx(0.05, abs=1e-5)


def test_draws_do_not_depend_on_partitions(spark):
    a = spark.range(0, 500, 1, 1).select("id", uniform(3, F.col("id"), 2, 1).alias("u"))
    b = spark.range(0, 500, 1, 7).select("id", uniform(3, F.col("id"), 2, 1).alias("u"))
    assert a.exceptAll(b).isEmpty()
    assert 0.4 < a.agg(F.avg("u")).first()[0] < 0.6


def test_original_row_is_kept(spark):
    p = spark.read.parquet(f"{DATA}/part.parquet")
    n = E.perturb(p, E.stats_row(p, ["p_size"]), "p_partkey", ["p_size"], 3)
    assert n.where("rep = 0 and p_size <> x0_p_size").isEmpty()
    assert n.count() == 4 * p.count()


def test_attributions_add_up(spark):
    p = spark.read.parquet(f"{DATA}/part.parquet").limit(20).withColumn("p_extra", F.col("p_partkey") % 5)
    bg = p.limit(6).select("p_size", "p_retailprice", "p_extra")
    features, model = ["p_size", "p_retailprice", "p_extra"], "p_size * p_retailprice / 1000 + p_extra * p_extra"
    exact = K.shap_exact(p, bg, "p_partkey", features, model).orderBy("p_partkey").collect()
    kernel = K.kernel_shap(p, bg, "p_partkey", features, model).orderBy("p_partkey").collect()
    assert np.allclose(np.array(exact), np.array(kernel), atol=1e-6)
    base = bg.agg(F.avg(F.expr(model))).first()[0]
    for r, x in zip(exact, p.withColumn("y", F.expr(model)).orderBy("p_partkey").collect(), strict=True):
        assert sum(r[1:]) == pytest.approx(x.y - base, abs=1e-6)


def test_scratch_is_cleared(spark):
    t = stored(spark.range(3))
    assert t.count() == 3 and clear_scratch(spark) >= 1
    assert clear_scratch(spark) == 0


def test_running_sums_and_percentiles(spark):
    rng = np.random.default_rng(1)
    g, v = rng.integers(0, 3, 900), rng.permutation(900) // 2
    df = spark.createDataFrame([(int(a) if a else None, int(b), i) for i, (a, b) in enumerate(zip(g, v, strict=True))], "g int, v int, i int").repartition(7)
    got = {r.i: (r.s, r.n) for r in numbered(running(df, ["v", "i"], {"s": F.col("v").cast("long")}, ("g",)), ["v", "i"], "n", ("g",)).collect()}
    for k in range(3):
        order = sorted((int(b), i) for i, (a, b) in enumerate(zip(g, v, strict=True)) if a == k)
        total = 0
        for n, (b, i) in enumerate(order):
            total += b
            assert got[i] == (total, n)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in percentiles(df, "v", shares, ("g",)).collect():
        assert r.percentiles == pytest.approx(np.quantile(v[g == (r.g or 0)], shares))
    assert percentiles(df, "v", [0.5]).first().percentiles == pytest.approx([np.quantile(v, 0.5)])
    assert percentiles(df.where("v < 0"), "v", [0.5]).isEmpty() or percentiles(df.where("v < 0"), "v", [0.5]).first().percentiles[0] is None


def test_constant_features_divide_nothing(spark):
    p = spark.range(6).select(F.col("id").alias("k"), F.lit(2.0).alias("a"), F.col("id").cast("double").alias("b"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("label"))
    cov = B.covariance(p, ["a", "b"])
    assert {(r.i, r.j): r.value for r in B.correlations(cov).collect()}["a", "b"] is None
    near = E.closest_rows(p, p.where("k = 0"), "k", ["a", "b"], "label", 2, 0.5)
    assert sorted(r.k for r in near.collect()) == [0, 1]
    zero = spark.createDataFrame([(1, "a", 0.5, 0.0), (1, "b", 0.5, 0.0)], "k int, feature string, phi double, variance double")
    assert [r.n for r in K.allocate_samples(zero, "k", 10).collect()] == [0, 0]
    fixed = K.efficiency_correction(zero, spark.createDataFrame([(1, 3.0)], "k int, total double"), "k")
    assert all(r.phi > 0.5 for r in fixed.collect())


def test_stream(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    part.write.parquet(str(tmp_path / "in"))
    bins = C.quartile_bins(part, ["p_size"])
    rows = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
    out = scored_stream(rows, "CASE WHEN p_size > 25 THEN 'Y' ELSE 'N' END", bins, ["p_size"])
    q = out.writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(90)
    got = spark.table("scored")
    assert got.count() == part.count()
    assert {r.p_size_bin for r in got.select("p_size_bin").distinct().collect()} <= {0, 1, 2, 3}


def test_several_counterfactuals(spark):
    """Searches start again from the basket, without the rules of earlier counterfactuals and the first rules of failed searches."""
    rng = np.random.default_rng(13)
    n_encoded, feature_of = 9, {i: "abc"[i // 3] for i in range(9)}
    predict_one = lambda items: "Y" if (1 in items and 4 in items) or 8 in items or 5 in items else "N"
    rules = []
    for r in range(8):
        items = sorted(int(3 * f + rng.integers(0, 3)) for f in rng.choice(3, rng.integers(1, 3), replace=False))
        rules.append((0, r, items, "Y" if r % 3 else "N", -float(rng.integers(1, 50)), float(rng.integers(1, 9)) / 10))
    baskets = [(0, t, [int(rng.integers(0, 3)), int(3 + rng.integers(0, 3)), int(6 + rng.integers(0, 2))]) for t in range(14)]
    baskets = [b for b in baskets if predict_one(b[2]) == "N"]
    wanted = []
    ranked = sorted((r for r in rules if r[3] == "Y"), key=lambda r: (round(r[4] * r[5], 9), r[1]))
    for _, t, items in baskets:
        used, k = set(), 0
        while k < 2:
            now, path = list(items), []
            for _step in range(2):
                best = next((r for r in ranked if r[1] not in used | set(path) and set(r[2]) - set(now)), None)
                if best is None:
                    break
                path.append(best[1])
                new = {feature_of[i]: i for i in best[2]}
                now = sorted(new.get(feature_of[i], i) for i in now)
                if predict_one(now) == "Y":
                    break
            if not path:
                break
            if predict_one(now) == "Y":
                k += 1
                wanted.append((0, t, k, now, path))
                used |= set(path)
            else:
                used.add(path[0])
    tx = spark.createDataFrame(baskets, "g int, tid long, items array<int>")
    table = spark.createDataFrame(rules, "g int, rule_id long, items array<int>, class string, log_p double, confidence double")
    predict = lambda df: df.withColumn("label", F.expr("CASE WHEN (array_contains(items, 1) AND array_contains(items, 4)) OR array_contains(items, 8) OR array_contains(items, 5) THEN 'Y' ELSE 'N' END"))
    names = spark.createDataFrame(list(feature_of.items()), "item int, feature string")
    out = I.rule_counterfactuals(tx, table, names, predict, "Y", n_encoded, 2, n=2)
    assert len(wanted) > len(baskets) and sorted(map(tuple, out.collect())) == sorted(wanted)
