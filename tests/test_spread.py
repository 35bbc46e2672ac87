"""Steps that ran in one task, or bisected one value at a time: what the plan holds now, and that results stay."""

import math
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationale.functions.special import kl_bound, normal_quantiles
from rationale.functions.spread import spread
from rationale.operators import anchors as J
from rationale.operators import bins as C
from rationale.operators import neighbours as E
from rationale.operators import rules as H
from rationale.operators import shapley as K
from rationale.operators import tabular as TAB
from rationale.operators import texts as T
from rationale.operators import trees as I
from rationale.sources import scratch


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def tasks(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().count()


def test_tasks_by_rows(spark):
    one = spark.range(0, 400, 1, 1)
    assert tasks(spread(one, "id")) == 4 and tasks(spread(one, "id", rows=400)) == 1
    assert spread(one, "id", rows=5_000_000).rdd.getNumPartitions() == 11


def test_hypercube_without_sorting_its_rows(spark):
    """strata are sorted inside an instance's row."""
    part = spark.range(0, 40, 1, 1).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    found = E.lhs_sample(part, E.stats_row(part, ["x", "y"]), "k", ["x", "y"], 6)
    assert "Window" not in plan(found) and tasks(found) == 4
    rows = found.toPandas()
    for c, mean, scale in (("x", 29.25, 1.5 * math.sqrt((1600 - 1) / 12)), ("y", None, None)):
        for _, of in rows.groupby("k"):
            assert sorted(of[f"stratum_{c}"]) == list(range(6)) and sorted(of.rep) == list(range(1, 7))
        if mean:
            inside = [math.floor(0.5 * (1 + math.erf((v - mean) / scale / math.sqrt(2))) * 6) for v in rows[c]]
            assert np.mean(np.array(inside) == rows[f"stratum_{c}"]) > 0.99
    assert E.lhs_sample(part, E.stats_row(part, ["x"]), "k", ["x"], 1).count() == 40


def test_bisections_of_a_batch(spark):
    assert normal_quantiles(np.array([0.5, 0.975, 0.025])) == pytest.approx([0, 1.959964, -1.959964], abs=1e-5)
    assert np.isnan(normal_quantiles(np.array([np.nan]))).all()
    df = spark.createDataFrame([(0.5, 0.1), (0.0, 0.2), (1.0, 0.2), (None, 0.1)], "p double, v double").select("p", "v", kl_bound("p", "v", True).alias("u"), kl_bound("p", "v", False).alias("l"))
    assert "aggregate(" not in plan(df)
    for r in df.where("p is not null").collect():
        assert r.l <= r.p <= r.u
        for q in (r.u, r.l):
            if 1e-3 < q < 1 - 1e-3 and abs(q - r.p) > 1e-9:
                p = min(max(r.p, 1e-7), 1 - 1e-7)
                assert p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q)) == pytest.approx(r.v, abs=1e-3)


def test_binned_draws_in_many_tasks(spark):
    """a file of one part is read by one task, its draws are made by all; ends of bins are worked out once a bin."""
    rows = spark.range(0, 60, 1, 1).select("id", (F.col("id") % 13).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    drawn = TAB.binned_neighbourhood(rows, rows, "id", ["x"], C.quartile_bins(rows, ["x"]), ["c"], 10)
    assert tasks(drawn) == 4 and drawn.count() == 60 * 11
    assert drawn.where("rep = 0 and same_x = 1 and same_c = 1").count() == 60 and drawn.where("x < 0 or x > 12").isEmpty()


def test_masks_in_many_tasks(spark):
    """documents of one file are masked by all tasks."""
    docs = spark.range(0, 40, 1, 1).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") + i) % 9) for i in range(6)]).alias("t"))
    for made in (T.text_mask(docs, "id", "t", 3), T.unk_mask(docs, "id", "t", 3), T.token_index(docs, "id", "t")):
        assert tasks(made) == 4


def test_anchor_beams_grow_from_masks(spark, monkeypatch):
    """F8: the best pair of positions, without pairing every set of a text with every mask."""
    rng = np.random.default_rng(3)
    masks = [(0, 0, list(range(6)), "a")]
    masks += [(0, r, kept, "a" if {1, 4} <= set(kept) else "b") for r in range(1, 200) for kept in [[i for i in range(6) if rng.random() < 0.5]]]
    plans, stored = [], scratch.stored
    monkeypatch.setattr(scratch, "stored", lambda df: plans.append(plan(df)) or stored(df))
    got = J.anchor_text(spark.createDataFrame(masks, "id int, rep int, kept array<int>, label string"), "id", "label").collect()
    held = {s: [m[3] == "a" for m in masks[1:] if set(s) <= set(m[2])] for s in combinations(range(6), 2)}
    assert not any("array_except(preds" in p for p in plans)
    assert len(got) == 1 and got[0].preds == [1, 4]
    assert got[0].n == len(held[1, 4]) and got[0].precision == 1.0 and got[0].coverage == pytest.approx(len(held[1, 4]) / 199)


def test_rules_met_without_counting_pairs(spark):
    """No aggregate by rule and basket; votes, scores and odd baskets as by definition."""
    tx = spark.createDataFrame([(1, 1, [0, 5], "Y"), (1, 2, [0, 6, 6], "N"), (1, 3, [5], "Y"), (1, 4, None, "N"), (1, 5, [7, None], "N"), (2, 1, [0, 5], "N")], "g int, tid long, items array<int>, class string")
    rules = spark.createDataFrame([(1, 1, [0], "Y", 0.5, 0.6, -2.0), (1, 2, [0, 5], "Y", 0.3, 0.9, -3.0), (1, 3, [6], "N", 0.2, 0.9, -4.0), (1, 4, [7, None], "N", 0.1, 1.0, -1.0), (2, 1, [5, 0], "N", 0.1, 1.0, -1.0)], "g int, rule_id int, items array<int>, class string, support double, confidence double, log_p double")
    met = H.applicable(rules, tx)
    assert "Aggregate" not in plan(met)
    assert {(r.g, r.tid, r.rule_id, r.tx_class) for r in met.collect()} == {(1, 1, 1, "Y"), (1, 1, 2, "Y"), (1, 2, 1, "N"), (1, 2, 3, "N"), (2, 1, 1, "N")}
    votes = H.importance(rules, tx)
    assert {(r.g, r.rule_id, r.importance) for r in votes.collect()} == {(1, 2, 1), (1, 3, 1), (2, 1, 1)}
    assert {(r.g, r.tid): r.predicted for r in H.classify(tx, votes, 2).collect()} == {(1, 1): "Y", (1, 2): "N", (1, 3): "N", (1, 4): "N", (1, 5): "N", (2, 1): "N"}


def test_backgrounds_met_in_many_tasks(spark):
    """Rows of a small file meet the background in all tasks, and stay where they are to be added up."""
    rows = spark.range(0, 40, 1, 1).select("id", (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    behind = spark.range(4).select(F.col("id").alias("bg_id"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    values = K.coalition_values(rows, behind, K.mask_table(spark, 2), "id", ["x", "y"], "x * 2 + y")
    draws = behind.select(F.col("bg_id").alias("rep"), (F.col("x") + 9).alias("x"), "y", F.lit("Y").alias("label"))
    nearest = I.random_counterfactual(rows, draws, "id", ["x", "y"], "label", "Y", F.abs(F.col("x") - F.col("x0_x")))
    for made in (values, K.sampling_shap(rows, behind, "id", ["x", "y"], "x * 2 + y", 2), nearest):
        assert tasks(made) == 4 and made.groupBy("id").count().count() == 40
        text = made._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(id") == 1 and "ENSURE_REQUIREMENTS" not in re.sub(r"SinglePartition, ENSURE_REQUIREMENTS", "", text)
    assert {r.v for r in values.where("id = 7 and mask = 3").collect()} == {5.0} and {r.new for r in nearest.where("feature = 'x'").collect()} == {9.0}


def test_students_of_a_batch(spark):
    """the uniforms of t draws come in batches, and are those of the expressions; keys may be null or negative."""
    from rationale.functions.draws import student_t

    part = spark.createDataFrame([(i - 3, float(i)) for i in range(30)] + [(None, 1.0)], "k long, x double")
    found = E.perturb(part, E.stats_row(part, ["x"]), "k", ["x"], 5, "t")
    assert "ArrowEvalPython" in plan(found)
    stats = E.stats_row(part, ["x"]).first()
    wanted = {(r.k, r.rep): r.t for r in found.select("k", "rep", student_t(1, F.col("k"), F.col("rep"), 0).alias("t")).collect()}
    for r in found.collect():
        if r.k is None and r.rep > 0:
            assert r.x is None
        else:
            assert r.x == (r.x0_x if r.rep == 0 else r.x0_x + stats.scale_x * wanted[r.k, r.rep])


def test_genetic_rows_side_by_side(spark):
    """instances of a batch evolve together, not one pandas group each; each by its own draws, whatever the batch."""
    part = spark.range(0, 60, 1, 1).select("id", (F.col("id") % 9).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    of = lambda rows: E.genetic_neighbourhood(rows, lambda m: m[:, 0] > m[:, 1], "id", ["x", "y"], {"x": 2.0, "y": 2.0}, 12, 2)
    assert "FlatMapGroupsInPandas" not in plan(of(part))
    every = {(r.id, r.rep): r for r in of(part).collect()}
    assert {k for k, _ in every} == set(range(60)) and {r.rep for (k, _), r in every.items() if k == 5} == set(range(1, 1 + sum(k == 5 for k, _ in every)))
    alone = of(part.where("id = 5 or id = 41").union(part.where("id = 5"))).collect()
    assert alone and {(r.id, r.rep): r for r in alone} == {k: r for k, r in every.items() if k[0] in (5, 41)} and len(alone) == len({(r.id, r.rep) for r in alone})


def test_search_steps_without_sorting(spark, monkeypatch):
    """the steps of a point aren't sorted or shuffled, however many points a task has."""
    from rationale.operators import search as S

    rows = spark.range(0, 30, 1, 1).select("id", (F.col("id") / 30).alias("p"), ((F.col("id") * 7 % 30) / 30).alias("q"))
    bounds = rows.agg(*[f(c).alias(f"{e}_{c}") for c in "pq" for e, f in (("lo", F.min), ("hi", F.max))])
    plans, stored = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or stored(df))
    found = S.search_counterfactuals(rows, bounds, "CASE WHEN p > 0.5 THEN 'Y' ELSE 'N' END", "id", ["p", "q"], "Y", starts=2, tolerance=0.1).collect()
    rounds = [p for p in plans if "posexplode" in p or "explode" in p and "cost" in p and "Aggregate" in p]
    assert rounds and not any("SortAggregate" in p for p in rounds)
    assert all(r.cf_p > 0.5 and r.distance >= 0 for r in found) and len(found) == 30


def test_token_index_within_texts(spark):
    """F32: places come from the text itself, without a window or a group over the words of all texts."""
    texts = {1: "a bc a, é bc!", 2: "", 3: None, 4: " x", 5: "\U0001f600 w w"}
    found = T.token_index(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t", r"[^a-zA-Z0-9_]+")
    assert "Window" not in plan(found) and "Aggregate" not in plan(found)
    assert {(r.id, r.word): (r.starts, r.n) for r in found.collect()} == {(1, "a"): ([0, 5], 2), (1, "bc"): ([2, 10], 2), (4, "x"): ([1], 1), (5, "w"): ([2, 4], 2)}
