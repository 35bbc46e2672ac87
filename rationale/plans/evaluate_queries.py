"""Queries over measures of explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rationale.functions.draws import draw_sql
from rationale.operators import distance as D
from rationale.operators import evaluate as L

from .common import PART_FEATURES, PART_MODEL, PART_SCORE, query, rounded, union_all
from .distance_queries import DIST
from .distance_queries import with_distance
from .linear_queries import event_explanations
from .neighbour_queries import UNIFORM

TREE = "CASE WHEN p_size > 25 THEN 'Y' ELSE 'N' END"
RUNS = "runs AS (SELECT instance_id, run, feature, weight, row_number() OVER (PARTITION BY instance_id, run ORDER BY weight DESC, feature) AS rank FROM (SELECT user_id % 200 AS instance_id, event_id % 4 AS run, event_type AS feature, round(sum(value), 6) AS weight FROM events GROUP BY ALL))"


def runs(read):
    """Importances of event types for user groups, over four repeats."""
    sums = read("events").groupBy((F.col("user_id") % 200).alias("instance_id"), (F.col("event_id") % 4).alias("run"), F.col("event_type").alias("feature")).agg(F.round(F.sum("value"), 6).alias("weight"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("instance_id", "run").orderBy(F.desc("weight"), "feature")))


def agreement(read):
    d = with_distance(read).select("p_partkey", "rep", "d", F.expr(PART_MODEL).alias("bb"), F.expr(TREE).alias("surrogate"))
    return d


_AGREE = f"a AS (SELECT p_partkey, rep, {DIST} AS d, {PART_MODEL} AS bb, {TREE} AS surrogate FROM neigh)"


@query("l1_fidelity", f"WITH {UNIFORM}, {_AGREE}, w AS (SELECT *, sum(d) OVER p / (d + 1e-8) AS w FROM a WHERE rep > 0 WINDOW p AS (PARTITION BY p_partkey)) SELECT p_partkey, round(sum(CASE WHEN bb = surrogate THEN w ELSE 0 END) / sum(w), 6) AS value FROM w GROUP BY p_partkey")
def _(spark, read):
    a = agreement(read).where("rep > 0")
    return rounded(L.fidelity(D.inverse_weights(a, "p_partkey", "d"), ["p_partkey"], "bb", "surrogate", "weight"))


@query("l2_fidelity_summary", f"WITH {UNIFORM}, {_AGREE}, v AS (SELECT p_partkey % 3 AS method, p_partkey % 2 AS weighting, avg(CASE WHEN bb = surrogate THEN 1.0 ELSE 0 END) AS value, max(CASE WHEN rep = 0 AND bb = surrogate THEN 1 ELSE 0 END) AS hit FROM a GROUP BY p_partkey) SELECT method, weighting, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, count(value) AS n, round(avg(hit), 6) AS hit_rate FROM v GROUP BY GROUPING SETS ((method, weighting), (method), ())")
def _(spark, read):
    a = agreement(read).groupBy("p_partkey").agg(F.avg((F.col("bb") == F.col("surrogate")).cast("double")).alias("value"), F.max(((F.col("rep") == 0) & (F.col("bb") == F.col("surrogate"))).cast("int")).alias("hit"))
    return rounded(L.fidelity_summary(a.select((F.col("p_partkey") % 3).alias("method"), (F.col("p_partkey") % 2).alias("weighting"), "value", "hit")))


@query("l3_constant_baseline", f"WITH {UNIFORM}, {_AGREE}, o AS (SELECT p_partkey, bb AS predicted FROM a WHERE rep = 0) SELECT bb, predicted, count(*) AS n FROM a JOIN o USING (p_partkey) GROUP BY bb, predicted")
def _(spark, read):
    return L.constant_baseline(agreement(read), "p_partkey", "bb").groupBy("bb", "predicted").agg(F.count("*").alias("n"))


@query("l4_loose_stability", f"WITH {RUNS}, t AS (SELECT instance_id, run, list(feature) AS s FROM runs WHERE rank <= 2 GROUP BY ALL) SELECT a.instance_id, round(avg(len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s)))), 6) AS value FROM t a JOIN t b ON a.instance_id = b.instance_id AND a.run < b.run GROUP BY 1")
def _(spark, read):
    return rounded(L.loose_stability(runs(read), 4))


@query("l5_rank_stability", f"WITH {RUNS} SELECT a.rank::INT AS rank, round(avg(CASE WHEN a.feature = b.feature THEN 1.0 ELSE 0 END), 6) AS value FROM runs a JOIN runs b ON a.instance_id = b.instance_id AND a.rank = b.rank AND a.run < b.run WHERE a.rank <= 5 GROUP BY a.rank")
def _(spark, read):
    return rounded(L.rank_stability(runs(read)))


@query("l6_variance_stability", f"WITH {RUNS}, o AS (SELECT instance_id, count(DISTINCT feature) AS nf, count(DISTINCT run) AS nr FROM runs GROUP BY instance_id), m AS (SELECT instance_id, feature, nr, sum(weight) / any_value(nr) AS a FROM runs JOIN o USING (instance_id) WHERE rank <= nf // 2 GROUP BY instance_id, feature, nr), d AS (SELECT m.instance_id, m.feature, sum(power(a - weight, 2)) / nullif(any_value(m.nr) - 1, 0) AS v FROM m JOIN runs r ON r.instance_id = m.instance_id AND r.feature = m.feature JOIN o ON o.instance_id = m.instance_id WHERE r.rank <= o.nf // 2 GROUP BY m.instance_id, m.feature) SELECT instance_id, round(avg(v), 2) AS value FROM d GROUP BY instance_id")
def _(spark, read):
    return rounded(L.variance_stability(runs(read)), 2)


@query("l7_elbow", f"WITH {RUNS}, f AS (SELECT instance_id, rank, lead(weight) OVER (PARTITION BY instance_id ORDER BY rank) / nullif(weight, 0) AS ratio FROM runs WHERE run = 0) SELECT instance_id, coalesce(min(CASE WHEN rank >= 2 AND ratio >= 0.7 THEN rank END), max(rank))::INT AS k FROM f GROUP BY instance_id")
def _(spark, read):
    return L.elbow(runs(read).where("run = 0"), 0.3, 2)


_SHUFFLED = "d AS (" + union_all([f"SELECT c_custkey AS id, run, '{f}' AS feature, {draw_sql(1, 'c_custkey', 'run', i)} AS c FROM customer CROSS JOIN (SELECT unnest(range(1, 7)) AS run)" for i, f in enumerate("abc")]) + "), k AS (SELECT id, run, feature, row_number() OVER (PARTITION BY id, run ORDER BY c, feature) AS rank FROM d)"


@query("l8_stability_baseline", f"WITH {_SHUFFLED} SELECT a.rank::INT AS rank, round(avg(CASE WHEN a.feature = b.feature THEN 1.0 ELSE 0 END), 6) AS value FROM k a JOIN k b ON a.id = b.id AND a.rank = b.rank AND a.run < b.run GROUP BY a.rank")
def _(spark, read):
    """Six random rankings of three features for each customer: they agree at a rank in about a third of the pairs."""
    users = read("customer").select(F.col("c_custkey").alias("instance_id"))
    return rounded(L.rank_stability(L.random_rankings(users, ["a", "b", "c"], 6)))


@query("l9_rule_stability", f"WITH {RUNS}, t AS (SELECT instance_id, run, list_sort(list(feature)) AS s FROM runs WHERE rank <= 2 GROUP BY ALL) SELECT a.instance_id, round(avg(len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s)))), 6) AS jaccard, round(avg(CASE WHEN a.s = b.s THEN 1.0 ELSE 0 END), 6) AS identical, round(avg(abs(len(a.s) - len(b.s))), 6) AS size_deviation FROM t a JOIN t b ON a.instance_id = b.instance_id AND a.run <= b.run GROUP BY 1")
def _(spark, read):
    return rounded(L.rule_stability(runs(read).where("rank <= 2")))


@query("l10_overlap_scores", f"WITH {RUNS}, t AS (SELECT instance_id, list(feature) FILTER (WHERE run = 0) AS t, list(feature) FILTER (WHERE run = 1) AS f FROM runs WHERE rank <= 2 GROUP BY instance_id HAVING count(*) FILTER (WHERE run = 0) > 0 AND count(*) FILTER (WHERE run = 1) > 0), p AS (SELECT len(list_intersect(t, f)) * 1.0 / len(f) AS p, len(list_intersect(t, f)) * 1.0 / len(t) AS r, len(list_intersect(t, f)) * 1.0 / len(list_distinct(list_concat(t, f))) AS j FROM t) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS f1, round(avg(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0)), 6) AS f05, round(avg(j), 6) AS jaccard FROM p")
def _(spark, read):
    top = runs(read).where("rank <= 2")
    a, b = (top.where(f"run = {i}").groupBy("instance_id").agg(F.collect_list("feature").alias(c)) for i, c in ((0, "t"), (1, "f")))
    return rounded(L.overlap_scores(a.join(b, "instance_id"), "t", "f"))


@query("l11_rank_overlap", f"""WITH {RUNS}, t AS (SELECT instance_id, list(feature ORDER BY rank) FILTER (WHERE run = 0) AS a, list(feature ORDER BY rank) FILTER (WHERE run = 1) AS b FROM runs GROUP BY instance_id HAVING count(*) FILTER (WHERE run = 0) > 0 AND count(*) FILTER (WHERE run = 1) > 0),
 x AS (SELECT instance_id, least(len(a), len(b)) AS s, greatest(len(a), len(b)) AS l, d, len(list_intersect(a[1:d], b[1:d]))::DOUBLE AS x FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS d FROM t)),
 g AS (SELECT instance_id, any_value(s) AS s, any_value(l) AS l, max(CASE WHEN d = s THEN x END) AS xs, max(CASE WHEN d = l THEN x END) AS xl, sum(CASE WHEN d <= s THEN x / d END) AS ao, sum(x / d * power(0.9, d)) AS allp, coalesce(sum(CASE WHEN d > s THEN (d - s) / d::DOUBLE * power(0.9, d) END), 0) AS tail, sum(CASE WHEN d <= s THEN x / d * power(0.9, d) END) AS sp, sum(CASE WHEN d <= s THEN power(0.9, d) / d END) AS lg FROM x GROUP BY instance_id)
 SELECT instance_id, s::INT AS k, round(xs / s, 6) AS overlap, round(ao / s, 6) AS average_overlap, round((0.1 / 0.9) * (sp - xs * ln(0.1) - xs * lg), 6) AS rbo_min, round((0.1 / 0.9) * (allp + xs / s * tail) + ((xl - xs) / l + xs / s) * power(0.9, l), 6) AS rbo_ext FROM g""")
def _(spark, read):
    r = runs(read)
    a, b = (r.where(f"run = {i}").groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]).alias(c)) for i, c in ((0, "a"), (1, "b")))
    return rounded(L.rank_overlap(a.join(b, "instance_id"), "instance_id", "a", "b"))


_TIED = "h AS (SELECT user_id % 200 AS instance_id, event_id % 4 AS run, event_type AS feature, count(*) AS c FROM events GROUP BY ALL), q AS (SELECT instance_id, run, c, list(feature ORDER BY feature) AS fs FROM h GROUP BY ALL), t AS (SELECT instance_id, list(fs ORDER BY c DESC) FILTER (WHERE run = 0) AS a, list(fs ORDER BY c DESC) FILTER (WHERE run = 1) AS b FROM q GROUP BY instance_id HAVING count(*) FILTER (WHERE run = 0) > 0 AND count(*) FILTER (WHERE run = 1) > 0), d AS (SELECT *, least(len(a), len(b)) AS s, greatest(len(a), len(b)) AS l, unnest(range(1, greatest(len(a), len(b)) + 1)) AS d FROM t), g AS (SELECT *, 2.0 * len(list_intersect(flatten(a[1:d]), flatten(b[1:d]))) / (len(flatten(a[1:d])) + len(flatten(b[1:d]))) AS g FROM d), x AS (SELECT instance_id, s, l, d, g, g * least(d, s) AS x, power(0.9, d) AS pd FROM g), y AS (SELECT instance_id, any_value(s) AS s, any_value(l) AS l, max(CASE WHEN d = s THEN x END) AS xs, max(CASE WHEN d = l THEN x END) AS xl, sum(pd * g) AS ag, sum(CASE WHEN d <= s THEN pd / d * x END) AS sx, coalesce(sum(CASE WHEN d > s THEN pd * (d - s) / d END), 0) AS bd FROM x GROUP BY instance_id), z AS (SELECT *, ceil(round(l + s - xl, 9))::BIGINT AS f FROM y), lp AS (SELECT n, sum(power(0.9, n) / n) OVER (ORDER BY n) AS p FROM range(1, 200) t(n))"


@query("l11_tied_rank_overlap", f"WITH {_TIED} SELECT instance_id, round((0.1 / 0.9) * (sx - xs * ps.p - xs * ln(0.1)), 6) AS rbo_min, round(power(0.9, s) + power(0.9, l) - power(0.9, f) - (0.1 / 0.9) * (s * (pf.p - ps.p) + l * (pf.p - pl.p) + xl * (-ln(0.1) - pf.p)), 6) AS rbo_res, round((0.1 / 0.9) * (ag + xs / s * bd) + power(0.9, l) * ((xl - xs) / l + xs / s), 6) AS rbo_ext FROM z JOIN lp ps ON ps.n = s JOIN lp pl ON pl.n = l JOIN lp pf ON pf.n = f")
def _(spark, read):
    """Rankings of event types by how often they occur; equal counts tie."""
    c = read("events").groupBy((F.col("user_id") % 200).alias("instance_id"), (F.col("event_id") % 4).alias("run"), F.col("event_type").alias("feature")).agg(F.count("*").alias("c"))
    g = c.groupBy("instance_id", "run", "c").agg(F.array_sort(F.collect_list("feature")).alias("fs"))
    a, b = (g.where(f"run = {i}").groupBy("instance_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "fs")), False), lambda s: s["fs"]).alias(k)) for i, k in ((0, "a"), (1, "b")))
    return rounded(L.tied_rank_overlap(a.join(b, "instance_id"), "instance_id", "a", "b"))


_EXPL = "e AS (SELECT user_id AS instance_id, event_type AS feature, sum(CASE WHEN event_id % 3 = 0 THEN -value ELSE value END) AS weight FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY abs(weight) DESC, feature) AS rank FROM e), o AS (SELECT rank, feature, count(*) * 1.0 / (SELECT count(DISTINCT instance_id) FROM e) AS share FROM r WHERE rank <= 3 GROUP BY ALL)"


@query("l12_rank_occurrence", f"WITH {_EXPL} SELECT rank::INT AS rank, feature, round(share, 6) AS share FROM o")
def _(spark, read):
    return rounded(L.rank_occurrence(event_explanations(read)))


@query("l12_cumulative_occurrence", f"WITH {_EXPL} SELECT rank::INT AS rank, round(sum(share) OVER (ORDER BY rank), 6) AS share FROM o WHERE feature = 'click'")
def _(spark, read):
    return rounded(L.cumulative_occurrence(L.rank_occurrence(event_explanations(read)), "click"))


CANDIDATES = "c AS (SELECT l_orderkey AS instance_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS k, CAST(l_discount > 0.05 AS INT) AS hit, l_tax > 0.01 AS changed, l_quantity / 10 AS distance, power(10, l_tax * 100) AS density_ratio FROM lineitem), most AS (SELECT max(k) AS most FROM c)"


def candidates(read):
    """Counterfactual candidates of each order, one for each of its lines: did they hit, and how far are they?"""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"))
    return read("lineitem").select(F.col("l_orderkey").alias("instance_id"), place.alias("k"), (F.col("l_discount") > 0.05).cast("int").alias("hit"), (F.col("l_tax") > 0.01).alias("changed"), (F.col("l_quantity") / 10).alias("distance"), F.pow(F.lit(10.0), F.col("l_tax") * 100).alias("density_ratio"))


def wide_scores(read):
    """Scores of all candidates, and how many an order has at most."""
    c = candidates(read)
    most = c.agg(F.max("k")).first()[0] or 1
    return L.counterfactual_scores(c, k=most), most


_WIDE = "w AS (SELECT instance_id, " + ", ".join(f"sum(CASE WHEN changed THEN {c} ELSE -1 END) - (any_value(most) - count(*)) AS {a}" for c, a in (("hit", "hit"), ("distance", "dist"), ("density_ratio", "dens"))) + ", " + ", ".join(f"coalesce(max(CASE WHEN k = 1 AND changed THEN {c} END), -1)::DOUBLE AS {a}_1" for c, a in (("hit", "hit"), ("distance", "dist"), ("density_ratio", "dens"))) + ", coalesce(max(CASE WHEN changed THEN hit END), 0)::INT AS any_hit, coalesce(sum(CASE WHEN changed THEN hit END), 0)::BIGINT AS hits FROM c CROSS JOIN most GROUP BY instance_id)"


@query("l13_counterfactual_scores", f"WITH {CANDIDATES}, {_WIDE} SELECT any_hit, hits, count(*) AS n, " + ", ".join(f"round(sum({a}), 2) AS {a}" for a in ("hit", "dist", "dens")) + " FROM w GROUP BY any_hit, hits")
def _(spark, read):
    """Sums of the scores over all places."""
    w, most = wide_scores(read)
    total = lambda a: sum((F.col(f"{a}_{i}") for i in range(1, most + 1)), F.lit(0.0))
    return w.groupBy("any_hit", "hits").agg(F.count("*").alias("n"), *[F.round(F.sum(total(a)), 2).alias(a) for a in ("hit", "dist", "dens")])


_SUMMED = ["hit_1", "dist_1", "dens_1"]


@query("l14_counterfactual_summary", f"WITH {CANDIDATES}, {_WIDE} SELECT instance_id % 4 AS method, count(*) FILTER (WHERE hit_1 <> -1) AS tries, " + ", ".join(f"round({'median' if c.startswith('dens') else 'avg'}(CASE WHEN {c} <> -1 THEN {c} END), 4) AS {c}, round(stddev_pop(CASE WHEN {c} <> -1 THEN {c} END), 4) AS {c}_std" for c in _SUMMED) + " FROM w GROUP BY 1")
def _(spark, read):
    w, _most = wide_scores(read)
    return rounded(L.counterfactual_summary(w.withColumn("method", F.col("instance_id") % 4), "method", _SUMMED), 4)


@query("l15_region_counts", f"WITH {CANDIDATES}, b AS (SELECT CASE WHEN distance <= 1 THEN '0-1' WHEN distance <= 3 THEN '1-3' WHEN distance <= 6 THEN '3-6' END AS distance_band, CASE WHEN log10(density_ratio) <= 2 THEN '0-2' WHEN log10(density_ratio) <= 5 THEN '2-5' WHEN log10(density_ratio) <= 20 THEN '5-20' END AS density_band FROM c) SELECT distance_band, density_band, count(*) AS n FROM b WHERE distance_band IS NOT NULL AND density_band IS NOT NULL GROUP BY CUBE (distance_band, density_band)")
def _(spark, read):
    return L.region_counts(candidates(read))


@query("l16_wide_to_long", f"WITH {CANDIDATES}, w AS (SELECT count(DISTINCT instance_id) AS n FROM c) SELECT k::INT AS k, " + ", ".join(f"round(sum(CASE WHEN changed THEN {c} ELSE -1 END) - (any_value(w.n) - count(*)), 2) AS {a}" for c, a in (("hit", "hit"), ("distance", "dist"), ("density_ratio", "dens"))) + " FROM c CROSS JOIN w GROUP BY k")
def _(spark, read):
    w, most = wide_scores(read)
    return L.wide_to_long(w, ["instance_id"], most).groupBy("k").agg(*[F.round(F.sum(a), 2).alias(a) for a in ("hit", "dist", "dens")])


@query("l17_leaf_fidelity", f"WITH {UNIFORM}, {_AGREE}, b AS (SELECT p_partkey, rep, (bb = 'Y')::INT AS bb, (surrogate = 'Y')::INT AS s, d < 1 AS leaf FROM a) SELECT p_partkey, max(CASE WHEN rep = 0 THEN (bb = s)::INT::DOUBLE END) AS hit, round(avg((bb = s)::INT), 6) AS accuracy, round(coalesce(2.0 * count(*) FILTER (WHERE bb = 1 AND s = 1) / nullif(2 * count(*) FILTER (WHERE bb = 1 AND s = 1) + count(*) FILTER (WHERE bb <> s), 0), 0), 6) AS f1, round(avg(CASE WHEN leaf THEN (bb = s)::INT END), 6) AS leaf_accuracy FROM b GROUP BY p_partkey")
def _(spark, read):
    a = agreement(read).select("p_partkey", "rep", (F.col("bb") == "Y").cast("int").alias("bb"), (F.col("surrogate") == "Y").cast("int").alias("surrogate"), (F.col("d") < 1).alias("in_leaf"))
    return rounded(L.leaf_fidelity(a, "p_partkey"))


@query("l18_counterfactual_fairness", f"WITH {UNIFORM}, f AS (SELECT p_partkey, rep, ({PART_MODEL} <> {PART_MODEL.replace('p_size', '(p_size + 10)')})::INT AS flip FROM neigh) SELECT p_partkey, round(avg(flip), 6) AS flip_share, max(CASE WHEN rep = 0 THEN flip END)::DOUBLE AS instance_flip FROM f GROUP BY p_partkey")
def _(spark, read):
    a = with_distance(read).select("p_partkey", "rep", F.expr(PART_MODEL).alias("before"), F.expr(PART_MODEL.replace("p_size", "(p_size + 10)")).alias("after"))
    return rounded(L.counterfactual_fairness(a, "p_partkey"))


_PHI = "p AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, 0.05 * (p_size - avg(p_size) OVER ()) AS a, 0.01 * (p_retailprice - avg(p_retailprice) OVER ()) AS b, avg(p_size) OVER () AS m1, avg(p_retailprice) OVER () AS m2 FROM part)"


def attributed(read):
    """Parts with linear attributions."""
    p = read("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    m = p.agg(F.avg("p_size").alias("m1"), F.avg("p_retailprice").alias("m2"))
    return p.join(F.broadcast(m)).select("p_partkey", *PART_FEATURES, (0.05 * (F.col("p_size") - F.col("m1"))).alias("phi_p_size"), (0.01 * (F.col("p_retailprice") - F.col("m2"))).alias("phi_p_retailprice"))


@query("l19_masks", f"WITH {_PHI} SELECT 1 AS k, round(avg({PART_SCORE.replace('p_size', '(CASE WHEN abs(a) >= abs(b) THEN p_size ELSE m1 END)').replace('p_retailprice', '(CASE WHEN abs(a) >= abs(b) THEN m2 ELSE p_retailprice END)')}), 6) AS score FROM p UNION ALL SELECT 2, round(avg({PART_SCORE}), 6) FROM p")
def _(spark, read):
    return L.masked(attributed(read), PART_FEATURES, [1, 2], True).groupBy("k").agg(F.round(F.avg(F.expr(PART_SCORE)), 6).alias("score"))


@query("l20_resampled_masks", f"WITH {_PHI}, g AS (SELECT n_nationkey AS bg_id, n_nationkey::DOUBLE AS s, 900.0 + n_nationkey AS r FROM nation) SELECT p_partkey, round(avg({PART_SCORE.replace('p_size', '(CASE WHEN abs(a) >= abs(b) THEN s ELSE p_size END)').replace('p_retailprice', '(CASE WHEN abs(a) >= abs(b) THEN p_retailprice ELSE r END)')}), 6) AS score FROM p CROSS JOIN g GROUP BY p_partkey")
def _(spark, read):
    g = read("nation").select(F.col("n_nationkey").alias("bg_id"), F.col("n_nationkey").cast("double").alias("p_size"), (900.0 + F.col("n_nationkey")).alias("p_retailprice"))
    return L.resampled(attributed(read), g, "p_partkey", PART_FEATURES, 1, False).groupBy("p_partkey").agg(F.round(F.avg(F.expr(PART_SCORE)), 6).alias("score"))


@query("l21_imputed_masks", f"WITH {_PHI}, s AS (SELECT avg(p_size) AS q1, avg(p_retailprice) AS q2, var_samp(p_size) AS v1, var_samp(p_retailprice) AS v2, covar_samp(p_size, p_retailprice) AS c FROM p) SELECT p_partkey, round(CASE WHEN abs(a) >= abs(b) THEN p_size ELSE q1 + c / v2 * (p_retailprice - q2) END, 4) AS p_size, round(CASE WHEN abs(a) >= abs(b) THEN q2 + c / v1 * (p_size - q1) ELSE p_retailprice END, 4) AS p_retailprice FROM p CROSS JOIN s")
def _(spark, read):
    s = read("part").agg(*[F.avg(c).alias(f"m{c}") for c in PART_FEATURES], *[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}{b}") for a in PART_FEATURES for b in PART_FEATURES]).first()
    mean = np.array([s[f"m{c}"] for c in PART_FEATURES])
    cov = np.array([[s[a + b] for b in PART_FEATURES] for a in PART_FEATURES])
    return rounded(L.imputed(attributed(read), "p_partkey", PART_FEATURES, 1, True, mean, cov), 4)


_MASKED = "k AS (SELECT p_partkey % 2 AS t, p_size AS x1, p_retailprice AS x2, " + PART_SCORE + " AS y, abs(0.05 * (p_size - avg(p_size) OVER w)) >= abs(0.01 * (p_retailprice - avg(p_retailprice) OVER w)) AS one, avg(p_size) OVER w AS n1, avg(p_retailprice) OVER w AS n2 FROM part WINDOW w AS ()), h AS (SELECT t, CASE WHEN one THEN x1 ELSE avg(x1) OVER v END AS x1, CASE WHEN one THEN avg(x2) OVER v ELSE x2 END AS x2, y FROM k WINDOW v AS (PARTITION BY t)), s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q FROM h WHERE t = 0), f AS (SELECT (c * p - b * q) / (a * c - b * b) AS k1, (a * q - b * p) / (a * c - b * b) AS k2, * FROM s)"


@query("l22_batch_retrain", f"WITH {_MASKED} SELECT round(1 - sum(power(y - (my + k1 * (x1 - m1) + k2 * (x2 - m2)), 2)) / (var_pop(y) * count(*)), 4) AS r2 FROM h CROSS JOIN f WHERE t = 1")
def _(spark, read):
    a = attributed(read).withColumn("y", F.expr(PART_SCORE))
    return rounded(L.batch_retrain(a.where("p_partkey % 2 = 0"), a.where("p_partkey % 2 = 1"), PART_FEATURES, "y", 1, True), 4)


@query("l23_local_accuracy", f"WITH {_PHI} SELECT round(avg(abs(y - (0.05 * p_size + 0.01 * p_retailprice - a - b))), 6) AS mean_gap, round(stddev_pop(y - (a + b)), 6) AS spread FROM (SELECT *, {PART_SCORE} AS y FROM p)".replace("abs(y - (0.05 * p_size + 0.01 * p_retailprice - a - b))", "abs(y - 1.5 - a - b)"))
def _(spark, read):
    return rounded(L.local_accuracy(attributed(read).withColumn("y", F.expr(PART_SCORE)), PART_FEATURES, "y", 1.5))


_SCORED = "x AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_discount * 5 + l_tax AS s FROM lineitem)"


@query("l24_metrics", f"WITH {_SCORED}, d AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY s), c AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM d) SELECT round((SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) FROM c), 6) AS auc, round(1 - sum(power(y - s, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(CASE WHEN (s >= 0.25)::INT = y THEN 1.0 ELSE 0 END), 6) AS accuracy FROM x")
def _(spark, read):
    x = read("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 5 + F.col("l_tax")).alias("s"))
    return rounded(L.roc_auc(x, "y", "s").join(L.r_squared(x, "y", "s")).join(L.accuracy(x, "y", "s", 0.25)))


@query("l25_confusion", f"SELECT {PART_MODEL} AS bb, {TREE} AS surrogate, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, read):
    return L.confusion(read("part").select(F.expr(PART_MODEL).alias("bb"), F.expr(TREE).alias("surrogate")), "bb", "surrogate")


@query("l26_runtime_summary", "SELECT event_type AS run, min(value) AS least, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def _(spark, read):
    return rounded(L.runtime_summary(read("events").withColumnRenamed("event_type", "run"), "run", "value"))
