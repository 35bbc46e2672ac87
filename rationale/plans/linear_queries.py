"""Queries over local linear surrogates, the flagship among them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from rationale.operators import bins as C
from rationale.operators import distance as D
from rationale.operators import linear as G
from rationale.operators import paths as P
from rationale.operators import tabular as TAB
from rationale.operators import neighbours as E
from rationale.operators import texts as T
from rationale.operators.score import score

from .common import PART_FEATURES, PART_SCORE, query, rounded
from .distance_queries import DIST, WIDTH, with_distance
from .neighbour_queries import UNIFORM, N

Z = ["z_size", "z_price"]


def scored_neighbourhood(read, n: int = N):
    """Neighbourhoods of all parts: standardised features, black-box score and kernel weight."""
    d = D.kernel_weights(score(with_distance(read, n), PART_SCORE, "y"), "d", 2)
    z = [((F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}")).alias(k) for c, k in zip(PART_FEATURES, Z, strict=True)]
    return d.select("p_partkey", "rep", *z, "y", "weight")


_FIT = f"""WITH {UNIFORM}, a AS (SELECT p_partkey, rep, (p_size - (SELECT m1 FROM s)) / s1 AS x1, (p_retailprice - (SELECT m2 FROM s)) / s2 AS x2, {PART_SCORE} AS y, sqrt(exp(-power({DIST}, 2) / power({WIDTH!r}, 2))) AS w FROM neigh),
 m AS (SELECT p_partkey, sum(w) AS sw, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * y) / sum(w) AS my FROM a GROUP BY p_partkey),
 c AS (SELECT a.p_partkey, sum(w * (x1 - m1) * (x1 - m1)) + 1 AS a11, sum(w * (x1 - m1) * (x2 - m2)) AS a12, sum(w * (x2 - m2) * (x2 - m2)) + 1 AS a22, sum(w * (x1 - m1) * (y - my)) AS b1, sum(w * (x2 - m2) * (y - my)) AS b2, sum(w * (y - my) * (y - my)) AS yy, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my FROM a JOIN m USING (p_partkey) GROUP BY a.p_partkey),
 f AS (SELECT p_partkey, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS k1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS k2, * EXCLUDE (p_partkey) FROM c)"""


@query("local_linear_explanation", f"{_FIT}, e AS (SELECT p_partkey, 'z_size' AS feature, round(k1, 6) AS weight, abs(k1) AS v FROM f UNION ALL SELECT p_partkey, 'z_price', round(k2, 6), abs(k2) FROM f) SELECT p_partkey, feature, weight, row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, feature)::INT AS rank FROM e")
def _(spark, read):
    """Which features drive the model's decision for each part?"""
    fits = G.local_ridge(scored_neighbourhood(read), ["p_partkey"], Z, "y", "weight")
    return rounded(G.explanation_rows(fits, ["p_partkey"], Z))


@query("g1_local_ridge", f"{_FIT} SELECT p_partkey, round(my - k1 * m1 - k2 * m2, 6) AS intercept, round(k1, 6) AS coef_z_size, round(k2, 6) AS coef_z_price FROM f")
def _(spark, read):
    return rounded(G.local_ridge(scored_neighbourhood(read), ["p_partkey"], Z, "y", "weight").drop("r2"))


@query("g2_local_score", f"{_FIT} SELECT f.p_partkey, round(1 - (yy - 2 * (k1 * b1 + k2 * b2) + k1 * k1 * (a11 - 1) + 2 * k1 * k2 * a12 + k2 * k2 * (a22 - 1)) / yy, 6) AS r2, round(my - k1 * f.m1 - k2 * f.m2 + k1 * x1 + k2 * x2, 6) AS local_pred FROM f JOIN a ON a.p_partkey = f.p_partkey AND a.rep = 0")
def _(spark, read):
    neigh = scored_neighbourhood(read)
    return rounded(G.local_prediction(G.local_ridge(neigh, ["p_partkey"], Z, "y", "weight"), neigh, ["p_partkey"], "p_partkey", Z))


@query("g3_select_highest_weights", f"{_FIT.replace('+ 1 AS a11', '+ 0.01 AS a11').replace('+ 1 AS a22', '+ 0.01 AS a22')} SELECT p_partkey, CASE WHEN abs(k1) >= abs(k2) THEN 'z_size' ELSE 'z_price' END AS chosen FROM f")
def _(spark, read):
    return G.select_features(scored_neighbourhood(read), ["p_partkey"], Z, "y", "weight", 1, "highest_weights").select("p_partkey", F.col("chosen")[0].alias("chosen"))


@query("g3_select_forward")
def _(spark, read):
    return G.select_features(scored_neighbourhood(read), ["p_partkey"], Z, "y", "weight", 1, "forward_selection").select("p_partkey", F.col("chosen")[0].alias("chosen"))


@query("g3_select_lasso")
def _(spark, read):
    return G.select_features(scored_neighbourhood(read, 8), ["p_partkey"], Z, "y", "weight", 1, "lasso_path").select("p_partkey", F.get("chosen", F.lit(0)).alias("chosen"))


@query("g4_explain_tabular")
def _(spark, read):
    """Quartiles of size and price, and the brand, of every part."""
    p = read("part")
    return rounded(TAB.explain_tabular(p, p, "p_partkey", PART_FEATURES, C.quartile_bins(p, PART_FEATURES), ["p_brand"], PART_SCORE, n=100))


@query("g5_explain_text")
def _(spark, read):
    """The ten words of every document that move a length score most."""
    masks = T.text_mask(read("documents"), "doc_id", "text", 8, pattern=r"[^a-zA-Z0-9_]+")
    scored = masks.select(F.col("doc_id").alias("id"), "rep", "kept", F.length("masked").cast("double").alias("y"), (D.cosine_mask(F.col("kept_share"))).alias("d"))
    return rounded(G.text_ridge(D.kernel_weights(scored, "d", 1, 25.0), "id", "kept", "y", "weight").where("rank <= 10"), 4)


_MODELS = "(SELECT 'A' AS label, 1.0 AS intercept, 0.02 AS k1, -0.001 AS k2 UNION ALL SELECT 'B', 0.0, -0.03, 0.001 UNION ALL SELECT 'C', 0.5, 0.0, 0.0002)"


@query("g6_surrogate_predict", f"SELECT p_partkey, label AS predicted FROM (SELECT p_partkey, label, row_number() OVER (PARTITION BY p_partkey ORDER BY intercept + k1 * p_size + k2 * p_retailprice DESC, label) AS r FROM part CROSS JOIN {_MODELS}) WHERE r = 1")
def _(spark, read):
    p = read("part").select("p_partkey", *PART_FEATURES)
    fits = p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(Decimal(b)).cast("decimal(2,1)").alias("intercept"), F.lit(Decimal(c)).cast("decimal(3,2)").alias("coef_p_size"), F.lit(d).alias("coef_p_retailprice")) for a, b, c, d in (("A", "1.0", "0.02", -0.001), ("B", "0.0", "-0.03", 0.001), ("C", "0.5", "0.0", 0.0002))])).alias("m")).select("p_partkey", "m.*")
    return G.surrogate_predict(p, fits, PART_FEATURES, "p_partkey").select("p_partkey", "predicted")


@query("g7_selection_test", f"""{_FIT}, t AS (SELECT p_partkey, avg(y) AS my, avg(x1) AS n1, avg(x2) AS n2, corr(x1, y) AS r1, corr(x2, y) AS r2, stddev_samp(x1) AS d1, stddev_samp(x2) AS d2 FROM a GROUP BY p_partkey),
 q AS (SELECT a.p_partkey, (y - my) * CASE WHEN abs(r1) > abs(r2) THEN (x1 - n1) / d1 * sign(r1) - (x2 - n2) / d2 * sign(r2) ELSE (x2 - n2) / d2 * sign(r2) - (x1 - n1) / d1 * sign(r1) END AS diff, abs(r1) > abs(r2) AS one FROM a JOIN t USING (p_partkey))
 SELECT p_partkey, CASE WHEN any_value(one) THEN 'z_size' ELSE 'z_price' END AS first, count(*) AS n, round(avg(diff) / sqrt(var_samp(diff) / count(*)), 5) AS statistic FROM q GROUP BY p_partkey""")
def _(spark, read):
    return rounded(G.selection_test(scored_neighbourhood(read), "p_partkey", Z, "y", "weight").select("p_partkey", "first", "n", "statistic"), 5)


@query("g8_stable_explain")
def _(spark, read):
    p = read("part")
    stats = E.stats_row(p, PART_FEATURES)

    def make(instances, n):
        rows = E.perturb(instances, stats, "p_partkey", PART_FEATURES, n, "standard-normal").join(F.broadcast(stats))
        d = D.kernel_weights(score(rows.withColumn("d", D.euclidean(PART_FEATURES)), PART_SCORE, "y"), "d", 2)
        return d.select("p_partkey", "rep", *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}")).alias(k) for c, k in zip(PART_FEATURES, Z, strict=True)], "y", "weight")

    return G.stable_explain(p, make, "p_partkey", Z, "y", "weight", 16, 64).select("p_partkey", "n", "stable")


@query("g9_maple")
def _(spark, read):
    p = read("part").select("p_partkey", *PART_FEATURES, F.expr(PART_SCORE).alias("y"))
    leaves = p.select(F.lit(0).alias("tree"), F.floor(F.col("p_size") / 10).alias("leaf"), "p_partkey").union(p.select(F.lit(1), F.floor(F.col("p_retailprice") / 50), "p_partkey"))
    own = leaves.select(F.col("leaf").alias("instance_id"), "tree", "leaf").distinct()
    return G.maple(p, D.leaf_weights(leaves, own, "p_partkey"), PART_FEATURES, "y", "p_partkey").select("instance_id", F.round("coef_p_size", 4).alias("coef_p_size"))


_EXPL = "SELECT user_id AS instance_id, event_type AS feature, sum(CASE WHEN event_id % 3 = 0 THEN -value ELSE value END) AS weight FROM events GROUP BY ALL"


def event_explanations(read):
    """Importance-like weights: signed value sums of each user and event type."""
    return read("events").groupBy(F.col("user_id").alias("instance_id"), F.col("event_type").alias("feature")).agg(F.sum(F.expr("CASE WHEN event_id % 3 = 0 THEN -value ELSE value END")).alias("weight"))


@query("g10_importance", f"SELECT feature, round(sqrt(sum(abs(weight))), 6) AS importance FROM ({_EXPL}) GROUP BY feature")
def _(spark, read):
    return rounded(G.importance(event_explanations(read)))


@query("g10_submodular_pick", f"WITH e AS ({_EXPL}), i AS (SELECT feature, sqrt(sum(abs(weight))) AS v FROM e GROUP BY feature) SELECT 1 AS round, instance_id FROM e JOIN i USING (feature) WHERE weight <> 0 GROUP BY instance_id ORDER BY round(sum(v), 6) DESC, instance_id DESC LIMIT 1")
def _(spark, read):
    return G.submodular_pick(event_explanations(read), 1)


_TWO = ["disc", "tax"]
_LINES = "x AS (SELECT l_returnflag, l_linestatus, l_discount * 100 AS disc, l_tax * 100 AS tax, l_quantity + 0.8 * (l_discount * 100) - 0.5 * (l_tax * 100) AS y FROM lineitem)"
# The first choice by the larger |c|; the second comes level at the smaller positive of two moves; then least squares.
_PATH_SQL = f"""WITH {_LINES}, m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, regr_sxy(y, disc) AS c1, regr_sxy(y, tax) AS c2, regr_sxx(disc, disc) AS g11, regr_sxx(tax, tax) AS g22, regr_sxy(disc, tax) AS g12, avg(y) AS my, avg(disc) AS m1, avg(tax) AS m2 FROM x GROUP BY ALL),
 f AS (SELECT *, abs(c1) >= abs(c2) AS one, greatest(abs(c1), abs(c2)) AS lam, CASE WHEN abs(c1) >= abs(c2) THEN sign(c1) / g11 ELSE sign(c2) / g22 END AS d, CASE WHEN abs(c1) >= abs(c2) THEN c2 ELSE c1 END AS ck FROM m),
 g AS (SELECT *, (lam - ck) / (1 - g12 * d) AS up, (lam + ck) / (1 + g12 * d) AS down FROM f),
 h AS (SELECT *, least(CASE WHEN up > 0 THEN up END, CASE WHEN down > 0 THEN down END) AS move, g11 * g22 - g12 * g12 AS det FROM g),
 t AS (SELECT l_returnflag, l_linestatus, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, (y - my) * CASE WHEN one THEN disc - m1 ELSE tax - m2 END AS a, (y - my) * CASE WHEN one THEN tax - m2 ELSE disc - m1 END AS b FROM x JOIN f USING (l_returnflag, l_linestatus)) GROUP BY ALL),
 s AS (SELECT l_returnflag, l_linestatus, (abs(ma) - abs(mb)) / sqrt(2 * (va + vb - 2 * CASE WHEN ma * mb >= 0 THEN 1 ELSE -1 END * cab) / n) AS statistic FROM t),
 p AS (SELECT l_returnflag, l_linestatus, 0 AS step, lam / n AS penalty, CASE WHEN one THEN 'disc' ELSE 'tax' END AS entered, 0.0 AS coef_disc, 0.0 AS coef_tax FROM h
  UNION ALL SELECT l_returnflag, l_linestatus, 1, (lam - move) / n, CASE WHEN one THEN 'tax' ELSE 'disc' END, CASE WHEN one THEN move * d ELSE 0 END, CASE WHEN one THEN 0 ELSE move * d END FROM h
  UNION ALL SELECT l_returnflag, l_linestatus, 2, 0, NULL, (g22 * c1 - g12 * c2) / det, (g11 * c2 - g12 * c1) / det FROM h)
 SELECT p.l_returnflag, p.l_linestatus, step, round(penalty, 6)::DOUBLE + 0.0 AS penalty, entered, round(coef_disc, 6)::DOUBLE + 0.0 AS coef_disc, round(coef_tax, 6)::DOUBLE + 0.0 AS coef_tax, CASE WHEN step = 0 THEN round(statistic, 4) END AS statistic, step > 0 OR statistic >= 1.6448536269514722 AS stable FROM p JOIN s USING (l_returnflag, l_linestatus)"""


@query("g11_tested_path", _PATH_SQL)
def _(spark, read):
    """Which of discount and tax comes first, and is it told from the other?"""
    rows = read("lineitem").select("l_returnflag", "l_linestatus", (F.col("l_discount") * 100).alias("disc"), (F.col("l_tax") * 100).alias("tax"), "l_quantity")
    rows = rows.withColumn("y", F.col("l_quantity") + 0.8 * F.col("disc") - 0.5 * F.col("tax")).withColumn("one", F.lit(1.0))
    path = P.tested_path(rows, ["l_returnflag", "l_linestatus"], _TWO, "y", "one")
    return rounded(path.select("l_returnflag", "l_linestatus", "step", "penalty", "entered", "coef_disc", "coef_tax", F.round("statistic", 4).alias("statistic"), "stable"))
