"""Queries over Shapley attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rationale.functions.draws import draw_sql
from rationale.operators import linearshap as LS
from rationale.operators import shapley as K

from .common import PART_FEATURES, PART_SCORE, query, rounded
from .evaluate_queries import attributed

BG = "g AS (SELECT n_nationkey AS bg_id, (n_nationkey * 2)::DOUBLE AS bs, 900.0 + n_nationkey * 3 AS br FROM nation)"


def background(read):
    return read("nation").select(F.col("n_nationkey").alias("bg_id"), (F.col("n_nationkey") * 2).cast("double").alias("p_size"), (900.0 + F.col("n_nationkey") * 3).alias("p_retailprice"))


def _f(size: str, price: str) -> str:
    return PART_SCORE.replace("p_size", f"({size})").replace("p_retailprice", f"({price})")


VALUES = f"{BG}, v AS (SELECT p_partkey, avg({_f('p_size', 'p_retailprice')}) AS v11, avg({_f('p_size', 'br')}) AS v10, avg({_f('bs', 'p_retailprice')}) AS v01, avg({_f('bs', 'br')}) AS v00 FROM part CROSS JOIN g GROUP BY p_partkey)"
PHIS = "SELECT p_partkey, round(((v10 - v00) + (v11 - v01)) / 2, 6) AS phi_p_size, round(((v01 - v00) + (v11 - v10)) / 2, 6) AS phi_p_retailprice FROM v"


@query("k1_shap_exact", f"WITH {VALUES} {PHIS}")
def _(spark, read):
    return rounded(K.shap_exact(read("part"), background(read), "p_partkey", PART_FEATURES, PART_SCORE))


@query("k2_varying_features", f"WITH {BG} SELECT p_partkey, (max((abs(p_size - bs) > 1e-7)::INT) + max((abs(p_retailprice - br) > 1e-7)::INT))::INT AS n FROM part CROSS JOIN g WHERE bg_id = 3 GROUP BY p_partkey")
def _(spark, read):
    return K.varying_features(read("part"), background(read).where("bg_id = 3"), "p_partkey", PART_FEATURES).select("p_partkey", F.size("varying").alias("n"))


_LINE = ["l_quantity", "l_extendedprice / 1000", "l_discount * 100", "l_tax * 100"]


@query("k3_kernel_masks", f"WITH k AS (SELECT m, bit_count(m) AS size, (3.0 / (bit_count(m) * (4 - bit_count(m)))) / (3.0 / 3 + 3.0 / 4 + 3.0 / 3) / CASE bit_count(m) WHEN 2 THEN 6 ELSE 4 END AS w FROM (SELECT unnest(range(1, 15)) AS m)) SELECT l_returnflag, size::INT AS size, count(*) AS n, round(max(w), 8) AS w, round(avg({' + '.join(f'(m >> {i} & 1) * ({x})' for i, x in enumerate(_LINE))}), 4) AS kept FROM lineitem CROSS JOIN k GROUP BY ALL")
def _(spark, read):
    """Weights of all coalitions of four features, and what each size keeps of the line items' values."""
    masks = K.kernel_masks(spark, len(_LINE))
    kept = sum((F.getbit("mask", F.lit(i)) * F.expr(x) for i, x in enumerate(_LINE)), F.lit(0.0))
    rows = read("lineitem").join(F.broadcast(masks)).groupBy("l_returnflag", F.bit_count("mask").cast("int").alias("size"))
    return rows.agg(F.count("*").alias("n"), F.round(F.max("w"), 8).alias("w"), F.round(F.avg(kept), 4).alias("kept"))


@query("k4_kernel_shap", f"WITH {VALUES} {PHIS}")
def _(spark, read):
    """With all coalitions the same as the exact values."""
    return rounded(K.kernel_shap(read("part"), background(read), "p_partkey", PART_FEATURES, PART_SCORE))


_DRAWN = f"{BG}, x AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r, bs, br, {draw_sql(2, 'p_partkey', 'rep', 0)} AS c0, {draw_sql(2, 'p_partkey', 'rep', 1)} AS c1 FROM part CROSS JOIN (SELECT unnest(range(1, 9)) AS rep) JOIN g ON bg_id = floor({draw_sql(1, 'p_partkey', 'rep', 50)} * (SELECT count(*) FROM g))), y AS (SELECT p_partkey, 'p_size' AS feature, {_f('s', '(CASE WHEN c1 < c0 THEN r ELSE br END)')} - {_f('bs', '(CASE WHEN c1 < c0 THEN r ELSE br END)')} AS d FROM x UNION ALL SELECT p_partkey, 'p_retailprice', {_f('(CASE WHEN c0 < c1 THEN s ELSE bs END)', 'r')} - {_f('(CASE WHEN c0 < c1 THEN s ELSE bs END)', 'br')} FROM x)"


@query("k5_sampling_shap", f"WITH {_DRAWN} SELECT p_partkey, feature, round(avg(d), 9) AS phi, round(var_pop(d), 9) AS variance FROM y GROUP BY ALL")
def _(spark, read):
    return rounded(K.sampling_shap(read("part"), background(read), "p_partkey", PART_FEATURES, PART_SCORE, 8), 9)


_VAR = "f AS (SELECT user_id, event_type AS feature, var_pop(value) AS variance, avg(value) AS phi FROM events GROUP BY ALL)"


def variances(read):
    return read("events").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.var_pop("value").alias("variance"), F.avg("value").alias("phi"))


@query("k6_allocate_samples", f"WITH {_VAR} SELECT user_id, feature, (floor(round(coalesce(variance / nullif(sum(variance) OVER (PARTITION BY user_id), 0), 0) * 1000 / 2, 9)) * 2)::BIGINT AS n FROM f")
def _(spark, read):
    return K.allocate_samples(variances(read), "user_id", 1000)


@query("k7_efficiency_correction", f"WITH {_VAR}, t AS (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id), v AS (SELECT f.user_id, feature, phi, total - sum(phi) OVER w AS gap, coalesce(variance / nullif(max(variance) OVER w, 0) * 1e6, 1.0) AS v FROM f JOIN t USING (user_id) WINDOW w AS (PARTITION BY f.user_id)) SELECT user_id, feature, round(phi + gap * (v - v * sum(v) OVER (PARTITION BY user_id) / (1 + sum(v) OVER (PARTITION BY user_id))), 3) AS phi FROM v")
def _(spark, read):
    v = variances(read)
    totals = read("events").groupBy("user_id").agg(F.sum("value").alias("total"))
    return rounded(K.efficiency_correction(v, totals, "user_id"), 3)


@query("k8_permutation_shap", f"WITH {VALUES} {PHIS}")
def _(spark, read):
    return rounded(K.permutation_shap(read("part"), background(read), "p_partkey", PART_FEATURES, PART_SCORE))


@query("k9_linear_shap", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) * 0.05, 6) AS phi_p_size, round((p_retailprice - avg(p_retailprice) OVER ()) * -0.01, 6) + 0.0 AS phi_p_retailprice FROM part")
def _(spark, read):
    return rounded(K.linear_shap(read("part"), {"p_size": 0.05, "p_retailprice": -0.01}).select("p_partkey", "phi_p_size", "phi_p_retailprice"))


@query("k10_global_importance", f"WITH {VALUES}, p AS ({PHIS}), l AS (SELECT 'p_size' AS feature, abs(phi_p_size) AS a FROM p UNION ALL SELECT 'p_retailprice', abs(phi_p_retailprice) FROM p), i AS (SELECT feature, avg(a) AS importance FROM l GROUP BY feature) SELECT feature, round(importance, 4) AS importance, row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank FROM i")
def _(spark, read):
    phis = K.shap_exact(read("part"), background(read), "p_partkey", PART_FEATURES, PART_SCORE)
    return rounded(K.global_importance(K.attribution_rows(phis, "p_partkey", PART_FEATURES)), 4)


@query("k11_interactions", "WITH x AS (SELECT l_quantity, l_extendedprice * l_discount AS phi, l_extendedprice, l_discount, l_tax, row_number() OVER (ORDER BY l_quantity, l_extendedprice) - 1 AS i FROM lineitem), r AS (SELECT i // 50 AS run, corr(phi, l_extendedprice) AS a, corr(phi, l_discount) AS b, corr(phi, l_tax) AS c FROM x GROUP BY 1), s AS (SELECT 'l_extendedprice' AS other, sum(abs(a)) FILTER (WHERE NOT isnan(a)) AS strength FROM r UNION ALL SELECT 'l_discount', sum(abs(b)) FILTER (WHERE NOT isnan(b)) FROM r UNION ALL SELECT 'l_tax', sum(abs(c)) FILTER (WHERE NOT isnan(c)) FROM r) SELECT other, round(strength, 2) AS strength, row_number() OVER (ORDER BY strength DESC, other)::INT AS rank FROM s")
def _(spark, read):
    x = read("lineitem").select("l_quantity", (F.col("l_extendedprice") * F.col("l_discount")).alias("phi_l_quantity"), "l_extendedprice", "l_discount", "l_tax")
    return rounded(K.interactions(x, "l_quantity", ["l_extendedprice", "l_discount", "l_tax"], "l_extendedprice"), 2)


@query("k11_interactions_nulls", "WITH x AS (SELECT l_quantity, l_extendedprice * l_discount AS phi, CASE WHEN l_tax > 0.02 THEN l_tax END AS t, CASE WHEN l_discount > 0.03 THEN l_discount END AS d, row_number() OVER (ORDER BY l_quantity, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem), m AS (SELECT i // 50 AS run, phi, coalesce(t, avg(t) OVER ()) AS t, coalesce(d, avg(d) OVER ()) AS d, (t IS NULL)::INT AS tn, (d IS NULL)::INT AS dn FROM x), r AS (SELECT run, corr(phi, t) AS a, corr(phi, tn) AS b, corr(phi, d) AS c, corr(phi, dn) AS e FROM m GROUP BY run), s AS (SELECT sum(abs(CASE WHEN isfinite(a) THEN a ELSE 0 END)) AS a, sum(abs(CASE WHEN isfinite(b) THEN b ELSE 0 END)) AS b, sum(abs(CASE WHEN isfinite(c) THEN c ELSE 0 END)) AS c, sum(abs(CASE WHEN isfinite(e) THEN e ELSE 0 END)) AS e FROM r), o AS (SELECT 't' AS other, greatest(a, b) AS strength FROM s UNION ALL SELECT 'd', greatest(c, e) FROM s) SELECT other, round(strength, 1) AS strength, row_number() OVER (ORDER BY strength DESC, other)::INT AS rank FROM o")
def _(spark, read):
    place = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    x = read("lineitem").select("l_quantity", (F.col("l_extendedprice") * F.col("l_discount")).alias("phi_l_quantity"), F.concat_ws("-", F.lpad(F.format_string("%.2f", "l_extendedprice"), 12, "0"), place).alias("place"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("t"), F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("d"))
    return rounded(K.interactions(x, "l_quantity", ["t", "d"], "place", True), 1)


@query("k12_monitor", """WITH r AS (SELECT event_type, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n, sum(value) OVER w AS s1, sum(value * value) OVER w AS q1, sum(value) OVER (PARTITION BY event_type) AS s, sum(value * value) OVER (PARTITION BY event_type) AS q FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT event_type, i, (s1 / i - (s - s1) / (n - i)) / sqrt(((q1 - s1 * s1 / i) + (q - q1 - (s - s1) * (s - s1) / (n - i))) / (n - 2) * (1.0 / i + 1.0 / (n - i))) AS t FROM r WHERE i % 50 = 0 AND i >= 2 AND n - i >= 2),
 b AS (SELECT event_type, i, t, row_number() OVER (PARTITION BY event_type ORDER BY abs(t) DESC, i) AS k FROM c) SELECT event_type, i::INT AS cut, round(t, 4) AS t FROM b WHERE k = 1""")
def _(spark, read):
    return rounded(K.monitor(read("events"), "event_type", "ts", "value").select("event_type", "cut", "t"), 4)


@query("k13_partial_dependence", f"WITH e AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part), g AS (SELECT lo + i * (hi - lo) / 9 AS x FROM e CROSS JOIN (SELECT unnest(range(0, 10)) AS i)) SELECT round(x, 6) AS x, round(avg({_f('x', 'p_retailprice')}), 6) AS mean FROM part CROSS JOIN g GROUP BY x")
def _(spark, read):
    return rounded(K.partial_dependence(read("part"), "p_partkey", "p_size", PART_FEATURES, PART_SCORE, 10))


@query("k13_partial_dependence_2d", f"WITH e AS (SELECT min(p_size)::DOUBLE AS l1, max(p_size)::DOUBLE AS h1, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM part), g AS (SELECT l1 + i * (h1 - l1) / 4 AS x, l2 + j * (h2 - l2) / 4 AS y FROM e CROSS JOIN (SELECT unnest(range(0, 5)) AS i) CROSS JOIN (SELECT unnest(range(0, 5)) AS j)) SELECT round(x, 6) AS x, round(y, 6) AS y, round({_f('x', 'y')}, 6) AS mean FROM g")
def _(spark, read):
    return rounded(K.partial_dependence_2d(read("part"), "p_partkey", ("p_size", "p_retailprice"), PART_FEATURES, PART_SCORE, 5))


_PCA = "a AS (SELECT p_partkey, 0.05 * (p_size - avg(p_size) OVER ()) AS a, 0.01 * (p_retailprice - avg(p_retailprice) OVER ()) AS b FROM part), v AS (SELECT var_samp(a) AS s, covar_samp(a, b) AS t, var_samp(b) AS u FROM a), e AS (SELECT *, (s + u) / 2 + sqrt(power((s - u) / 2, 2) + t * t) AS l FROM v)"


@query("k14_attribution_pca", f"WITH {_PCA} SELECT p_partkey, round(abs(a * t + b * (l - s)) / sqrt(t * t + (l - s) * (l - s)), 4) AS pc1 FROM a CROSS JOIN e")
def _(spark, read):
    return K.attribution_pca(attributed(read), "p_partkey", PART_FEATURES).select("p_partkey", F.round(F.abs(F.col("pc")[0]), 4).alias("pc1"))


@query("k20_correlated_linear", "WITH x AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice + 0.5 * p_size AS b FROM part), m AS (SELECT avg(a) AS ma, avg(b) AS mb, covar_samp(a, b) / var_samp(a) AS ra, covar_samp(a, b) / var_samp(b) AS rb FROM x) SELECT p_partkey, round(2 + 3 * ma - 0.5 * mb, 6) AS base, round(0.5 * ((2 * 3 - 0.5 * ra) * (a - ma) - 3 * rb * (b - mb)), 6) + 0.0 AS phi_size, round(0.5 * ((2 * -0.5 + 3 * rb) * (b - mb) + 0.5 * ra * (a - ma)), 6) + 0.0 AS phi_price FROM x CROSS JOIN m")
def _(spark, read):
    """Size and a price that rises with it."""
    rows = read("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") + 0.5 * F.col("p_size")).alias("price"))
    return rounded(LS.correlated_linear_shap(rows, rows, "p_partkey", ["size", "price"], {"size": 3.0, "price": -0.5}, 2.0))
