"""Queries over choices: features of an attribution, refits, kept rows, families of distributions, counterfactuals by search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rationale.operators import condensed as N
from rationale.operators import families as D
from rationale.operators import refit as R
from rationale.operators import search as S
from rationale.operators import shapley as K

from .common import PART_FEATURES, PART_MODEL, query, rounded, union_all

_ADDITIVE = "0.03 * p_size + 0.00001 * p_retailprice * p_retailprice"
_FOUR = ["p_size", "p_retailprice", "seventh", "eleventh"]


@query("k21_kernel_shap_aic", "WITH g AS (SELECT avg(0.03 * n_nationkey * 2) AS s, avg(0.00001 * (900.0 + n_nationkey * 3) * (900.0 + n_nationkey * 3)) AS r FROM nation) SELECT p_partkey, round(0.03 * p_size - s, 9) + 0.0 AS phi_p_size, round(0.00001 * p_retailprice * p_retailprice - r, 9) + 0.0 AS phi_p_retailprice, 0.0::DOUBLE AS phi_seventh, 0.0::DOUBLE AS phi_eleventh FROM part CROSS JOIN g")
def _(spark, read):
    """Two features that the model reads, and two that it doesn't."""
    rows = read("part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 7).alias("seventh"), (F.col("p_partkey") % 11).alias("eleventh"))
    n = F.col("n_nationkey")
    background = read("nation").select((n * 2).cast("double").alias("p_size"), (900.0 + n * 3).alias("p_retailprice"), (n % 7).alias("seventh"), (n % 11).alias("eleventh"))
    return rounded(K.kernel_shap(rows, background, "p_partkey", _FOUR, _ADDITIVE, select="aic"), 9)


_PHI = {"l_quantity": "(l_quantity - 25) * 0.02", "l_discount": "(l_discount - 0.05) * 10"}
_REFIT = "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS bq, regr_intercept(l_extendedprice, l_quantity) AS aq, regr_slope(l_extendedprice, l_discount) AS bd, regr_intercept(l_extendedprice, l_discount) AS ad FROM lineitem), p AS (SELECT l_returnflag, l_extendedprice AS y, CASE WHEN {q} {cmp} {d} THEN ad + bd * l_discount ELSE aq + bq * l_quantity END AS f FROM lineitem CROSS JOIN m) SELECT l_returnflag, count(*) AS n, round(sqrt(avg((y - f) * (y - f))), 3) AS rmse, round(avg(f), 3) AS mean FROM p GROUP BY l_returnflag"


def _refit(read, keep):
    rows = read("lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice", *[F.expr(x).alias(f"phi_{f}") for f, x in _PHI.items()])
    error = F.col("l_extendedprice") - F.col("prediction")
    out = R.refit_predictions(read("lineitem"), rows, list(_PHI), "l_extendedprice", 1, keep)
    return rounded(out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg("prediction").alias("mean")), 3)


@query("l27_refit_without", _REFIT.format(q=_PHI["l_quantity"], d=_PHI["l_discount"], cmp=">="))
def _(spark, read):
    """Error of the model that never knew the more important of a line item's two features."""
    return _refit(read, False)


@query("l27_refit_with", _REFIT.format(q=_PHI["l_quantity"], d=_PHI["l_discount"], cmp="<"))
def _(spark, read):
    """Error of the model that knew that feature alone."""
    return _refit(read, True)


@query("e20_condensed")
def _(spark, read):
    """The parts by whose nearest one every part keeps the model's label."""
    rows = read("part").select("p_partkey", (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 1000).alias("price"), F.expr(PART_MODEL).alias("label"))
    return N.condensed(rows, "p_partkey", ["size", "price"], "label")


@query("i12_counterfactual_search")
def _(spark, read):
    """For each part the nearest size and price found that the model gives the other label."""
    rows = read("part").select("p_partkey", *[F.col(c).cast("double").alias(c) for c in PART_FEATURES])
    bounds = rows.agg(*[f(c).alias(f"{e}_{c}") for c in PART_FEATURES for e, f in (("lo", F.min), ("hi", F.max))])
    other = F.when(F.expr(PART_MODEL) == "Y", "N").otherwise("Y")
    return rounded(S.search_counterfactuals(rows, bounds, PART_MODEL, "p_partkey", PART_FEATURES, other, starts=4))


_FITTED = ["l_quantity", "l_extendedprice", "l_discount"]
_CLOSED = {
    "uniform": ("lo", "hi - lo", "1 / (hi - lo)"),
    "normal": ("m", "sd", "exp(-power((t - m) / sd, 2) / 2) / (sd * sqrt(2 * pi()))"),
    "exponential": ("lo", "m - lo", "exp(-(t - lo) / (m - lo)) / (m - lo)"),
    "laplace": ("q2", "md", "exp(-abs(t - q2) / md) / (2 * md)"),
    "lognormal": ("ml", "sl", "CASE WHEN lo > 0 THEN exp(-power((ln(t) - ml) / sl, 2) / 2) / (t * sl * sqrt(2 * pi())) END"),
}
_FAMILIES = f"""WITH x AS ({union_all([f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM lineitem" for c in _FITTED])}),
 s AS (SELECT feature, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sd, avg(CASE WHEN v > 0 THEN ln(v) END) AS ml, stddev_pop(CASE WHEN v > 0 THEN ln(v) END) AS sl, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY feature),
 w AS (SELECT *, greatest(ceil((hi - lo) / (2 * (q3 - q1) / power(n, 1.0 / 3))), ceil(log2(n)) + 1)::BIGINT AS bins FROM s), d AS (SELECT feature, avg(abs(v - q2)) AS md FROM x JOIN s USING (feature) GROUP BY feature),
 c AS (SELECT feature, least(floor((v - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin, count(*) AS k FROM x JOIN w USING (feature) GROUP BY ALL), e AS (SELECT *, unnest(range(0, bins)) AS bin FROM w JOIN d USING (feature)),
 g AS (SELECT e.*, coalesce(k, 0) * bins / n AS y, lo + (e.bin + 0.5) * (hi - lo) / bins AS t FROM e LEFT JOIN c ON c.feature = e.feature AND c.bin = e.bin),
 f AS ({union_all([f"SELECT feature, '{f}' AS family, {a} AS a, {b} AS b, power(y - ({p}) * (hi - lo), 2) AS e FROM g" for f, (a, b, p) in _CLOSED.items()])}), h AS (SELECT feature, family, any_value(a) AS a, any_value(b) AS b, sum(e) AS sse FROM f WHERE e IS NOT NULL GROUP BY ALL)
 SELECT feature, family, round(a, 4) AS a, round(b, 4) AS b, round(sse, 4) AS sse, row_number() OVER (PARTITION BY feature ORDER BY sse, family) = 1 AS best FROM h"""


@query("b22_families", _FAMILIES)
def _(spark, read):
    """The families whose parameters SQL can give; the gamma distribution is in ``b22_drawn``."""
    return rounded(D.fit_families(read("lineitem"), _FITTED, tuple(_CLOSED)), 4)


@query("b22_drawn")
def _(spark, read):
    """A drawn row for each part, from the families that fit the order values and the line items' best."""
    rows = read("lineitem").join(read("orders").select("o_totalprice", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    fits = D.fit_families(rows, ["o_totalprice", "l_extendedprice", "l_quantity"])
    return rounded(D.fitted_sample(fits, read("part").count()))
