"""Queries over anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rationale.functions.special import exploration_rate
from rationale.operators import anchors as J
from rationale.operators import bestarm as B
from rationale.operators import bins as C
from rationale.operators.score import score

from .common import PART_MODEL, query, rounded

EDGES = "e AS (SELECT unnest(list_distinct(quantile_cont(p_size, [0.25, 0.5, 0.75]))) AS value FROM part)"


@query("j1_predicates", f"WITH {EDGES} SELECT p_partkey, 'p_size' AS feature, CASE WHEN p_size <= value THEN '<=' ELSE '>' END AS op, value::DOUBLE AS value, NULL::VARCHAR AS text FROM part CROSS JOIN e UNION ALL SELECT p_partkey, 'p_brand', '=', NULL, p_brand FROM part")
def _(spark, read):
    p = read("part")
    return J.predicates(p, "p_partkey", C.quartile_bins(p, ["p_size"]), ["p_brand"])


def _preds(spark, read):
    """Both sides of each size quartile, and the first brand."""
    e = C.quartile_bins(read("part"), ["p_size"]).select(F.posexplode("edges").alias("i", "value"))
    both = e.select((F.col("i") * 2).alias("pred_id"), F.lit("p_size").alias("feature"), F.lit("<=").alias("op"), "value", F.lit(None).cast("string").alias("text")).union(e.select(F.col("i") * 2 + 1, F.lit("p_size"), F.lit(">"), "value", F.lit(None).cast("string")))
    return both.union(spark.createDataFrame([(6, "p_brand", "=", None, "Brand#1")], "pred_id int, feature string, op string, value double, text string"))


_P = "q AS (SELECT list_sort(list_distinct(quantile_cont(p_size, [0.25, 0.5, 0.75]))) AS edges FROM part), pr AS (SELECT (i - 1) * 2 AS pred_id, edges[i] AS value, '<=' AS op FROM q CROSS JOIN (SELECT unnest(range(1, 4)) AS i) UNION ALL SELECT (i - 1) * 2 + 1, edges[i], '>' FROM q CROSS JOIN (SELECT unnest(range(1, 4)) AS i) UNION ALL SELECT 6, NULL, '='), mx AS (SELECT p_partkey, pred_id::INT AS pred_id, CASE op WHEN '<=' THEN p_size <= value WHEN '>' THEN p_size > value ELSE p_brand = 'Brand#1' END::INT AS holds FROM part CROSS JOIN pr)"


@query("j2_predicate_matrix", f"WITH {_P} SELECT pred_id, sum(holds)::BIGINT AS n, count(*) AS of FROM mx GROUP BY pred_id")
def _(spark, read):
    m = J.predicate_matrix(read("part"), _preds(spark, read), "p_partkey", ["p_size", "p_brand"])
    return m.groupBy("pred_id").agg(F.sum("holds").alias("n"), F.count("*").alias("of"))


_SETS = [(1, 0), (2, 1), (2, 6), (3, 3), (3, 4)]
_STATS = f"{_P}, st AS (SELECT * FROM (VALUES {', '.join(map(str, _SETS))}) t(set_id, pred_id)), y AS (SELECT p_partkey, ({PART_MODEL} = 'Y')::INT AS positive FROM part), hit AS (SELECT set_id, p_partkey FROM st JOIN mx USING (pred_id) WHERE holds = 1 GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM st s2 WHERE s2.set_id = st.set_id)), cs AS (SELECT set_id, count(*) AS n, sum(positive)::BIGINT AS positives, count(*)::DOUBLE / (SELECT count(*) FROM part) AS coverage FROM hit JOIN y USING (p_partkey) GROUP BY set_id)"
_STATS = _STATS.replace("GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM st s2 WHERE s2.set_id = st.set_id)", "GROUP BY set_id, p_partkey HAVING count(*) = CASE set_id WHEN 1 THEN 1 ELSE 2 END")


def _stats(spark, read):
    p = read("part")
    matrix = J.predicate_matrix(p, _preds(spark, read), "p_partkey", ["p_size", "p_brand"])
    labels = p.select("p_partkey", (F.expr(PART_MODEL) == "Y").cast("int").alias("positive"))
    return J.candidate_stats(matrix, labels, spark.createDataFrame(_SETS, "set_id int, pred_id int"), "p_partkey")


@query("j3_candidate_stats", f"WITH {_STATS} SELECT set_id, n, positives, round(coverage, 6) AS coverage FROM cs")
def _(spark, read):
    return rounded(_stats(spark, read))


_KL = "(least(greatest({p}, 1e-7), 1 - 1e-7) * ln(least(greatest({p}, 1e-7), 1 - 1e-7) / least(greatest({q}, 1e-7), 1 - 1e-7)) + (1 - least(greatest({p}, 1e-7), 1 - 1e-7)) * ln((1 - least(greatest({p}, 1e-7), 1 - 1e-7)) / (1 - least(greatest({q}, 1e-7), 1 - 1e-7))))"
_UP, _LOW = _KL.format(p="p", q="((a + b) / 2)"), _KL.format(p="p", q="((c + d) / 2)")
_HALVED = f"bi AS (SELECT set_id, p, level, 0 AS step, p AS a, least(p + sqrt(level / 2), 1.0) AS b, greatest(p - sqrt(level / 2), 0.0) AS c, p AS d FROM (SELECT set_id, positives::DOUBLE / n AS p, {exploration_rate(2, 1, 0.05)!r} / n AS level FROM cs) UNION ALL SELECT set_id, p, level, step + 1, CASE WHEN {_UP} > level THEN a ELSE (a + b) / 2 END, CASE WHEN {_UP} > level THEN (a + b) / 2 ELSE b END, CASE WHEN {_LOW} > level THEN (c + d) / 2 ELSE c END, CASE WHEN {_LOW} > level THEN d ELSE (c + d) / 2 END FROM bi WHERE step < 16)"


@query("j4_kl_bounds", f"WITH RECURSIVE {_STATS}, {_HALVED} SELECT set_id, n, positives, round(coverage, 6) AS coverage, round(p, 6) AS precision, round(c, 6) AS lower, round(b, 6) AS upper FROM cs JOIN bi USING (set_id) WHERE step = 16")
def _(spark, read):
    return rounded(J.with_bounds(_stats(spark, read), 2, 1))


@query("j5_anchor_beam")
def _(spark, read):
    p = score(read("part"), PART_MODEL)
    own = J.predicate_matrix(p, _preds(spark, read), "p_partkey", ["p_size", "p_brand"], ("label",)).where("holds = 1")
    named = own.select("p_partkey", "pred_id", F.col("label").alias("wanted")).join(F.broadcast(_preds(spark, read)), "pred_id")
    return rounded(J.anchor_beam(p.withColumnRenamed("p_partkey", "row_key"), named, "row_key", ["p_size", "p_brand"], "label", "p_partkey", beam=2, max_size=2).groupBy("accepted").agg(F.count("*").alias("n"), F.avg("precision").alias("precision")))


@query("j6_anchor_text")
def _(spark, read):
    """The words of each turn of a conversation that keep its length label."""
    c = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = J.anchor_words(c, "id", "text", lambda masked: F.when(F.length(masked) > 200, "long").otherwise("short"))
    return rounded(found.withColumn("preds", F.array_join(F.transform("preds", lambda x: x.cast("string")), " ")))




_CELL = "CASE WHEN s <= 4 THEN 0 WHEN s <= 25 THEN 1 ELSE 2 END"


@query("j7_best_arm_anchors", f"""WITH b AS (SELECT {_CELL} AS cs, (r > 950)::INT AS cr, CASE WHEN (s > 25 AND r > 950) OR s < 5 THEN 'Y' ELSE 'N' END AS y FROM (SELECT (n_nationkey * 2)::DOUBLE AS s, 900.0 + 4 * ((7 * n_nationkey) % 25) AS r FROM nation)),
 x AS (SELECT p_partkey, {_CELL} AS cs, (p_retailprice > 950)::INT AS cr, {PART_MODEL} AS y FROM (SELECT *, p_size AS s FROM part)),
 c AS (SELECT p_partkey, cs = 2 AS two, (SELECT count(*) FROM b WHERE b.cs = x.cs AND (x.cs < 2 OR b.cr = x.cr)) / 25.0 AS coverage FROM x)
 SELECT p_partkey, CASE WHEN two THEN 'p_size,p_retailprice' ELSE 'p_size' END AS anchor, 1.0::DOUBLE AS precision, round(coverage, 6)::DOUBLE AS coverage, true AS accepted FROM c""")
def _(spark, read):
    """A bin of sizes decides most labels by itself, the large sizes together with the price; brands decide nothing."""
    n = F.col("n_nationkey")
    behind = read("nation").select((n * 2).cast("double").alias("p_size"), (900.0 + 4 * ((7 * n) % 25)).alias("p_retailprice"), F.concat(F.lit("Brand#"), n).alias("p_brand"))
    edges = C.stats_bins({"p_size": [4, 25], "p_retailprice": [950]}, behind)
    found = B.best_arm_anchors(read("part"), behind, "p_partkey", ["p_size", "p_retailprice"], edges, ["p_brand"], PART_MODEL, max_size=2, epsilon=0.2, batch=300, growth=2.0)
    return rounded(found.select("p_partkey", F.array_join("anchor", ",").alias("anchor"), "precision", "coverage", "accepted"))
