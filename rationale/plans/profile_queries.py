"""Queries over sources, profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from rationale.functions.draws import draw_sql
from rationale.operators import profile as B
from rationale.sources import files
from rationale.sources.scratch import scratch_path

from .common import LINE_FEATURES, query, rounded, union_all

COV_SQL = union_all([f"SELECT '{a}' AS i, '{b}' AS j, covar_samp({a}, {b}) AS value FROM lineitem" for a in LINE_FEATURES for b in LINE_FEATURES])
STATS_SQL = union_all([f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max FROM lineitem" for c in LINE_FEATURES])


@query("a1_read_table", "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, nullif(o_orderstatus, '?') AS o_orderstatus, o_totalprice FROM orders")
def _(spark, read):
    path = scratch_path(spark, "csv")
    read("orders").select("o_orderkey", "o_custkey", F.coalesce("o_orderstatus", F.lit("?")).alias("o_orderstatus"), "o_totalprice").write.option("header", True).csv(path)
    return files.read_table(spark, path, has_index=True, schema="o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("a2_read_transactions", "SELECT class, len(items) AS n_items, list_sum(items) AS item_sum, count(*) AS n FROM (SELECT l_linenumber AS class, [CAST(l_quantity AS INT), CAST(l_suppkey % 97 AS INT) + 100] AS items FROM lineitem) GROUP BY ALL")
def _(spark, read):
    path = scratch_path(spark, "baskets")
    read("lineitem").select(F.concat_ws(" ", F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 97 + 100).cast("int"), "l_linenumber").alias("value")).write.text(path)
    t = files.read_transactions(spark, path)
    return t.select("class", F.size("items").alias("n_items"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("item_sum")).groupBy("class", "n_items", "item_sum").agg(F.count("*").alias("n"))


@query("a3_rule_lines", "SELECT CAST(p_size AS INT) AS item, CAST(p_partkey % 7 AS INT) AS class, round(p_size / 100.0, 4) AS support, round((p_partkey % 1000) / 1000.0, 3) AS confidence, round(-(p_partkey % 5000) / 8.0, 3) AS log_p FROM part")
def _(spark, read):
    path = scratch_path(spark, "rules")
    rules = read("part").select(F.array(F.col("p_size")).alias("items"), (F.col("p_partkey") % 7).alias("class"), (F.col("p_size") / 100.0).alias("support"), (F.col("p_partkey") % 1000 / 1000.0).alias("confidence"), (-(F.col("p_partkey") % 5000) / 8.0).alias("log_p"))
    files.write_rules(rules, path)
    back = files.read_rules(spark, path)
    return back.select(F.col("items")[0].alias("item"), "class", "support", "confidence", "log_p")


@query("a4_write_results", "SELECT p_brand AS method, 'parts' AS dataset, 16 AS nperturb, count(*) AS n, round(sum(p_retailprice), 4) AS total FROM part GROUP BY p_brand")
def _(spark, read):
    path = scratch_path(spark, "results")
    files.write_results(read("part").select(F.col("p_brand").alias("method"), F.lit("parts").alias("dataset"), "p_retailprice"), path, nperturb=16)
    return spark.read.parquet(path).groupBy(F.col("method").cast("string").alias("method"), F.col("dataset").cast("string").alias("dataset"), "nperturb").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"))


_LINE = [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_linestatus", "string"), ("l_shipdate", "string"), ("l_returnflag", "string")]


@query("b1_infer_features", union_all([f"SELECT {i} AS ord, '{c}' AS feature, CASE WHEN typeof(any_value({c})) IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN typeof(any_value({c})) IN ('DOUBLE', 'FLOAT') THEN 'double' ELSE 'string' END AS kind, {'true' if k == 'string' else 'false'} AS is_discrete FROM lineitem" for i, (c, k) in enumerate(_LINE)]))
def _(spark, read):
    return B.infer_features(read("lineitem"), "l_returnflag")


@query("b2_detect_categorical", union_all([f"SELECT '{c}' AS feature, count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct, bool_and(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL OR {c} IS NULL) AS all_numeric, count(DISTINCT {c}) <= 10 OR NOT bool_and(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL OR {c} IS NULL) AS is_categorical, count(DISTINCT {c}) <= 10 AND bool_and(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL OR {c} IS NULL) AS finite_numeric FROM lineitem" for c in ("l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")]))
def _(spark, read):
    return B.detect_categorical(read("lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))


@query("b3_feature_stats", f"SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, min, max FROM ({STATS_SQL})")
def _(spark, read):
    return rounded(B.feature_stats(read("lineitem"), LINE_FEATURES))


@query("b4_covariance", f"SELECT i, j, round(value, 4) + 0.0 AS value FROM ({COV_SQL})")
def _(spark, read):
    return rounded(B.covariance(read("lineitem"), LINE_FEATURES), 4)


@query(
    "b5_categorical_variance",
    f"""WITH c AS ({COV_SQL}), d AS (SELECT i AS k, value FROM c WHERE i = j)
    SELECT c.i, c.j, round(CASE WHEN c.i = c.j AND c.i IN ('l_discount', 'l_tax') THEN 0.3334 * 0.3334 ELSE c.value
      * CASE WHEN c.i IN ('l_discount', 'l_tax') THEN 0.3334 * 0.3334 / sqrt(a.value) ELSE 1 END
      * CASE WHEN c.j IN ('l_discount', 'l_tax') THEN 0.3334 * 0.3334 / sqrt(b.value) ELSE 1 END END, 4) + 0.0 AS value
    FROM c JOIN d a ON a.k = c.i JOIN d b ON b.k = c.j""",
)
def _(spark, read):
    return rounded(B.standardize_categorical_variance(B.covariance(read("lineitem"), LINE_FEATURES), ["l_discount", "l_tax"]), 4)


@query("b6_dev_scale", f"SELECT feature, round(mean, 6) AS mean, round(std / 2.5, 6) AS std, min, max FROM ({STATS_SQL})")
def _(spark, read):
    return rounded(B.dev_scale(B.feature_stats(read("lineitem"), LINE_FEATURES), 2.5))


@query("b7_category_frequencies", union_all([f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")]))
def _(spark, read):
    return rounded(B.category_frequencies(read("lineitem"), ["l_returnflag", "l_linestatus"]))


@query(
    "b8_impute_mode",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '?' ELSE o_orderpriority END AS p FROM orders),
    m AS (SELECT p FROM o WHERE p <> '?' GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
    SELECT p AS o_orderpriority, count(*) AS n FROM (SELECT CASE WHEN o.p IS NULL OR o.p = '?' THEN m.p ELSE o.p END AS p FROM o CROSS JOIN m) GROUP BY p""",
)
def _(spark, read):
    o = read("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '?' ELSE o_orderpriority END").alias("o_orderpriority"))
    return B.impute_mode(o, ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("b9_drop_incomplete", "SELECT count(*) AS n_rows, 1 AS n_columns FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def _(spark, read):
    o = read("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END").alias("a"), F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END").alias("b"))
    return B.drop_incomplete_rows(o).agg(F.count("*").alias("n_rows"), F.lit(len(B.drop_incomplete_columns(o).columns)).alias("n_columns"))


@query("b10_map_unseen", "WITH r AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 3) SELECT coalesce(r.p_brand, 'unknown') AS p_brand, count(*) AS n FROM part p LEFT JOIN r ON p.p_brand = r.p_brand GROUP BY 1")
def _(spark, read):
    p = read("part")
    return B.map_unseen(p, p.where("p_size < 3"), ["p_brand"]).groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "b11_derive_labels",
    """WITH c AS (SELECT quantile_cont(c_acctbal, 0.7) AS cut FROM customer)
    SELECT CASE WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS by_threshold, CAST(c_acctbal >= cut AS INT) AS by_percentile, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END AS by_outcome, count(*) AS n FROM customer CROSS JOIN c GROUP BY 1, 2, 3""",
)
def _(spark, read):
    c = B.threshold_labels(read("customer"), "c_acctbal", 5000).withColumnRenamed("label", "by_threshold")
    c = B.percentile_labels(c, "c_acctbal", 0.7).withColumnRenamed("label", "by_percentile")
    c = B.outcome_labels(c, "c_mktsegment", {"BUILDING": 1, "MACHINERY": 0}).withColumnRenamed("label", "by_outcome")
    return c.groupBy("by_threshold", "by_percentile", "by_outcome").agg(F.count("*").alias("n"))


@query("b12_stay_days", "SELECT abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS days, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 GROUP BY 1")
def _(spark, read):
    both = read("lineitem").select("l_orderkey", "l_shipdate").join(read("orders").where("o_totalprice > 1000").select("o_orderkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
    return both.groupBy(B.stay_days("o_orderdate", "l_shipdate").cast("long").alias("days")).agg(F.count("*").alias("n"))


@query("b13_split", f"SELECT {draw_sql(1, 'o_orderkey')} < 0.8 AS is_train, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, read):
    return B.split(read("orders"), "o_orderkey").groupBy("is_train").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("b14_subsample", union_all([f"SELECT {i} AS run, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE {draw_sql(s, 'o_orderkey')} < CAST(1 AS DOUBLE) / 3" for i, s in enumerate((3, 4, 5))]))
def _(spark, read):
    return B.subsample(read("orders"), "o_orderkey", [3, 4, 5]).groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    "b15_train_scaled",
    f"""WITH x AS (SELECT *, {draw_sql(1, 'o_orderkey')} < 0.8 AS is_train, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS v FROM orders),
    s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM x WHERE is_train)
    SELECT is_train, count(*) AS n, round(sum(coalesce((v - m) / d, 0)), 4) + 0.0 AS total, round(sum(power(coalesce((v - m) / d, 0), 2)), 4) AS squares FROM x CROSS JOIN s GROUP BY is_train""",
)
def _(spark, read):
    o = B.split(read("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END").alias("v")), "o_orderkey")
    scaled = B.train_scaled(o.where("is_train").drop("is_train"), o.where("not is_train").drop("is_train"), ["v"])
    return rounded(scaled.groupBy("is_train").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares")), 4)


_CORR = f"WITH c AS ({COV_SQL}), d AS (SELECT i AS k, value FROM c WHERE i = j), r AS (SELECT c.i, c.j, c.value / sqrt(a.value * b.value) AS r FROM c JOIN d a ON a.k = c.i JOIN d b ON b.k = c.j)"


@query("b16_correlation_labels", f"{_CORR} SELECT i, j, CASE WHEN r >= 0.6 THEN '++' WHEN r >= 0.2 THEN '+' WHEN r <= -0.6 THEN '--' WHEN r <= -0.2 THEN '-' ELSE '.' END AS mark FROM r")
def _(spark, read):
    return B.correlation_labels(B.covariance(read("lineitem"), LINE_FEATURES))


_TWICE = ["q", "q2", "t"]
_TWICE_SQL = union_all([f"SELECT '{a}' AS i, '{b}' AS j, corr({a}, {b}) AS r FROM (SELECT l_quantity AS q, l_quantity * 3 + 1 AS q2, l_tax AS t FROM lineitem)" for a in _TWICE for b in _TWICE])


@query("b17_redundant_groups", f"SELECT i AS feature, min(j) AS group_id FROM ({_TWICE_SQL}) WHERE abs(r - 1) <= 1e-8 GROUP BY i")
def _(spark, read):
    t = read("lineitem").selectExpr("l_quantity as q", "l_quantity * 3 + 1 as q2", "l_tax as t")
    return B.redundant_groups(B.covariance(t, _TWICE))


@query("b18_histogram_bins", union_all([f"SELECT '{c}' AS feature, CAST(CASE WHEN w > 0 THEN greatest(ceil((hi - lo) / w), ceil(log2(n)) + 1) ELSE ceil(sqrt(n)) END AS BIGINT) AS bins FROM (SELECT count({c}) AS n, min({c}) AS lo, max({c}) AS hi, 2 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / power(count({c}), CAST(1 AS DOUBLE) / 3) AS w FROM {t})" for t, c in (("lineitem", "l_extendedprice"), ("orders", "o_totalprice"))]))
def _(spark, read):
    return B.histogram_bins(read("lineitem"), "l_extendedprice").union(B.histogram_bins(read("orders"), "o_totalprice"))


@query("b19_category_codes", "WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)) SELECT p_type, CAST(code AS INT) AS code, count(*) AS n FROM part JOIN c USING (p_type) GROUP BY ALL")
def _(spark, read):
    return B.category_codes(read("part"), "p_type").groupBy("p_type", "code").agg(F.count("*").alias("n"))


@query("b20_kmeans_background")
def _(spark, read):
    return B.kmeans_background(read("part").select(*map(F.col, ("p_size", "p_retailprice"))), ["p_size", "p_retailprice"], 8)


@query("b21_cluster_stats", union_all([f"SELECT p_brand, '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM part GROUP BY p_brand" for c in ("p_size", "p_retailprice")]))
def _(spark, read):
    return rounded(B.cluster_stats(read("part"), ["p_size", "p_retailprice"], "p_brand"))


@query("b21_assigned_clusters")
def _(spark, read):
    p = B.assign_clusters(read("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 4)
    return p.groupBy("cluster").agg(F.count("*").alias("n"))
