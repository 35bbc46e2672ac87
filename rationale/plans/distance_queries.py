"""Queries over distances and weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rationale.operators import distance as D
from rationale.operators import neighbours as E

from .common import PART_FEATURES, query, rounded
from .neighbour_queries import UNIFORM, N, part_neighbours

DIST = "sqrt(power((p_size - x0_p_size) / s1, 2) + power((p_retailprice - x0_p_retailprice) / s2, 2))"
WIDTH = 0.75 * 2**0.5


def with_distance(read, n: int = N):
    neigh = part_neighbours(read, n=n).join(F.broadcast(E.stats_row(read("part"), PART_FEATURES)))
    return neigh.withColumn("d", D.euclidean(PART_FEATURES))


def per_part(df, *sums):
    return rounded(df.groupBy("p_partkey").agg(*[F.sum(c).alias(a) for c, a in sums]), 4)


@query("f1_euclidean", f"WITH {UNIFORM} SELECT p_partkey, round(sum({DIST}), 4) AS d FROM neigh GROUP BY p_partkey")
def _(spark, read):
    return per_part(with_distance(read), ("d", "d"))


@query("f2_kernel", f"WITH {UNIFORM} SELECT p_partkey, round(sum(sqrt(exp(-power({DIST}, 2) / power({WIDTH!r}, 2)))), 4) AS w FROM neigh GROUP BY p_partkey")
def _(spark, read):
    return per_part(D.kernel_weights(with_distance(read), "d", 2), ("weight", "w"))


@query("f3_cosine_mask", "SELECT doc_id, round(100 * (1 - sqrt(1 - (doc_id % 10) / 10.0)), 6) AS d FROM documents")
def _(spark, read):
    return rounded(read("documents").select("doc_id", D.cosine_mask(1 - F.col("doc_id") % 10 / 10.0).alias("d")))


@query("f4_inverse_weights", f"WITH {UNIFORM}, d AS (SELECT p_partkey, rep, {DIST} AS d FROM neigh), rw AS (SELECT *, sum(d) OVER (PARTITION BY p_partkey) / (d + 1e-8) AS raw FROM d), w AS (SELECT *, raw / sum(raw) OVER (PARTITION BY p_partkey) AS w FROM rw) SELECT p_partkey, round(sum(w * d) * 1e8, 4) AS wd, round(sum(w), 6) AS w FROM w GROUP BY p_partkey")
def _(spark, read):
    w = D.inverse_weights(with_distance(read), "p_partkey", "d")
    return w.groupBy("p_partkey").agg(F.round(F.sum(F.col("weight") * F.col("d")) * 1e8, 4).alias("wd"), F.round(F.sum("weight"), 6).alias("w"))


@query("f5_percentile_weights", f"WITH {UNIFORM}, d AS (SELECT p_partkey, rep, {DIST} AS d FROM neigh), c AS (SELECT p_partkey, quantile_cont(d, 0.3) AS c1, quantile_cont(d, 0.9) AS c2 FROM d GROUP BY p_partkey), b AS (SELECT d.*, CASE WHEN d <= c1 THEN 0 WHEN d <= c2 THEN 1 ELSE 2 END AS band FROM d JOIN c USING (p_partkey)), w AS (SELECT *, CASE band WHEN 0 THEN 0.8 WHEN 1 THEN 0.15 ELSE 0.05 END / count(*) OVER (PARTITION BY p_partkey, band) AS w FROM b) SELECT p_partkey, round(sum(w * d), 6) AS wd, round(sum(w), 6) AS w FROM w GROUP BY p_partkey")
def _(spark, read):
    w = D.percentile_weights(with_distance(read), "p_partkey", "d", {30: 80, 90: 15, 100: 5})
    return w.groupBy("p_partkey").agg(F.round(F.sum(F.col("weight") * F.col("d")), 6).alias("wd"), F.round(F.sum("weight"), 6).alias("w"))


_PAIR = "SELECT a.p_partkey, a.p_size, a.p_retailprice, a.p_brand, a.p_type, b.p_size AS x0_p_size, b.p_retailprice AS x0_p_retailprice, b.p_brand AS x0_p_brand, b.p_type AS x0_p_type FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1"


def pairs(read):
    p = read("part")
    other = p.select((F.col("p_partkey") + 1).alias("p_partkey"), *[F.col(c).alias(f"x0_{c}") for c in ("p_size", "p_retailprice", "p_brand", "p_type")])
    return p.join(other, "p_partkey")


@query("f6_simple_match", f"SELECT p_partkey, round(((p_brand <> x0_p_brand)::INT + (p_type <> x0_p_type)::INT) / 2.0, 6) AS d FROM ({_PAIR})")
def _(spark, read):
    return rounded(pairs(read).select("p_partkey", D.simple_match(["p_brand", "p_type"]).alias("d")))


_NED = "coalesce(0.5 * power(((p_size - x0_p_size) - (p_retailprice - x0_p_retailprice)) / 2, 2) / nullif(power((p_size - p_retailprice) / 2, 2) + power((x0_p_size - x0_p_retailprice) / 2, 2), 0), 0)"


@query("f7_normalized_euclidean", f"SELECT p_partkey, round({_NED}, 8) AS d FROM ({_PAIR})")
def _(spark, read):
    return rounded(pairs(read).select("p_partkey", D.normalized_euclidean(PART_FEATURES).alias("d")), 8)


@query("f8_mixed_distance", f"WITH r AS (SELECT max(p_size) - min(p_size) AS r1, max(p_retailprice) - min(p_retailprice) AS r2 FROM part) SELECT p_partkey, round((3 * ((p_brand <> x0_p_brand)::INT + (p_type <> x0_p_type)::INT) / 2.0 + 2 * {_NED}) / 5, 6) AS mixed, round((power((p_size - x0_p_size) / r1, 2) + power((p_retailprice - x0_p_retailprice) / r2, 2)) / 2, 6) AS ranged FROM ({_PAIR}) CROSS JOIN r")
def _(spark, read):
    p = pairs(read).join(F.broadcast(E.stats_row(read("part"), PART_FEATURES)))
    return rounded(p.select("p_partkey", D.mixed_distance(["p_brand", "p_type"], PART_FEATURES).alias("mixed"), D.range_scaled_sq(PART_FEATURES).alias("ranged")))


@query("f9_mad_distance", f"WITH m AS (SELECT median(p_size) AS m1, median(p_retailprice) AS m2 FROM part), k AS (SELECT median(abs(p_size - m1)) AS d1, median(abs(p_retailprice - m2)) AS d2 FROM part CROSS JOIN m) SELECT p_partkey, round(abs(p_size - x0_p_size) / d1 + abs(p_retailprice - x0_p_retailprice) / d2, 6) AS d FROM ({_PAIR}) CROSS JOIN k")
def _(spark, read):
    return rounded(pairs(read).join(F.broadcast(D.mad_row(read("part"), PART_FEATURES))).select("p_partkey", D.mad_distance(PART_FEATURES).alias("d")))


@query("f10_scaled_l1", f"WITH s AS (SELECT stddev_pop(p_size) AS s1, stddev_pop(p_retailprice) AS s2 FROM part) SELECT p_partkey, round(abs(p_size - x0_p_size) / s1 + abs(p_retailprice - x0_p_retailprice) / s2, 6) AS d FROM ({_PAIR}) CROSS JOIN s")
def _(spark, read):
    return rounded(pairs(read).join(F.broadcast(E.stats_row(read("part"), PART_FEATURES))).select("p_partkey", D.scaled_l1(PART_FEATURES).alias("d")))


@query("f11_density_ratio", f"WITH s AS (SELECT avg(p_size) AS m1, avg(p_retailprice) AS m2, var_samp(p_size) AS v1, var_samp(p_retailprice) AS v2 FROM part) SELECT p_partkey, round(exp(0.5 * (power(p_size - m1, 2) / v1 + power(p_retailprice - m2, 2) / v2 - power(x0_p_size - m1, 2) / v1 - power(x0_p_retailprice - m2, 2) / v2)), 5) AS d FROM ({_PAIR}) CROSS JOIN s")
def _(spark, read):
    s = read("part").agg(*[f(c).alias(f"{k}{c}") for c in PART_FEATURES for k, f in (("m", F.avg), ("v", F.var_samp))]).first()
    mean, cov = np.array([s[f"m{c}"] for c in PART_FEATURES]), np.diag([s[f"v{c}"] for c in PART_FEATURES])
    return rounded(pairs(read).select("p_partkey", D.density_ratio(PART_FEATURES, mean, cov).alias("d")), 5)


@query("f12_leaf_weights", "WITH l AS (SELECT 0 AS tree, p_size % 10 AS leaf, p_partkey FROM part UNION ALL SELECT 1, CAST(floor(p_retailprice) AS BIGINT) % 7, p_partkey FROM part), i AS (SELECT 1 AS instance_id, 0 AS tree, 3 AS leaf UNION ALL SELECT 1, 1, 5), z AS (SELECT tree, leaf, 1.0 / count(*) AS w FROM l GROUP BY ALL) SELECT p_partkey, round(sum(w), 8) AS weight FROM i JOIN z USING (tree, leaf) JOIN l USING (tree, leaf) GROUP BY p_partkey")
def _(spark, read):
    p = read("part")
    leaves = p.select(F.lit(0).alias("tree"), (F.col("p_size") % 10).cast("long").alias("leaf"), "p_partkey").union(p.select(F.lit(1), F.floor("p_retailprice") % 7, "p_partkey"))
    own = spark.createDataFrame([(1, 0, 3), (1, 1, 5)], "instance_id long, tree int, leaf long")
    return rounded(D.leaf_weights(leaves, own, "p_partkey").drop("instance_id"), 8)
