"""Queries over tree rules and counterfactual changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rationale.operators import bins as C
from rationale.operators import neighbours as E
from rationale.operators import rules as H
from rationale.operators import trees as I
from rationale.operators.score import score

from .common import PART_FEATURES, PART_MODEL, query, rounded
from .neighbour_queries import part_neighbours
from .rules_queries import _APP, PAIRS, PV, RULES, TX, baskets, item_features, ruleset

# Three paths of a tree over parts, as fixed conditions of the queries.
PATHS = [(1, "p_size", 25.0, None, "Y"), (1, "p_retailprice", 950.0, None, "Y"), (2, "p_size", 25.0, None, "N"), (2, "p_retailprice", None, 950.0, "N"), (3, "p_size", None, 25.0, "N"), (3, "p_size", 4.0, None, "N"), (4, "p_size", None, 4.0, "Y"), (4, "p_size", None, 25.0, "Y")]
PATHS_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, '{a}', {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, '{k}')" for r, a, lo, hi, k in PATHS) + ") t(rule_id, attr, lo, hi, class)), p AS (SELECT rule_id, attr, class, max(lo) AS lo, min(hi) AS hi FROM c GROUP BY rule_id, attr, class)"
LEAF_SQL = "n AS (SELECT rule_id, count(*) AS need FROM p GROUP BY rule_id), m AS (SELECT p_partkey, rule_id, count(*) AS k FROM (SELECT p_partkey, 'p_size' AS attr, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part) x JOIN p USING (attr) WHERE (lo IS NULL OR v > lo) AND (hi IS NULL OR v <= hi) GROUP BY p_partkey, rule_id), h AS (SELECT p_partkey, m.rule_id FROM m JOIN n ON m.rule_id = n.rule_id AND k = need)"


def paths(spark):
    c = spark.createDataFrame([(r, a, lo, hi, None, k) for r, a, lo, hi, k in PATHS], "rule_id int, attr string, lo double, hi double, eq string, class string")
    return I.path_rule(c, ["rule_id", "class"])


@query("i1_local_tree")
def _(spark, read):
    neigh = score(part_neighbours(read, n=24), PART_MODEL)
    t = I.local_tree(neigh, "p_partkey", PART_FEATURES, "label", C.quartile_bins(read("part"), PART_FEATURES), 2)
    return t.groupBy("attr", "class").agg(F.count("*").alias("n"))


TESTS = "t AS (SELECT l_orderkey, l_suppkey % 3 AS rule_id, l_returnflag AS attr, max(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS lo, min(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 20 END) AS hi FROM lineitem GROUP BY ALL)"


def order_tests(read):
    """Each line of an order is one test of a path: odd lines ask for more than their quantity, even ones for 20 more at most."""
    c = read("lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("rule_id"), F.col("l_returnflag").alias("attr"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).alias("lo"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") + 20).alias("hi"), F.lit(None).cast("string").alias("eq"))
    return I.path_rule(c, ["l_orderkey", "rule_id"])


@query("i2_path_rule", f"WITH {TESTS} SELECT * FROM t")
def _(spark, read):
    return order_tests(read).drop("eq")


@query("i3_tree_assign", f"WITH {PATHS_SQL}, {LEAF_SQL} SELECT p_partkey, rule_id FROM h")
def _(spark, read):
    return I.tree_assign(read("part"), paths(spark), "p_partkey", PART_FEATURES)


@query("i4_covered", f"WITH {PATHS_SQL}, {LEAF_SQL}, w AS (SELECT DISTINCT rule_id, class FROM p), y AS (SELECT p_partkey, {PART_MODEL} AS label FROM part) SELECT rule_id, round(count(*)::DOUBLE / (SELECT count(*) FROM part), 6) AS coverage, round(avg(CASE WHEN label = class THEN 1.0 ELSE 0 END), 6) AS precision FROM h JOIN w USING (rule_id) JOIN y USING (p_partkey) GROUP BY rule_id")
def _(spark, read):
    p = paths(spark)
    return rounded(I.covered(score(read("part"), PART_MODEL), p, "p_partkey", PART_FEATURES, "label", p.select("rule_id", "class").distinct()))


@query("i5_counterfactual_deltas", f"WITH {TESTS}, f AS (SELECT l_orderkey, attr, lo AS flo, hi AS fhi FROM t WHERE rule_id = 0), d AS (SELECT t.l_orderkey, rule_id, t.attr, CASE WHEN lo IS NOT NULL AND (flo IS NULL OR flo < lo) THEN lo END AS lo, CASE WHEN hi IS NOT NULL AND (fhi IS NULL OR fhi > hi) THEN hi END AS hi FROM t LEFT JOIN f ON f.l_orderkey = t.l_orderkey AND f.attr = t.attr WHERE rule_id > 0 AND t.l_orderkey IN (SELECT l_orderkey FROM f)), s AS (SELECT l_orderkey, rule_id, sum((lo IS NOT NULL)::INT + (hi IS NOT NULL)::INT)::BIGINT AS changes FROM d GROUP BY ALL), k AS (SELECT l_orderkey, min(changes) AS changes FROM s GROUP BY l_orderkey) SELECT d.l_orderkey, d.rule_id, attr, lo, hi, k.changes FROM d JOIN s ON s.l_orderkey = d.l_orderkey AND s.rule_id = d.rule_id JOIN k ON k.l_orderkey = s.l_orderkey AND k.changes = s.changes WHERE lo IS NOT NULL OR hi IS NOT NULL")
def _(spark, read):
    """What the nearest other path of each order asks for beyond its first."""
    p = order_tests(read)
    return I.counterfactual_deltas(p.where("rule_id = 0"), p.where("rule_id > 0"), ["l_orderkey"]).drop("eq")


@query("i6_apply_delta", "SELECT p_partkey, 1 AS rule_id, 26.0 AS p_size, 951.0 AS p_retailprice FROM part UNION ALL SELECT p_partkey, 4, 4.0, p_retailprice FROM part")
def _(spark, read):
    return I.apply_delta(read("part"), paths(spark).where("class = 'Y'"), "p_partkey", PART_FEATURES)


_BASE = f"WITH {TX}, {PAIRS}, {PV}, {RULES}, {_APP}"


@query("i7_class_totals", f"{_BASE}, s AS (SELECT g, tid, class, round(sum(log_p * confidence), 9) AS total FROM ap GROUP BY g, tid, class) SELECT g, tid, class, round(total, 4) AS total, row_number() OVER (PARTITION BY g, tid ORDER BY total, class)::INT AS rank FROM s")
def _(spark, read):
    return rounded(I.class_totals(H.applicable(ruleset(spark, read), baskets(read))), 4)


@query("i8_next_rule", f"{_BASE}, q AS (SELECT t.g, t.tid, rule_id, row_number() OVER (PARTITION BY t.g, t.tid ORDER BY round(log_p * confidence, 9), rule_id) AS r FROM tx t JOIN ru ON ru.g = t.g AND ru.class = 'Y' WHERE len(list_filter(ru.items, lambda x: NOT list_contains(t.items, x))) > 0 AND NOT list_has_any(list_filter(ru.items, lambda x: NOT list_contains(t.items, x)), [10, 11, 12])) SELECT g, tid, rule_id FROM q WHERE r = 1")
def _(spark, read):
    return I.next_rule(ruleset(spark, read), baskets(read), "Y", restricted=[10, 11, 12]).withColumn("rule_id", F.col("rule_id").cast("long"))


@query("i9_apply_rule", "WITH x AS (SELECT CAST(p_size % 3 AS INT) AS g, p_partkey AS tid, [CAST(p_size AS INT) // 11, 5 + CAST(floor(p_retailprice) AS INT) % 5, 10 + ascii(p_type) % 3] AS items FROM part) SELECT g, tid, 2 AS a, items[2] AS b, CASE WHEN items[3] = 12 THEN 11 ELSE items[3] END::INT AS c FROM x WHERE items[3] = 12")
def _(spark, read):
    """A rule that asks for size band 2 and not for the last type band."""
    tx = baskets(read).where("array_contains(items, 12)")
    rules = tx.select("g").distinct().select("g", F.lit(1).alias("rule_id"), F.array(F.lit(2), F.lit(12 + 13)).alias("items"))
    moved = I.apply_rule(tx, tx.select("g", "tid", F.lit(1).alias("rule_id")), rules, item_features(spark), 13)
    return moved.select("g", "tid", F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), F.col("items")[2].alias("c"))


@query("i10_rule_counterfactuals")
def _(spark, read):
    def predict(df):
        return df.withColumn("label", F.when(F.array_contains("items", 0) | F.array_contains("items", 3) | F.array_contains("items", 4), "Y").otherwise("N"))

    tx = predict(baskets(read).drop("class")).where("label = 'N'")
    found = I.rule_counterfactuals(tx, ruleset(spark, read), item_features(spark), predict, "Y", 13, 2, n=2)
    return found.select("g", "tid", "k", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), F.array_join(F.transform("rules", lambda x: x.cast("string")), " ").alias("rules"))


_DRAWS = f"w AS (SELECT n_nationkey AS rep, (n_nationkey * 2)::DOUBLE AS p_size, 900.0 + n_nationkey * 5 AS p_retailprice FROM nation), k AS (SELECT * FROM w WHERE {PART_MODEL} = 'Y')"


@query("i11_random_counterfactual", f"WITH {_DRAWS}, s AS (SELECT stddev_pop(p_size) AS s1, stddev_pop(p_retailprice) AS s2 FROM part), d AS (SELECT p_partkey, p.p_size::DOUBLE AS os, p.p_retailprice AS op, k.p_size, k.p_retailprice, row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(k.p_size - p.p_size) / s1 + abs(k.p_retailprice - p.p_retailprice) / s2, 9), rep) AS r FROM part p CROSS JOIN k CROSS JOIN s) SELECT p_partkey, 'p_size' AS feature, os AS old, p_size AS new FROM d WHERE r = 1 AND os <> p_size UNION ALL SELECT p_partkey, 'p_retailprice', op, p_retailprice FROM d WHERE r = 1 AND op <> p_retailprice")
def _(spark, read):
    p = read("part")
    draws = score(read("nation").select(F.col("n_nationkey").alias("rep"), (F.col("n_nationkey") * 2).cast("double").alias("p_size"), (900.0 + F.col("n_nationkey") * 5).alias("p_retailprice")), PART_MODEL)
    s = E.stats_row(p, PART_FEATURES).first()
    scales = {c: s[f"scale_{c}"] for c in PART_FEATURES}
    d = F.round(sum((F.abs(F.col(c) - F.col(f"x0_{c}")) / scales[c] for c in PART_FEATURES), F.lit(0.0)), 9)
    return I.random_counterfactual(p, draws, "p_partkey", PART_FEATURES, "label", "Y", d)
