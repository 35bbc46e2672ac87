"""Queries over association rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rationale.operators import neighbours as E
from rationale.operators import rules as H
from rationale.operators.score import score
from rationale.sources.scratch import stored

from .common import PART_FEATURES, PART_MODEL, query, rounded

# Baskets of parts by brand: items are bands of size (0-4), price (5-9) and the type's first letter (10-12).
ITEMS = "[CAST(p_size AS INT) // 11, 5 + CAST(floor(p_retailprice) AS INT) % 5, 10 + ascii(p_type) % 3]"
TX = f"tx AS (SELECT CAST(p_size % 3 AS INT) AS g, p_partkey AS tid, {ITEMS} AS items, {PART_MODEL} AS class FROM part)"
PAIRS = """s1 AS (SELECT g, tid, class, unnest(items) AS x FROM tx),
 sets AS (SELECT g, tid, class, [x] AS items FROM s1 UNION ALL SELECT a.g, a.tid, a.class, [a.x, b.x] FROM s1 a JOIN s1 b ON a.g = b.g AND a.tid = b.tid AND a.x < b.x),
 cls AS (SELECT g, class, count(*) AS n_class, sum(count(*)) OVER (PARTITION BY g) AS n FROM tx GROUP BY g, class),
 bo AS (SELECT g, items, class, count(*) AS n_both FROM sets GROUP BY ALL),
 cn AS (SELECT b.g, b.items, b.class, sum(n_both) OVER (PARTITION BY b.g, b.items) AS n_items, n_both, n_class, n FROM bo b JOIN cls USING (g, class))"""
LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
TERM = LC.format(n="n_class", k="k") + " + " + LC.format(n="(n - n_class)", k="(n_items - k)") + " - " + LC.format(n="n", k="n_items")
PV = f"pv AS (SELECT g, items, class, any_value(n_items) AS n_items, any_value(n_both) AS n_both, any_value(n_class) AS n_class, any_value(n) AS n, max(t) + ln(sum(exp(t - m))) AS log_p FROM (SELECT *, max(t) OVER (PARTITION BY g, items, class) AS m FROM (SELECT *, {TERM} AS t FROM (SELECT *, unnest(range(n_both::BIGINT, least(n_items, n_class)::BIGINT + 1)) AS k FROM cn))) GROUP BY g, items, class)"


def baskets(read):
    p = read("part")
    items = F.array(F.floor(F.col("p_size") / 11).cast("int"), (F.floor("p_retailprice") % 5 + 5).cast("int"), (F.ascii("p_type") % 3 + 10).cast("int"))
    return p.select((F.col("p_size") % 3).cast("int").alias("g"), F.col("p_partkey").alias("tid"), items.alias("items"), F.expr(PART_MODEL).alias("class"))


def counted(read):
    tx = baskets(read)
    return H.candidate_counts(tx, 1).unionByName(H.candidate_counts(tx, 2))


def keyed(df):
    return df.select("g", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), *[c for c in df.columns if c not in ("g", "items")])


KEY = "array_to_string(items, ' ') AS items"
PAIRS3 = PAIRS.replace("a.x < b.x),", "a.x < b.x UNION ALL SELECT a.g, a.tid, a.class, [a.x, b.x, c.x] FROM s1 a JOIN s1 b ON a.g = b.g AND a.tid = b.tid AND a.x < b.x JOIN s1 c ON a.g = c.g AND a.tid = c.tid AND b.x < c.x),")


@query("h1_split_prune", f"WITH {TX} SELECT g, is_prune, count(*) AS n, sum(tid)::BIGINT AS tids FROM (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY tid) - 1) % 3 = 0 AS is_prune FROM tx) GROUP BY g, is_prune")
def _(spark, read):
    return H.split_prune(baskets(read)).groupBy("g", "is_prune").agg(F.count("*").alias("n"), F.sum("tid").alias("tids"))


@query("h2_candidate_counts", f"WITH {TX}, {PAIRS3} SELECT g, {KEY}, class, n_items::BIGINT AS n_items, n_both, n_class, n::BIGINT AS n FROM cn")
def _(spark, read):
    tx = baskets(read)
    return keyed(counted(read).unionByName(H.candidate_counts(tx, 3)))


@query("h3_fisher_log_p", f"WITH {TX}, {PAIRS}, {PV} SELECT g, {KEY}, class, round(log_p, 5) + 0.0 AS log_p FROM pv")
def _(spark, read):
    return rounded(keyed(H.fisher_log_p(counted(read)).select("g", "items", "class", "log_p")), 5)


_PSS = f"ps AS (SELECT * FROM pv WHERE n_items > n_class OR lgamma(n_class + 1) + lgamma(n - n_items + 1) - lgamma(n + 1) - lgamma(greatest(n_class - n_items, 0) + 1) <= ln(0.001))"


@query("h4_pss_filter", f"WITH {TX}, {PAIRS}, {PV}, {_PSS} SELECT g, {KEY}, class FROM ps")
def _(spark, read):
    return keyed(H.pss_filter(counted(read)).select("g", "items", "class"))


@query("h5_minimal_rules", f"WITH {TX}, {PAIRS}, d AS (SELECT g, class, items[1] AS x FROM cn WHERE len(items) = 1 AND n_both = n_items) SELECT g, {KEY}, class FROM cn WHERE len(items) = 2 AND NOT EXISTS (SELECT 1 FROM d WHERE d.g = cn.g AND d.class = cn.class AND list_contains(cn.items, d.x))")
def _(spark, read):
    c = counted(read)
    return keyed(H.minimal_rules(c.where("size(items) = 1"), c.where("size(items) = 2")).select("g", "items", "class"))


@query("h6_non_redundant", f"WITH {TX}, {PAIRS}, {PV}, o AS (SELECT g, class, items[1] AS x, log_p, n_both < n_items AS op FROM pv WHERE len(items) = 1), j AS (SELECT p.g, p.items, p.class, any_value(p.log_p) AS lp, count(*) AS k, bool_and(op) AS op, min(o.log_p) AS below FROM pv p JOIN o ON o.g = p.g AND o.class = p.class AND list_contains(p.items, o.x) WHERE len(p.items) = 2 GROUP BY p.g, p.items, p.class) SELECT g, {KEY}, class FROM j WHERE k = 2 AND op AND lp < below")
def _(spark, read):
    c = H.fisher_log_p(counted(read))
    return keyed(H.non_redundant(c.where("size(items) = 1").withColumn("min_log_p", F.col("log_p")), c.where("size(items) = 2")).select("g", "items", "class"))


@query("h7_rules", f"WITH {TX}, {PAIRS} SELECT g, {KEY}, class, round(n_items::DOUBLE / n, 6) AS support, round(n_both::DOUBLE / n_items, 6) AS confidence FROM cn")
def _(spark, read):
    return rounded(keyed(H.as_rules(counted(read)).select("g", "items", "class", "support", "confidence")))


# A rule of a level has all its parts in the level before, open and of higher log_p than its own.
_LEVEL = "l{k} AS (SELECT p.g, p.items, p.class, any_value(p.n_items) AS n_items, any_value(p.n_both) AS n_both, any_value(p.n) AS n, any_value(p.log_p) AS log_p, least(any_value(p.log_p), min(o.below)) AS below, any_value(p.n_both) < any_value(p.n_items) AS open FROM ps p JOIN l{j} o ON o.g = p.g AND o.class = p.class AND len(list_intersect(p.items, o.items)) = {j} WHERE len(p.items) = {k} GROUP BY p.g, p.items, p.class HAVING count(*) = {k} AND bool_and(o.open) AND any_value(p.log_p) < min(o.below))"
_MINED = "l1 AS (SELECT g, items, class, n_items, n_both, n, log_p, log_p AS below, n_both < n_items AS open FROM ps WHERE len(items) = 1), " + _LEVEL.format(k=2, j=1) + ", " + _LEVEL.format(k=3, j=2) + ", fo AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"


@query("h7_mined_rules", f"WITH {TX}, {PAIRS3}, {PV}, {_PSS}, {_MINED} SELECT g, {KEY}, class, round(n_items::DOUBLE / n, 6) AS support, round(n_both::DOUBLE / n_items, 6) AS confidence, round(log_p, 5) + 0.0 AS log_p FROM fo WHERE log_p <= ln(0.001)")
def _(spark, read):
    m = keyed(H.mine(baskets(read)))
    return rounded(m.withColumn("log_p", F.round("log_p", 5)))


# A rule set for the rest: single items and pairs, numbered.
RULES = "ru AS (SELECT row_number() OVER (ORDER BY g, class, len(items), array_to_string(list_transform(items, lambda x: lpad(x::VARCHAR, 3, '0')), ' ')) AS rule_id, g, items, class, n_items::DOUBLE / n AS support, n_both::DOUBLE / n_items AS confidence, log_p FROM pv WHERE log_p < -1)"


def ruleset(spark, read):
    from pyspark.sql import Window

    r = H.as_rules(H.fisher_log_p(counted(read))).where("log_p < -1")
    text = F.array_join(F.transform("items", lambda x: F.lpad(x.cast("string"), 3, "0")), " ")
    return r.withColumn("rule_id", F.row_number().over(Window.orderBy("g", "class", F.size("items"), text))).select("g", "rule_id", "items", "class", "support", "confidence", "log_p").transform(stored)


@query("h8_sequential_cover")
def _(spark, read):
    tx = H.split_prune(baskets(read))
    return H.sequential_cover(ruleset(spark, read), tx.where("is_prune").drop("is_prune"))


_APP = "ap AS (SELECT t.g, t.tid, t.class AS tx_class, ru.* EXCLUDE (g) FROM tx t JOIN ru ON ru.g = t.g AND len(list_intersect(ru.items, t.items)) = len(ru.items))"
_IMP = "im AS (SELECT g, rule_id, count(*) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY g, tid ORDER BY confidence DESC, support DESC, rule_id) AS r FROM ap WHERE class = tx_class) WHERE r = 1 GROUP BY g, rule_id)"
_BASE = f"WITH {TX}, {PAIRS}, {PV}, {RULES}, {_APP}"


@query("h9_importance", f"{_BASE}, {_IMP} SELECT g, rule_id, importance FROM im")
def _(spark, read):
    return H.importance(ruleset(spark, read), baskets(read)).select("g", F.col("rule_id").cast("long").alias("rule_id"), "importance")


@query("h10_applicable", f"{_BASE} SELECT g, rule_id, count(*) AS n, sum(tid)::BIGINT AS tids FROM ap GROUP BY g, rule_id")
def _(spark, read):
    return H.applicable(ruleset(spark, read), baskets(read)).groupBy("g", F.col("rule_id").cast("long").alias("rule_id")).agg(F.count("*").alias("n"), F.sum("tid").alias("tids"))


for _h, _value, _dir in ((1, "importance * log_p", "ASC"), (2, "importance * confidence", "DESC"), (3, "importance * log_p * confidence", "ASC")):

    @query(f"h11_classify_{_h}", f"{_BASE}, {_IMP}, sc AS (SELECT ap.g, tid, class, round(sum({_value}), 9) AS v FROM ap JOIN im USING (g, rule_id) GROUP BY ap.g, tid, class), w AS (SELECT *, row_number() OVER (PARTITION BY g, tid ORDER BY v {_dir}, class) AS r FROM sc), mj AS (SELECT g, class AS majority FROM (SELECT g, class, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, class) AS r FROM tx GROUP BY g, class) WHERE r = 1) SELECT tx.g, coalesce(w.class, majority) AS predicted, count(*) AS n, sum(tx.tid)::BIGINT AS tids FROM tx JOIN mj ON mj.g = tx.g LEFT JOIN w ON w.g = tx.g AND w.tid = tx.tid AND r = 1 GROUP BY 1, 2")
    def _(spark, read, hrs=_h):
        tx = baskets(read)
        rules = H.importance(ruleset(spark, read), tx)
        return H.classify(tx, rules, hrs).groupBy("g", "predicted").agg(F.count("*").alias("n"), F.sum("tid").alias("tids"))


NAMES = [(i, "size", None if i == 0 else 11.0 * i, None if i == 4 else 11.0 * (i + 1), None) for i in range(5)] + [(5 + i, "price", None, None, f"mod {i}") for i in range(5)] + [(10 + i, "type", None, None, f"t{i}") for i in range(3)]


def item_names(spark):
    return spark.createDataFrame(NAMES, "item int, feature string, lo double, hi double, value string")


_TEXT = "(CASE " + " ".join(f"WHEN x = {i} THEN '" + (f"''{f}'' = ''{v}''" if v else f"''{f}'' < {hi:.2f}" if lo is None else f"{lo:.2f} <= ''{f}''" if hi is None else f"{lo:.2f} <= ''{f}'' <= {hi:.2f}") + "'" for i, f, lo, hi, v in NAMES) + " END)"


@query("h12_rule_text", f"{_BASE} SELECT g, rule_id, array_to_string(list_transform(items, lambda x: {_TEXT}), ', ') || ' -> ' || class AS text FROM ru")
def _(spark, read):
    return H.rule_text(ruleset(spark, read), item_names(spark), 13).withColumn("rule_id", F.col("rule_id").cast("long"))


@query("h13_rule_sort", f"{_BASE} SELECT g, rule_id, row_number() OVER (PARTITION BY g ORDER BY len(items), round(confidence * support, 12) DESC, log_p, support DESC, confidence DESC, rule_id)::INT AS place FROM (SELECT * REPLACE (round(log_p, 8) AS log_p) FROM ru)")
def _(spark, read):
    return H.rule_sort(ruleset(spark, read).withColumn("log_p", F.round("log_p", 8))).select("g", F.col("rule_id").cast("long").alias("rule_id"), "place")


_FEAT = "(CASE WHEN x < 5 THEN 'size' WHEN x < 10 THEN 'price' ELSE 'type' END)"
_OWN = "ow AS (SELECT g, [0, 6, 11] AS own, 'Y' AS o, 'N' AS nx FROM (SELECT DISTINCT g FROM tx))"
_TOUCH = f"to_ AS (SELECT DISTINCT ru.g, rule_id, class, support, log_p, len(items) AS need, len(list_intersect(items, own)) AS m, o, nx, feature FROM (SELECT *, unnest(list_distinct(list_transform(items, lambda x: {_FEAT}))) AS feature FROM ru) ru JOIN ow USING (g))"


def own_basket(read):
    g = baskets(read).select("g").distinct()
    return g.select("g", F.array(*[F.lit(i) for i in (0, 6, 11)]).alias("items")), g.select("g", F.lit("Y").alias("own"), F.lit("N").alias("next"))


def item_features(spark):
    return item_names(spark).select("item", "feature")


@query("h14_feature_importance", f"{_BASE}, {_OWN}, {_TOUCH} SELECT g, feature, round(sum(support), 6) AS weight FROM to_ WHERE (class = o OR class = nx) AND (need = 1 OR m >= need / 2.0) GROUP BY g, feature")
def _(spark, read):
    b, c = own_basket(read)
    return rounded(H.feature_importance(ruleset(spark, read), b, c, item_features(spark)))


@query("h15_feature_importance_weighted", f"{_BASE}, {_OWN}, {_TOUCH}, s AS (SELECT g, feature, sum((2 * m + 1) / (2.0 * need + 2) * least(abs(log_p), 100) * CASE WHEN class = o THEN 1 ELSE -1 END) AS w FROM to_ GROUP BY g, feature) SELECT g, feature, round(w / sum(abs(w)) OVER (PARTITION BY g), 5) + 0.0 AS weight FROM s")
def _(spark, read):
    b, c = own_basket(read)
    return rounded(H.feature_importance_weighted(ruleset(spark, read), b, c, item_features(spark)), 5)


@query("h16_feature_tiers", f"{_BASE}, {_OWN}, {_TOUCH}, a AS (SELECT g, feature, 1 AS tier, sum(support) AS value FROM to_ WHERE m = need AND class = o GROUP BY g, feature UNION ALL SELECT g, feature, 2, min(p)::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY support DESC, rule_id, feature) AS p FROM to_ WHERE m = need AND class <> o) GROUP BY g, feature UNION ALL SELECT g, feature, 3, sum(support) FROM to_ WHERE m = need - 1 GROUP BY g, feature) SELECT g, feature, tier, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY g, feature ORDER BY tier) AS r FROM a) WHERE r = 1")
def _(spark, read):
    b, c = own_basket(read)
    return rounded(H.feature_tiers(ruleset(spark, read), b, c, item_features(spark)))


@query("h17_contrast_rules", f"{_BASE}, k AS (SELECT g, rule_id, class, exp(log_p) AS p, array_to_string(list_sort(list_distinct(list_transform(items, lambda x: {_FEAT}))), ',') AS fs FROM ru) SELECT a.g, a.rule_id AS rule1, b.rule_id AS rule2, a.class AS class1, b.class AS class2 FROM k a JOIN k b ON a.g = b.g AND a.fs = b.fs AND a.class < b.class AND abs(a.p - b.p) <= 0.0005")
def _(spark, read):
    c = H.contrast_rules(ruleset(spark, read), item_features(spark))
    return c.withColumn("rule1", F.col("rule1").cast("long")).withColumn("rule2", F.col("rule2").cast("long"))


@query("h18_explain_rules")
def _(spark, read):
    """Rules around every tenth of the size range stand for the parts that have it."""
    p = read("part")
    stats = E.stats_row(p, PART_FEATURES)
    instances = p.groupBy("p_size").agg(F.avg("p_retailprice").alias("p_retailprice")).select(F.col("p_size").cast("long").alias("id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")

    def make(rows, seed):
        return score(E.perturb(rows, stats, "id", PART_FEATURES, 200, "uniform", seed), PART_MODEL)

    def to_baskets(rows):
        size, price = F.least(F.greatest(F.floor(F.col("p_size") / 11), F.lit(0)), F.lit(4)), F.least(F.greatest(F.floor((F.col("p_retailprice") - 900) / 100), F.lit(0)), F.lit(4))
        return rows.select(F.col("id").alias("g"), F.col("rep").cast("long").alias("tid"), F.array(size.cast("int"), (price + 5).cast("int")).alias("items"), F.col("label").alias("class"))

    return rounded(H.explain_rules(instances, make, to_baskets, item_features(spark), "id", 2))


