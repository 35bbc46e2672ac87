"""Queries over attributions of trees and over hierarchies."""

from __future__ import annotations

from math import factorial

from pyspark.sql import functions as F

from rationale.operators import hierarchy as H
from rationale.operators import treeshap as T

from .common import query, rounded

FEATURES = ["p_size", "p_retailprice", "p_len"]
# An ensemble of three trees over parts: (tree, node, feature, edge, value).
NODES = [(0, 1, "p_size", 25.0, None), (0, 2, "p_retailprice", 950.0, None), (0, 3, "p_len", 9.0, None), (0, 4, "p_len", 8.0, None), (0, 5, "p_size", 10.0, None), (0, 6, None, None, 4.0), (0, 7, "p_retailprice", 970.0, None), (0, 8, None, None, 1.0), (0, 9, None, None, -2.0), (0, 10, None, None, 3.0), (0, 11, None, None, 0.5), (0, 14, None, None, -1.0), (0, 15, None, None, 2.5), (1, 1, "p_retailprice", 940.0, None), (1, 2, None, None, 0.7), (1, 3, None, None, -0.3), (2, 1, None, None, 0.25)]
_AT = {(t, k): (a, e, v) for t, k, a, e, v in NODES}


def tree_sql(tree: int, names: dict[str, str], node: int = 1) -> str:
    """The tree as a CASE expression over the given columns."""
    attr, edge, value = _AT[tree, node]
    return f"{value}::DOUBLE" if attr is None else f"CASE WHEN {names[attr]} <= {edge} THEN {tree_sql(tree, names, 2 * node)} ELSE {tree_sql(tree, names, 2 * node + 1)} END"


def mixed_sql(tree: int, own: set[str], node: int = 1) -> str:
    """The mean of the tree where features that aren't ``own`` go both ways by counts n<tree>_<node>."""
    attr, edge, value = _AT[tree, node]
    if attr is None:
        return f"{value}::DOUBLE"
    low, high = mixed_sql(tree, own, 2 * node), mixed_sql(tree, own, 2 * node + 1)
    share = lambda child: f"coalesce(n{tree}_{child}::DOUBLE / nullif(n{tree}_{node}, 0), 0)"
    return f"CASE WHEN {attr} <= {edge} THEN {low} ELSE {high} END" if attr in own else f"({share(2 * node)} * ({low}) + {share(2 * node + 1)} * ({high}))"


def counts_sql(tree: int, node: int = 1, where: str = "true") -> list[str]:
    attr, edge, _ = _AT[tree, node]
    own = [f"count(*) FILTER (WHERE {where}) AS n{tree}_{node}"]
    return own if attr is None else own + counts_sql(tree, 2 * node, f"{where} AND {attr} <= {edge}") + counts_sql(tree, 2 * node + 1, f"{where} AND {attr} > {edge}")


def shapley_sql(features: list[str]) -> str:
    """Shapley values of coalition values v0, v1, ... by mask."""
    p = len(features)
    out = []
    for i, f in enumerate(features):
        parts = [f"{factorial(bin(m).count('1')) * factorial(p - bin(m).count('1') - 1)}.0 / {factorial(p)} * (v{m | 1 << i} - v{m})" for m in range(1 << p) if not m >> i & 1]
        out.append(f"round({' + '.join(parts)}, 6) + 0.0 AS phi_{f}")
    return ", ".join(out)


def parts(read):
    return read("part").withColumn("p_len", F.length("p_name").cast("double"))


def nodes(spark):
    return spark.createDataFrame([(t, k, a, e) for t, k, a, e, _ in NODES], "tree int, node long, attr string, edge double")


def values(spark):
    return spark.createDataFrame([(t, k, v) for t, k, _, _, v in NODES if v is not None], "tree int, rule_id long, value double")


_PARTS = "x AS (SELECT p_partkey, p_size, p_retailprice, length(p_name) AS p_len FROM part)"
_INTERVENED = ", ".join(f"avg({' + '.join('(' + tree_sql(t, {f: ('x.' if m >> i & 1 else 'b.') + f for i, f in enumerate(FEATURES)}) + ')' for t in range(3))}) AS v{m}" for m in range(8))


@query("k15_tree_shap", f"WITH {_PARTS}, v AS (SELECT x.p_partkey, {_INTERVENED} FROM x CROSS JOIN x b GROUP BY x.p_partkey) SELECT p_partkey, round(v0, 6) AS base, {shapley_sql(FEATURES)} FROM v")
def _(spark, read):
    """Every part is the background of every other."""
    p, t = parts(read), nodes(spark)
    return rounded(T.tree_shap(p, p, T.tree_paths(T.node_counts(p, t, FEATURES)), values(spark), "p_partkey", FEATURES))


_MIXED = ", ".join(f"{' + '.join('(' + mixed_sql(t, {f for i, f in enumerate(FEATURES) if m >> i & 1}) + ')' for t in range(3))} AS v{m}" for m in range(8))


@query("k16_tree_shap_paths", f"WITH {_PARTS}, n AS (SELECT {', '.join(c for t in range(3) for c in counts_sql(t))} FROM x), v AS (SELECT p_partkey, {_MIXED} FROM x CROSS JOIN n) SELECT p_partkey, round(v0, 6) AS base, {shapley_sql(FEATURES)} FROM v")
def _(spark, read):
    """Shares of the parts at each node stand for the features outside a coalition."""
    p = parts(read)
    return rounded(T.tree_shap_paths(p, T.tree_paths(T.node_counts(p, nodes(spark), FEATURES)), values(spark), "p_partkey", FEATURES))


FOUR = ["p_size", "p_retailprice", "p_len", "p_no"]
MODEL = "(0.03 * p_size - 0.002 * p_retailprice + 0.0001 * p_size * p_retailprice + 0.05 * p_len * p_no - 0.01 * p_size * p_no)"
_BEHIND = "b AS (SELECT (n_nationkey * 2)::DOUBLE AS b_size, 900.0 + n_nationkey * 3 AS b_retailprice, (7 + n_nationkey % 6)::DOUBLE AS b_len, (n_nationkey % 5)::DOUBLE AS b_no FROM nation)"
_FOUR_SQL = "x AS (SELECT p_partkey, p_size::DOUBLE AS x_size, p_retailprice AS x_retailprice, length(p_name)::DOUBLE AS x_len, (p_partkey % 7)::DOUBLE AS x_no FROM part)"


def _model_at(mask: int) -> str:
    out = MODEL
    for i, f in enumerate(FOUR):
        out = out.replace(f, ("x_" if mask >> i & 1 else "b_") + f[2:])
    return out


def _owen_sql(i: int) -> str:
    """Of two pairs: with and without the partner, with and without the other pair."""
    partner, other = 1 << (i ^ 1), 12 if i < 2 else 3
    return " + ".join(f"v{c | 1 << i} - v{c}" for c in (0, partner, other, other | partner))


def _owen_part(spark, read):
    behind = read("nation").select((F.col("n_nationkey") * 2).alias("p_size"), (900.0 + F.col("n_nationkey") * 3).alias("p_retailprice"), (7 + F.col("n_nationkey") % 6).alias("p_len"), (F.col("n_nationkey") % 5).alias("p_no"))
    return parts(read).withColumn("p_no", F.col("p_partkey") % 7), behind


_FOUR_VALUES = f"WITH {_BEHIND}, {_FOUR_SQL}, v AS (SELECT p_partkey, {', '.join(f'avg({_model_at(m)}) AS v{m}' for m in range(16))} FROM x CROSS JOIN b GROUP BY p_partkey)"


@query("k17_owen_values", f"{_FOUR_VALUES} SELECT p_partkey, {', '.join(f'round(({_owen_sql(i)}) / 4, 6) + 0.0 AS phi_{f}' for i, f in enumerate(FOUR))} FROM v")
def _(spark, read):
    """Two pairs of features."""
    own, behind = _owen_part(spark, read)
    tree = spark.createDataFrame([(4, 0, 1), (5, 2, 3), (6, 4, 5)], "node long, left long, right long")
    return rounded(H.owen_values(own, behind, "p_partkey", FOUR, MODEL, tree))


def nation_distances(read):
    """Nations by their numbers of customers and suppliers; many pairs are equally far."""
    n = read("nation").select(F.col("n_nationkey").cast("long").alias("i"))
    count = lambda t, c: read(t).groupBy(F.col(c).alias("i")).agg(F.count("*").alias(f"of_{t}"))
    n = n.join(count("customer", "c_nationkey"), "i", "left").join(count("supplier", "s_nationkey"), "i", "left").fillna(0)
    d = F.abs(F.col("of_customer") - F.col("z_customer")) + 3 * F.abs(F.col("of_supplier") - F.col("z_supplier"))
    return n.join(n.select(F.col("i").alias("j"), F.col("of_customer").alias("z_customer"), F.col("of_supplier").alias("z_supplier")), F.col("i") < F.col("j")).select("i", "j", d.cast("double").alias("d"))


# One row with a list of clusters; each step merges the pair with the least (distance, least nations).
_LINKED = """WITH RECURSIVE n AS (SELECT n_nationkey AS i, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation),
 e AS MATERIALIZED (SELECT list(l ORDER BY i) AS m FROM (SELECT x.i, list((abs(x.c - y.c) + 3 * abs(x.s - y.s))::DOUBLE ORDER BY y.i) AS l FROM n x CROSS JOIN n y GROUP BY x.i)),
 r AS (SELECT -1::BIGINT AS step, 0.0::DOUBLE AS height, -1::BIGINT AS l, -1::BIGINT AS r, 0::BIGINT AS size, list({'rep': i::BIGINT, 'node': i::BIGINT, 'items': [i::BIGINT]} ORDER BY i) AS cs FROM n
  UNION ALL
  SELECT step + 1, best.d, x.node, y.node, len(x.items) + len(y.items), list_append(list_filter(cs, lambda c: c.rep <> best.a AND c.rep <> best.b), {'rep': best.a, 'node': 26 + step, 'items': CASE way WHEN 0 THEN x.items || y.items WHEN 1 THEN y.items || x.items WHEN 2 THEN list_reverse(x.items) || y.items ELSE x.items || list_reverse(y.items) END})
  FROM (SELECT *, list_sort([{'d': m[x.items[-1] + 1][y.items[1] + 1], 'w': 0}, {'d': m[x.items[1] + 1][y.items[-1] + 1], 'w': 1}, {'d': m[x.items[1] + 1][y.items[1] + 1], 'w': 2}, {'d': m[x.items[-1] + 1][y.items[-1] + 1], 'w': 3}])[1].w AS way
   FROM (SELECT step, cs, best, m, two[1] AS x, two[2] AS y FROM (SELECT *, list_sort(list_transform(list_filter(cs, lambda c: c.rep = best.a OR c.rep = best.b), lambda c: {'node': c.node, 'items': c.items})) AS two
    FROM (SELECT step, cs, m, list_sort(flatten(list_transform(cs, lambda c: list_transform(list_filter(cs, lambda o: o.rep > c.rep), lambda o: {'d': list_max(flatten(list_transform(c.items, lambda i: list_transform(o.items, lambda j: m[i + 1][j + 1])))), 'a': c.rep, 'b': o.rep}))))[1] AS best FROM r CROSS JOIN e WHERE step < 23))))
 )"""


@query("k18_complete_linkage", f'{_LINKED} SELECT step, 25 + step AS node, l AS "left", r AS "right", height, size FROM r WHERE step >= 0')
def _(spark, read):
    return H.complete_linkage(nation_distances(read))


@query("k19_leaf_order", f"{_LINKED} SELECT (place - 1)::INT AS place, cs[1].items[place] AS item FROM r, (SELECT unnest(range(1, 26)) AS place) WHERE step = 23")
def _(spark, read):
    d = nation_distances(read)
    return H.leaf_order(H.complete_linkage(d), d)
