"""Queries over encoding, bins and baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rationale.operators import bins as C

from .common import LINE_FEATURES, query, rounded, union_all

FLAGS = ["A", "N", "R"]
STATES = ["F", "O"]
SPEC = {"l_returnflag": FLAGS, "l_linestatus": STATES}


@query("c1_one_hot", "SELECT " + ", ".join(f"sum(CASE WHEN {f} = '{v}' THEN 1 ELSE 0 END)::DOUBLE AS {f}_{v}" for f, vs in SPEC.items() for v in vs) + " FROM lineitem")
def _(spark, read):
    hot = C.one_hot(read("lineitem").select(*SPEC), SPEC)
    return hot.agg(*[F.sum(f"`{f}={v}`").alias(f"{f}_{v}") for f, vs in SPEC.items() for v in vs])


@query("c2_ordinal", "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END::BIGINT AS l_returnflag, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::BIGINT AS l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, read):
    return C.ordinal(read("lineitem").select(*SPEC), SPEC).groupBy(*SPEC).agg(F.count("*").alias("n"))


@query("c3_decode", "SELECT l_returnflag, l_linestatus, CASE WHEN l_discount <= 0.025 THEN 0.0 WHEN l_discount <= 0.07 THEN 0.05 ELSE 0.09 END::DOUBLE AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def _(spark, read):
    back = C.decode(C.one_hot(read("lineitem").select("l_discount", *SPEC), SPEC), SPEC)
    # 0.07 lies between 0.05 and 0.09: the first of two equally near values is 0.05
    return back.withColumn("discount", C.nearest_allowed(F.round(F.col("l_discount") * 1000) / 1000, [0.0, 0.05, 0.0900000001])).withColumn("discount", F.round("discount", 2)).groupBy("l_returnflag", "l_linestatus", "discount").agg(F.count("*").alias("n"))


@query(
    "c4_rescale_categorical",
    "WITH m AS (SELECT " + ", ".join(f"avg(CASE WHEN l_returnflag = '{v}' THEN 1.0 ELSE 0 END) AS m_{v}" for v in FLAGS) + " FROM lineitem) SELECT l_returnflag, " + ", ".join(f"round(CASE WHEN l_returnflag = '{v}' THEN m_{v} + (m_A + m_N + m_R - m_{v}) / 3 ELSE m_{v} END, 6) AS v_{v}" for v in FLAGS) + ", count(*) AS n FROM lineitem CROSS JOIN m GROUP BY ALL",
)
def _(spark, read):
    hot = C.one_hot(read("lineitem").select("l_returnflag", F.col("l_returnflag").alias("f")), {"f": FLAGS})
    scaled = C.rescale_categorical(hot, {"f": FLAGS})
    return scaled.select("l_returnflag", *[F.round(f"`f={v}`", 6).alias(f"v_{v}") for v in FLAGS]).groupBy("l_returnflag", *[f"v_{v}" for v in FLAGS]).agg(F.count("*").alias("n"))


def _edges_sql(c: str, shares, table: str = "lineitem") -> str:
    return f"SELECT '{c}' AS feature, unnest(list_sort(list_distinct(quantile_cont({c}, [{', '.join(map(str, shares))}])))) AS edge FROM {table}"


QUARTILES = (0.25, 0.5, 0.75)
BINNED = "(SELECT '{c}' AS feature, list_sort(list_distinct(quantile_cont({c}, [0.25, 0.5, 0.75]))) AS edges FROM lineitem)"


@query("c5_quartile_bins", f"SELECT feature, round(edge, 4) AS edge FROM ({union_all([_edges_sql(c, QUARTILES) for c in LINE_FEATURES])})")
def _(spark, read):
    return rounded(C.quartile_bins(read("lineitem"), LINE_FEATURES).select("feature", F.explode("edges").alias("edge")), 4)


@query("c5_decile_bins", f"SELECT feature, round(edge, 4) AS edge FROM ({union_all([_edges_sql(c, [i / 10 for i in range(1, 10)]) for c in LINE_FEATURES])})")
def _(spark, read):
    return rounded(C.decile_bins(read("lineitem"), LINE_FEATURES).select("feature", F.explode("edges").alias("edge")), 4)


@query(
    "c6_entropy_bins",
    """WITH v AS (SELECT p_size::DOUBLE AS value, CASE WHEN (p_size > 25 AND p_retailprice > 950) OR p_size < 5 THEN 'Y' ELSE 'N' END AS y FROM part),
    g AS (SELECT DISTINCT value FROM v), k AS (SELECT DISTINCT y FROM v),
    c AS (SELECT g.value, k.y, sum(CASE WHEN v.value <= g.value THEN 1 ELSE 0 END) AS l, count(*) AS a FROM g CROSS JOIN k JOIN v ON v.y = k.y GROUP BY ALL),
    s AS (SELECT value, sum(l)::DOUBLE AS nl, sum(a)::DOUBLE AS na, sum(CASE WHEN l > 0 THEN l * log2(l) ELSE 0 END) AS sl, sum(CASE WHEN a > l THEN (a - l) * log2(a - l) ELSE 0 END) AS sr FROM c GROUP BY value),
    o AS (SELECT *, lead(value) OVER (ORDER BY value) AS nxt FROM s),
    b AS (SELECT (value + nxt) / 2 AS cut FROM o WHERE nxt IS NOT NULL ORDER BY (nl * log2(nl) - sl) + ((na - nl) * log2(na - nl) - sr), value LIMIT 1)
    SELECT 'p_size' AS feature, cut AS edge FROM b""",
)
def _(spark, read):
    """The first cut; further levels have their own test."""
    from .common import PART_MODEL

    return C.entropy_bins(read("part").withColumn("y", F.expr(PART_MODEL)), ["p_size"], "y", 1).select("feature", F.explode("edges").alias("edge"))


@query("c6_entropy_bins_deep")
def _(spark, read):
    return C.entropy_bins(read("lineitem"), LINE_FEATURES, "l_returnflag").select("feature", F.explode("edges").alias("edge"))


_PLACED = "SELECT l_quantity, l_tax, len(list_filter(q.edges, lambda e: e < l_quantity)) AS b_q, len(list_filter(t.edges, lambda e: e < l_tax)) AS b_t FROM lineitem CROSS JOIN " + BINNED.format(c="l_quantity") + " q CROSS JOIN " + BINNED.format(c="l_tax") + " t"


@query("c7_discretize", f"SELECT b_q::INT AS l_quantity, b_t::INT AS l_tax, count(*) AS n FROM ({_PLACED}) GROUP BY 1, 2")
def _(spark, read):
    x, two = read("lineitem"), ["l_quantity", "l_tax"]
    return C.discretize(x.select(*two), C.quartile_bins(x, two), two).groupBy(*two).agg(F.count("*").alias("n"))


_NAMES = "SELECT feature, bin::INT AS bin, CASE WHEN bin = 0 THEN printf('%s <= %.2f', feature, edges[1]) WHEN bin = len(edges) THEN printf('%s > %.2f', feature, edges[len(edges)]) ELSE printf('%.2f < %s <= %.2f', edges[bin], feature, edges[bin + 1]) END AS name FROM (SELECT *, unnest(range(0, len(edges) + 1)) AS bin FROM {b})"


@query("c8_bin_names", union_all([_NAMES.format(b=BINNED.format(c="l_quantity")), _NAMES.format(b=BINNED.format(c="p_size").replace("lineitem", "part"))]))
def _(spark, read):
    """Of features whose edges engines print alike: others differ where a half cent is rounded."""
    return C.bin_names(C.quartile_bins(read("lineitem"), ["l_quantity"])).union(C.bin_names(C.quartile_bins(read("part"), ["p_size"])))


_STATS = """SELECT b.feature, b.bin::INT AS bin, round(coalesce(avg(x.v), 0), 4) AS mean, round(coalesce(stddev_pop(x.v), 0) + 1e-11, 4) AS std, round(coalesce(any_value(b.lo), any_value(x.least)), 4) AS lo, round(coalesce(any_value(b.hi), any_value(x.most)), 4) AS hi FROM
  (SELECT feature, bin, CASE WHEN bin > 0 THEN edges[bin] END AS lo, CASE WHEN bin < len(edges) THEN edges[bin + 1] END AS hi FROM (SELECT *, unnest(range(0, len(edges) + 1)) AS bin FROM {b})) b
  LEFT JOIN (SELECT {c} AS v, len(list_filter(e.edges, lambda k: k < {c})) AS bin, min({c}) OVER () AS least, max({c}) OVER () AS most FROM lineitem CROSS JOIN {b} e) x ON x.bin = b.bin GROUP BY b.feature, b.bin"""


@query("c9_bin_stats", union_all([_STATS.format(b=BINNED.format(c=c), c=c) for c in ("l_quantity", "l_extendedprice")]))
def _(spark, read):
    x, two = read("lineitem"), ["l_quantity", "l_extendedprice"]
    return rounded(C.bin_stats(x, C.quartile_bins(x, two), two), 4)


@query("c10_undiscretize")
def _(spark, read):
    x, two = read("orders"), ["o_totalprice"]
    b = C.quartile_bins(x, two)
    return C.undiscretize(C.discretize(x.select("o_orderkey", *two), b, two), C.bin_stats(x, b, two), two, "o_orderkey").selectExpr("count(*) as n", "min(o_totalprice) as least", "max(o_totalprice) as most")


@query(
    "c11_kbins",
    "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]))) AS edges, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), x AS (SELECT len(list_filter(edges, lambda k: k < o_totalprice)) AS bin, edges, lo, hi FROM orders CROSS JOIN e) SELECT bin::INT AS bin, round((coalesce(CASE WHEN bin > 0 THEN edges[bin] END, lo) + coalesce(CASE WHEN bin < len(edges) THEN edges[bin + 1] END, hi)) / 2, 4) AS centre, count(*) AS n FROM x GROUP BY 1, 2",
)
def _(spark, read):
    x, one = read("orders"), ["o_totalprice"]
    b = C.kbins(x, one, 5)
    placed = C.discretize(x.select(*one), b, one).select(F.col("o_totalprice").alias("bin"))
    return rounded(placed.groupBy("bin").agg(F.count("*").alias("n")).join(C.bin_centres(x, b, one).drop("feature"), "bin"), 4)


@query("c12_bin_bounds", union_all([f"SELECT feature, bin::INT AS bin, round(CASE WHEN bin > 0 THEN edges[bin] END, 4) AS lo, round(CASE WHEN bin < len(edges) THEN edges[bin + 1] END, 4) AS hi FROM (SELECT *, unnest(range(0, len(edges) + 1)) AS bin FROM {BINNED.format(c=c)})" for c in LINE_FEATURES]))
def _(spark, read):
    return rounded(C.bin_bounds(C.quartile_bins(read("lineitem"), LINE_FEATURES)), 4)


@query("c13_items", f"SELECT item::INT AS item, count(*) AS n FROM (SELECT unnest(list_concat([b_q, b_t + 4], list_transform(list_filter(range(0, 8), lambda i: i <> b_q AND i <> b_t + 4), lambda i: i + 8))) AS item FROM ({_PLACED})) GROUP BY 1")
def _(spark, read):
    x, two = read("lineitem"), ["l_quantity", "l_tax"]
    placed = C.discretize(x.select(*two), C.quartile_bins(x, two), two)
    basket = C.with_negated(C.items(two, {"l_quantity": 4, "l_tax": 4}), 8)
    return placed.select(F.explode(basket).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
