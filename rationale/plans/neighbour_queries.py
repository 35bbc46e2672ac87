"""Queries over scoring and neighbourhoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rationale.functions.draws import draw_sql, normal_sql, permuted_sql
from rationale.functions.special import normal_cdf
from rationale.operators import bins as C
from rationale.operators import neighbours as E
from rationale.operators import profile as B
from rationale.operators import score as D
from rationale.operators import texts as T

from .common import PART_FEATURES, PART_MODEL, PART_SCORE, query, rounded

N = 16
S = "s AS (SELECT avg(p_size)::DOUBLE AS m1, avg(p_retailprice) AS m2, stddev_pop(p_size) AS s1, stddev_pop(p_retailprice) AS s2, min(p_size)::DOUBLE AS lo1, max(p_size)::DOUBLE AS hi1, min(p_retailprice) AS lo2, max(p_retailprice) AS hi2 FROM part)"


def neigh_sql(draw1: str, draw2: str, n: int = N) -> str:
    """CTEs s and neigh: rows of part perturbed by two draws."""
    return f"""{S}, r AS (SELECT unnest(range(0, {n + 1})) AS rep),
    neigh AS (SELECT p_partkey, rep, CASE WHEN rep = 0 THEN p_size ELSE p_size + s1 * {draw1} END AS p_size, CASE WHEN rep = 0 THEN p_retailprice ELSE p_retailprice + s2 * {draw2} END AS p_retailprice, p_size::DOUBLE AS x0_p_size, p_retailprice AS x0_p_retailprice, s1, s2 FROM part CROSS JOIN r CROSS JOIN s)"""


UNIFORM = neigh_sql(f"(4 * {draw_sql(1, 'p_partkey', 'rep', 0)} - 2)", f"(4 * {draw_sql(1, 'p_partkey', 'rep', 1)} - 2)")
NORMAL = neigh_sql(normal_sql(1, "p_partkey", "rep", 0), normal_sql(1, "p_partkey", "rep", 1))
SUMS = "SELECT p_partkey, round(sum(p_size), 4) AS size, round(sum(p_retailprice), 3) AS price, count(*) AS n FROM neigh GROUP BY p_partkey"


def part_neighbours(read, dist: str = "uniform", n: int = N):
    p = read("part")
    return E.perturb(p, E.stats_row(p, PART_FEATURES), "p_partkey", PART_FEATURES, n, dist)


def _sums(neigh):
    return neigh.groupBy("p_partkey").agg(F.round(F.sum("p_size"), 4).alias("size"), F.round(F.sum("p_retailprice"), 3).alias("price"), F.count("*").alias("n"))


@query("d1_score_sql", f"SELECT {PART_MODEL} AS label, count(*) AS n FROM part GROUP BY 1")
def _(spark, read):
    return D.score(read("part"), PART_MODEL).groupBy("label").agg(F.count("*").alias("n"))


@query("d1_score_python", "SELECT CASE WHEN p_size * 2 + p_retailprice > 1000 THEN 'Y' ELSE 'N' END AS label, count(*) AS n FROM part GROUP BY 1")
def _(spark, read):
    def model(f):
        return np.where(f["p_size"] * 2 + f["p_retailprice"] > 1000, "Y", "N")

    return D.score(read("part"), model, columns=PART_FEATURES).groupBy("label").agg(F.count("*").alias("n"))


@query("d2_one_vs_rest", f"WITH {UNIFORM}, l AS (SELECT p_partkey, rep, {PART_MODEL} AS label FROM neigh), o AS (SELECT p_partkey, label AS own FROM l WHERE rep = 0) SELECT CASE WHEN label = own THEN own ELSE '~' || own END AS label, count(*) AS n FROM l JOIN o USING (p_partkey) GROUP BY 1")
def _(spark, read):
    return D.one_vs_rest(D.score(part_neighbours(read), PART_MODEL), "p_partkey").groupBy("label").agg(F.count("*").alias("n"))


@query("d3_label_indicator", "SELECT sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS r FROM lineitem")
def _(spark, read):
    return D.label_indicator(read("lineitem").select("l_returnflag"), ["A", "N", "R"], "l_returnflag").agg(*[F.sum(f"is_{c}").alias(c.lower()) for c in "ANR"])


@query("d4_top_labels", "SELECT vec_id, i::INT AS class_index, round(p, 6) AS p, rank::INT AS rank FROM (SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rank FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS p FROM embeddings)) WHERE rank <= 2")
def _(spark, read):
    e = read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    return rounded(D.top_labels(e, "vec_id", "p", 2))


_BINARY = f"l AS (SELECT p_partkey, rep, CAST(floor({PART_SCORE} * 2) AS BIGINT)::VARCHAR AS label FROM neigh)"


@query("d5_next_best_class", f"WITH {UNIFORM}, {_BINARY}, o AS (SELECT p_partkey, label AS own FROM l WHERE rep = 0), c AS (SELECT p_partkey, label, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT c.p_partkey, label, row_number() OVER (PARTITION BY c.p_partkey ORDER BY n DESC, label) AS r FROM c JOIN o ON o.p_partkey = c.p_partkey AND label <> own) SELECT p_partkey, label AS next_class FROM k WHERE r = 1")
def _(spark, read):
    return D.next_best_class(D.score(part_neighbours(read), f"string(bigint(floor({PART_SCORE} * 2)))"), "p_partkey")


@query("e1_perturb_uniform", f"WITH {UNIFORM} {SUMS}")
def _(spark, read):
    return _sums(part_neighbours(read))


@query("e1_perturb_range", f"WITH {S}, r AS (SELECT unnest(range(0, {N + 1})) AS rep), neigh AS (SELECT p_partkey, rep, CASE WHEN rep = 0 THEN p_size ELSE lo1 + {draw_sql(1, 'p_partkey', 'rep', 0)} * (hi1 - lo1) END AS p_size, CASE WHEN rep = 0 THEN p_retailprice ELSE lo2 + {draw_sql(1, 'p_partkey', 'rep', 1)} * (hi2 - lo2) END AS p_retailprice FROM part CROSS JOIN r CROSS JOIN s) {SUMS}")
def _(spark, read):
    return _sums(part_neighbours(read, "range"))


@query("e1_perturb_standard_normal", f"WITH {NORMAL} {SUMS}")
def _(spark, read):
    return _sums(part_neighbours(read, "standard-normal"))


CAUCHY = neigh_sql(f"tan(({draw_sql(1, 'p_partkey', 'rep', 0)} - 0.5) * pi())", f"tan(({draw_sql(1, 'p_partkey', 'rep', 1)} - 0.5) * pi())")


@query("e1_perturb_cauchy", f"WITH {CAUCHY} SELECT p_partkey, round(median(p_size), 4) AS size, round(median(p_retailprice), 3) AS price, count(*) AS n FROM neigh GROUP BY p_partkey")
def _(spark, read):
    return part_neighbours(read, "cauchy").groupBy("p_partkey").agg(F.round(F.median("p_size"), 4).alias("size"), F.round(F.median("p_retailprice"), 3).alias("price"), F.count("*").alias("n"))


def _t_sql(i: int) -> str:
    squares = " + ".join(f"power({normal_sql(s, 'p_partkey', 'rep', i)}, 2)" for s in (101, 103, 105))
    return f"({normal_sql(1, 'p_partkey', 'rep', i)} / sqrt(({squares}) / 3))"


@query("e1_perturb_t", f"WITH {neigh_sql(_t_sql(0), _t_sql(1))} {SUMS}")
def _(spark, read):
    return _sums(part_neighbours(read, "t"))


def part_covariance(read) -> np.ndarray:
    rows = {(r.i, r.j): r.value for r in B.covariance(read("part"), PART_FEATURES).collect()}
    return np.array([[rows[i, j] for j in PART_FEATURES] for i in PART_FEATURES])


_Z = [normal_sql(1, "p_partkey", "rep", i) for i in (0, 1)]


@query("e2_perturb_normal", f"WITH c AS (SELECT covar_samp(p_size, p_size) AS a, covar_samp(p_size, p_retailprice) AS b, covar_samp(p_retailprice, p_retailprice) AS c FROM part), l AS (SELECT sqrt(a) AS l11, b / sqrt(a) AS l21, sqrt(c - b * b / a) AS l22 FROM c), r AS (SELECT unnest(range(0, {N + 1})) AS rep), neigh AS (SELECT p_partkey, CASE WHEN rep = 0 THEN p_size ELSE p_size + l11 * {_Z[0]} END AS p_size, CASE WHEN rep = 0 THEN p_retailprice ELSE p_retailprice + l21 * {_Z[0]} + l22 * {_Z[1]} END AS p_retailprice FROM part CROSS JOIN r CROSS JOIN l) {SUMS}")
def _(spark, read):
    return _sums(E.perturb_normal(read("part"), part_covariance(read), "p_partkey", PART_FEATURES, N))


@query("e3_bound", f"WITH {UNIFORM}, b AS (SELECT lo1, hi1 FROM s) SELECT p_partkey, round(sum(least(greatest(p_size, lo1), hi1)), 4) AS lazy, round(sum(CASE WHEN p_size > hi1 THEN hi1 - (((p_size % (hi1 - lo1)) + (hi1 - lo1)) % (hi1 - lo1)) / 2 WHEN p_size < lo1 THEN lo1 + (((p_size % (hi1 - lo1)) + (hi1 - lo1)) % (hi1 - lo1)) / 2 ELSE p_size END), 4) AS absolute FROM neigh CROSS JOIN b GROUP BY p_partkey")
def _(spark, read):
    n = part_neighbours(read).join(F.broadcast(E.stats_row(read("part"), ["p_size"])))
    lo, hi = F.col("min_p_size"), F.col("max_p_size")
    return n.groupBy("p_partkey").agg(F.round(F.sum(E.bounded(F.col("p_size"), lo, hi)), 4).alias("lazy"), F.round(F.sum(E.bounded(F.col("p_size"), lo, hi, "absolute")), 4).alias("absolute"))


_MOVED = "CASE WHEN x < lo1 THEN {c} + ((x % (hi1 - lo1)) + (hi1 - lo1)) % (hi1 - lo1) / 2 WHEN x > hi1 THEN {c} - ((x % (hi1 - lo1)) + (hi1 - lo1)) % (hi1 - lo1) / 2 ELSE x END"


def _distributed(centre: str, name: str) -> str:
    return f"{name} AS (SELECT p_partkey, rep, 0 AS step, p_size AS x, x0_p_size AS x0, lo1, hi1, m1 FROM neigh CROSS JOIN (SELECT lo1, hi1, m1 FROM s) UNION ALL SELECT p_partkey, rep, step + 1, {_MOVED.format(c=centre)}, x0, lo1, hi1, m1 FROM {name} WHERE step < 8)"


@query("e3_bound_distribute", f"WITH RECURSIVE {UNIFORM}, {_distributed('m1', 'dm')}, {_distributed('x0', 'ds')} SELECT p_partkey, round(sum(least(greatest(dm.x, dm.lo1), dm.hi1)), 4) AS mean, round(sum(least(greatest(ds.x, ds.lo1), ds.hi1)), 4) AS sample FROM dm JOIN ds USING (p_partkey, rep) WHERE dm.step = 8 AND ds.step = 8 GROUP BY p_partkey")
def _(spark, read):
    """Values beyond the range move to either side of the mean, or of the instance's own value."""
    n = part_neighbours(read).join(F.broadcast(E.stats_row(read("part"), ["p_size"])))
    lo, hi = F.col("min_p_size").cast("double"), F.col("max_p_size").cast("double")
    by = {k: E.bounded(F.col("p_size"), lo, hi, "distribute", F.col(c)) for k, c in (("mean", "mean_p_size"), ("sample", "x0_p_size"))}
    return n.groupBy("p_partkey").agg(*[F.round(F.sum(x), 4).alias(k) for k, x in by.items()])


_CLASS = "CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 15 THEN 'middle' ELSE 'low' END"


@query(
    "e4_class_balanced",
    f"""WITH {UNIFORM}, x AS (SELECT p_partkey, rep, (rep - 1) // 4 AS round, {_CLASS} AS label FROM neigh WHERE rep > 0),
    h AS (SELECT p_partkey, floor(6 / count(DISTINCT label)) AS share FROM x GROUP BY p_partkey),
    c AS (SELECT p_partkey, label, round, sum(count(*)) OVER (PARTITION BY p_partkey, label ORDER BY round) AS c FROM x GROUP BY p_partkey, label, round),
    f AS (SELECT c.p_partkey, label, min(CASE WHEN c >= share THEN round END) AS met, max(round) AS till FROM c JOIN h USING (p_partkey) GROUP BY c.p_partkey, label),
    l AS (SELECT p_partkey, CASE WHEN count(met) = count(*) THEN max(met) ELSE max(till) END AS last FROM f GROUP BY p_partkey),
    q AS (SELECT x.*, share, row_number() OVER (PARTITION BY x.p_partkey, label ORDER BY round, rep) AS r FROM x JOIN l USING (p_partkey) JOIN h USING (p_partkey) WHERE round <= last)
    SELECT p_partkey, label, count(*) AS n, sum(rep)::BIGINT AS reps FROM q WHERE r <= share GROUP BY p_partkey, label""",
)
def _(spark, read):
    """Every class that turns up around an instance has the same share."""
    rounds = part_neighbours(read).where("rep > 0").select("p_partkey", "rep", F.expr("(rep - 1) div 4").alias("round"), F.expr(_CLASS).alias("label"))
    return E.class_balanced(rounds, "p_partkey", 6).groupBy("p_partkey", "label").agg(F.count("*").alias("n"), F.sum("rep").alias("reps"))


@query(
    "e4_balanced",
    f"""WITH {UNIFORM}, l AS (SELECT p_partkey, rep, (rep - 1) // 4 AS round, {PART_MODEL} AS label FROM neigh), o AS (SELECT p_partkey, label AS own FROM l WHERE rep = 0),
    x AS (SELECT l.p_partkey, rep, round, label = own AS own FROM l JOIN o USING (p_partkey) WHERE rep > 0),
    c AS (SELECT p_partkey, round, sum(count(*) FILTER (WHERE own)) OVER w AS a, sum(count(*) FILTER (WHERE NOT own)) OVER w AS b FROM x GROUP BY p_partkey, round WINDOW w AS (PARTITION BY p_partkey ORDER BY round)),
    k AS (SELECT p_partkey, coalesce(min(CASE WHEN a >= 3 AND b >= 3 THEN round END), max(round)) AS last FROM c GROUP BY p_partkey),
    q AS (SELECT x.*, row_number() OVER (PARTITION BY x.p_partkey, own ORDER BY round, rep) AS r FROM x JOIN k USING (p_partkey) WHERE round <= last)
    SELECT p_partkey, own, count(*) AS n, sum(rep)::BIGINT AS reps FROM q WHERE r <= 3 GROUP BY p_partkey, own""",
)
def _(spark, read):
    scored = D.score(part_neighbours(read), PART_MODEL)
    own = scored.where("rep = 0").select("p_partkey", F.col("label").alias("c"))
    rounds = scored.where("rep > 0").join(own, "p_partkey").select("p_partkey", "rep", F.expr("(rep - 1) div 4").alias("round"), (F.col("label") == F.col("c")).alias("own"))
    return E.balanced(rounds, "p_partkey", 6).groupBy("p_partkey", "own").agg(F.count("*").alias("n"), F.sum("rep").alias("reps"))


@query("e5_clustered_perturb", f"WITH c AS (SELECT p_brand, stddev_pop(p_size) AS s1 FROM part GROUP BY p_brand), r AS (SELECT unnest(range(0, {N + 1})) AS rep) SELECT p_partkey, round(sum(CASE WHEN rep = 0 THEN p_size ELSE p_size + s1 * {normal_sql(1, 'p_partkey', 'rep', 0)} END), 4) AS size FROM part JOIN c USING (p_brand) CROSS JOIN r GROUP BY p_partkey")
def _(spark, read):
    p = read("part")
    scales = p.groupBy("p_brand").agg(F.stddev_pop("p_size").alias("scale_p_size"))
    return E.clustered_perturb(p, scales, "p_partkey", "p_brand", ["p_size"], N).groupBy("p_partkey").agg(F.round(F.sum("p_size"), 4).alias("size"))


_FREQ = "f AS (SELECT p_brand AS value, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM part GROUP BY p_brand), cf AS (SELECT value, sum(share) OVER (ORDER BY value) AS hi FROM f)"


@query("e6_lime_sample", f"WITH {S}, {_FREQ}, r AS (SELECT unnest(range(0, {N + 1})) AS rep), d AS (SELECT p_partkey, p_brand, p_size, rep, m1, s1, {draw_sql(1, 'p_partkey', 'rep', 1)} AS u FROM part CROSS JOIN r CROSS JOIN s), v AS (SELECT d.*, CASE WHEN rep = 0 THEN p_brand ELSE (SELECT min(value) FROM cf WHERE cf.hi >= u) END AS b FROM d) SELECT p_partkey, round(sum(CASE WHEN rep = 0 THEN p_size ELSE m1 + s1 * {normal_sql(1, 'p_partkey', 'rep', 0)} END), 4) AS size, sum(CASE WHEN b = p_brand THEN 1 ELSE 0 END)::BIGINT AS same, min(b) AS least, max(b) AS most FROM v GROUP BY p_partkey")
def _(spark, read):
    p = read("part")
    s = E.lime_sample(p, E.stats_row(p, ["p_size"]), B.category_frequencies(p, ["p_brand"]), "p_partkey", ["p_size"], ["p_brand"], N)
    return s.groupBy("p_partkey").agg(F.round(F.sum("p_size"), 4).alias("size"), F.sum("same_p_brand").alias("same"), F.min("p_brand").alias("least"), F.max("p_brand").alias("most"))


@query("e7_proximity_shares", "WITH g AS (SELECT a.i AS bin, b.i AS other, exp(-0.5 * abs(a.i - b.i)) AS w FROM (SELECT unnest(range(0, 4)) AS i) a CROSS JOIN (SELECT unnest(range(0, 4)) AS i) b), h AS (SELECT bin, other, w / sum(w) OVER (PARTITION BY bin) AS share FROM g), k AS (SELECT *, sum(share) OVER (PARTITION BY bin ORDER BY other) AS hi FROM h), e AS (SELECT list_sort(list_distinct(quantile_cont(p_size, [0.25, 0.5, 0.75]))) AS edges FROM part), x AS (SELECT p_partkey, len(list_filter(edges, lambda q: q < p_size)) AS own, rep, " + draw_sql(1, "p_partkey", "rep", 0) + f" AS u FROM part CROSS JOIN e CROSS JOIN (SELECT unnest(range(0, {N + 1})) AS rep)) SELECT p_partkey, sum(CASE WHEN rep = 0 THEN own ELSE (SELECT min(other) FROM k WHERE k.bin = own AND k.hi >= u) END)::BIGINT AS bins FROM x GROUP BY p_partkey")
def _(spark, read):
    p, one = read("part"), ["p_size"]
    edges = C.quartile_bins(p, one)
    placed = C.discretize(p.select("p_partkey", *one), edges, one)
    shares = E.proximity_shares(edges.select("feature", (F.size("edges") + 1).alias("n_bins")))
    return E.proximity_sample(placed, shares, "p_partkey", one, N).groupBy("p_partkey").agg(F.sum("bin").alias("bins"))


@query("e8_lhs_sample", f"WITH x AS (SELECT p_partkey, rep, row_number() OVER (PARTITION BY p_partkey ORDER BY {draw_sql(1, 'p_partkey', 'rep', 0)}, rep) - 1 AS a, row_number() OVER (PARTITION BY p_partkey ORDER BY {draw_sql(1, 'p_partkey', 'rep', 1)}, rep) - 1 AS b FROM part CROSS JOIN (SELECT unnest(range(1, {N + 1})) AS rep)) SELECT p_partkey, sum(rep * a)::BIGINT AS strata_size, sum(rep * b)::BIGINT AS strata_price, {2 * N}::BIGINT AS inside FROM x GROUP BY p_partkey")
def _(spark, read):
    """Strata by draw, and values that lie in their stratum of the normal distribution."""
    p = read("part")
    stats = E.stats_row(p, PART_FEATURES)
    s = E.lhs_sample(p, stats, "p_partkey", PART_FEATURES, N).join(F.broadcast(stats))
    inside = [(F.floor(normal_cdf((F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}")) * N) == F.col(f"stratum_{c}")).cast("long") for c in PART_FEATURES]
    return s.groupBy("p_partkey").agg(F.sum(F.col("rep") * F.col("stratum_p_size")).alias("strata_size"), F.sum(F.col("rep") * F.col("stratum_p_retailprice")).alias("strata_price"), F.sum(inside[0] + inside[1]).alias("inside"))


_PIECES = "pc AS (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+') AS p FROM documents)"


@query("e9_token_index", f"WITH {_PIECES}, u AS (SELECT doc_id, unnest(p) AS w, unnest(range(0, len(p))) AS i FROM pc), s AS (SELECT doc_id, w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS start FROM u) SELECT doc_id, w AS word, count(*) AS n, array_to_string(list(start::BIGINT ORDER BY start), ' ') AS starts FROM s WHERE regexp_matches(w, '^[a-zA-Z0-9_]') GROUP BY doc_id, w")
def _(spark, read):
    t = T.token_index(read("documents"), "doc_id", "text", r"[^a-zA-Z0-9_]+")
    return t.select("doc_id", "word", "n", F.array_join(F.transform("starts", lambda s: s.cast("string")), " ").alias("starts"))


def _word_code(w: str) -> str:
    """The keyed code of a word, seed 1."""
    mixed = f"((doc_id % 2147483647) * 16807 + (rep % 2147483647) * 7919 + (('0x' || substr(md5({w}), 1, 8))::BIGINT % 2147483647) * 104729 + 32)"
    return permuted_sql(mixed)


def _masks(words: str, parts: str, gap: str | None, kept: str) -> str:
    left = f"list_filter({parts}, lambda x: {kept} OR list_contains(k, x))" if gap is None else f"list_transform({parts}, lambda x: CASE WHEN {kept} OR list_contains(k, x) THEN x ELSE '{gap}' END)"
    return f"v AS (SELECT doc_id, p, rep, list_distinct({words}) AS v FROM pc CROSS JOIN (SELECT unnest(range(0, 3)) AS rep)), q AS (SELECT *, CASE WHEN rep = 0 THEN 0 ELSE floor({draw_sql(1, 'doc_id', 'rep', 999)} * len(v)) + 1 END::INT AS removed FROM v WHERE len(v) > 0), b AS (SELECT *, CASE WHEN removed = 0 THEN -1 ELSE list_sort(list_transform(v, lambda x: {_word_code('x')}))[removed] END AS bar FROM q), k AS (SELECT *, list_filter(v, lambda x: {_word_code('x')} > bar) AS k FROM b) SELECT doc_id, rep::INT AS rep, removed, md5(array_to_string({left}, '')) AS masked FROM k"


_WORDS, _GAP = "list_filter(p, lambda x: regexp_matches(x, '^[a-zA-Z0-9_]'))", "NOT regexp_matches(x, '^[a-zA-Z0-9_]')"


@query("e9_text_mask", f"WITH {_PIECES}, {_masks(_WORDS, 'p', None, _GAP)}")
def _(spark, read):
    m = T.text_mask(read("documents"), "doc_id", "text", 2, pattern=r"[^a-zA-Z0-9_]+")
    return m.select("doc_id", "rep", "removed", F.md5(F.col("masked").cast("binary")).alias("masked"))


@query("e9_text_mask_positions", f"WITH {_PIECES}, {_masks(_WORDS, 'p', 'UNKWORDZ', _GAP)}")
def _(spark, read):
    """Words that go leave a mark in their place."""
    m = T.text_mask(read("documents"), "doc_id", "text", 2, False, pattern=r"[^a-zA-Z0-9_]+")
    return m.select("doc_id", "rep", "removed", F.md5(F.col("masked").cast("binary")).alias("masked"))


@query("e9_text_mask_characters", f"WITH pc AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS p FROM documents), {_masks('p', 'p', ' ', 'false')}")
def _(spark, read):
    m = T.text_mask(read("documents"), "doc_id", "text", 2, False, char_level=True)
    return m.select("doc_id", "rep", "removed", F.md5(F.col("masked").cast("binary")).alias("masked"))


@query("e10_unk_mask", f"SELECT doc_id, rep::INT AS rep, sum(CASE WHEN w = 'UNK' OR (rep > 0 AND {draw_sql(1, 'doc_id', 'rep', 0).replace('CAST(32 AS BIGINT)', '(CAST(32 AS BIGINT) + i * 104729)')} < 0.5) THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents) CROSS JOIN (SELECT unnest(range(0, 2)) AS rep) GROUP BY doc_id, rep")
def _(spark, read):
    m = T.unk_mask(read("documents"), "doc_id", "text", 1)
    return m.select("doc_id", "rep", F.size(F.filter(F.split("masked", " "), lambda w: w == "UNK")).cast("long").alias("n"))


@query("e11_marginal_sample", f"WITH {S} SELECT count(*) AS n, round(sum(trunc(m1 + s1 * {normal_sql(1, 'rep', '0', 0)})), 4) AS size FROM range(0, 2000) t(rep) CROSS JOIN s")
def _(spark, read):
    return E.marginal_sample(read("part"), "p_partkey", ["p_size"], ["p_brand"], 2000).agg(F.count("*").alias("n"), F.round(F.sum("p_size"), 4).alias("size"))


_NEAR = f"""WITH {S}, x AS (SELECT p_partkey, p_size, p_retailprice, {PART_MODEL} AS label FROM part), i AS (SELECT p_partkey AS instance_id, p_size AS a, p_retailprice AS b FROM part WHERE p_partkey % 100 = 0),
    d AS (SELECT instance_id, p_partkey, label, sqrt(power((p_size - a) / s1, 2) + power((p_retailprice - b) / s2, 2)) AS distance FROM x CROSS JOIN i CROSS JOIN s),
    k AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY distance, p_partkey) AS r, row_number() OVER (PARTITION BY instance_id, label ORDER BY distance, p_partkey) AS rc FROM d),
    c AS (SELECT instance_id, label, count(*) FILTER (WHERE r <= 20) AS n FROM k GROUP BY ALL), q AS (SELECT instance_id, min(label) AS rare FROM c WHERE n < 4 GROUP BY instance_id)
    SELECT k.instance_id, p_partkey, label, round(distance, 6) AS distance FROM k LEFT JOIN q USING (instance_id) WHERE r <= CASE WHEN rare IS NULL THEN 20 ELSE 16 END OR (label = rare AND rc <= 4)"""


@query("e12_closest_rows", _NEAR)
def _(spark, read):
    p = D.score(read("part"), PART_MODEL)
    return rounded(E.closest_rows(p, p.where("p_partkey % 100 = 0"), "p_partkey", PART_FEATURES, "label", 20, 0.2))


@query("e13_genetic_neighbourhood")
def _(spark, read):
    def predict(m):
        return ((m[:, 0] > 25) & (m[:, 1] > 950)) | (m[:, 0] < 5)

    scales = {c: float(v) for c, v in zip(PART_FEATURES, np.sqrt(np.diag(part_covariance(read))), strict=True)}
    return E.genetic_neighbourhood(read("part"), predict, "p_partkey", PART_FEATURES, scales, 30, 3).groupBy("p_partkey").agg(F.count("*").alias("n"), F.max("fitness").alias("best"))


@query("e13_fitness_gap", "WITH g AS (SELECT user_id, value, value - lead(value) OVER (PARTITION BY user_id ORDER BY value DESC) AS gap FROM events) SELECT user_id, arg_max(value, (gap, value)) AS cut FROM g WHERE gap IS NOT NULL GROUP BY user_id")
def _(spark, read):
    return E.fitness_gap(read("events"), "user_id", "value")


@query("e14_oversample", f"WITH x AS (SELECT p_partkey, {PART_MODEL} AS label FROM part), y AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p_partkey) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM x), z AS (SELECT *, max(n) OVER () AS most FROM y), c AS (SELECT *, most // n + (r < most % n)::INT AS copies FROM z) SELECT label, sum(copies)::BIGINT AS n, sum(p_partkey * copies)::BIGINT AS keys, sum(copies * (copies - 1) // 2)::BIGINT AS copies FROM c GROUP BY label")
def _(spark, read):
    o = E.oversample(D.score(read("part"), PART_MODEL), "label", "p_partkey")
    return o.groupBy("label").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"), F.sum("copy").alias("copies"))


_REDRAWN = f"a AS (SELECT p_partkey, p_size::DOUBLE AS v, row_number() OVER (ORDER BY {draw_sql(1, 'p_partkey')}, p_partkey) - 1 AS i FROM part), b AS (SELECT p_size::DOUBLE AS w, row_number() OVER (ORDER BY {draw_sql(2, 'p_partkey')}, p_partkey) - 1 AS j FROM part WHERE p_size > 10 AND p_size <= 20), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE v > 10 AND v <= 20) AS m FROM a), k AS (SELECT rep, floor({draw_sql(3, 'rep')} * n) AS i, floor({draw_sql(4, 'rep')} * greatest(m, 1)) AS j FROM range(0, 4000) t(rep) CROSS JOIN s)"


@query("e15_conditional_sample", f"WITH {_REDRAWN} SELECT rep, p_partkey, round(CASE WHEN v > 10 AND v <= 20 THEN v ELSE coalesce(w, 10 + {draw_sql(5, 'rep')} * 10) END, 6) AS value FROM k JOIN a USING (i) LEFT JOIN b USING (j)")
def _(spark, read):
    return rounded(E.conditional_sample(read("part"), "p_partkey", "p_size", 10, 20, 4000))


@query("e16_noise_pairs", f"SELECT label::INT AS label, count(*) AS n, round(sum(v), 3) AS total FROM (SELECT 1 AS label, p_size::DOUBLE AS v FROM part UNION ALL SELECT 0, p_size + 0.3 * {normal_sql(1, 'p_partkey', 'rep', 0)} FROM part CROSS JOIN (SELECT unnest(range(1, 4)) AS rep)) GROUP BY label")
def _(spark, read):
    return E.noise_pairs(read("part"), "p_partkey", ["p_size"], multiplier=3).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("p_size"), 3).alias("total"))


_BG = "bg AS (SELECT n_nationkey::BIGINT AS bg_id, CAST(n_nationkey % 10 AS INT) + 1 AS p_size, 'ECONOMY' AS p_type FROM nation)"


def background(read):
    return read("nation").select(F.col("n_nationkey").cast("long").alias("bg_id"), (F.col("n_nationkey") % 10 + 1).cast("int").alias("p_size"), F.lit("ECONOMY").alias("p_type"))


@query("e17_substitution_set", f"WITH {_BG}, m AS (SELECT p_partkey, CASE WHEN {draw_sql(1, 'p_partkey', '2', 0)} < 0.5 THEN bg.p_size ELSE p.p_size END AS a, CASE WHEN {draw_sql(1, 'p_partkey', '2', 1)} < 0.5 THEN bg.p_type ELSE p.p_type END AS b FROM part p JOIN bg ON bg.bg_id = floor({draw_sql(1, 'p_partkey', '1', 0)} * (SELECT count(*) FROM bg))), k AS (SELECT DISTINCT p_size, p_type FROM part) SELECT CASE WHEN k.p_size IS NULL THEN 0 ELSE 1 END::INT AS label, count(*) AS n, sum(a)::BIGINT AS sizes FROM m LEFT JOIN k ON k.p_size = a AND k.p_type = b GROUP BY 1")
def _(spark, read):
    return E.substitution_set(read("part"), background(read), "p_partkey", ["p_size", "p_type"]).groupBy("label").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("e18_permutation_pairs", f"WITH {_BG}, x AS (SELECT p_partkey, rep, p.p_size, bg.p_size AS o, {draw_sql(1, 'p_partkey', 'rep', 0)} AS c0, {draw_sql(1, 'p_partkey', 'rep', 1)} AS c1, floor({draw_sql(2, 'p_partkey', 'rep', 0)} * 2) AS chosen FROM part p CROSS JOIN (SELECT unnest(range(1, 4)) AS rep) JOIN bg ON bg.bg_id = floor({draw_sql(3, 'p_partkey', 'rep', 0)} * (SELECT count(*) FROM bg))) SELECT CASE WHEN chosen = 0 THEN 'p_size' ELSE 'p_type' END AS feature, count(*) AS n, sum(CASE WHEN chosen = 1 AND c0 > c1 THEN o ELSE p_size END)::BIGINT AS on_size, sum(CASE WHEN chosen = 0 OR c0 > c1 THEN o ELSE p_size END)::BIGINT AS off_size FROM x GROUP BY 1")
def _(spark, read):
    p = E.permutation_pairs(read("part"), background(read), "p_partkey", ["p_size", "p_type"], 3)
    return p.groupBy("feature").agg(F.count("*").alias("n"), F.sum("on_p_size").alias("on_size"), F.sum("off_p_size").alias("off_size"))


@query("e19_class_rule", "SELECT CAST(c_acctbal / 1000 * c_acctbal / 1000 - c_acctbal / 1000 * c_nationkey + c_nationkey > 1 AS INT) AS y, count(*) AS n FROM customer GROUP BY 1")
def _(spark, read):
    c = read("customer").select((F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return c.groupBy(E.polynomial_rule(F.col("a"), F.col("b")).alias("y")).agg(F.count("*").alias("n"))


_POINTS = f"z AS (SELECT c_custkey, ({draw_sql(1, 'c_custkey')} < 0.5)::INT + 1 AS z FROM customer), p AS (SELECT c_custkey, z, CASE WHEN z = 1 THEN -1.5 ELSE 1.5 END + {normal_sql(2, 'c_custkey')} AS a, CASE WHEN z = 1 THEN -0.75 ELSE 0.75 END + {normal_sql(4, 'c_custkey')} AS b FROM z)"


@query("e19_simulate", f"WITH {_POINTS} SELECT z, (a * a - a * b + b > 1)::INT AS y, count(*) AS n, round(sum(a), 4) AS a, round(sum(b), 4) AS b FROM p GROUP BY 1, 2")
def _(spark, read):
    """A simulated point for each customer."""
    return E.simulate(read("customer"), "c_custkey").groupBy("z", "y").agg(F.count("*").alias("n"), F.round(F.sum("a"), 4).alias("a"), F.round(F.sum("b"), 4).alias("b"))
