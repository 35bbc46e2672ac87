"""Tree attributions, linkage and Owen values against versions that try everything."""

import itertools
import math

import numpy as np
import pytest

from rationale.operators import hierarchy, shapley, treeshap

FEATURES = ["a", "b", "c"]


def grown(rng, depth, node=1):
    """(node, attr, edge, value) rows of a random tree."""
    if depth == 0 or (node > 1 and rng.random() < 0.15):
        return [(node, None, None, float(rng.integers(-5, 6)))]
    return [(node, str(rng.choice(FEATURES)), float(rng.integers(1, 9)), None), *grown(rng, depth - 1, 2 * node), *grown(rng, depth - 1, 2 * node + 1)]


def case_of(tree, node=1):
    attr, edge, value = tree[node]
    return f"CAST({value} AS DOUBLE)" if attr is None else f"CASE WHEN {attr} <= {edge} THEN {case_of(tree, 2 * node)} ELSE {case_of(tree, 2 * node + 1)} END"


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(7)
    trees = [{n: rest for n, *rest in grown(rng, d)} for d in (4, 3, 1)] + [{1: [None, None, 1.5]}]
    nodes = spark.createDataFrame([(t, n, a, e) for t, tree in enumerate(trees) for n, (a, e, _) in tree.items()], "tree int, node long, attr string, edge double")
    values = spark.createDataFrame([(t, n, v) for t, tree in enumerate(trees) for n, (_, _, v) in tree.items() if v is not None], "tree int, rule_id long, value double")
    rows = spark.createDataFrame([(i, *map(float, rng.integers(0, 10, 3))) for i in range(40)], "id long, a double, b double, c double").cache()
    return trees, nodes, values, rows, " + ".join(f"({case_of(t)})" for t in trees)


def test_tree_shap_is_exact(spark, forest):
    trees, nodes, values, rows, model = forest
    behind = rows.where("id < 13")
    got = {r.id: r for r in treeshap.tree_shap(rows, behind, treeshap.tree_paths(treeshap.node_counts(rows, nodes, FEATURES)), values, "id", FEATURES).collect()}
    wanted = shapley.shap_exact(rows, behind, "id", FEATURES, model).collect()
    mean = behind.selectExpr(f"avg({model}) AS m").first().m
    assert len(got) == len(wanted) == 40
    for r in wanted:
        assert all(abs(got[r.id][f"phi_{f}"] - r[f"phi_{f}"]) < 1e-9 for f in FEATURES) and abs(got[r.id].base - mean) < 1e-9


def test_tree_shap_weights(spark, forest):
    _, nodes, values, rows, _ = forest
    conditions = treeshap.tree_paths(treeshap.node_counts(rows, nodes, FEATURES))
    behind = rows.where("id < 9").selectExpr("*", "cast(1 + id % 3 as int) AS n")
    repeated = behind.selectExpr("*", "explode(sequence(1, n)) AS k")
    one, two = (sorted(map(tuple, treeshap.tree_shap(rows, b, conditions, values, "id", FEATURES, w).collect())) for b, w in ((behind, "n"), (repeated, None)))
    assert np.allclose(one, two)


def test_tree_shap_paths(spark, forest):
    """Against the mean over all coalitions, each a walk down the tree."""
    trees, nodes, values, rows, _ = forest
    counted = treeshap.node_counts(rows, nodes, FEATURES)
    n = {(r.tree, r.node): r.n for r in counted.collect()}
    data = {r.id: r.asDict() for r in rows.collect()}
    for (t, k), c in n.items():
        held = sum(all((row[trees[t][k >> up][0]] <= trees[t][k >> up][1]) == (k >> (up - 1) & 1 == 0) for up in range(1, k.bit_length())) for row in data.values())
        assert c == held

    def walk(t, row, own, node=1):
        attr, edge, value = trees[t][node]
        if attr is None:
            return value
        low, high = walk(t, row, own, 2 * node), walk(t, row, own, 2 * node + 1)
        if attr in own:
            return low if row[attr] <= edge else high
        return (n[t, 2 * node] * low + n[t, 2 * node + 1] * high) / n[t, node] if n[t, node] else 0.0

    worth = lambda row, own: sum(walk(t, row, own) for t in range(len(trees)))
    for r in treeshap.tree_shap_paths(rows, treeshap.tree_paths(counted), values, "id", FEATURES).collect():
        row = data[r.id]
        assert abs(r.base - worth(row, ())) < 1e-9
        for f in FEATURES:
            rest = [x for x in FEATURES if x != f]
            phi = sum(math.factorial(k) * math.factorial(2 - k) / 6 * (worth(row, (*s, f)) - worth(row, s)) for k in range(3) for s in itertools.combinations(rest, k))
            assert abs(r[f"phi_{f}"] - phi) < 1e-9


def test_nulls_follow_their_branch(spark):
    nodes = spark.createDataFrame([(0, 1, "a", 5.0, True), (0, 2, None, None, None), (0, 3, "b", 5.0, False), (0, 6, None, None, None), (0, 7, None, None, None)], "tree int, node long, attr string, edge double, null_left boolean")
    values = spark.createDataFrame([(0, 2, 1.0), (0, 6, 2.0), (0, 7, 4.0)], "tree int, rule_id long, value double")
    rows = spark.createDataFrame([(1, None, 9.0), (2, 9.0, None), (3, 9.0, 1.0)], "id long, a double, b double")
    paths = treeshap.tree_paths(treeshap.node_counts(rows, nodes, ["a", "b"]))
    got = {r.id: r for r in treeshap.tree_shap(rows, rows.where("id = 3"), paths, values, "id", ["a", "b"]).collect()}
    assert [tuple(got[i])[1:] for i in (1, 2, 3)] == [(2.0, -2.0, 1.0), (2.0, 0.0, 2.0), (2.0, 0.0, 0.0)]


def test_tree_shap_edges(spark, forest):
    _, nodes, values, rows, _ = forest
    paths = treeshap.tree_paths(treeshap.node_counts(rows, nodes, FEATURES))
    assert treeshap.tree_shap(rows.limit(0), rows, paths, values, "id", FEATURES).isEmpty()
    assert all(r.base is None for r in treeshap.tree_shap(rows, rows.limit(0), paths, values, "id", FEATURES).collect())
    with pytest.raises(ValueError, match="isn't among"):
        treeshap.tree_shap(rows, rows, paths, values, "id", ["a"])
    with pytest.raises(ValueError, match="coalitions"):
        shapley.mask_table(spark, 40)


def linked(d, n):
    """One merge at a time: (height, left, right, size)."""
    clusters, out = {i: (i, [i]) for i in range(n)}, []
    while len(clusters) > 1:
        height, a, b = min((max(d[min(i, j), max(i, j)] for i in clusters[x][1] for j in clusters[y][1]), x, y) for x, y in itertools.combinations(sorted(clusters), 2))
        ends = sorted((clusters[a][0], clusters[b][0]))
        out.append((len(out), n + len(out), *ends, height, len(clusters[a][1] + clusters[b][1])))
        clusters[a] = (n + len(out) - 1, clusters[a][1] + clusters.pop(b)[1])
    return out


@pytest.mark.parametrize(("n", "top"), [(17, 6), (12, 1000), (2, 3)])
def test_complete_linkage(spark, n, top):
    rng = np.random.default_rng(n)
    d = {(i, j): float(rng.integers(0, top)) for i, j in itertools.combinations(range(n), 2)}
    table = spark.createDataFrame([(*((i, j) if rng.random() < 0.5 else (j, i)), x) for (i, j), x in d.items()], "i long, j long, d double")
    merges = hierarchy.complete_linkage(table)
    assert sorted(map(tuple, merges.collect())) == linked(d, n)
    near = lambda i, j: d[min(i, j), max(i, j)]
    order = {i: [i] for i in range(n)}
    for _, node, left, right, _, _ in linked(d, n):
        a, b = order[left], order[right]
        ways = [(near(a[-1], b[0]), 0, a + b), (near(a[0], b[-1]), 1, b + a), (near(a[0], b[0]), 2, a[::-1] + b), (near(a[-1], b[-1]), 3, a + b[::-1])]
        order[node] = min(ways)[2]
    assert [r["item"] for r in hierarchy.leaf_order(merges, table).orderBy("place").collect()] == order[2 * n - 2]


def test_linkage_edges(spark):
    none = spark.createDataFrame([], "i long, j long, d double")
    assert hierarchy.complete_linkage(none).isEmpty()
    for rows in ([(0, 1, 1.0), (1, 2, 2.0)], [(0, 1, None)], [(0, 1, float("nan"))]):
        with pytest.raises(ValueError, match="needs a distance"):
            hierarchy.complete_linkage(spark.createDataFrame(rows, "i long, j long, d double"))


MODEL = "a * b + 2 * c - b * c * d + abs(a - e) + e"
NAMES = list("abcde")


def owen(f, tree, p, root):
    """Each half of each node, with and without the other half, in every context of the node."""
    kids = {n: (x, y) for n, x, y in tree}
    inside = lambda n: {n} if n < p else inside(kids[n][0]) | inside(kids[n][1])
    contexts, phi = {root: [frozenset()]}, [0.0] * p
    for n in sorted(kids, reverse=True):
        for own, other in (kids[n], kids[n][::-1]):
            contexts[own] = [c for o in contexts[n] for c in (o, o | inside(other))]
    for i in range(p):
        phi[i] = float(np.mean([f(c | {i}) - f(c) for c in contexts[i]]))
    return phi


@pytest.fixture(scope="module")
def owned(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, *rng.normal(size=5).round(3).tolist()) for i in range(8)], "id long, a double, b double, c double, d double, e double")
    return rows, rows.where("id in (1, 4, 6)").selectExpr("*", "cast(id as double) AS n")


@pytest.mark.parametrize("tree", [[(5, 0, 1), (6, 2, 3), (7, 5, 6), (8, 4, 7)], [(5, 0, 4), (6, 5, 2), (7, 6, 1), (8, 7, 3)]])
def test_owen_values(spark, owned, tree):
    rows, behind = owned
    merges = spark.createDataFrame(tree, "node long, left long, right long")
    got = {r.id: r for r in hierarchy.owen_values(rows, behind, "id", NAMES, MODEL, merges, weight="n").collect()}
    own, back = ({r.id: r.asDict() for r in t.collect()} for t in (rows, behind))
    total = sum(b["n"] for b in back.values())
    for i, x in own.items():
        f = lambda s: sum(b["n"] * eval(MODEL, {"abs": abs}, {v: (x if k in s else b)[v] for k, v in enumerate(NAMES)}) for b in back.values()) / total  # noqa: B023, E731
        assert np.allclose([got[i][f"phi_{v}"] for v in NAMES], owen(f, tree, 5, 8))


def test_owen_of_two_features_is_exact(spark, owned):
    rows, behind = owned
    merges = spark.createDataFrame([(2, 0, 1)], "node long, left long, right long")
    got, wanted = (sorted(map(tuple, t.collect())) for t in (hierarchy.owen_values(rows, behind, "id", ["a", "b"], "a * b + a", merges), shapley.shap_exact(rows, behind, "id", ["a", "b"], "a * b + a")))
    assert np.allclose(got, wanted)


def test_owen_tolerance_closes_branches(spark, owned):
    """Without interactions one context is enough, and less is scored; over the hierarchy that linkage finds."""
    rows, behind = owned
    d = spark.createDataFrame([(i, j, float(abs(i - j) + i)) for i, j in itertools.combinations(range(5), 2)], "i long, j long, d double")
    merges = hierarchy.complete_linkage(d)
    seen = spark.sparkContext.accumulator(0)

    def counting(batch):
        seen.add(len(batch))
        return batch.a + 2 * batch.b - batch.c + 3 * batch.d + batch.e

    results = []
    for tolerance in (-1.0, 1e-9):
        before = seen.value
        results.append((sorted(map(tuple, hierarchy.owen_values(rows, behind, "id", NAMES, counting, merges, tolerance).collect())), seen.value - before))
    assert np.allclose(results[0][0], results[1][0]) and results[1][1] < results[0][1]


def test_owen_edges(spark, owned):
    rows, behind = owned
    one = spark.createDataFrame([], "node long, left long, right long")
    assert len(hierarchy.owen_values(rows, behind, "id", ["a"], "a + 1", one).collect()) == 8
    with pytest.raises(ValueError, match="every feature"):
        hierarchy.owen_values(rows, behind, "id", NAMES, MODEL, spark.createDataFrame([(5, 0, 1)], "node long, left long, right long"))
    with pytest.raises(ValueError, match="at most"):
        hierarchy.owen_values(rows, behind, "id", NAMES * 20, MODEL, one)
