"""Nearest rows where many rows stand at one place."""

import numpy as np

from rationale.operators import neighbours as E


def test_places_are_searched_once(spark, monkeypatch):
    """copies of rows and of instances add no distances, and the nearest are those of all rows."""
    rng = np.random.default_rng(3)
    places = [(float(a), float(b), str(y)) for a, b, y in zip(rng.integers(0, 6, 12), rng.integers(0, 6, 12), rng.choice(["p", "q", "q", "q"], 12), strict=True)]
    rows = [(i, *places[i % 12]) for i in range(12 * 40)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y string").repartition(5)
    tables, stored = [], E.stored
    monkeypatch.setattr(E, "stored", lambda x: tables.append(stored(x)) or tables[-1])
    found = E.closest_rows(df, df.where("k % 5 = 0"), "k", ["a", "b"], "y", 7, 0.5, block=50).collect()
    assert tables[0].count() <= 12 * 7 and tables[2].count() <= 12
    width = np.array([np.std([r[c] for r in rows]) for c in (1, 2)])
    x = np.array([r[1:3] for r in rows])
    for q in range(0, 480, 5):
        d = np.sqrt((((x - x[q]) / width) ** 2).sum(1)).round(9)
        order = sorted(range(480), key=lambda i: (d[i], i))
        best, rare = order[:7], [c for c in ("p", "q") if sum(rows[i][3] == c for i in order[:7]) < 3]
        if rare:
            best = order[:4] + [i for i in order if rows[i][3] == min(rare)][:3]
        assert sorted({r.k for r in found if r.instance_id == q}) == sorted(set(best))
