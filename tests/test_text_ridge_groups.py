"""Ridge fits on the masks of a text."""

from rationale.operators import linear as G


def test_words_are_coded_in_arrow(spark):
    """the masks of a text aren't turned into Python objects; a mask without a list keeps nothing."""
    rows = [(1, ["b", "a", "a"], 2.0, 1.0), (1, ["b"], 1.0, 1.0), (1, None, 0.0, 1.0), (1, [], 0.0, 1.0), (2, [], 1.0, 1.0)]
    found = G.text_ridge(spark.createDataFrame(rows, "d int, kept array<string>, y double, w double"), "d", "kept", "y", "w")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {r.word: r for r in found.collect()}
    assert set(got) == {"a", "b"} and {got[w]["rank"] for w in "ab"} == {1, 2} and all(r.d == 1 and r.weight > 0 for r in got.values())
