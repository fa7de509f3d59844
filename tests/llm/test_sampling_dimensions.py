"""Three and more dimensions: minimums, correlated dimensions, and margins against exhaustive search."""

import itertools

import pytest

from lectern.llm import sampling

TARGETS = "target_set long, sample_fraction double, dimension string, category string, target_share double, min_rows long"


@pytest.mark.parametrize("dims", [["a", "b"], ["a", "b", "c"]])
def test_minimum_of_a_small_category_in_any_dimension(spark, dims):
    rows = [(f"r{i}", str(i % 4), "rare" if i % 33 == 0 else "usual", str(i % 3)) for i in range(4000)]
    t = [(1, 0.1, "a", str(v), 0.25, 10) for v in range(4)] + [(1, 0.1, "b", "rare", 0.02, 60), (1, 0.1, "b", "usual", 0.98, 0)] + [(1, 0.1, "c", str(v), 1 / 3, 10) for v in range(3)]
    t = [x for x in t if x[2] in dims]
    s = sampling.TargetSample(spark.createDataFrame(rows, "row_id string, a string, b string, c string"), spark.createDataFrame(t, TARGETS), "row_id", dims)
    rep = {(r["dimension"], r["category"]): r for r in s.report().collect()}
    assert rep["b", "rare"]["available"] == 122
    assert rep["b", "rare"]["drawn"] == 60
    assert all(r["minimum_met"] for r in rep.values())
    assert s.sample().count() == rep["b", "rare"]["sample_rows"]


def test_minimum_in_the_third_dimension():
    cells = {(a, b, c): 100 if c == "usual" else 4 for a in "xy" for b in "pqr" for c in ("usual", "rare")}
    q = sampling.quotas(cells, {"x": (60, 0), "y": (40, 0)}, {"p": (40, 0), "q": (30, 0), "r": (30, 0)}, {"usual": (90, 0), "rare": (20, 20)})
    assert sum(n for c, n in q.items() if c[2] == "rare") == 20
    assert sum(q.values()) == 100
    assert all(n <= cells[c] for c, n in q.items())


def test_correlated_dimensions_are_drawn_in_full():
    cells = {("a", "p", "u"): 100, ("b", "q", "v"): 100}
    q = sampling.quotas(cells, {"a": (50, 0), "b": (50, 0)}, {"p": (50, 0), "q": (50, 0)}, {"u": (50, 0), "v": (50, 0)})
    assert q == {("a", "p", "u"): 50, ("b", "q", "v"): 50}


def test_against_exhaustive_search():
    keys = [("a", "p", "u"), ("a", "p", "v"), ("a", "q", "u"), ("b", "p", "v"), ("b", "q", "u"), ("b", "q", "v")]
    goals = [{"a": (3, 0), "b": (3, 1)}, {"p": (2, 0), "q": (4, 0)}, {"u": (4, 2), "v": (2, 1)}]
    for sizes in itertools.product((0, 2, 4), repeat=6):
        cells = dict(zip(keys, sizes, strict=True))
        got = sampling.quotas(cells, *goals)
        assert all(n <= cells[c] for c, n in got.items())
        for d, g in enumerate(goals):
            assert all(sum(n for c, n in got.items() if c[d] == k) <= t for k, (t, _) in g.items())
    cells = dict.fromkeys(keys, 2)
    best = min(sampling._lacking(dict(zip(keys, x, strict=True)), goals) for x in itertools.product(range(3), repeat=6) if all(sum(n for c, n in zip(keys, x, strict=True) if c[d] == k) <= t for d, g in enumerate(goals) for k, (t, _) in g.items()))
    assert sampling._lacking(sampling.quotas(cells, *goals), goals) == best


def test_four_dimensions(spark):
    rows = spark.createDataFrame([(f"r{i}", *(str(i // 2**k % 2) for k in range(4))) for i in range(800)], "row_id string, a string, b string, c string, d string")
    t = [(7, 0.25, d, v, 0.7 if v == "0" else 0.3, 20) for d in "abcd" for v in "01"]
    s = sampling.TargetSample(rows, spark.createDataFrame(t, TARGETS), "row_id", list("abcd"))
    assert s.sample().count() == 200
    assert all(r["target_met"] for r in s.report().collect())
