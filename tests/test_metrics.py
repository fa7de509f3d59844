"""Metric arithmetic against published values and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.stats import t_test_p
from lectern.operators import compare, fusion, metrics

HITS = "run_id long, method string, query_id string, query string, latency_ms double, rank int, id string, reference string, grade int"


def hits(spark, runs):
    rows = []
    for i, (method, query, grades) in enumerate(runs):
        rows += [(i, method, query, query, 10.0 * (i + 1), r + 1, f"d{r}", f"R{r}", g) for r, g in enumerate(grades)] or [(i, method, query, query, 10.0 * (i + 1), None, None, None, None)]
    return spark.createDataFrame(rows, HITS)


def test_known_list(spark):
    m = metrics.per_query(hits(spark, [("m", "q", [3, 2, 1, 3, 0, 2, 1, 0, 0, 1])])).first()
    for k, p, n in ((1, 1.0, 1.0), (3, 0.666667, 0.727193), (5, 0.6, 0.850099), (10, 0.4, 0.922382)):
        assert m[f"p_{k}"] == pytest.approx(p, abs=1e-6)
        assert m[f"ndcg_{k}"] == pytest.approx(n, abs=1e-6)
    assert m["rr"] == 1.0
    assert (m["num_relevant"], m["num_retrieved"]) == (4, 10)


def test_short_zero_and_empty_lists(spark):
    got = {r["query_id"]: r for r in metrics.per_query(hits(spark, [("m", "short", [0, 3]), ("m", "zero", [0, 0, 0]), ("m", "empty", [])])).collect()}
    assert got["short"]["p_3"] is None
    assert got["short"]["rr"] == 0.5
    assert (got["zero"]["ndcg_3"], got["zero"]["rr"]) == (0.0, 0.0)
    assert (got["empty"]["num_retrieved"], got["empty"]["avg_relevance"], got["empty"]["p_1"]) == (0, 0.0, None)


def test_aggregate_counts_short_lists_as_zero(spark):
    a = metrics.aggregate(metrics.per_query(hits(spark, [("m", "a", [3, 3, 3]), ("m", "b", [3])]))).first()
    assert a["mean_p_3"] == 0.5
    assert a["mean_p_5"] is None
    assert a["std_latency_ms"] == 5.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_bounds(spark, grades):
    m = metrics.per_query(hits(spark, [("m", "q", grades)])).first()
    for k in metrics.KS:
        if len(grades) >= k:
            assert 0 <= m[f"ndcg_{k}"] <= 1 + 1e-12
            assert m[f"p_{k}"] * k == pytest.approx(round(m[f"p_{k}"] * k))


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id string, source string, rank int, reference string, id string")


def test_published_fusion_scores(spark):
    pairs = [(1, 2), (4, 1), (3, 3), (2, 4), (6, 5)]
    rows = [("q", "sparse", s, f"r{i}", f"s{i}") for i, (s, _) in enumerate(pairs)] + [("q", "dense", d, f"r{i}", f"d{i}") for i, (_, d) in enumerate(pairs)]
    got = {r["reference"]: r for r in fusion.fuse(lists(spark, rows), {"sparse": 1.0, "dense": 1.2}).collect()}
    assert [round(got[f"r{i}"]["rrf_score"], 4) for i in range(5)] == [0.0357, 0.0353, 0.0349, 0.0349, 0.0336]
    assert [got[f"r{i}"]["rank"] for i in range(5)] == [1, 2, 3, 4, 5]
    assert got["r0"]["id"] == "s0"  # the payload of the first list
    assert got["r0"]["in_both"]


def test_fusion_repeats_and_ties(spark):
    rows = [("q", "sparse", 1, "twice", "a"), ("q", "sparse", 2, "twice", "b"), ("q", "sparse", 3, "x", "x"), ("q", "dense", 5, None, "n")]
    got = {r["reference"]: r for r in fusion.fuse(lists(spark, rows), {"sparse": 1.0, "dense": 1.0}).collect()}
    assert got["twice"]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62)
    assert got["twice"]["source_ranks"] == {"sparse": 2}
    assert not got["twice"]["in_both"]
    tie = fusion.fuse(lists(spark, [("q", "dense", 1, "d", "1"), ("q", "sparse", 1, "s", "2")]), {"sparse": 1.0, "dense": 1.0}).orderBy("rank").collect()
    assert [r["reference"] for r in tie] == ["s", "d"]


def values(spark, rows):
    return spark.createDataFrame(rows, "method string, query_id string, metric string, value double")


def test_paired_tests_without_variance_or_pairs(spark):
    rows = [("a", "1", "m", 1.0), ("b", "1", "m", 2.0), ("a", "1", "c", 1.0), ("a", "2", "c", 2.0), ("b", "1", "c", 2.0), ("b", "2", "c", 3.0), ("a", "1", "z", 0.0), ("b", "1", "z", 1.0)]
    got = {r["metric"]: r for r in compare.paired_tests(values(spark, rows), (("a", "b"), ("a", "none"))).collect()}
    assert got["m"]["p_value"] is None
    assert not got["m"]["significant"]
    assert got["c"]["p_value"] is None
    assert got["z"]["improvement_pct"] == 0.0
    assert len(got) == 3


def test_p_value_against_the_jvm(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    cases = [(t, n) for t in (0.0, 0.3, 1.7, 4.2, -2.5) for n in (1, 2, 3, 4, 9, 30, 149)]
    got = spark.createDataFrame([(t, n) for t, n in cases], "t double, n long").select("t", "n", t_test_p(F.col("t"), F.col("n")).alias("p")).collect()
    for r in got:
        want = 2 * (1 - dist(float(r["n"])).cumulativeProbability(abs(r["t"])))
        assert math.isclose(r["p"], want, abs_tol=1e-9)


def test_overlap_divides_by_k(spark):
    rows = [("q", "base", i, f"r{i}") for i in range(1, 5)] + [("q", "m", 1, "r1"), ("q", "m", 2, "zz")]
    got = compare.overlap(spark.createDataFrame(rows, "query_id string, method string, rank int, reference string"), "base").first()
    assert got["overlap"] == 0.1
