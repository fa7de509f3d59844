"""The registered rerankers keep the depths of the methods they stand for: a hit far down the first pass can come out first."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.plans import catalog

HIT = "array<struct<rank:int,id:string,score:double,text:string,reference:string>>"


@pytest.fixture
def tables(spark, tmp_path):
    """One query; write(method=n, ...) stores a list of n hits for each method, of which only the last has the query's words."""

    def write(**lengths):
        runs = []
        for i, (method, n) in enumerate(lengths.items()):
            hits = [(k, f"{method}{k}", 1.0 / k, "the lamp" if k == n else "bread", f"{method} {k}") for k in range(1, n + 1)]
            runs.append((i, "F1", "the lamp", method, hits, datetime.datetime(2025, 1, 1)))
        spark.createDataFrame(runs, f"result_id long, query_id string, query string, method string, documents {HIT}, run_at timestamp").write.parquet(f"{tmp_path}/retrieval_results.parquet")
        return str(tmp_path)

    return write


def test_rerank_topn_scores_150_and_keeps_20(spark, tables):
    got = catalog.queries()["rerank_topn"](spark, tables(contextual=150)).orderBy("rank").collect()
    assert [r["original_rank"] for r in got] == [150, *range(1, 20)]


def test_hybrid_rerank_scores_50_and_keeps_20(spark, tables):
    got = catalog.queries()["hybrid_rerank"](spark, tables(sparse=30, dense=19)).orderBy("rank").collect()
    # of the 49 fused references the words are in each list's last, both of them below place 15
    assert len(got) == 20
    assert {r["reference"] for r in got[:2]} == {"sparse 30", "dense 19"}
    assert max(r["original_rank"] for r in got) > 15


def test_evaluation_run_covers_methods_pairs_and_depth(spark, tmp_path, monkeypatch):
    day = datetime.datetime(2025, 1, 1)
    # the queries' words stand in two passages of 25 only, so lists are full at 20 and the rerankers have something to do
    texts = ["the lamp of the tower" if i in (7, 19) else f"bread {i} the" for i in range(25)]
    spark.createDataFrame([(f"B 1:{i}", t, f"about {t}", "V", "B", 1, i, day) for i, t in enumerate(texts)], "reference string, text string, context string, volume string, book string, chapter int, verse int, loaded_at timestamp").write.parquet(f"{tmp_path}/passages.parquet")
    spark.createDataFrame([("F1", "the lamp", "factual", day), ("T2", "the tower", "thematic", day)], "id string, query string, type string, added_at timestamp").write.parquet(f"{tmp_path}/test_queries.parquet")
    kept, evaluate = [], catalog.evaluation.evaluate
    monkeypatch.setattr(catalog.evaluation, "evaluate", lambda *a, **k: kept.append(evaluate(*a, **k)) or kept[-1])
    got = catalog.queries()["evaluation_run"](spark, str(tmp_path)).collect()
    assert {(r["method_a"], r["method_b"]) for r in got} == set(catalog.compare.PAIRS)
    depth = {r["method"]: r["d"] for r in kept[0].hits.groupBy("method").agg(F.max("rank").alias("d")).collect()}
    assert depth == dict.fromkeys(("legacy", "contextual", "contextual_rerank", "hybrid_rrf", "hybrid_rerank"), 20)
    assert all(r["mean_p_20"] is not None for r in kept[0].methods.collect())
