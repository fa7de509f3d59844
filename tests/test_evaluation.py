"""Evaluation, quick comparison, training sets and writers, end to end on a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import rerank
from lectern.plans import evaluation
from lectern.plans.methods import Retrieval
from lectern.sources import providers, readers, runs


@pytest.fixture(scope="module")
def retrieval(spark):
    texts = ["the keeper lit the tower", "bread at the river", "weavers sang of rain", "the tower fell", "rain on the tower"]
    p = spark.createDataFrame([(f"p{i}", t, f"about {t}", f"R {i}", "V") for i, t in enumerate(texts)], "id string, text string, context string, reference string, volume string")
    return Retrieval(p, spark.createDataFrame([("F1", "who lit the tower"), ("T2", "rain and weavers"), ("X3", "zzz")], "query_id string, query string"))


def test_evaluate_and_write(spark, retrieval, tmp_path):
    asked = retrieval.queries
    hits, lat = evaluation.timed({"legacy": lambda: retrieval.legacy(3), "contextual": lambda: retrieval.contextual(3), "sparse": lambda: retrieval.sparse(3)}, asked)
    e = evaluation.evaluate(hits, asked, config=readers.RunConfig(top_k=3, precision_k_values=(1, 5), ndcg_k_values=(1, 10)), latencies=lat, pairs=(("legacy", "contextual"), ("legacy", "gone")))
    rows = {(r["method"], r["query_id"]): r for r in e.queries.collect()}
    assert len(rows) == 9
    assert rows["sparse", "X3"]["num_retrieved"] == 0
    assert rows["contextual", "F1"]["rr"] > 0
    assert {r["num_queries"] for r in e.methods.collect()} == {3}
    assert e.comparisons.select("method_b").distinct().count() == 1
    e.write(str(tmp_path / "run"))
    assert set(runs.read_run(spark, str(tmp_path / "run"))) == {"raw", "judgments", "metrics", "comparisons"}
    q = {r["method"]: r for r in evaluation.quick_comparison(hits, lat, "contextual", 3).collect()}
    assert q["contextual"]["mean_overlap"] is None
    assert 0 <= q["sparse"]["mean_overlap"] <= 1
    assert evaluation.top_lines(hits, 1).where("method = 'contextual' and query_id = 'F1'").first()["lines"][0].startswith("R 0 (")


def test_training_set(spark, retrieval):
    asked = retrieval.queries.withColumn("type", F.lit("cross-reference"))
    t = evaluation.build_training_set(retrieval, asked, 4)
    assert t.count() == t.select("example_id").distinct().count() > 0
    assert t.select("query_type").distinct().first()["query_type"] == "cross_reference"
    assert {round(r["label"] * 3) for r in t.collect()} <= {0, 1, 2, 3}


def test_writers(spark):
    docs = [("r", "text " * 100)]
    rows = spark.createDataFrame([("q1", "query", "answer", docs)], "query_id string, query string, response string, documents array<struct<reference:string,text:string>>")
    got = evaluation.judge_responses(rows, lambda prompts: [json.dumps({"overall": 2, "notes": str(len(p) > 0)}) for p in prompts]).first()
    assert (got["overall"], got["completeness"], got["notes"]) == (2, 0, "True")
    p = spark.createDataFrame([("V", "B", 1, 1, "B 1:1", "t"), ("V", "B", 1, 2, "B 1:2", "u")], "volume string, book string, chapter int, verse int, reference string, text string")
    assert evaluation.summarize_with(p, lambda prompts: ["Verses: 2" if "Verses: 2" in x else "?" for x in prompts]).first()["summary"] == "Verses: 2"


def test_custom_reranker_and_models(spark, retrieval, tmp_path):
    r = Retrieval(retrieval.passages, retrieval.queries, custom=lambda q, t: -F.length(t).cast("double"))
    best = r.contextual_custom_rerank(5, 1).where("query_id = 'F1'").first()
    assert (best["id"], best["original_rank"] > 0) == ("p3", True)
    assert "contextual_custom_rerank" in {x["method"] for x in r.retrieve_all(2, hybrid=False).select("method").distinct().collect()}
    assert evaluation.load_reranker(str(tmp_path / "none")) is None
    assert evaluation.load_reranker(None) is None
    assert rerank.rerank(r.contextual(1).limit(0), 3).count() == 0


def test_extractive_answer_and_queries(spark, retrieval):
    a = providers.extractive_answer(retrieval.contextual(5), 2).where("query_id = 'F1'").first()["answer"]
    assert a.count("[R ") == 2
    assert providers.topic_queries(retrieval.passages.withColumn("reference", F.col("id")), 3).count() == 3
