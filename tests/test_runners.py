"""Every command writes what it should, and what was written reads back."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import report, training
from lectern.plans import evaluation, runners
from lectern.plans.methods import Retrieval
from lectern.sources import providers, readers, runs, storage
from lectern.streaming.ingest import VersionedIndex

PASSAGE = "reference string, volume string, book string, chapter int, verse int, text string, context string"
TEXTS = ["the keeper lit the tower", "bread was shared at the river", "weavers sang of rain", "the tower fell at night", "rain on the tower", "an oath was sworn at the well"]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    spark.createDataFrame([(f"B 1:{i}", "V", "B", 1, i, t, f"about {t}") for i, t in enumerate(TEXTS)], PASSAGE).write.parquet(f"{root}/passages")
    (root / "queries.json").write_text(json.dumps({"queries": [{"id": i, "query": q, "type": t} for i, q, t in (("F1", "who lit the tower", "factual"), ("T2", "rain and weavers", "thematic"), ("X3", "sworn at the well", "cross-reference"))]}))
    (root / "config.json").write_text(json.dumps({"top_k": 3, "metrics": {"precision_k_values": [1, 3], "ndcg_k_values": [3]}}))
    return str(root)


def test_evaluate_report_train_and_use_the_model(spark, files):
    said = []
    stamp = runners.training_data(spark, f"{files}/passages", f"{files}/queries.json", f"{files}/training", count=5, k=4, now=datetime(2025, 1, 1))
    assert stamp == "20250101_000000"
    assert json.loads(storage.read_text(f"{files}/training/training_stats_{stamp}.json"))["unique_queries"] == 5
    assert runners.train(spark, f"{files}/training", f"{files}/model").endswith(f"dataset_{stamp}")
    path = runners.evaluate(spark, f"{files}/passages", f"{files}/queries.json", f"{files}/runs", f"{files}/config.json", f"{files}/model", said.append)
    assert runs.latest_run(f"{files}/runs") == path
    got = runs.read_run(spark, path)
    assert {r["method"] for r in got["metrics"].collect()} == {*runners.SHORT, "contextual_custom_rerank"}
    assert any(line.startswith("legacy: MRR") for line in said)
    text = storage.read_text(runners.write_report(spark, f"{files}/runs", now=datetime(2025, 1, 2)))
    for part in ("# Retrieval comparison run_", "Made 2025-01-02 00:00:00; 3 queries.", "| MRR |", "### legacy -> contextual", "- Latency:", "## Kinds of queries", "- **factual** (1 queries)", "### hybrid_rrf: lowest relevance", "- **F1**"):
        assert part in text
    assert "| Precision@10 | - |" in text


def test_missing_runs_and_models(spark, files, tmp_path):
    with pytest.raises(FileNotFoundError):
        runners.write_report(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        runners.train(spark, str(tmp_path), str(tmp_path / "m"))
    asked = readers.query_set(spark, f"{files}/queries.json").select(F.col("id").alias("query_id"), "query")
    assert runners._retrieval(spark, f"{files}/passages", asked, str(tmp_path / "none")).custom is None


def test_quick_comparison_and_search(spark, files, tmp_path):
    said = []
    runners.quick(spark, f"{files}/passages", str(tmp_path / "quick"), k=3, say=said.append)
    assert {line.split()[0] for line in said} == set(readers.SHOWN)
    summary = spark.read.json(f"{tmp_path}/quick/summary").collect()
    assert {r["method"] for r in summary} == set(runners.SHORT)
    assert spark.read.json(f"{tmp_path}/quick/queries").select("query_id").distinct().count() == 11
    out = []
    assert runners.search(spark, f"{files}/passages", ["who lit the tower", "", "rain weavers", "quit"], 2, out.append) == 2
    assert out[0].startswith("1. B 1:0 (")
    assert len(out) == 4


def test_commands(spark, files, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(runners, "session", lambda: spark)
    assert runners.main(["index", f"{files}/passages", str(tmp_path / "ix"), "--dry-run"]) == 0
    assert "4. index: would run" in capsys.readouterr().out
    assert not storage.exists(str(tmp_path / "ix"))
    assert runners.main(["index", f"{files}/passages", str(tmp_path / "ix")]) == 0
    assert spark.read.parquet(f"{tmp_path}/ix/index").count() == len(TEXTS)
    with pytest.raises(SystemExit):
        runners.main(["nothing"])


def test_batched_scorer_loads_once_a_task_and_tries_again(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write("load\n")
        failed = []

        def model(pairs):
            if not failed:
                failed.append(1)
                raise OSError("busy")
            with open(log, "a") as f:
                f.write(f"{len(pairs)}\n")
            return [float(len(t)) for _, t in pairs]

        return model

    score = providers.batched_scorer(load, batch=3, least=0.0)
    df = spark.createDataFrame([(i, "q", "x" * i if i else None) for i in range(8)], "i int, q string, t string").coalesce(1)
    assert [s for _, s in sorted(tuple(r) for r in df.select("i", score(F.col("q"), F.col("t")).alias("s")).collect())] == [float(i) for i in range(8)]
    lines = open(log).read().split()
    assert lines.count("load") == 1
    assert max(int(x) for x in lines if x != "load") == 3


def test_model_scorer_equals_prediction(spark):
    rows = spark.createDataFrame([("gate tower", "the gate and the tower", 1.0), ("gate tower", "bread river", 0.0), ("gate", "", 0.2), ("", "x", 0.0)] * 10, "query string, document string, label double")
    model = training.fit_reranker(rows)
    both = training.predict(model, rows).withColumn("s", training.model_scorer(model)(F.col("query"), F.col("document"))).collect()
    assert all(abs(r["s"] - r["prediction_score"]) < 1e-9 for r in both)


def test_held_out_accuracy_of_the_reranker(spark):
    words = ["gate", "tower", "river", "bread", "rain", "oath", "well", "horn"]
    rows = [(f"{words[i % 8]} {words[(i * 3 + 1) % 8]}", " ".join(words[(i * j + j) % 8] for j in range(1, 4))) for i in range(400)]
    df = spark.createDataFrame([(q, d, 1.0 if set(q.split()) & set(d.split()) else 0.0) for q, d in rows], "query string, document string, label double")
    marked = df.withColumn("h", F.pmod(F.xxhash64("query", "document"), F.lit(5)))
    got = training.predict(training.fit_reranker(marked.where("h > 0").drop("h")), marked.where("h = 0")).toPandas()
    assert ((got.prediction_score > 0.5) == (got.label > 0.5)).mean() > 0.95


def test_queries_until_the_count(spark):
    answers = []

    def few(prompts):
        answers.append(len(prompts))
        return ['noise [{"query": "a", "type": "t"}, {"query": "b", "type": "t"}] end' for _ in prompts]

    assert providers.generate_queries(spark, few, 7, batch=50).count() == 7
    assert providers.generate_queries(spark, lambda p: ["nothing" for _ in p], 3, rounds=2).count() == 0
    assert providers.generate_queries(spark, few, 0).count() == 0


def test_answers(spark):
    hits = spark.createDataFrame([("q1", 1, "R 1", "one"), ("q1", 3, "R 3", "three"), ("q1", 2, "R 2", None)], "query_id string, rank int, reference string, text string")
    asked = spark.createDataFrame([("q1", "what"), ("q2", None)], "query_id string, query string")
    got = {r["query_id"]: r["answer"] for r in providers.answer_with(hits, asked, lambda p: p, 2).collect()}
    assert "[R 1]: one\n\n[R 2]: " in got["q1"]
    assert "R 3" not in got["q1"]
    assert got["q2"].startswith("Query: \n")


def test_stream_versions_survive_and_old_ones_go(spark, tmp_path):
    ix = VersionedIndex(spark, str(tmp_path / "ix"), "id string, text string, at long", "at", buckets=2)
    assert ix.read().count() == 0
    for n in range(5):
        ix.apply(spark.createDataFrame([("a", str(n), n), (f"b{n}", "x", n)], "id string, text string, at long"))
    assert {(r["id"], r["text"]) for r in ix.read().collect()} == {("a", "4"), *((f"b{n}", "x") for n in range(5))}
    names = [e.name for e in storage.entries(str(tmp_path / "ix"))]
    assert [n for n in names if n.startswith("pointer-")] == ["pointer-000000000004", "pointer-000000000005"]
    ix.apply(spark.createDataFrame([], "id string, text string, at long"))
    assert ix.read().count() == 6
    # an unfinished version isn't read
    storage.write_text(str(tmp_path / "ix" / "next-x"), "0\tnowhere")
    assert ix.read().count() == 6
    assert not storage.rename(str(tmp_path / "ix" / "next-x"), str(tmp_path / "ix" / "pointer-000000000005"))


def test_signed_lines_leave_out_what_has_no_base(spark):
    m = spark.createDataFrame([("legacy", 0.5, 0.0, 1.0, 2.0, 10.0), ("contextual", 0.6, 1.0, 0.5, 2.0, 7.5)], "method string, mrr double, mean_avg_relevance double, mean_p_5 double, mean_ndcg_10 double, mean_latency_ms double")
    lines = [r["line"] for r in report.improvement_lines(m).orderBy("row").collect()]
    assert lines == ["- MRR: 0.500 -> 0.600 (+20.0%)", "- Precision@5: 1.000 -> 0.500 (-50.0%)", "- NDCG@10: 2.000 -> 2.000 (+0.0%)", "- Latency: 10.0 ms -> 7.5 ms (-2.5 ms)"]


def test_word_jaccard_and_custom_in_all(spark):
    assert providers.word_jaccard([("a b", "b c"), ("", ""), ("?", "x")]) == [pytest.approx(1 / 3), 0.0, 0.0]
    p = spark.createDataFrame([(f"p{i}", t, t, f"R {i}", "V") for i, t in enumerate(TEXTS)], "id string, text string, context string, reference string, volume string")
    r = Retrieval(p, spark.createDataFrame([("q", "rain tower")], "query_id string, query string"), custom=providers.batched_scorer(lambda: providers.word_jaccard))
    best = r.retrieve_all(3, hybrid=False).where("method = 'contextual_custom_rerank' and rank = 1").first()
    assert best["id"] == "p4"


def test_judged_pairs_with_nulls_are_told_apart(spark):
    from lectern.operators import judge

    pairs = spark.createDataFrame([(1, None, "x"), (2, "x", None), (3, "", "x"), (4, None, None)], "i int, query string, text string")
    seen = judge.judge_pairs(pairs, lambda q, t: F.to_json(F.struct(F.lit(1).alias("score"), F.concat(F.coalesce(q, F.lit("-")), F.lit("|"), F.coalesce(t, F.lit("-"))).alias("reasoning"))))
    assert {r["i"]: r["reasoning"] for r in seen.collect()} == {1: "-|x", 2: "x|-", 3: "|x", 4: "-|-"}


def test_entries_of_a_missing_folder(spark, tmp_path):
    assert storage.entries(str(tmp_path / "no")) == []
    assert runs.latest_run(str(tmp_path / "no")) is None
    assert runs.latest_training_set(str(tmp_path / "no")) is None
    assert isinstance(evaluation.load_reranker(None), type(None))
