"""Corpus shapes, upserts, training sets, retrieval, pipeline and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, dense, index, judge, relational, report, sparse, training
from lectern.plans import pipeline
from lectern.plans.methods import Retrieval
from lectern.sources import providers, readers, runs
from lectern.streaming.ingest import VersionedIndex, stream_upserts

PASSAGE = "volume string, book string, chapter int, verse int, reference string, text string"
ROWS = [("V", "B", c, v, f"B {c}:{v}", f"verse {v} of chapter {c} tells about gates") for c in (1, 2, 10) for v in (1, 2, 10)]


def passages(spark, rows=ROWS):
    return spark.createDataFrame(rows, PASSAGE)


def test_nest_and_flatten_round_trip(spark):
    got = corpus.flatten(corpus.nest(passages(spark))).collect()
    assert sorted(tuple(r) for r in got) == sorted(ROWS)


def test_chapter_text_is_in_numeric_order(spark):
    body = corpus.chapter_texts(passages(spark)).where("chapter = 10").first()["body"]
    assert [line.split(".")[0] for line in body.split("\n")] == ["1", "2", "10"]


def test_map_format_skips_scalars_and_sorts_numbers(spark):
    raw = json.dumps({"last_modified": "x", "version": 2, "B": {"2": {"10": "t10", "2": "t2"}, "10": {"1": "u"}}})
    got = corpus.normalize_map(spark.createDataFrame([("V", raw)], "volume string, raw string"), "raw").orderBy("chapter", "verse").collect()
    assert [(r["reference"], r["text"]) for r in got] == [("B 2:2", "t2"), ("B 2:10", "t10"), ("B 10:1", "u")]


def test_sectioned_files_are_read_not_overwritten(spark, tmp_path):
    doc = {"sections": [{"section": 3, "reference": "S 3", "verses": [{"verse": 1, "reference": "S 3:1", "text": "t"}]}]}
    f = tmp_path / "s.json"
    f.write_text(json.dumps(doc))
    for _ in range(2):
        assert [r["reference"] for r in readers.sectioned(spark, str(f), "S").collect()] == ["S 3:1"]
    canonical = tmp_path / "c.json"
    canonical.write_text(json.dumps({"books": [{"book": "B", "chapters": [{"chapter": 1, "reference": "B 1", "verses": [{"verse": 1, "reference": "B 1:1", "text": "t"}]}]}]}))
    assert readers.sectioned(spark, str(canonical), "S").count() == 0
    assert readers.canonical(spark, str(canonical), "V").count() == 1


def test_missing_summary_gives_empty_context(spark):
    s = corpus.summarize(passages(spark).where("chapter <> 10"))
    got = {r["reference"]: r["context"] for r in corpus.with_context(passages(spark), s).collect()}
    assert "from the **V**. \"" in got["B 10:1"]
    assert "This chapter contains 3 verses" in got["B 1:1"]


def test_total_row(spark):
    got = {r["volume"]: r for r in corpus.volume_counts(passages(spark)).collect()}
    assert (got["Total"]["chapters"], got["Total"]["verses"], got["V"]["verses"]) == (3, 9, 9)


def test_batches_and_numbering(spark):
    df = spark.range(257).select(F.format_string("%05d", "id").alias("k"))
    got = relational.batches(df, ["k"]).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 100), (1, 100), (2, 57)]


def test_upsert_is_idempotent_and_replaces(spark):
    schema = "id string, text string, at long"
    first = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "x", 1)], schema)
    empty = first.limit(0)
    one = index.upsert(empty, first, ["at", "text"])
    two = index.upsert(one, first, ["at", "text"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == [("a", "2", 2), ("b", "x", 1)]
    changed = index.upsert(two, spark.createDataFrame([("b", "y", 3)], schema), ["at", "text"])
    assert sorted((r["id"], r["text"]) for r in changed.collect()) == [("a", "2"), ("b", "y")]


def test_stream_upserts(spark, tmp_path):
    schema = "id string, text string, at long"
    src = tmp_path / "in"
    spark.createDataFrame([("a", "1", 1), ("b", "x", 1)], schema).write.json(str(src))
    ix = VersionedIndex(spark, str(tmp_path / "ix"), schema, "at", buckets=4)
    for _ in range(2):
        stream_upserts(spark.readStream.schema(schema).json(str(src)), ix, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", "2", 2)], schema).write.mode("append").json(str(src))
    stream_upserts(spark.readStream.schema(schema).json(str(src)), ix, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, ix.read().collect())) == [("a", "2", 2), ("b", "x", 1)]


def test_dense_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [0.0] * 8), (501, None), (502, [float("nan")] * 8), (503, [1.0])], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    got = dense.cosine_topk(df.where("id < 20").withColumnRenamed("id", "query_id"), df, 5).collect()
    for q in range(20):
        want = sorted((j for j in range(120) if j != q), key=lambda j: (-s[q, j], j))[:5]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_bm25_ties_and_empty(spark):
    docs = spark.createDataFrame([("b", "gate gate tower"), ("a", "gate gate tower"), ("c", ""), ("d", None)], "id string, text string")
    got = sparse.bm25_topk(spark.createDataFrame([("q", "Gate gate"), ("n", None)], "query_id string, query string"), docs, 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b"]


def test_retrieval_methods(spark):
    p = spark.createDataFrame([(f"p{i}", t, None if i else f"about {t}", f"R {i}", "V") for i, t in enumerate(["the keeper lit the tower", "bread at the river", "weavers sang of rain", "the tower fell"])], "id string, text string, context string, reference string, volume string")
    q = spark.createDataFrame([("q1", "who lit the tower"), ("q2", "rain and weavers")], "query_id string, query string")
    r = Retrieval(p, q)
    every = r.retrieve_all(3)
    assert {x["method"] for x in every.select("method").distinct().collect()} == {"legacy", "contextual", "contextual_rerank", "hybrid_rrf", "hybrid_rerank"}
    assert every.where("query_id = 'q1' and rank = 1 and method = 'hybrid_rerank'").first()["id"] == "p0"
    with pytest.raises(ValueError, match="custom"):
        r.contextual_custom_rerank()
    assert r.small_hybrid(k=4, n=2).columns == ["query_id", "rank", "reference", "text", "rerank_score", "original_sources"]


def test_judging_once_per_pair(spark):
    pairs = spark.createDataFrame([("m1", 1, "gate", "the gate"), ("m2", 4, "gate", "the gate"), ("m2", 5, "gate", "none")], "method string, rank int, query string, text string")
    got = judge.judge_pairs(pairs).orderBy("rank").collect()
    assert [(r["method"], r["score"]) for r in got] == [("m1", 3), ("m2", 3), ("m2", 0)]


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"))
    got = training.split(df, "k")
    assert got.count() == 1003
    assert got.where("test").count() == 101


def test_labels_weights_samples(spark):
    rows = spark.createDataFrame([("q", f"d{i}", i, s, None if s is None else s / 3.0) for i, s in enumerate([0, 1, 2, 3, 7, None, 3, 3, 3])] + [("only", "x", 90, 3, 1.0)], "query string, document string, k int, raw_score int, label double")
    assert [r["x"] for r in rows.where("k < 6").orderBy("k").select(training.soft_label(F.col("raw_score")).alias("x")).collect()] == [0.0, 0.2, 0.7, 1.0, 0.0, 0.0]
    e = training.eval_samples(rows, "k").collect()
    assert [(r["query"], r["positive"], r["documents"]) for r in e] == [("q", ["d2", "d3", "d4"], ["d0", "d1", "d5"])]
    w = training.class_weights(rows).first()
    assert w["pos_weight"] == pytest.approx(3 / 7)


def test_training_set_files(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"q{i % 3}", f"d\t{i}", "r", (i % 4) / 3.0, i % 4, "cross-reference" if i % 2 else "cross_reference", "why") for i in range(30)], "k string, query string, document string, reference string, label double, raw_score bigint, query_type string, reasoning string")
    runs.write_training_set(rows, str(tmp_path), "k", "20250101_000000")
    s = json.loads((tmp_path / "training_stats_20250101_000000.json").read_text())
    assert (s["total_examples"], s["train_examples"], s["test_examples"], s["unique_queries"]) == (30, 27, 3, 3)
    assert s["query_type_distribution"] == {"cross_reference": 30}
    assert runs.latest_training_set(str(tmp_path)).endswith("dataset_20250101_000000")
    assert readers.training_set(spark, str(tmp_path / "training_data_20250101_000000.parquet"), pair_names=True).columns == ["text1", "text2", "label"]


def test_reranker_learns_overlap(spark):
    rows = spark.createDataFrame([("gate tower", "the gate and the tower", 1.0), ("gate tower", "bread river", 0.0)] * 20, "query string, document string, label double")
    got = {r["document"]: r["prediction_score"] for r in training.predict(training.fit_reranker(rows), rows).collect()}
    assert got["the gate and the tower"] > got["bread river"]


def test_runs_and_reports(spark, tmp_path):
    assert runs.latest_run(str(tmp_path)) is None
    a = runs.new_run(str(tmp_path))
    assert runs.latest_run(str(tmp_path)) == a
    m = spark.createDataFrame([("legacy", 0.5, 1.0, None)], "method string, mrr double, mean_p_1 double, mean_p_10 double")
    for c in [c for _, c, _ in report.ROWS if c not in m.columns]:
        m = m.withColumn(c, F.lit(0.25))
    text = report.markdown(m, ["legacy", "absent"])
    assert "| MRR | 0.500 | - |" in text
    assert "| Precision@10 | - | - |" in text


def test_pipeline_resumes(spark, tmp_path):
    said = []
    stages = pipeline.default_stages(lambda s: passages(s))
    assert pipeline.run(spark, stages, str(tmp_path), dry_run=True, say=said.append) == ["passages", "summaries", "contexts", "index"]
    pipeline.run(spark, stages, str(tmp_path), say=said.append)
    assert pipeline.run(spark, stages, str(tmp_path), start=2, skip_done=True, say=said.append) == ["contexts", "index"]
    rows = spark.read.parquet(f"{tmp_path}/index")
    assert rows.count() == 9
    assert rows.select(F.size("values").alias("n")).distinct().first()["n"] == 64


def test_search_loop():
    out = []
    assert pipeline.search_loop(lambda q: [q.upper()], ["", "gate\n", "Quit", "no"], out.append) == 1
    assert out == ["GATE"]


def test_retry_gives_up_after_six():
    calls, waits = [], []

    def fails():
        calls.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        providers.retrying(fails, sleep=waits.append)()
    assert len(calls) == 6
    assert len(waits) == 5


def test_plans_have_no_cartesian_product_and_prune_groups(spark):
    df = spark.range(50).select(F.col("id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"))
    plan = dense.cosine_topk(df.where("id < 5").withColumnRenamed("id", "query_id"), df, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "WindowGroupLimit" in plan


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 64)))], "id long, vector array<double>")
    q = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in dense.cosine_topk(q, df, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in dense.lsh_topk(q, df, 10, 1.6).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_bm25_without_queries(spark):
    docs = spark.createDataFrame([("a", "gate")], "id string, text string")
    none = spark.createDataFrame([("n", None), ("m", "?")], "query_id string, query string")
    assert sparse.bm25_topk(none, docs, 3).count() == 0
    assert sparse.bm25_topk(spark.createDataFrame([("q", "gate")], "query_id string, query string"), docs.limit(0), 3).count() == 0
