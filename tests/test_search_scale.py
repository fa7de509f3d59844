"""Searches keep memory and output bounded, whatever the number of queries and rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import dense, running, sparse


def batch(n, dim, seed, start=0):
    x = np.random.default_rng(seed).standard_normal(n * dim)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32()), pa.array(x)), pa.array(np.full(n, dim, dtype=np.int32))], ["id", "v", "dim"])


def test_dense_memory_and_rows_with_70000_queries():
    n, k, dim = 70_000, 11, 16
    matrix = dense._unit(np.random.default_rng(1).standard_normal((n, dim)))
    tracemalloc.start()
    rows = sum(b.num_rows for b in dense._best({dim: (pa.array(np.arange(n)), matrix)}, k)(batch(3_000, dim, i, i * 3_000) for i in range(3)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n * k
    assert peak < 400 << 20  # 70,000 queries by 3,000 rows would be 1.7 GB


def test_dense_parts_equal_one(spark, monkeypatch):
    x = np.random.default_rng(2).standard_normal((300, 8)).round(1)  # many ties
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    q = df.withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in dense.cosine_topk(q, df, 4).collect()}
    monkeypatch.setattr(dense, "QUERY_BYTES", 4_000)
    monkeypatch.setattr(dense, "CELLS", 500)
    assert {tuple(r) for r in dense.cosine_topk(q, df, 4).collect()} == whole
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    for i in range(0, 300, 17):
        best = sorted((-s[i, j], f"v{j}") for j in range(300) if j != i)[:4]
        assert [w[1] for w in sorted(whole, key=lambda w: w[3]) if w[0] == f"v{i}"] == [b for _, b in best]


@pytest.mark.parametrize("ids", ["long", "string"])
def test_running_keeps_the_best_and_settles_ties_by_id(ids, monkeypatch):
    monkeypatch.setattr(running, "CELLS", 50)
    rng = np.random.default_rng(3)
    held, every = running.Running(5, 3), []
    for _ in range(40):
        q, s = rng.integers(0, 5, 20), rng.integers(0, 6, 20).astype(float)
        i = rng.permutation(10_000)[:20]
        i = i if ids == "long" else np.array([f"k{x}" for x in i], dtype=object)
        every += list(zip(q.tolist(), (-s).tolist(), i.tolist(), strict=True))
        ok = s >= held.edge[q]
        held.add(q[ok], s[ok], i[ok])
    got = sorted((q, -s, i) for b in held.batches(pa.array(range(5)), pa.int64() if ids == "long" else pa.string()) for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
    want = sorted(x for q in range(5) for x in sorted(e for e in every if e[0] == q)[:3])
    assert got == want


def test_a_third_of_the_rows_tied(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.5), F.col("id") + 1.0)).alias("vector"))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r["id"] for r in dense.cosine_topk(q, df, 5).orderBy("rank").collect()] == [3, 6, 9, 12, 15]


def test_bm25_rows_and_parts(spark, monkeypatch):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(words[(i * j) % 30] for j in range(1, 8))) for i in range(200)], "id string, text string")
    q = spark.createDataFrame([(f"q{i}", " ".join(words[i : i + 3])) for i in range(28)], "query_id string, query string")
    whole = {tuple(r) for r in sparse.bm25_topk(q, docs, 3).collect()}
    monkeypatch.setattr(sparse, "QUERY_TERMS", 20)
    monkeypatch.setattr(sparse, "CELLS", 40)
    assert {tuple(r) for r in sparse.bm25_topk(q, docs, 3).collect()} == whole
    terms = {w: (1.0, np.arange(500)) for w in words}
    made = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array([[words[i % 30]] for i in range(2_000)])], ["id", "w"])
    assert sum(b.num_rows for b in sparse._scores(pa.array(range(500)), terms, 4, 1.0, 1.2, 0.75)(iter([made, made]))) == 500 * 4


def test_hashed_search_prunes_and_recalls(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((200, 48))
    x = centres[rng.integers(0, 200, 2_000)] + rng.standard_normal((2_000, 48)) * rng.uniform(0.1, 0.6, (2_000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    q = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    distance = 0.4**0.5  # a cosine of 0.8
    exact = {(r["query_id"], r["id"]) for r in dense.cosine_topk(q, df, 10).where("score >= 0.8").collect()}
    near = {(r["query_id"], r["id"]) for r in dense.lsh_topk(q, df, 10, distance).collect()}
    assert len(exact) > 300
    assert len(exact & near) >= 0.9 * len(exact)
    valid = lambda d, c: dense._valid(d, c, "vector").withColumn("dim", F.size("v"))
    assert dense.lsh_candidates(valid(q, "query_id"), valid(df, "id"), distance).count() < 0.1 * 100 * 2_000


def test_hash_shape():
    assert dense.hash_shape(0.4**0.5, 0.95, 48)[0] > dense.hash_shape(1.2, 0.95, 48)[0]
    assert dense.hash_shape(0.0, 0.95, 48) == (30, 1)
    with pytest.raises(ValueError, match="opposite"):
        dense.hash_shape(2.0, 0.95, 48)
