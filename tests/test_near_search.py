"""The search within a distance misses none, and no pairs leave the task that reads the row."""

import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import dense

DISTANCE = 0.4**0.5  # a cosine of 0.8


def batch(x, start=0):
    n, dim = x.shape
    return pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32()), pa.array(x.ravel())), pa.array(np.full(n, dim, dtype=np.int32))], ["id", "v", "dim"])


def at_cosine(u, cosine, rng):
    """A row for each of ``u`` at that cosine."""
    side = rng.standard_normal(u.shape)
    side -= np.sum(side * u, axis=1, keepdims=True) * u
    return cosine[:, None] * u + np.sqrt(1 - cosine[:, None] ** 2) * dense._unit(side)


def test_none_missed_at_the_edge_and_no_join(spark):
    rng = np.random.default_rng(11)
    u = dense._unit(rng.standard_normal((50, 96)))
    rows = [(f"q{i}", v.tolist()) for i, v in enumerate(u)]
    for n in range(20):  # half of them barely within the distance, half barely beyond it
        rows += [(f"{'in' if n % 2 else 'out'}{n}-{i}", (v * 3).tolist()) for i, v in enumerate(at_cosine(u, np.full(50, 0.8001 if n % 2 else 0.7999), rng))]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    found = dense.lsh_topk(df.where("id like 'q%'").withColumnRenamed("id", "query_id"), df, 30, DISTANCE)
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    assert got == {(f"q{i}", f"in{n}-{i}") for i in range(50) for n in range(1, 20, 2)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [0.8, 0.95, 1.0])
@pytest.mark.parametrize("kind", ["random", "one cone", "sparse"])
def test_pruned_equals_all_pairs(kind, least, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1_500, 96))
    if kind == "one cone":  # all rows near each other, nothing to prune
        x = x * 0.4 + rng.standard_normal(96)
    elif kind == "sparse":  # hashed words
        x = (rng.random((1_500, 96)) < 0.04).astype(float) + (np.arange(96) == 5)
    x[700:900] = at_cosine(dense._unit(x[:200]), rng.uniform(0.78, 1.0, 200), rng)
    x[900:950] = x[:50]
    u = dense._unit(x)
    s = np.round(u[:200] @ u.T, 9)
    want = {(i, j) for i in range(200) for j in sorted(np.flatnonzero(s[i] >= least).tolist(), key=lambda j: (-s[i, j], j))[:7]}
    for cells in (dense.CELLS, 9_000):
        monkeypatch.setattr(dense, "CELLS", cells)
        out = [b for b in dense._best({96: (pa.array(np.arange(200)), u[:200])}, 7, least)(iter([batch(x[:1_200]), batch(x[1_200:], 1_200)]))]
        got = {(q, i) for b in out for q, i in zip(b.column("query_id").to_pylist(), b.column("id").to_pylist(), strict=True)}
        assert got == want


def test_few_pairs_are_scored(monkeypatch):
    rng = np.random.default_rng(13)
    x = dense._unit(rng.standard_normal((4_000, 96)))
    x[2_000:2_200] = at_cosine(x[:200], np.full(200, 0.85), rng)
    scored, plain = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: scored.append(len(a)) or plain(how, a, b))
    d = dense._directions(96, 0.8)
    i, j, _ = dense._reaching(x[:200], x, np.full(200, 0.8), (dense._sketch(x[:200], d), dense._sketch(x, d)))
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {(n, m) for n in range(200) for m in (n, 2_000 + n)}
    assert d.shape[1] < 48
    assert sum(scored) < 0.002 * 200 * 4_000


def test_without_a_bound_nothing_is_pruned():
    assert dense._directions(96, -np.inf) is None
    assert dense._directions(64, -0.28) is None
    assert dense._directions(1, 1.0) is None
    assert dense._directions(1_536, 0.8).shape[1] < 500
