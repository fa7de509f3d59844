"""Similar vectors against brute force."""

import numpy as np

from lectern.llm import neighbors

SCHEMA = "id string, values array<double>, at long, metadata string, rank int"


def table(spark, x, ids=None):
    ids = ids or [f"v{i:05}" for i in range(len(x))]
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], 0, "m", 9) for i, v in zip(ids, x, strict=True)], SCHEMA)


def clustered(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * rng.uniform(0.05, 0.5, (n, 1))
    return x * rng.uniform(0.5, 3, (n, 1))


def truth(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {tuple(sorted((i, int(j)))) for i in range(len(x)) for j in top[i] if s[i, j] >= least}


def pairs(df):
    return {(int(r["id_a"][1:]), int(r["id_b"][1:])) for r in neighbors.similar_pairs(df).collect()}


def test_recall(spark):
    x = clustered(3000, 96)
    want = truth(x, 5, 0.8)
    got = pairs(neighbors.most_similar(table(spark, x)))
    assert len(want & got) >= 0.97 * len(want)
    assert len(got - want) <= 0.02 * len(want)


def test_hot_buckets_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CHUNK", 16)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.standard_normal(96) + rng.standard_normal((200, 96)) * 0.02, clustered(300, 96)])
    assert pairs(neighbors.most_similar(table(spark, x))) == truth(x, 5, 0.8)


def test_invalid_vectors_nulls_copies_and_scales(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(96)
    near = v + rng.standard_normal(96) * 0.1
    bad = [None, [1.0] * 95, [float("nan")] * 96, [float("inf")] + [0.0] * 95, [0.0] * 96, [None] + [1.0] * 95]
    x = [v * (i + 1) for i in range(8)] + [near] + bad
    got = neighbors.most_similar(table(spark, x, [f"v{i:05}" for i in range(9)] + [f"b{i}" for i in range(len(bad))]).union(table(spark, [v], [None])))
    rows = got.collect()
    assert not [r for r in rows if r["id"][0] == "b"]
    mine = [r for r in rows if r["id"] == "v00003"]
    assert [r["other"] for r in sorted(mine, key=lambda r: r["rank"])] == ["v00000", "v00001", "v00002", "v00004", "v00005"]
    assert [r["other"] for r in sorted((r for r in rows if r["id"] == "v00008"), key=lambda r: r["rank"])] == ["v00000", "v00001", "v00002", "v00003", "v00004"]


def test_latest_row_of_an_id_counts_and_empty_table(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 96))
    df = table(spark, [a, b, a], ["x", "y", "z"]).union(spark.createDataFrame([("y", a.tolist(), 5, "m", 1)], SCHEMA))
    got = {(r["id"], r["other"]) for r in neighbors.most_similar(df, latest="at").collect()}
    assert ("y", "x") in got
    assert neighbors.most_similar(df.limit(0)).count() == 0
    assert neighbors.most_similar(df.limit(1)).count() == 0


def test_long_substrings(spark, monkeypatch):
    x = clustered(400, 96, seed=8)
    monkeypatch.setattr(neighbors, "index_shape", lambda n, recall, at: (18, 50))
    want = truth(x, 5, 0.8)
    assert len(want & pairs(neighbors.most_similar(table(spark, x)))) >= 0.9 * len(want)


def test_shape_grows_with_the_collection():
    small, large = neighbors.index_shape(10**5, 0.93, 0.86), neighbors.index_shape(10**9, 0.93, 0.86)
    assert small[0] == 12
    assert large[0] == 22
    assert large[1] > small[1]
