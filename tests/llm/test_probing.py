"""Searching a bucket by probing finds what all against all finds; recall on either side of every switch, and what is sent."""

import numpy as np
import pytest

from lectern.llm import neighbors
from tests.llm.test_neighbors import clustered, pairs, table, truth


def codes(n, seed, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (n // 4, neighbors.BITS), dtype=np.uint8)
    bits = np.concatenate([base] + [base ^ (rng.random(base.shape) < flips) for _ in range(3)])
    bits[:, 16:24] = 1  # all agree in the third byte
    return np.packbits(bits, axis=1)


def pigeonhole(shape, radius):
    return radius <= 2 * shape[1] - 1


@pytest.mark.parametrize("sides", ["one", "two"])
def test_every_code_within_the_radius_is_found(sides):
    code = codes(1200, 1, 0.05)
    every = np.arange(len(code))
    left, right = (every, every) if sides == "one" else (every[:500], every[500:])
    shape, radius = (15, 18), 35  # 18 substrings of 15 bits, within 35 bits for certain
    assert pigeonhole(shape, radius)
    want = {(int(i), int(j)) for a, b in neighbors._all_pairs(code, left, right, radius) for i, j in zip(a, b, strict=True)}
    found = [(int(i), int(j)) for a, b in neighbors._probed_pairs(code, left, right, radius, shape, 2) for i, j in zip(a, b, strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == want
    assert len(want) > 500


@pytest.mark.parametrize("local", [1 << 20, 30])
def test_recall_on_either_side_of_the_switch(spark, monkeypatch, local):
    monkeypatch.setattr(neighbors, "LOCAL", local)
    x = clustered(3000, 96, seed=12)
    want = truth(x, 5, 0.8)
    got = pairs(neighbors.most_similar(table(spark, x)))
    assert len(want & got) >= 0.95 * len(want)
    assert len(got - want) <= 0.02 * len(want)


def test_shapes():
    assert neighbors.key_tables(0.93, 0.86) == 11
    for n in (10**4, 2**20, 2**20 + 1, 2**24):  # either side of a change of bits
        bits, count = neighbors.local_shape(n, 0.93, 0.86)
        same = 1 - np.arccos(0.86) / np.pi
        near = same**bits + bits * (1 - same) * same ** (bits - 1)
        assert 1 - (1 - near) ** count >= 0.93
        assert bits * count <= 2 * neighbors.BITS


def test_bytes_sent_a_vector_do_not_grow():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rotation = neighbors.learn_rotations(rng.standard_normal((300, 96)), neighbors.BITS)
    for n in (100, 1000):
        x = rng.standard_normal(n * 96).astype(np.float32)
        batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * 96, 96), pa.int32()), pa.array(x)), pa.array(np.arange(n))], ["v", "rid"])
        out = list(neighbors._codes(rotation, 11, False)(iter([batch])))
        assert sum(b.num_rows for b in out) == 11 * n
        assert {len(c) for b in out for c in b.column("code").to_pylist()} == {neighbors.BITS // 8}
