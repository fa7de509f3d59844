"""Fingerprints of nearly same texts always meet, single or chained, short or long; candidates grow with the texts only."""

import random

import numpy as np
import pytest

from lectern.llm import overlap

NONE = np.zeros(overlap.SKETCH, dtype=np.int64)


def lcs(a, b):
    return overlap.chain(a, b)


def edited(rnd, words, vocabulary, n):
    w = list(words)
    for _ in range(n):
        kind, i = rnd.randrange(4), rnd.randrange(len(w))
        if kind == 0:
            w[i] = rnd.choice(vocabulary)
        elif kind == 1 and len(w) > 5:
            del w[i]
        elif kind == 2:
            w.insert(i, rnd.choice(vocabulary))
        else:
            w.insert(rnd.randrange(len(w)), w.pop(i))
    return w


@pytest.mark.parametrize("vocabulary", [3, 12, 400])
def test_nearly_same_texts_share_a_key(vocabulary):
    rnd = random.Random(vocabulary)
    words = [f"w{i}" for i in range(vocabulary)]
    counts = np.random.default_rng(vocabulary).integers(0, 50, overlap.SKETCH)
    near = 0
    for _ in range(1500):
        a = [rnd.choice(words) for _ in range(rnd.choice((5, 6, 9, 15, 40, 66, 79, 80, 81, 100, 130)))]
        b = edited(rnd, a, words, rnd.randrange(len(a) // 5 + 1))
        n = max(len(a), len(b))
        if a == b or n - lcs(a, b) > n // 5:
            continue
        near += 1
        for table in (NONE, counts):
            assert set(overlap.single_keys(a, table).tolist()) & set(overlap.single_keys(b, table).tolist())
            assert set(overlap.chained_keys(a, table).tolist()) & set(overlap.chained_keys(b, table).tolist())
    assert near > 300


def test_selected_share_of_the_words():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    texts = [[rnd.choice(words) for _ in range(40)] for _ in range(200)]
    assert np.mean([len(overlap.single_keys(t, NONE)) / 40 for t in texts]) < 0.3
    assert np.mean([len(overlap.seeds(t, NONE, overlap._tolerated(40) + 2)) / 40 for t in texts]) < 0.31


def candidates(texts):
    where = {}
    counts = np.zeros(overlap.SKETCH, dtype=np.int64)
    for t in texts:
        counts[np.unique(overlap.hashes(t) & np.uint64(overlap.SKETCH - 1)).astype(np.int64)] += 1
    for i, t in enumerate(texts):
        for g in overlap.chained_keys(t, counts).tolist():
            where.setdefault(g, []).append(i)
    return sum(len(v) * (len(v) - 1) // 2 for v in where.values())


def test_candidates_of_a_growing_vocabulary_grow_in_proportion():
    def corpus(n):
        rnd = random.Random(4)
        common = [f"c{i}" for i in range(60)]  # half of all words are of sixty
        return [[rnd.choice(common) if rnd.random() < 0.5 else f"r{rnd.randrange(n)}" for _ in range(15)] for _ in range(n)]

    small, large = candidates(corpus(2000)), candidates(corpus(4000))
    assert large < 2.6 * max(small, 50)


def test_short_texts_and_the_sketch(spark):
    assert len(overlap.chained_keys([], NONE)) == 0
    assert len(overlap.single_keys(["a"], NONE)) == 1
    df = spark.createDataFrame([("a b a",), ("b c",), ("",)], "text string")
    counts = overlap.sketch(df)
    at = (overlap.hashes(["a", "b", "c"]) & np.uint64(overlap.SKETCH - 1)).astype(int)
    assert counts[at].tolist() == [1, 2, 1]
    assert counts.sum() == 4


def test_a_query_with_many_documents(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 20)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):
        d = [rnd.choice(words) for _ in range(rnd.choice((12, 30, 78, 95)))]
        rows.append((f"t{i:02}", "one query for all of them here", " ".join(d), "train", "s", 1))
        rows.append((f"v{i:02}", "one query for all of them here", " ".join(edited(rnd, d, words, len(d) // 6)), "test", "s", 1))
        rows += [(f"u{i:02}", f"query number {i} of its own kind", " ".join(d), "train", "s", 1), (f"x{i:02}", f"query number {i} of its own kind", " ".join(edited(rnd, d, words, 1)), "validation", "s", 1)]
    o = overlap.CrossSplitOverlap(spark.createDataFrame(rows, "key string, query string, document string, split string, source string, at long"), spark.createDataFrame([], "key string, query string"))
    norm = {r[0]: (overlap.normalise(r[1]).split(), overlap.normalise(r[2]).split()) for r in rows}
    near = lambda a, b: max(len(a), len(b)) - lcs(a, b) <= max(len(a), len(b)) // 5
    want = {tuple(sorted((a[0], b[0]))) for a in rows if a[3] != "train" for b in rows if b[3] == "train" and near(norm[a[0]][0], norm[b[0]][0]) and near(norm[a[0]][1], norm[b[0]][1])}
    assert {tuple(p) for p in o.pairs().collect()} == want
    assert len(want) >= 70
