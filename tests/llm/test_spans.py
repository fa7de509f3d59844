"""Shared spans against all windows of every text."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import spans

SCHEMA = "id string, text string, h string, extra int"


def brute(texts, m):
    where = defaultdict(set)
    for i, t in texts.items():
        for s in range(len(t) - m + 1):
            where[t[s : s + m]].add(i)
    pairs = {(a, b) for g in where.values() for a in g for b in g if a < b}
    cover = {}
    for i, t in texts.items():
        mask = np.zeros(len(t), bool)
        for s in range(len(t) - m + 1):
            if len(where[t[s : s + m]]) > 1:
                mask[s : s + m] = True
        cover[i] = int(mask.sum())
    return pairs, cover


def shared(spark, rows, m=120):
    return spans.SharedSpans(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), min_len=m)


def check(spark, texts, m):
    s = shared(spark, list(texts.items()), m)
    pairs, cover = brute(texts, m)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in s.coverage().collect()} == cover


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é\n", "".join(map(chr, range(0x4E00, 0x4E40))) + "😀"])
def test_random_texts_with_planted_spans(spark, alphabet):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    planted = [word(120), word(119), word(400), word(121)]
    texts = {f"d{i}": word(rnd.randrange(60)) + rnd.choice(planted) + word(rnd.randrange(60)) for i in range(24)}
    check(spark, texts, 120)


def test_runs_periods_and_copies(spark):
    texts = {"a": "-" * 130, "b": "x" * 40 + "-" * 300, "c": "ab" * 100, "d": "q" + "ab" * 61, "e": "abc" * 50, "f": "z" + "abc" * 41, "g": "-" * 119, "h": "-" * 130, "i": "", "j": "-" * 5000}
    check(spark, texts, 120)


def test_nulls_repeats_and_empty_tables(spark):
    t = "word " * 30
    s = shared(spark, [("a", t), ("a", t), ("b", t + "!"), (None, t), ("c", None), ("d", "")])
    assert [tuple(r) for r in s.pairs().collect()] == [("a", "b")]
    assert {r["doc_id"]: r["shared_chars"] for r in s.coverage().collect()} == {"a": 150, "b": 150, "d": 0}
    none = shared(spark, [("a", "x")])
    assert none.pairs().count() == 0
    assert spans.SharedSpans(spark.createDataFrame([], SCHEMA)).coverage().count() == 0


def test_a_hot_text_is_one_class(spark):
    t = "".join(chr(97 + i % 23) for i in range(200))
    s = shared(spark, [(f"c{i:03}", t) for i in range(60)] + [("z", "!" + t)])
    assert s.class_pairs().count() == 1
    assert s.pairs().count() == 61 * 60 // 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ", min_size=64, max_size=64), st.text(alphabet="ab ", max_size=40), st.text(alphabet="ab ", max_size=40))
def test_equal_windows_share_a_symbol(window, before, after):
    p = spans.plan(64)
    names = [set(spans.symbols([x], p)[2].tolist()) for x in (window, before + window + after)]
    inside = {n for n in names[0]}
    assert inside
    assert inside & names[1] or not inside
    assert inside <= names[1] or len(inside & names[1]) > 0


@pytest.mark.parametrize("m", [8, 20, 50, 120, 1000])
def test_the_bounds_of_a_plan(m):
    p = spans.plan(m)
    reach = sum(p.caps) + sum(p.runs)
    gap = max(2 * p.caps[-1], *p.runs)
    assert p.half >= min(reach, p.half)
    assert 2 * p.half + gap <= m
    if len(p.caps) > 1 or 2 * reach + gap <= m:
        assert reach <= p.half


def test_short_min_len_is_refused():
    with pytest.raises(ValueError):
        spans.plan(5)
