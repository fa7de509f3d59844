"""Cross-split overlap against plain alignment, and spam pages on a labelled fixture."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import overlap, spam

ROW = "key string, query string, document string, split string, source string, at long, a string"
QUERY = "key string, query string, split string"


def run(spark, rows, queries=()):
    return overlap.CrossSplitOverlap(spark.createDataFrame([(*r, "x") for r in rows], ROW), spark.createDataFrame([(*q, "z") for q in queries], QUERY))


def test_normal_form():
    assert overlap.normalise('23 <b>If</b> the  Gates&amp;Towers, of "Ríver" stood!') == "if the gates towers of river stood"
    assert overlap.normalise("3:16 So it was") == "so it was"
    assert overlap.normalise("  ") == ""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_chain_is_the_longest_common_subsequence(a, b):
    assert overlap.chain(a, b) == lcs(a, b)


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


def test_all_nearly_same_texts_are_found(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 40))] for _ in range(60)]
    rows, n = [], 0
    for b in base:
        for split, edits in (("train", 0), ("test", len(b) // 5), ("validation", len(b) // 6), ("test", len(b) // 2)):
            rows.append((f"k{n:04}", " ".join(edited(rnd, b, vocabulary, edits)), "the same words in every document", split, "s", 1))
            n += 1
    words = {r[0]: overlap.normalise(r[1]).split() for r in rows}
    train = [r[0] for r in rows if r[3] == "train"]
    want = set()
    for r in rows:
        if r[3] != "train":
            for t in train:
                m = max(len(words[r[0]]), len(words[t]))
                if m - lcs(words[r[0]], words[t]) <= m // 5:
                    want.add(tuple(sorted((r[0], t))))
    assert {tuple(p) for p in run(spark, rows).pairs().collect()} == want
    assert len(want) > 80


def test_edge_rows(spark):
    q, d = "who kept the tower at dawn", "the keeper of the tower sang while the long rain fell on the roofs"
    rows = [
        ("t1", q, d, "train", "s", 1), ("t1", q, d, "train", "s", 2), ("v1", q.upper() + "?", "12 " + d, "validation", "s", 1), ("v2", q, None, "validation", None, 1), ("v3", None, d, "test", "s", 1), ("v4", "...", "...", "test", "s", 1),
        ("t2", "...", "...", "train", "s", 1), (None, q, d, "test", "s", 1), ("v5", q, "other words entirely here now and then", "test", "s", 1), ("v6", q, d, None, "s", 1), ("long", q, d + " word" * 3000, "test", "s", 1),
    ]
    o = run(spark, rows, [("T1", q), ("T1", q), ("T2", None), (None, q), ("T3", "nothing alike")])
    assert {tuple(p) for p in o.pairs().collect()} == {("t1", "v1"), ("T1", "t1")}
    rep = {(r["split"], r["source"]): r for r in o.report().collect()}
    assert (rep["validation", "s"]["records"], rep["validation", "s"]["same"]) == (1, 1)
    assert rep["test_queries", None]["records"] >= 2
    empty = overlap.CrossSplitOverlap(spark.createDataFrame([], ROW), spark.createDataFrame([], QUERY))
    assert empty.pairs().count() == 0
    assert empty.report().count() == 0


# --- spam

DOC = "doc_id long, text string, lang string, chars int, d double"
NOUNS = "gate tower river keeper vessel lantern bread garden shepherd letter harvest mountain anchor cedar scribe".split()
VERBS = "kept found carried measured guarded forgot praised opened".split()


def prose(rnd, n=14):
    s = [f"The {rnd.choice(NOUNS)} that {rnd.choice(NOUNS)}{rnd.randrange(99)} {rnd.choice(VERBS)} near the {rnd.choice(NOUNS)} became a sign to the {rnd.choice(NOUNS)}s of {rnd.choice(NOUNS).title()}{chr(97 + rnd.randrange(26))}." for _ in range(n)]
    return " ".join(s)


def fixture(rnd):
    kw = lambda: rnd.choice(NOUNS) + " " + rnd.choice(["mug", "poster", "candle"])
    spam_texts = []
    for _ in range(6):
        a, b = kw(), kw()
        spam_texts += [
            ", ".join(rnd.choice([a, b]) for _ in range(60)),
            "\n".join(f"https://www.{rnd.choice(NOUNS)}{i}.example.com/{rnd.choice(NOUNS)} {a}" for i in range(20)),
            " ".join(f"#{rnd.choice(NOUNS)}{b.replace(' ', '')}{i}" for i in range(40)),
            "; ".join(f"{a} SKU-{i:05} $12.50" for i in range(30)),
            " ".join(f"Why {a}? Because {a} means {b} and {a}. Our {b} is the best {a}." for _ in range(12)),
        ]
    good = [
        "\n".join(f"Chapter {i}. The {rnd.choice(NOUNS)} of the {rnd.choice(NOUNS)} and its {rnd.choice(NOUNS)}{i}." for i in range(1, 20)),
        " ".join(f"And Name{chr(97 + i)} begat Name{chr(98 + i)}, in the {i + 30} year of his life." for i in range(20)),
        "\n".join(f"{rnd.choice(NOUNS).title()}: Hefil {i}:4; Dronno {i + 1}:12; Kesh 3:{i}." for i in range(20)),
        prose(rnd, 10) + " See https://www.gate.example.com/x for more.",
    ]
    return spam_texts, good


def test_spam_pages(spark):
    rnd = random.Random(2)
    bad, good = fixture(rnd)
    plain = [prose(rnd, rnd.randrange(4, 30)) for _ in range(200)]
    mixed = [prose(rnd, 30) + " " + bad[0], bad[0] * 6 + " " + prose(rnd, 3)]
    texts = plain + good + mixed + bad + [None, "", "   ", "x"]
    rows = [(i, t, None if i % 9 == 0 else "en", 1, 0.0) for i, t in enumerate(texts)] + [(None, "x", "en", 1, 0.0)]
    got = {r["doc_id"]: r["is_spam"] for r in spam.spam_scores(spark.createDataFrame(rows, DOC)).collect()}
    first_bad = len(plain) + len(good) + 2
    flagged = {i for i, s in got.items() if s}
    assert flagged == set(range(first_bad, first_bad + len(bad))) | {len(plain) + len(good) + 1}
    assert set(got) == {i for i, t in enumerate(texts) if t and t.strip()}
    assert spam.spam_scores(spark.createDataFrame([], DOC)).count() == 0
