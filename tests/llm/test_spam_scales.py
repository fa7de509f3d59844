"""The scales come from the corpus; languages without a list, and few documents of one, are judged too."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import spam

PARTS = "doc_id long, lang string, chars long, " + ", ".join(f"{f} double" for f in spam.FEATURES)
DOC = "doc_id long, text string, lang string"
#: An invented language: its function words and its nouns.
SMALL = "ta ke lo mi ri sa nu pa vo de".split()
NOUNS = [a + b + c for a in ("bar", "kel", "tor", "min", "sol") for b in ("ga", "ne", "ri", "lu") for c in ("dun", "meth", "wick")]


def parts(spark, noise, n=30_000, lang="en"):
    """Stretches whose lack of function words is spread by ``noise``; a third have a link share of about it."""
    x = F.rand(3) + F.rand(4) + F.rand(5) + F.rand(6) - 2
    link = F.when(F.rand(7) < 0.33, F.lit(noise) * (1 + F.rand(8)))
    return spark.range(n).select("id", F.lit(lang), F.lit(350).cast("long"), F.coalesce(link, F.lit(0.0)), F.lit(0.0), F.lit(0.0), F.lit(-0.4) + x * noise, F.lit(0.0), F.lit(-0.97) + F.abs(x) * noise).toDF(*[c.split()[0] for c in PARTS.split(", ")])


def test_scales_follow_the_corpus(spark):
    tight, wide = (dict(zip(spam.FEATURES, spam._frame(parts(spark, noise))["en"][1], strict=True)) for noise in (0.04, 0.2))
    for f in ("links", "bare", "flat"):
        assert wide[f] > 2 * tight[f]
    assert wide["links"] > 2 * spam.PRIOR["links"]
    assert tight["bare"] < spam.PRIOR["bare"]
    # what no text has keeps the scale of marks as such, or the prior one
    assert wide["repeated"] == pytest.approx(spam.PRIOR["repeated"])


def test_few_stretches_are_drawn_to_all(spark):
    both = parts(spark, 0.1).union(parts(spark, 0.4, 20, "de"))
    frame = spam._frame(both)
    assert abs(frame["de"][1][3] / frame["en"][1][3] - 1) < 0.05
    assert spam._frame(both.limit(0)) == {}


def sentence(rnd):
    return " ".join(w for _ in range(7) for w in (rnd.choice(SMALL), rnd.choice(NOUNS) + rnd.choice(NOUNS))) + "."


def test_a_language_without_a_list(spark):
    rnd = random.Random(5)
    prose = [" ".join(sentence(rnd) for _ in range(rnd.randrange(6, 20))) for _ in range(150)]
    bad = [", ".join(rnd.choice(["kelgadun torne", "minri soldun"]) for _ in range(80)) for _ in range(4)] + [" ".join(f"https://{rnd.choice(NOUNS)}.zz/{i}" for i in range(30)) for _ in range(4)]
    texts = prose + bad
    df = spark.createDataFrame([(i, t, ("xx", "XX-yy")[i % 2]) for i, t in enumerate(texts)], DOC)
    lists = spam._learned(df.withColumn("lang", F.lit("xx")))
    assert set(SMALL) <= lists["xx"]
    rows = {r["doc_id"]: r for r in spam.spam_scores(df).collect()}
    assert {r["lang"] for r in rows.values()} == {"xx"}
    assert {i for i, r in rows.items() if r["is_spam"]} == set(range(len(prose), len(texts)))


def test_unusable_language_codes(spark):
    text = "The keeper of the tower kept the gate that was near the river when it was night."
    df = spark.createDataFrame([(1, text, "?"), (2, text, ""), (3, text, "english"), (4, text, "qq"), (5, text, "EN_gb"), (6, text, None)], DOC)
    assert {r["lang"] for r in spam.spam_scores(df).collect()} == {"en"}


@pytest.mark.parametrize("mark", ["[gate](https://x.yz/" + "a" * 2000 + ")", "[" + "long name " * 60 + "](u)", "shop.someending/x", "https://a.b/c", "keeper-mugs.store"])
def test_links_of_any_length_and_ending(mark):
    _, found = spam.stretches(f"See {mark} for the gate of the river", "en")
    assert found[0][1][0] > 0.3


def test_markup_of_any_length_is_no_text():
    _, found = spam.stretches("the gate <div style='" + "x y " * 300 + "'> of the river", "en")
    assert len(found) == 1
