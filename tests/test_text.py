"""Scalar functions against plain values."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Hefil 2:3", "hefil-2-3"), ("Yodnith—Glukvim & Sons 8:9", "yodnith-glukvim-sons-8-9"), ("--A--", "a"), ("", ""), (None, None)])
def test_slug(spark, raw, want):
    assert one(spark, T.slug("s"), s=raw) == want


def test_display_name(spark):
    assert one(spark, T.display_name("s"), s="book-of-hours.json") == "Book Of Hours"
    assert one(spark, T.summary_file_name("s"), s="book-of-hours.json") == "book-of-hours-summaries.json"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('**Context**: "inner"\n**Verse**: "v"', "inner"), ('**Context**: "only one marker', '**Context**: "only one marker'), ("plain", "plain"), ("", "No context"), (None, "No context"), ('**Context**: ""\n**Verse**: "v"', "No context")],
)
def test_context(spark, raw, want):
    assert one(spark, T.context_or_default("s"), s=raw) == want


def test_contextualize_and_back(spark):
    made = T.contextualize(F.lit("Hefil 2:3"), F.lit("Vol"), F.lit(None).cast("string"), F.lit("text"))
    assert one(spark, made, s="") == '**Context**: "The following passage is from **Hefil 2:3** from the **Vol**. "\n**Verse**: "text"'
    assert one(spark, T.extract_context(made), s="") == "The following passage is from **Hefil 2:3** from the **Vol**. "


def test_truncate(spark):
    assert one(spark, T.truncate("s", 4), s="abcd") == "abcd"
    assert one(spark, T.truncate("s", 4), s="abcde") == "abcd..."
    assert one(spark, T.preview("s", 4), s="ab") == "ab..."


def test_tsv(spark):
    assert one(spark, T.tsv_field("s"), s="a\tb\nc") == "a b c"
    assert one(spark, T.tsv_field("s", newlines=False), s="a\tb\nc") == "a b\nc"


@pytest.mark.parametrize(
    ("answer", "strict", "lenient"),
    [
        ('{"score": 2, "reasoning": "ok"}', (2, "ok"), (2, "ok")),
        ('So: {"score": 2, "reasoning": "ok"}.', (0, 'Failed to parse response: So: {"score": 2, "reasoning": "ok"}.'), (2, "ok")),
        ("nothing", (0, "Failed to parse response: nothing"), (0, "Failed to parse judgment")),
        ("[1, 2]", (0, "Failed to parse response: [1, 2]"), (0, "Failed to parse judgment")),
        ('{"reasoning": "r"}', (0, "r"), (0, "r")),
        ('{"score": 9}', (3, ""), (3, "")),
        ('{"score": "3"}', (3, ""), (3, "")),
        ('{"score": 2.7}', (2, ""), (2, "")),
        ('{"score": null}', (0, ""), (0, "")),
        (None, (0, None), (0, "Failed to parse judgment")),
    ],
)
def test_judgments(spark, answer, strict, lenient):
    assert tuple(one(spark, T.parse_judgment("s"), s=answer)) == strict
    assert tuple(one(spark, T.parse_judgment_lenient("s"), s=answer)) == lenient


def test_query_list_and_response(spark):
    got = one(spark, T.parse_queries("s"), s='Here: [{"query": "a", "type": "t"}, {"query": "b", "type": "u"}] done')
    assert [tuple(x) for x in got] == [("a", "t"), ("b", "u")]
    assert one(spark, T.parse_queries("s"), s="none") == []
    r = one(spark, T.parse_response("s"), s='{"completeness": 3, "overall": "2", "notes": "n"}')
    assert (r["completeness"], r["overall"], r["faithfulness"], r["notes"]) == (3, 2, 0, "n")
    assert one(spark, T.parse_response("s"), s="bad")["notes"] == "Failed to parse: bad"


def test_label(spark):
    assert one(spark, T.scored_label(F.lit("A 1"), F.lit(0.03571), F.lit(True)), s="") == "A 1 (0.0357) [BOTH]"
