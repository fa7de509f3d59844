"""Scalar text functions as column expressions, all inside the JVM.

Fixed values, as the formats must agree with existing corpora and run files:
the context markers, the file suffixes, the failure notes and the rating names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_OPEN = '**Context**: "'
CONTEXT_CLOSE = '"\n**Verse**:'
NO_CONTEXT = "No context"
SUMMARY_SUFFIX = "-summaries.json"
STRICT_FAILURE = "Failed to parse response: "
LENIENT_FAILURE = "Failed to parse judgment"
RESPONSE_FAILURE = "Failed to parse: "
RESPONSE_SCORES = ("completeness", "citation_accuracy", "faithfulness", "format_compliance", "overall")
SECTIONED_VOLUME = "Doctrine and Covenants"
WORD_PATTERN = r"([\p{L}\p{N}]+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slug(text: Column | str) -> Column:
    """Lower case, runs of anything but ASCII letters and digits become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")


def display_name(file_name: Column | str, suffix: str = ".json") -> Column:
    """``book-of-x.json`` as ``Book Of X``."""
    return F.initcap(F.replace(F.replace(_c(file_name), F.lit(suffix), F.lit("")), F.lit("-"), F.lit(" ")))


def summary_file_name(file_name: Column | str) -> Column:
    return F.replace(_c(file_name), F.lit(".json"), F.lit(SUMMARY_SUFFIX))


def unit_type(volume: Column | str, sectioned: str = SECTIONED_VOLUME) -> Column:
    return F.when(_c(volume) == sectioned, "section").otherwise("chapter")


def contextualize(reference: Column | str, volume: Column | str, summary: Column | str, text: Column | str) -> Column:
    """The string that is embedded for a verse; a missing summary is empty."""
    part = lambda c: F.coalesce(_c(c), F.lit(""))
    return F.concat(F.lit(CONTEXT_OPEN + "The following passage is from **"), part(reference), F.lit("** from the **"), part(volume), F.lit("**. "), part(summary), F.lit(CONTEXT_CLOSE + ' "'), part(text), F.lit('"'))


def extract_context(full: Column | str) -> Column:
    """What stands between the markers if both are there, else the whole."""
    full = _c(full)
    begin, end = F.locate(CONTEXT_OPEN, full), F.locate(CONTEXT_CLOSE, full)
    inner = F.substring(full, begin + len(CONTEXT_OPEN), F.greatest(end - begin - len(CONTEXT_OPEN), F.lit(0)))
    return F.when((begin > 0) & (end > 0), inner).otherwise(full)


def context_or_default(full: Column | str) -> Column:
    """Empty counts as missing."""
    return F.coalesce(F.nullif(extract_context(full), F.lit("")), F.lit(NO_CONTEXT))


def truncate(text: Column | str, n: int) -> Column:
    """At most n characters, dots only where something was cut."""
    text = _c(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def preview(text: Column | str, n: int) -> Column:
    """The first n characters and dots, always."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))


def tokens(text: Column | str) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD_PATTERN))


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def tsv_field(text: Column | str, newlines: bool = True) -> Column:
    """Tabs, and for texts newlines, become spaces."""
    return F.translate(_c(text), "\t\n" if newlines else "\t", "  " if newlines else " ")


def scored_label(reference: Column | str, score: Column | str, in_both: Column | str) -> Column:
    return F.format_string("%s (%.4f)%s", _c(reference), F.round(_c(score), 4), F.when(_c(in_both), " [BOTH]").otherwise(""))


def docs_block(documents: Column | str) -> Column:
    """``[reference]: text`` of each document, blank lines between."""
    return F.array_join(F.transform(_c(documents), lambda x: F.concat(F.lit("["), F.coalesce(x["reference"], F.lit("")), F.lit("]: "), F.coalesce(x["text"], F.lit("")))), "\n\n")


def docs_list(documents: Column | str, n: int = 5, chars: int = 200) -> Column:
    """The first n documents as a list of previews."""
    return F.array_join(F.transform(F.slice(_c(documents), 1, n), lambda x: F.concat(F.lit("- ["), F.coalesce(x["reference"], F.lit("")), F.lit("]: "), preview(F.coalesce(x["text"], F.lit("")), chars))), "\n")


def _score(text: Column) -> Column:
    """Numbers and numeric strings as whole grades 0 to 3; anything else is 0."""
    return F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce(F.expr("cast(null as int)"), text.try_cast("double").cast("int"), F.lit(0))))


def parse_judgment(text: Column | str) -> Column:
    """struct(score, reasoning) of a strict JSON answer; what is no JSON object scores 0 and is quoted."""
    text = _c(text)
    got = F.from_json(text, "score string, reasoning string, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    bad = got.isNull() | got["__bad"].isNotNull() | ~F.ltrim(text).startswith("{")
    failed = F.struct(F.lit(0).alias("score"), F.concat(F.lit(STRICT_FAILURE), F.substring(text, 1, 100)).alias("reasoning"))
    return F.when(F.coalesce(bad, F.lit(True)), failed).otherwise(F.struct(_score(got["score"]).alias("score"), F.coalesce(got["reasoning"], F.lit("")).alias("reasoning")))


def parse_judgment_lenient(text: Column | str) -> Column:
    """Like the strict one over what stands from the first ``{`` to the last ``}``."""
    inner = F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)
    got = F.from_json(inner, "score string, reasoning string, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    bad = (inner == "") | got.isNull() | got["__bad"].isNotNull()
    failed = F.struct(F.lit(0).alias("score"), F.lit(LENIENT_FAILURE).alias("reasoning"))
    return F.when(F.coalesce(bad, F.lit(True)), failed).otherwise(F.struct(_score(got["score"]).alias("score"), F.coalesce(got["reasoning"], F.lit("")).alias("reasoning")))


def parse_queries(text: Column | str) -> Column:
    """The array of (query, type) from the first ``[`` to the last ``]``; empty if there is none."""
    inner = F.regexp_extract(_c(text), r"(?s)(\[.*\])", 1)
    kind = "array<struct<query:string,type:string>>"
    return F.coalesce(F.from_json(inner, kind), F.from_json(F.lit("[]"), kind))


def parse_response(text: Column | str) -> Column:
    """struct of five grades and notes."""
    text = _c(text)
    got = F.from_json(text, ", ".join(f"{s} string" for s in RESPONSE_SCORES) + ", notes string, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    bad = F.coalesce(got.isNull() | got["__bad"].isNotNull() | ~F.ltrim(text).startswith("{"), F.lit(True))
    grades = [F.when(bad, 0).otherwise(_score(got[s])).alias(s) for s in RESPONSE_SCORES]
    return F.struct(*grades, F.when(bad, F.concat(F.lit(RESPONSE_FAILURE), F.substring(text, 1, 100))).otherwise(F.coalesce(got["notes"], F.lit(""))).alias("notes"))


def summary_prompt(unit: Column, volume: Column, book: Column, chapter: Column, reference: Column, verses: Column, body: Column) -> Column:
    """One head line, the text, and the task at the end."""
    head = F.concat(F.lit("["), unit, F.lit(" "), chapter.cast("string"), F.lit(" of "), book, F.lit(", "), volume, F.lit("] "), reference, F.lit(". Verses: "), verses.cast("string"))
    return F.concat(head, F.lit("\n\n"), body, F.lit("\n\nSay in two or three sentences what this "), unit, F.lit(" tells."))


def relevance_prompt(query: Column, reference: Column, text: Column) -> Column:
    return F.concat(F.lit("Rate from 0 to 3 how relevant the passage is to the query.\nQuery: "), query, F.lit("\nReference: "), F.coalesce(reference, F.lit("Unknown")), F.lit('\nText: "'), F.coalesce(text, F.lit("")), F.lit('"\nAnswer with JSON: {"score": 0-3, "reasoning": "..."}'))


def response_prompt(query: Column, response: Column, documents: Column) -> Column:
    return F.concat(F.lit("Rate the response from 0 to 3 in each respect.\nQuery: "), query, F.lit("\nResponse:\n"), response, F.lit("\nDocuments:\n"), docs_list(documents), F.lit("\nAnswer with JSON: " + ", ".join(RESPONSE_SCORES) + ", notes"))


def answer_prompt(query: Column, documents: Column) -> Column:
    return F.concat(F.lit("Query: "), query, F.lit("\n\nPassages:\n"), docs_block(documents), F.lit("\n\nAnswer from these passages only and cite them."))


def query_generation_prompt(count: Column) -> Column:
    return F.concat(F.lit("Write "), count.cast("string"), F.lit(" diverse search queries as a JSON array of objects with query and type."))
