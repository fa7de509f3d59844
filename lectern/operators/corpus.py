"""Nested corpora to flat passages and back, chapter texts and summaries, contexts and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.relational import top

VERSE = "struct<verse:int,reference:string,text:string>"
CANONICAL = f"books array<struct<book:string,chapters:array<struct<chapter:int,reference:string,verses:array<{VERSE}>>>>>"
SECTIONED = f"sections array<struct<section:int,reference:string,verses:array<{VERSE}>>>"
SUMMARIES = "volume string, books array<struct<book:string,chapters:array<struct<chapter:int,reference:string,verse_count:int,summary:string>>>>"
#: Keys of the map format that are no books.
SKIP_KEYS = ("last_modified", "version")


def flatten(df: DataFrame, volume: Column | str = "volume") -> DataFrame:
    """Rows of ``books`` to one row per verse."""
    v = F.col(volume) if isinstance(volume, str) else volume
    books = df.select(v.alias("volume"), F.explode("books").alias("b"))
    chapters = books.select("volume", "b.book", F.explode("b.chapters").alias("c"))
    return chapters.select("volume", "book", F.col("c.chapter").alias("chapter"), F.explode("c.verses").alias("v")).select("volume", "book", "chapter", F.col("v.verse").alias("verse"), F.col("v.reference").alias("reference"), F.col("v.text").alias("text"))


def flatten_summaries(df: DataFrame) -> DataFrame:
    books = df.select("volume", F.explode("books").alias("b"))
    return books.select("volume", "b.book", F.explode("b.chapters").alias("c")).select("volume", "book", "c.chapter", F.col("c.reference").alias("chapter_ref"), "c.verse_count", "c.summary")


def chapters(passages: DataFrame) -> DataFrame:
    """One row per chapter with its verses in numeric order; the unit of nesting, bounded by the longest chapter."""
    verse = F.struct("verse", "reference", "text")
    return passages.groupBy("volume", "book", "chapter").agg(F.sort_array(F.collect_list(verse)).alias("verses")).withColumn("chapter_ref", F.concat_ws(" ", "book", F.col("chapter").cast("string")))


def nest(passages: DataFrame) -> DataFrame:
    """One canonical document per chapter: the nested shape without ever holding a whole volume."""
    c = F.struct("chapter", F.col("chapter_ref").alias("reference"), "verses")
    return chapters(passages).select("volume", F.array(F.struct("book", F.array(c).alias("chapters"))).alias("books"))


def nest_books(passages: DataFrame) -> DataFrame:
    """One canonical document per book, chapters in numeric order; bounded by the longest book."""
    c = F.struct("chapter", F.col("chapter_ref").alias("reference"), "verses")
    books = chapters(passages).groupBy("volume", "book").agg(F.sort_array(F.collect_list(c)).alias("chapters"))
    return books.select("volume", F.array(F.struct("book", "chapters")).alias("books"))


def nest_summaries(summaries: DataFrame) -> DataFrame:
    """The summaries' nested shape: one row per volume, books by name, chapters by number. A summary a chapter, so a volume fits a row."""
    c = F.struct("chapter", F.col("chapter_ref").alias("reference"), F.col("verse_count").cast("int").alias("verse_count"), "summary")
    books = summaries.groupBy("volume", "book").agg(F.sort_array(F.collect_list(c)).alias("chapters"))
    return books.groupBy("volume").agg(F.sort_array(F.collect_list(F.struct("book", "chapters"))).alias("books"))


def normalize_sections(df: DataFrame, book: str) -> DataFrame:
    """The sectioned format as one canonical book; already canonical input has no ``sections`` and isn't accepted twice."""
    chapter = F.transform("sections", lambda s: F.struct(s["section"].alias("chapter"), s["reference"].alias("reference"), s["verses"].alias("verses")))
    return df.select(*(c for c in df.columns if c != "sections"), F.array(F.struct(F.lit(book).alias("book"), chapter.alias("chapters"))).alias("books"))


def normalize_map(df: DataFrame, raw: str) -> DataFrame:
    """JSON objects {book: {chapter: {verse: text}}} to flat verses with built references; scalar keys are skipped."""
    top_level = F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, v: ~k.isin(*SKIP_KEYS))
    books = df.select(*(c for c in df.columns if c != raw), F.explode(top_level).alias("book", "__inner"))
    inner = books.withColumn("__c", F.from_json("__inner", "map<string,map<string,string>>")).select(*(c for c in books.columns if c != "__inner"), F.explode("__c").alias("__chapter", "__verses"))
    flat = inner.select(*(c for c in inner.columns if c != "__verses"), F.explode("__verses").alias("__verse", "text"))
    chapter, verse = F.col("__chapter").cast("int"), F.col("__verse").cast("int")
    return flat.select(*(c for c in flat.columns if c[:2] != "__" and c != "text"), chapter.alias("chapter"), verse.alias("verse"), F.format_string("%s %d:%d", "book", chapter, verse).alias("reference"), F.format_string("%s %d", "book", chapter).alias("chapter_ref"), "text")


def chapter_texts(passages: DataFrame) -> DataFrame:
    """``verse. text`` lines per chapter, in verse order, and how many."""
    lines = F.transform("verses", lambda v: F.concat(v["verse"].cast("string"), F.lit(". "), F.coalesce(v["text"], F.lit(""))))
    return chapters(passages).select("volume", "book", "chapter", "chapter_ref", F.array_join(lines, "\n").alias("body"), F.size("verses").alias("verse_count"))


def summarize(passages: DataFrame, n_terms: int = 5, shortest: int = 5) -> DataFrame:
    """The default extractive summary of each chapter: its verse count and most frequent longer words."""
    key = ["volume", "book", "chapter"]
    counts = passages.groupBy(*key).agg(F.count(F.lit(1)).alias("verse_count"))
    words = passages.select(*key, F.explode(T.tokens("text")).alias("term")).where(F.length("term") >= shortest).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    best = top(words, key, [F.desc("tf"), F.asc("term")], n_terms).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    said = F.concat(F.lit("This chapter contains "), F.col("verse_count").cast("string"), F.lit(" verses and covers "), F.coalesce("terms", F.lit("nothing")), F.lit("."))
    return counts.join(best, key, "left").select(*key, F.concat_ws(" ", "book", F.col("chapter").cast("string")).alias("chapter_ref"), "verse_count", said.alias("summary"))


def with_context(passages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each verse with its chapter's summary in the context; a chapter without one has an empty summary. Summaries must be unique per volume and chapter."""
    s = summaries.select("volume", "chapter_ref", "summary")
    joined = passages.withColumn("chapter_ref", F.concat_ws(" ", "book", F.col("chapter").cast("string"))).join(s, ["volume", "chapter_ref"], "left")
    return joined.select("volume", "book", "chapter", "verse", "reference", "text", T.contextualize("reference", "volume", "summary", "text").alias("context"))


def volume_counts(passages: DataFrame) -> DataFrame:
    """Chapters, verses and tokens per volume and a grand total row."""
    per_chapter = passages.groupBy("volume", "book", "chapter").agg(F.count(F.lit(1)).alias("v"), F.sum(T.token_count("text")).alias("t"))
    total = per_chapter.rollup("volume").agg(F.grouping("volume").alias("all"), F.count(F.lit(1)).alias("chapters"), F.sum("v").alias("verses"), F.sum("t").alias("tokens"))
    return total.select(F.when(F.col("all") == 1, "Total").otherwise(F.coalesce("volume", F.lit("Unknown"))).alias("volume"), "chapters", "verses", "tokens")
