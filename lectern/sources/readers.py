"""Readers of all input shapes; every schema is explicit."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import corpus
from lectern.sources import storage

PASSAGE = "volume string, book string, chapter int, verse int, reference string, text string, context string"
QUERY = "id string, query string, type string, expected_volumes array<string>, expected_topics array<string>"
EXAMPLE = "query string, document string, reference string, label double, raw_score bigint, query_type string, reasoning string"
HIT = "query_id string, method string, rank int, id string, score double, text string, reference string, volume string, context string, source string"
#: A small labelled set to try an index with, and queries of four kinds.
SAMPLES = [
    ("rec1", "The keeper lit the tower before dawn.", "place"), ("rec2", "Bread was shared at the river crossing.", "food"), ("rec3", "A promise was written on the gate.", "covenant"), ("rec4", "Weavers sang while the rain fell.", "music"),
    ("rec5", "The old bridge carried carts until the flood.", "place"), ("rec6", "Figs were dried on the flat roofs.", "food"), ("rec7", "Two villages swore to share one well.", "covenant"), ("rec8", "A horn answered from the far hill.", "music"),
    ("rec9", "Lanterns marked the path to the harbour.", "place"), ("rec10", "Salt was weighed against barley.", "food"), ("rec11", "The elders kept the sealed letter.", "covenant"), ("rec12", "Children learned the harvest song.", "music"),
]
QUICK_QUERIES = [
    ("exact_1", "the keeper lit the tower", "exact_phrase"), ("exact_2", "promise written on the gate", "exact_phrase"), ("exact_3", "salt was weighed against barley", "exact_phrase"),
    ("semantic_1", "why do weavers sing in the rain", "semantic"), ("semantic_2", "how did people cross the water", "semantic"), ("semantic_3", "what lights the way at night", "semantic"),
    ("doctrinal_1", "what does sharing bread mean", "doctrinal"), ("doctrinal_2", "why are oaths kept", "doctrinal"), ("doctrinal_3", "what is owed to a stranger", "doctrinal"),
    ("character_1", "who kept the tower", "character"), ("character_2", "who kept the sealed letter", "character"),
]
#: One query of each of three kinds, shown as examples.
SHOWN = ("exact_1", "semantic_1", "doctrinal_1")


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One document per file, or with ``lines`` one per line, which large folders of many documents should have."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def canonical(spark: SparkSession, path: str, volume: str | None, lines: bool = False) -> DataFrame:
    """Flat verses of a canonical corpus file or folder; without a ``volume`` that of the documents or their folder's name counts."""
    if volume is None:
        return corpus.flatten(_json(spark, path, f"{corpus.CANONICAL}, volume string", lines))
    return corpus.flatten(_json(spark, path, corpus.CANONICAL, lines), F.lit(volume))


def sectioned(spark: SparkSession, path: str, volume: str, lines: bool = False) -> DataFrame:
    """Flat verses of a sectioned corpus; a file without sections (one already canonical) gives none rather than being overwritten."""
    return corpus.flatten(corpus.normalize_sections(_json(spark, path, corpus.SECTIONED, lines).where("sections is not null"), volume), F.lit(volume))


def mapped(spark: SparkSession, path: str, volume: str, lines: bool = False) -> DataFrame:
    """Flat verses of the {book: {chapter: {verse: text}}} format."""
    raw = spark.read.text(path, wholetext=not lines).select(F.lit(volume).alias("volume"), F.col("value").alias("raw"))
    return corpus.normalize_map(raw, "raw").select("volume", "book", "chapter", "verse", "reference", "text")


def summaries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return corpus.flatten_summaries(_json(spark, path, corpus.SUMMARIES, lines))


def contextualized(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Passages from {"verses": [...]} documents."""
    return _json(spark, path, f"verses array<struct<{_as_struct(PASSAGE)}>>", lines).select(F.inline("verses"))


def embedded(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Embedded passages: Parquet, or {"embeddings": [...]} documents."""
    if lines or path.rstrip("/").endswith(".json"):
        return _json(spark, path, f"embeddings array<struct<{_as_struct(PASSAGE)}, embedding: array<float>>>", lines).select(F.inline("embeddings"))
    return spark.read.parquet(path)


def _as_struct(ddl: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in ddl.split(", "))


def query_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The ``queries`` array of a query file."""
    return _json(spark, path, f"queries array<struct<{_as_struct(QUERY)}>>", lines).select(F.inline("queries"))


def quick_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUICK_QUERIES, "id string, query string, type string")


def sample_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, "_id string, content string, category string")


def training_set(spark: SparkSession, path: str, pair_names: bool = False) -> DataFrame:
    """Examples from Parquet or JSON; with ``pair_names`` as (text1, text2, label)."""
    df = spark.read.schema(EXAMPLE).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return df.withColumnsRenamed({"query": "text1", "document": "text2"}).select("text1", "text2", "label") if pair_names else df


@dataclass(frozen=True)
class RunConfig:
    """Settings of an evaluation run; both k lists count for both metrics."""

    top_k: int = 20
    rerank_initial_k: int = 150
    rerank_top_n: int = 20
    relevance_threshold: int = 2
    precision_k_values: tuple[int, ...] = (1, 3, 5, 10, 20)
    ndcg_k_values: tuple[int, ...] = (5, 10, 20)
    extra: dict = field(default_factory=dict)

    @property
    def ks(self) -> tuple[int, ...]:
        return tuple(sorted({*self.precision_k_values, *self.ndcg_k_values}))


def run_config(path: str) -> RunConfig:
    raw = json.loads(storage.read_text(path))
    metrics = raw.pop("metrics", {})
    known = {k: raw.pop(k) for k in ("top_k", "rerank_initial_k", "rerank_top_n", "relevance_threshold") if k in raw}
    lists = {k: tuple(metrics[k]) for k in ("precision_k_values", "ndcg_k_values") if k in metrics}
    return RunConfig(**known, **lists, extra=raw)


def missing_settings(names: Iterable[str]) -> list[str]:
    """Those environment settings that are unset or empty."""
    return [n for n in names if not os.environ.get(n)]
