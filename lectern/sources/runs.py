"""Run folders, and the artifacts of evaluation runs and training sets."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import training
from lectern.sources import storage

STAMP = "%Y%m%d_%H%M%S"


def new_run(root: str, now: datetime | None = None) -> str:
    """A new folder run_<stamp> under ``root``."""
    path = f"{root.rstrip('/')}/run_{(now or datetime.now()).strftime(STAMP)}"
    storage.make_dir(path)
    return path


def latest_run(root: str) -> str | None:
    """The run folder with the greatest name."""
    found = [e.name for e in storage.entries(root) if e.is_dir and e.name.startswith("run_")]
    return f"{root.rstrip('/')}/{max(found)}" if found else None


def latest_training_set(root: str) -> str | None:
    """The newest data set folder, else the newest JSON file, by change time."""
    there = storage.entries(root)
    for found in ([e for e in there if e.is_dir and "dataset" in e.name], [e for e in there if e.name.startswith("training_data_") and e.name.endswith(".json")]):
        if found:
            return f"{root.rstrip('/')}/{max(found, key=lambda e: (e.changed, e.name)).name}"
    return None


def write_run(path: str, hits: DataFrame, judgments: DataFrame, metrics: DataFrame, comparisons: DataFrame) -> None:
    """Raw hits by method, judgments, metrics and comparisons as JSON lines."""
    hits.write.mode("overwrite").partitionBy("method").json(f"{path}/raw")
    judgments.write.mode("overwrite").json(f"{path}/judgments")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    comparisons.write.mode("overwrite").json(f"{path}/comparisons")


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Those artifacts of a run that are there."""
    return {p: spark.read.json(f"{path}/{p}") for p in ("raw", "judgments", "metrics", "comparisons") if storage.complete(f"{path}/{p}")}


def write_nested(passages: DataFrame, path: str, by: str = "chapter") -> None:
    """Canonical documents, one per line, in folders by volume: a line for each ``chapter``, which no book's size touches, or for each ``book``."""
    from lectern.operators import corpus

    nested = corpus.nest(passages) if by == "chapter" else corpus.nest_books(passages)
    nested.write.mode("overwrite").partitionBy("volume").json(path)


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Chapter summaries as one document per volume, books by name and chapters by number."""
    from lectern.operators import corpus

    corpus.nest_summaries(summaries).write.mode("overwrite").json(path)


def write_passages(passages: DataFrame, path: str, also_json: bool = False) -> None:
    passages.write.mode("overwrite").parquet(path)
    if also_json:
        passages.write.mode("overwrite").json(path.rstrip("/") + "-json")


def write_embeddings(embedded: DataFrame, path: str) -> None:
    """Embedded passages as Parquet in the order of the corpus: volume, book, chapter, verse."""
    embedded.orderBy("volume", "book", "chapter", "verse").write.mode("overwrite").parquet(path)


def write_training_set(examples: DataFrame, path: str, key: str, stamp: str) -> None:
    """Five forms of a training set and its statistics: full JSON, Parquet split into train and test, one Parquet, pairs, tab-separated text."""
    parts = training.split(examples, key).withColumn("split", F.when(F.col("test"), "test").otherwise("train")).drop("test")
    examples.write.mode("overwrite").json(f"{path}/training_data_{stamp}.json")
    parts.write.mode("overwrite").partitionBy("split").parquet(f"{path}/dataset_{stamp}")
    examples.write.mode("overwrite").parquet(f"{path}/training_data_{stamp}.parquet")
    training.pairs(examples).write.mode("overwrite").parquet(f"{path}/pairs_{stamp}")
    training.tsv_lines(examples.withColumnRenamed("raw_score", "score"), key).select("line").write.mode("overwrite").text(f"{path}/training_data_{stamp}.csv")
    stats = training.dataset_stats(examples, "raw_score").first().asDict()
    types = {r["t"]: r["count"] for r in training.shares(examples, F.coalesce(training.query_type_key(F.col("query_type")), F.lit("unknown")), "t").collect()}
    sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    out = {"total_examples": stats["total_examples"], "unique_queries": stats["unique_queries"], "train_examples": sizes.get("train", 0), "test_examples": sizes.get("test", 0), "score_distribution": {str(s): stats[f"score_{s}"] for s in range(4)}, "query_type_distribution": types, "timestamp": stamp}
    storage.write_text(f"{path}/training_stats_{stamp}.json", json.dumps(out, indent=2, ensure_ascii=False))


def page_content(hits: DataFrame) -> DataFrame:
    """Hits as (query_id, rank, pageContent, metadata)."""
    return hits.select("query_id", "rank", F.col("text").alias("pageContent"), F.struct("reference", "volume", "score").alias("metadata"))


def write_page_content(hits: DataFrame, path: str) -> None:
    """Hits as JSON lines of (query_id, rank, pageContent, metadata)."""
    page_content(hits).write.mode("overwrite").json(path)


def write_quick(hits: DataFrame, summary: DataFrame, path: str) -> None:
    """The quick comparison: a line of first hits for each query and method, and the summary by method, as JSON lines."""
    hits.write.mode("overwrite").json(f"{path}/queries")
    summary.write.mode("overwrite").json(f"{path}/summary")
