"""The evaluation run, the quick comparison and the making of a training set, end to end."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import compare, corpus, judge, metrics, training
from lectern.plans.methods import Retrieval
from lectern.runtime import materialize
from lectern.sources import providers, runs
from lectern.sources.readers import RunConfig


@dataclass
class Evaluation:
    """hits: graded, one row per method, query and rank; queries: metrics per query; methods: per method; comparisons: paired tests."""

    hits: DataFrame
    queries: DataFrame
    methods: DataFrame
    comparisons: DataFrame

    def write(self, path: str) -> None:
        judgments = self.hits.where("rank is not null").select("method", "query_id", "rank", "id", F.col("grade").alias("score"), "reasoning")
        runs.write_run(path, self.hits.where("rank is not null"), judgments, self.methods, self.comparisons)


def evaluate(hits: DataFrame, asked: DataFrame, grade: judge.Judge = judge.overlap_judge, config: RunConfig | None = None, latencies: DataFrame | None = None, pairs: tuple[tuple[str, str], ...] = compare.PAIRS) -> Evaluation:
    """``hits``: method, query_id, rank, id, reference, text. ``asked``: query_id, query. ``latencies``: method, query_id, latency_ms.

    Every (query, text) is judged once, whichever methods found it. A query for which a method found nothing counts as an
    empty list. The judged hits have four consumers and are written to the shared folder first.
    """
    config = config or RunConfig()
    judged = judge.judge_pairs(hits.where(F.col("rank") <= config.top_k).select("method", "query_id", "rank", "id", "reference", "text").join(asked, "query_id"), grade)
    every = asked.crossJoin(F.broadcast(hits.select("method").distinct()))  # a handful of methods for each query
    if latencies is None:
        every = every.withColumn("latency_ms", F.lit(None).cast("double"))
    else:
        every = every.join(latencies, ["method", "query_id"], "left")
    found = judged.select("method", "query_id", "rank", "id", "reference", F.col("score").alias("grade"), "reasoning")
    graded = materialize(every.join(found, ["method", "query_id"], "left").withColumn("run_id", F.concat_ws("|", "method", "query_id")))
    per_query = metrics.per_query(graded, config.ks, config.relevance_threshold)
    named = tuple(m for m in compare.METRICS if m in per_query.columns)
    return Evaluation(graded, per_query, metrics.aggregate(per_query, config.ks), compare.paired_tests(compare.by_query(per_query, named), pairs))


def timed(methods: dict[str, Callable[[], DataFrame]], asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run each method once for all queries; its hits, and its wall time spread evenly over the queries."""
    spark, n = asked.sparkSession, max(1, asked.count())
    hits, took = None, []
    for name, make in methods.items():
        began = time.perf_counter()
        part = materialize(make().withColumn("method", F.lit(name)).select("query_id", "method", "rank", "id", "score", "reference", "text"))
        took.append((name, (time.perf_counter() - began) * 1000 / n))
        hits = part if hits is None else hits.unionByName(part)
    lat = spark.createDataFrame(took, "method string, latency_ms double")
    return hits, asked.select("query_id").crossJoin(lat)  # a handful of methods for each query


def quick_comparison(hits: DataFrame, latencies: DataFrame, baseline: str = "contextual_rerank", k: int = 10) -> DataFrame:
    """(method, mean_latency_ms, mean_overlap) without any judge; the baseline has no overlap with itself."""
    shared = compare.overlap(hits, baseline, k).groupBy("method").agg(F.avg("overlap").alias("mean_overlap"))
    return latencies.groupBy("method").agg(F.avg("latency_ms").alias("mean_latency_ms")).join(shared, "method", "left")


def top_lines(hits: DataFrame, n: int = 5) -> DataFrame:
    """The first n hits of each query and method as formatted lines."""
    line = T.scored_label("reference", "score", F.lit(False))
    return hits.where(F.col("rank") <= n).groupBy("query_id", "method").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))


def judge_responses(responses: DataFrame, writer: providers.Writer) -> DataFrame:
    """``responses`` (query_id, query, response, documents) with five grades and notes by a writer that answers in JSON."""
    asked = responses.withColumn("prompt", T.response_prompt(F.col("query"), F.col("response"), F.col("documents"))).select("query_id", "prompt")
    said = providers.write_texts(asked, "prompt", writer, "answer").select("query_id", T.parse_response("answer").alias("j"))
    return said.select("query_id", "j.*")


def summarize_with(passages: DataFrame, writer: providers.Writer) -> DataFrame:
    """Chapter summaries by a writer: one prompt per chapter."""
    t = corpus.chapter_texts(passages)
    prompt = T.summary_prompt(T.unit_type(F.coalesce("volume", F.lit(""))), F.coalesce("volume", F.lit("Unknown")), F.col("book"), F.col("chapter"), F.col("chapter_ref"), F.col("verse_count"), F.col("body"))
    said = providers.write_texts(t.select("volume", "book", "chapter", "chapter_ref", "verse_count", prompt.alias("prompt")), "prompt", writer, "summary")
    return said.drop("prompt")


def build_training_set(retrieval: Retrieval, asked: DataFrame, k: int = 50, grade: judge.Judge = judge.overlap_judge) -> DataFrame:
    """(example_id, query, document, reference, label, raw_score, query_type, reasoning) of the k candidates of each query; ``asked`` has query_id, query, type.

    Queries of equal text count once, the first id stands for them.
    """
    once = asked.groupBy("query").agg(F.min_by("type", "query_id").alias("type"), F.min("query_id").alias("query_id"))
    found = retrieval.contextual(k).join(once.select("query_id", "type"), "query_id")
    judged = judge.judge_pairs(found.drop("score"), grade, lenient=True)
    return judged.select(
        F.concat_ws("|", "query_id", "id").alias("example_id"), "query", F.col("text").alias("document"), "reference", (F.col("score") / 3.0).alias("label"), F.col("score").cast("long").alias("raw_score"), training.query_type_key(F.col("type")).alias("query_type"), "reasoning"
    )


def save_reranker(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_reranker(path: str | None) -> PipelineModel | None:
    """The saved model, or none if there is no path or it can't be read."""
    if not path:
        return None
    try:
        return PipelineModel.load(path)
    except Exception:
        return None
