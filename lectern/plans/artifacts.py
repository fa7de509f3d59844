"""Queries that write a sink and read it back, and queries over what models and writers are asked and say. Each takes (spark, sf_dir)."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import compare, corpus, index, metrics, report, rerank, training
from lectern.operators.relational import latest, numbered
from lectern.plans import catalog, evaluation, pipeline
from lectern.runtime import scratch, table
from lectern.sources import providers, readers, runs, storage

QUICK = ("legacy", "contextual", "contextual_rerank", "hybrid_rrf", "sparse", "dense")
STAMP = "20250101_000000"


# --- files of the corpus


def nested_books(spark: SparkSession, d: str) -> DataFrame:
    """Passages as one document per book, written and read back."""
    path = scratch(spark)
    runs.write_nested(catalog.passages(spark, d).where("volume is not null"), path, by="book")
    return readers.canonical(spark, path, None, lines=True)


def nested_chapters(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    runs.write_nested(catalog.passages(spark, d).where("volume is not null"), path)
    return readers.canonical(spark, path, None, lines=True)


def summary_files(spark: SparkSession, d: str) -> DataFrame:
    """Chapter summaries as one document per volume, written and read back."""
    path = scratch(spark)
    runs.write_summaries(corpus.summarize(catalog.passages(spark, d)), path)
    return readers.summaries(spark, path, lines=True).select("volume", "chapter_ref", F.col("verse_count").cast("long").alias("verse_count"), "summary")


def sectioned_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    c = corpus.chapters(catalog.passages(spark, d))
    c.select(F.array(F.struct(F.col("chapter").alias("section"), F.col("chapter_ref").alias("reference"), "verses")).alias("sections")).write.json(path)
    return readers.sectioned(spark, path, "Sections", lines=True).select("book", F.col("chapter").alias("section"), "verse", "reference", "text")


def mapped_files(spark: SparkSession, d: str) -> DataFrame:
    """Passages in the map format, one object per chapter and line, written and read back."""
    path = scratch(spark)
    c = corpus.chapters(catalog.passages(spark, d).where("book is not null"))
    verses = F.map_from_entries(F.transform("verses", lambda v: F.struct(v["verse"].cast("string").alias("key"), F.coalesce(v["text"], F.lit("")).alias("value"))))
    whole = F.map_from_entries(F.array(F.struct(F.col("book").alias("key"), F.create_map(F.col("chapter").cast("string"), verses).alias("value"))))
    c.select(F.to_json(whole).alias("value")).write.text(path)
    return readers.mapped(spark, path, "V", lines=True).select("book", "chapter", "verse", "reference", "text")


def context_files(spark: SparkSession, d: str) -> DataFrame:
    """Contextualized passages as {"verses": [...]} documents, one per chapter, written and read back."""
    path = scratch(spark)
    p = catalog.passages(spark, d)
    c = corpus.with_context(p, corpus.summarize(p))
    verse = F.struct("volume", "book", "chapter", "verse", "reference", "text", "context")
    c.groupBy("volume", "book", "chapter").agg(F.sort_array(F.collect_list(verse)).alias("verses")).select("verses").write.json(path)
    return readers.contextualized(spark, path, lines=True).select("reference", "text", "context")


def embedding_files(spark: SparkSession, d: str) -> DataFrame:
    """Embedded passages as Parquet in the corpus' order, written and read back: the components that aren't zero."""
    path = scratch(spark)
    p = providers.embed(catalog.passages(spark, d).select("volume", "book", "chapter", "verse", "reference", "text"), "text", name="embedding")
    runs.write_embeddings(p, path)
    return readers.embedded(spark, path).select("reference", F.posexplode("embedding").alias("slot", "x")).where("x <> 0").select("reference", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


def embedded_queries(spark: SparkSession, d: str) -> DataFrame:
    e = providers.embed(catalog.asked(spark, d).select("query_id", "query"), "query")
    return e.select("query_id", F.posexplode("vector").alias("slot", "x")).where("x <> 0").select("query_id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


def embedded_order(spark: SparkSession, d: str) -> DataFrame:
    """Passages numbered in the order of an embedding file."""
    p = catalog.passages(spark, d).select("volume", "book", "chapter", "verse", "reference")
    return numbered(p, ["volume", "book", "chapter", "verse", "reference"], "position").select("reference", "position")


def query_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    q = latest(table(spark, d, "test_queries"), "id", ["added_at", "query"])
    q.select(F.array(F.struct("id", "query", "type", "expected_volumes", "expected_topics")).alias("queries")).write.json(path)
    back = readers.query_set(spark, path, lines=True)
    return back.select("id", "query", "type", F.array_join(F.coalesce("expected_volumes", F.array().cast("array<string>")), "|").alias("volumes"), F.array_join(F.coalesce("expected_topics", F.array().cast("array<string>")), "|").alias("topics"))


def quick_queries(spark: SparkSession, d: str) -> DataFrame:
    return readers.quick_queries(spark)


def shown_queries(spark: SparkSession, d: str) -> DataFrame:
    """The queries that a quick comparison shows as examples."""
    return readers.quick_queries(spark).where(F.col("id").isin(*readers.SHOWN))


def sample_records(spark: SparkSession, d: str) -> DataFrame:
    return readers.sample_records(spark)


def run_settings(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/config.json"
    storage.write_text(path, json.dumps({"top_k": 12, "relevance_threshold": 1, "metrics": {"precision_k_values": [1, 7], "ndcg_k_values": [7, 12]}, "judge": "x"}))
    c = readers.run_config(path)
    return spark.createDataFrame([("top_k", c.top_k), ("rerank_initial_k", c.rerank_initial_k), ("rerank_top_n", c.rerank_top_n), ("relevance_threshold", c.relevance_threshold), *((f"k_{k}", k) for k in c.ks), *((k, 0) for k in c.extra)], "name string, value long")


# --- the index


def pipeline_index(spark: SparkSession, d: str) -> DataFrame:
    """The four stages run to their end, then again from the third with summaries skipped; the index that stands then."""
    path = scratch(spark)
    stages = pipeline.default_stages(lambda s: catalog.passages(s, d))
    pipeline.run(spark, stages, path, say=lambda _: None)
    pipeline.run(spark, stages, path, start=3, skip_done=True, say=lambda _: None)
    r = spark.read.parquet(f"{path}/index")
    return r.select("id", "metadata.volume", "metadata.reference", "metadata.context", "metadata.text", F.size("values").cast("long").alias("dims"))


def namespace_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Text rows upserted twice into one namespace, the second batch into another as well."""
    stored = table(spark, d, "index_records").select(F.col("id").alias("_id"), F.col("metadata.text").alias("content"), "upserted_at")
    early = F.col("upserted_at") < catalog.CUT
    put = lambda ix, rows, ns: index.upsert(ix, index.text_records(rows, ns), ["upserted_at", "text"], ["namespace", "id"])
    ix = index.text_records(stored.limit(0), "main")
    for rows, ns in ((stored.where(early), "main"), (stored.where(~early), "main"), (stored.where(~early), "late")):
        ix = put(ix, rows, ns)
    return ix.select("namespace", "id", "text")


# --- hits


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "query", "method", "rank", "id", "score", "text", "reference", "volume", "context", "source")


def dense_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the dense search, as documents."""
    return _found(catalog._retrieval(spark, d).dense(20))


def sparse_hits(spark: SparkSession, d: str) -> DataFrame:
    return _found(catalog._retrieval(spark, d).sparse(20)).withColumn("score", F.round("score", 6))


def integrated_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A search with its reranking: the best ten of 150."""
    return catalog._retrieval(spark, d).contextual_rerank(150, 10).select("query_id", "rank", "id", "score", "original_rank")


def custom_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The custom reranker's method, with a model of pairs that scores in batches."""
    r = catalog._retrieval(spark, d)
    r.custom = providers.batched_scorer(lambda: providers.word_jaccard)
    return r.contextual_custom_rerank().select("query_id", "method", "rank", "id", "score", "original_rank")


def full_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Stored lists reranked at the depths of the composed methods: 150 scored and 20 kept of contextual hits, 50 and 20 of fused ones."""
    one = rerank.rerank(catalog._hits(spark, d, "contextual"), 20, initial=150).select("query_id", F.lit("contextual").alias("list"), "reference", "score", "rank", "original_rank")
    two = rerank.rerank(catalog._fused(spark, d, 50).drop("score").withColumnRenamed("rrf_score", "score"), 20).select("query_id", F.lit("fused").alias("list"), "reference", "score", "rank", "original_rank")
    return one.union(two).select("query_id", "list", "reference", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), F.col("original_rank").cast("long").alias("original_rank"))


def page_content(spark: SparkSession, d: str) -> DataFrame:
    """Stored hits in the mapping of a search's answer, written and read back."""
    path = scratch(spark)
    hits = catalog.lists(spark, d, "contextual").withColumn("volume", F.lit("V"))
    runs.write_page_content(hits, path)
    back = spark.read.schema("query_id string, rank int, pageContent string, metadata struct<reference:string,volume:string,score:double>").json(path)
    return back.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("pageContent").alias("page_content"), "metadata.reference", "metadata.volume", F.round("metadata.score", 6).alias("score"))


def hit_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first five hits of each list as they are printed."""
    lines = evaluation.top_lines(catalog.lists(spark, d, *QUICK), 5)
    return lines.select("query_id", "method", F.array_join("lines", " / ").alias("lines"))


# --- runs and reports


def _quick(spark: SparkSession, d: str) -> DataFrame:
    lat = latest(table(spark, d, "retrieval_results"), "result_id", ["run_at"]).where(F.col("method").isin(*QUICK)).select("query_id", "method", "latency_ms")
    return evaluation.quick_comparison(catalog.lists(spark, d, *QUICK), lat)


def quick_files(spark: SparkSession, d: str) -> DataFrame:
    """The quick comparison, written and read back."""
    path = scratch(spark)
    runs.write_quick(evaluation.top_lines(catalog.lists(spark, d, *QUICK), 5), _quick(spark, d), path)
    back = spark.read.schema("method string, mean_latency_ms double, mean_overlap double").json(f"{path}/summary")
    return back.select("method", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("mean_overlap", 6).alias("mean_overlap"))


def run_files(spark: SparkSession, d: str) -> DataFrame:
    """The artifacts of a run, written into a new run folder; the newest one is looked up and its metrics read back."""
    root = scratch(spark)
    judged = catalog.judged(spark, d)
    hits = judged.where("rank is not null")
    queries = metrics.per_query(judged)
    methods = metrics.aggregate(queries)
    runs.write_run(runs.new_run(root), hits, hits.select("method", "query_id", "rank", "id", "grade"), methods, compare.paired_tests(compare.by_query(queries)))
    got = runs.read_run(spark, runs.latest_run(root))
    n = reduce(DataFrame.union, (got[name].groupBy("method").agg(F.count(F.lit(1)).alias("n")).select("method", F.lit(name).alias("artifact"), "n") for name in ("raw", "judgments", "metrics")))
    tests = got["comparisons"].groupBy(F.col("method_a").alias("method")).agg(F.count(F.lit(1)).alias("n")).select("method", F.lit("comparisons").alias("artifact"), "n")
    return n.union(tests).join(got["metrics"].select("method", F.round("mrr", 6).alias("mrr")), "method", "left").select("method", "artifact", "n", "mrr")


def run_stamps(spark: SparkSession, d: str) -> DataFrame:
    """The stamp that a run of each stored result would have."""
    return catalog.results(spark, d).select("run_id", F.date_format("run_at", "yyyyMMdd_HHmmss").alias("stamp"))


def relevance_tests(spark: SparkSession, d: str) -> DataFrame:
    """The paired tests of one metric, as a run prints them."""
    t = catalog.comparison_matrix(spark, d).where("metric = 'avg_relevance'")
    return t.select("method_a", "method_b", F.format_string("%+.1f%%", "improvement_pct").alias("change"), "p_value", "significant")


def improvement_report(spark: SparkSession, d: str) -> DataFrame:
    r = report.improvement_lines(metrics.aggregate(catalog._queries_table(spark, d)))
    return r.select(F.col("step").cast("long").alias("step"), F.col("row").cast("long").alias("row"), "line")


def type_report(spark: SparkSession, d: str) -> DataFrame:
    return report.type_lines(catalog.by_type(spark, d))


def report_file(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown report, written and read back: its table."""
    path = f"{scratch(spark)}/report.md"
    queries = catalog._queries_table(spark, d)
    methods = metrics.aggregate(queries)
    storage.write_text(path, report.full("run", methods, queries, ["legacy", "contextual", "contextual_rerank", "absent"], "now", compare.by_type(queries), compare.worst_queries(queries)))
    return spark.read.text(path).where("value like '| %' and value not like '| ---%'").select(F.col("value").alias("line"))


# --- prompts, writers, training sets


def summary_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.chapter_texts(catalog.passages(spark, d).where("volume is not null"))
    p = T.summary_prompt(T.unit_type("volume"), F.col("volume"), F.col("book"), F.col("chapter"), F.col("chapter_ref"), F.col("verse_count"), F.col("body"))
    return t.select("volume", "chapter_ref", F.md5(p).alias("prompt_md5"))


def written_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Chapter summaries by a writer; this one says how long its prompt is."""
    s = evaluation.summarize_with(catalog.passages(spark, d).where("volume is not null"), lambda prompts: [f"A text of {len(p)} characters." for p in prompts])
    return s.select("volume", "chapter_ref", F.col("verse_count").cast("long").alias("verse_count"), "summary")


def written_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by a writer from the first hits; this one names the references it was given."""
    hits = catalog.lists(spark, d, "contextual")
    asked = hits.groupBy("query_id").agg(F.min("query").alias("query"))
    cite = lambda prompts: ["; ".join(line[1:].split("]: ")[0] for line in p.split("\n") if line.startswith("[")) for p in prompts]
    return providers.answer_with(hits, asked, cite, 4)


def cited_answers(spark: SparkSession, d: str) -> DataFrame:
    """The default answer: the first three hits with their references."""
    return providers.extractive_answer(catalog.lists(spark, d, "contextual"))


def judged_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses judged in five respects; this judge grades by the length of what it was asked."""
    hits = catalog.results(spark, d).where("method = 'contextual' and size(documents) > 0")
    rows = hits.select(F.col("run_id").cast("string").alias("query_id"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce(F.col("documents")[0]["text"], F.lit("")).alias("response"), "documents")
    said = lambda prompts: [json.dumps({"completeness": len(p) % 5, "overall": str(len(p) % 3), "notes": "seen"}) if len(p) % 7 else "no" for p in prompts]
    return evaluation.judge_responses(rows, said)


def query_pool(spark: SparkSession, d: str) -> DataFrame:
    """The test queries and 120 written ones, repeats kept."""
    def writer(prompts: list[str]) -> list[str]:
        return [f"Here: {json.dumps([{'query': f'written {n}', 'type': 'thematic'} for n in range(int(p.split()[1]))])} done" for p in prompts]

    made = providers.generate_queries(spark, writer, 120)
    return catalog.asked(spark, d).where("query is not null").select("query", "type").union(made)


def training_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the five forms of a training set and of its statistics, written and read back."""
    path = scratch(spark)
    e = catalog.rows(spark, d).where("query is not null and document is not null").select("row_id", "query", "document", "reference", "label", "raw_score", "query_type", "reasoning")
    runs.write_training_set(e, path, "row_id", STAMP)
    folder = runs.latest_training_set(path)
    forms = {
        "json": spark.read.schema(f"row_id string, {readers.EXAMPLE}").json(f"{path}/training_data_{STAMP}.json"), "parquet": readers.training_set(spark, f"{path}/training_data_{STAMP}.parquet"), "pairs": spark.read.parquet(f"{path}/pairs_{STAMP}"),
        "text": spark.read.text(f"{path}/training_data_{STAMP}.csv"), "train": spark.read.parquet(folder).where("split = 'train'"), "test": spark.read.parquet(folder).where("split = 'test'"), "renamed": readers.training_set(spark, f"{path}/training_data_{STAMP}.parquet", pair_names=True).where("text1 is not null"),
    }
    stats = json.loads(storage.read_text(f"{path}/training_stats_{STAMP}.json"))
    counts = reduce(DataFrame.union, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("form"), "n") for name, df in forms.items()))
    return counts.union(spark.createDataFrame([(f"stats_{k}", stats[k]) for k in ("total_examples", "unique_queries", "train_examples", "test_examples")], "form string, n long"))


def eval_head(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred evaluation samples, by query."""
    e = catalog.eval_samples(spark, d)
    return e.orderBy("query").limit(100).select("query", "n_positive", "n_documents")


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Training rows scored by a model of pairs in batches."""
    r = catalog.rows(spark, d).where("query is not null and document is not null")
    score = providers.batched_scorer(lambda: providers.word_jaccard, batch=7)
    return r.select("row_id", F.round(score(F.col("query"), F.col("document")), 6).alias("score"))


def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Training rows as pairs with soft labels."""
    r = catalog.rows(spark, d).where("query is not null and document is not null").withColumn("label", training.soft_label(F.col("raw_score")))
    return training.pairs(r)


_ALL = (
    nested_books, nested_chapters, summary_files, sectioned_files, mapped_files, context_files, embedding_files, embedded_queries, embedded_order, query_files, quick_queries, shown_queries, sample_records, run_settings, pipeline_index, namespace_upsert,
    dense_hits, sparse_hits, integrated_rerank, custom_rerank, full_rerank, page_content, hit_lines, quick_files, run_files, run_stamps, relevance_tests, improvement_report, type_report, report_file,
    summary_prompts, written_summaries, written_answers, cited_answers, judged_responses, query_pool, training_files, eval_head, scored_pairs, label_pairs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
