"""All queries of the core, by name. Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import compare, corpus, dense, fusion, index, judge, metrics, report, rerank, sparse, training
from lectern.operators.relational import batches, latest
from lectern.plans import evaluation, oracle, oracle_artifacts, oracle_search
from lectern.plans.methods import Retrieval
from lectern.runtime import table
from lectern.sources.readers import RunConfig

CUT = "2025-07-01 00:00:00"


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def passages(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "passages"), "reference", ["loaded_at", "text", "context"])


def results(spark: SparkSession, d: str) -> DataFrame:
    r = latest(table(spark, d, "retrieval_results"), "result_id", ["run_at"])
    return r.withColumnRenamed("result_id", "run_id")


def lists(spark: SparkSession, d: str, *methods: str) -> DataFrame:
    """The hits of the newest run of each query and method."""
    r = results(spark, d).where(F.col("method").isin(*methods)).groupBy("query_id", "method").agg(F.max_by(F.struct("query", "documents"), F.struct("run_at", "run_id")).alias("x"))
    hits = r.select("query_id", "method", F.col("x.query").alias("query"), F.explode("x.documents").alias("h"))
    return hits.select("query_id", "query", "method", F.col("h.rank").alias("rank"), F.col("h.id").alias("id"), F.col("h.score").alias("score"), F.col("h.text").alias("text"), F.col("h.reference").alias("reference"))


def examples(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "training_examples"), "example_id", ["generated_at", "document_id"])


def rows(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "training_rows"), "row_id", ["loaded_at", "query", "document"])


def asked(spark: SparkSession, d: str) -> DataFrame:
    q = latest(table(spark, d, "test_queries"), "id", ["added_at", "query"])
    return q.select(F.col("id").alias("query_id"), "query", "type")


def judged(spark: SparkSession, d: str) -> DataFrame:
    return judge.grade_results(results(spark, d), judge.grades_by_document(examples(spark, d)))


def _queries_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(judged(spark, d))


# --- corpus


def flatten_passages(spark, d):
    return corpus.flatten(corpus.nest(passages(spark, d)))


def chapter_text(spark, d):
    return corpus.chapter_texts(passages(spark, d)).select("volume", "chapter_ref", "verse_count", "body")


def chapter_counts(spark, d):
    return corpus.volume_counts(passages(spark, d)).select("volume", "chapters", "verses")


def chapter_summaries(spark, d):
    return corpus.summarize(passages(spark, d)).select("volume", "chapter_ref", F.col("verse_count").cast("long").alias("verse_count"), "summary")


def contextualize(spark, d):
    p = passages(spark, d)
    return corpus.with_context(p, corpus.summarize(p)).select("reference", "context")


def context_extract(spark, d):
    return passages(spark, d).select("reference", T.context_or_default("context").alias("context"))


def slug_ids(spark, d):
    return passages(spark, d).select("reference", T.slug("reference").alias("slug"))


def display_names(spark, d):
    file = F.concat(F.replace(F.lower("volume"), F.lit(" "), F.lit("-")), F.lit(".json"))
    v = table(spark, d, "passages").where("volume is not null").select("volume", file.alias("file")).distinct()
    return v.select("volume", T.display_name("file").alias("display_name"), T.summary_file_name("file").alias("summary_file"), T.unit_type("volume").alias("unit"), F.initcap(T.unit_type("volume")).alias("unit_title"))


def token_counts_rollup(spark, d):
    return corpus.volume_counts(passages(spark, d)).select("volume", "verses", "tokens")


def normalize_sections(spark, d):
    c = corpus.chapters(passages(spark, d))
    docs = c.select("volume", "book", F.array(F.struct(F.col("chapter").alias("section"), F.col("chapter_ref").alias("reference"), "verses")).alias("sections"))
    return corpus.flatten(corpus.normalize_sections(docs, "Sections")).select("book", F.col("chapter").alias("section"), "verse", "reference", "text")


def normalize_map(spark, d):
    c = corpus.chapters(passages(spark, d))
    verses = F.map_from_entries(F.transform("verses", lambda v: F.struct(v["verse"].cast("string").alias("key"), F.coalesce(v["text"], F.lit("")).alias("value"))))
    inner = F.to_json(F.create_map(F.col("chapter").cast("string"), verses))
    raw = F.concat(F.lit('{"version": 3, "last_modified": "2025-01-01", '), F.regexp_extract(F.to_json(F.create_map("book", F.lit("@"))), r'^\{(.*):"@"\}$', 1), F.lit(": "), inner, F.lit("}"))
    return corpus.normalize_map(c.select("volume", raw.alias("raw")), "raw").select("volume", "book", "chapter", "verse", "reference", "text")


def batch_assignment(spark, d):
    return batches(passages(spark, d).select("reference"), ["reference"], 100).select("reference", "batch")


# --- index


def index_records(spark, d):
    r = index.records(passages(spark, d))
    return r.select("id", "metadata.volume", "metadata.reference", "metadata.context", "metadata.text")


def _stored(spark, d):
    return table(spark, d, "index_records").select("id", F.col("metadata.volume").alias("volume"), F.col("metadata.text").alias("text"), "upserted_at")


def upsert_merge(spark, d):
    stored, early = _stored(spark, d), F.col("upserted_at") < CUT
    first = index.upsert(stored.limit(0), stored.where(early), ["upserted_at", "text"])
    return index.upsert(first, stored.where(~early), ["upserted_at", "text"]).select("id", "text", F.date_format("upserted_at", "yyyy-MM-dd HH:mm:ss").alias("upserted_at"))


def index_stats(spark, d):
    return index.stats(latest(_stored(spark, d), "id", ["upserted_at", "text"]), "volume")


# --- retrieval


def dense_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = dense.cosine_topk(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 10)
    return out.select("query_id", F.col("id").alias("vec_id"), _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def lsh_topk(spark, d):
    """Neighbours with a cosine of 0.8 or more; queries are the ids whose hash is divisible by 20."""
    v = latest(table(spark, d, "index_records").select("id", "values", "upserted_at"), "id", ["upserted_at", "values"]).where(F.size("values") == 96).select("id", F.col("values").alias("vector"))
    asked_ = v.where(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 20 == 0).withColumnRenamed("id", "query_id")
    out = dense.lsh_topk(asked_, v, 10, math.sqrt(0.4))
    return out.select("query_id", "id", _r("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def inverted_index(spark, d):
    return sparse.inverted_index(passages(spark, d), "reference").select("term", F.col("id").alias("reference"), F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def bm25_topk(spark, d):
    out = sparse.bm25_topk(asked(spark, d), passages(spark, d), 10, id_col="reference")
    return out.select("query_id", F.col("id").alias("reference"), _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def _both_lists(spark, d):
    return lists(spark, d, "sparse", "dense").withColumnRenamed("method", "source")


def _fused(spark, d, limit=None):
    return fusion.fuse(_both_lists(spark, d), {"sparse": 1.0, "dense": 1.2}, 60, limit)


def rrf_fusion(spark, d):
    f = _fused(spark, d)
    return f.select("query_id", "reference", _r("rrf_score").alias("rrf_score"), F.array_join("sources", ",").alias("sources"), F.col("source_ranks")["sparse"].cast("long").alias("sparse_rank"), F.col("source_ranks")["dense"].cast("long").alias("dense_rank"), "in_both", "id", F.col("rank").cast("long").alias("rank"))


def hybrid_rrf(spark, d):
    whole = _fused(spark, d)
    n = fusion.counts(_both_lists(spark, d))
    fused = whole.withColumn("fusion_count", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where("rank <= 20")
    return fused.join(n, "query_id").select("query_id", "reference", _r("rrf_score").alias("rrf_score"), F.col("rank").cast("long").alias("rank"), "sparse_count", "dense_count", "fusion_count", T.scored_label("reference", "rrf_score", "in_both").alias("label"))


def _hits(spark, d, method):
    return lists(spark, d, method)


def rerank_topn(spark, d):
    r = rerank.rerank(_hits(spark, d, "contextual"), 20, initial=150)
    return r.select("query_id", "id", "reference", _r("score").alias("score"), F.col("rank").cast("long").alias("rank"), F.col("original_rank").cast("long").alias("original_rank"), _r("original_score").alias("original_score"))


def hybrid_rerank(spark, d):
    f = _fused(spark, d, 50).drop("score").withColumnRenamed("rrf_score", "score")
    r = rerank.rerank(f, 20)
    return r.select("query_id", "reference", _r("score").alias("rerank_score"), F.col("rank").cast("long").alias("rank"), F.col("original_rank").cast("long").alias("original_rank"), _r("original_score").alias("original_score"), F.array_join("sources", ",").alias("original_sources"))


def _retrieval(spark, d):
    p = passages(spark, d).select(F.col("reference").alias("id"), "text", "context", "reference", "volume")
    return Retrieval(p, asked(spark, d))


def retrieve_all(spark, d):
    """All five methods; their ids are the passages' references."""
    return _retrieval(spark, d).retrieve_all()


def legacy_vs_contextual(spark, d):
    r = _retrieval(spark, d)
    return r.legacy(10).unionByName(r.contextual(10)).select("query_id", "method", "rank", "id", "score")


def small_hybrid(spark, d):
    return _rounded(_retrieval(spark, d).small_hybrid().withColumn("original_sources", F.array_join("original_sources", ",")))


def evaluation_run(spark, d):
    """Retrieval, judging and metrics of five methods over all test queries, at the depths of the run's settings."""
    r, q, c = _retrieval(spark, d), asked(spark, d).select("query_id", "query").where("query is not null"), RunConfig()
    r.hold("context", max(c.top_k, c.rerank_initial_k))
    r.hold("sparse", 75)
    made = [r.legacy(c.top_k), r.contextual(c.top_k), r.contextual_rerank(c.rerank_initial_k, c.rerank_top_n), r.hybrid_rrf(n=c.top_k), r.hybrid_rerank(n=c.rerank_top_n)]
    hits = reduce(DataFrame.unionByName, (m.select("method", "query_id", "rank", "id", "reference", "text") for m in made))
    return _rounded(evaluation.evaluate(hits, q, config=c).comparisons)


def built_training_set(spark, d):
    """Candidates of all test queries, judged and labelled."""
    q = latest(table(spark, d, "test_queries"), "id", ["added_at", "query"]).where("query is not null").select(F.col("id").alias("query_id"), "query", "type")
    return _rounded(evaluation.build_training_set(_retrieval(spark, d), q, 50).drop("document"))


def sparse_vs_dense(spark, d):
    s, e = _hits(spark, d, "sparse").where("rank <= 5"), _hits(spark, d, "dense").where("rank <= 5")
    return compare.side_by_side(s, e).withColumn("rank", F.col("rank").cast("long"))


# --- judging


def _answers(spark, d):
    n = F.col("event_id") % 6
    k = (F.col("event_id") % 5).cast("string")
    text = F.when(n == 0, F.concat(F.lit('{"score": '), k, F.lit(', "reasoning": "r"}'))).when(n == 1, F.lit('Sure: {"score": 2, "reasoning": "ok"} done')).when(n == 2, F.concat(F.lit("no json "), F.col("event_type"))).when(n == 3, F.lit("[1, 2]")).when(n == 4, F.lit('{"reasoning": "none"}')).otherwise(F.concat(F.lit('{"score": "'), k, F.lit('"}')))
    return table(spark, d, "events").select("event_id", text.alias("answer"))


def judge_parse(spark, d):
    a = _answers(spark, d).select("event_id", T.parse_judgment("answer").alias("s"), T.parse_judgment_lenient("answer").alias("l"))
    return a.select("event_id", "s.score", "s.reasoning", F.col("l.score").alias("lenient_score"), F.col("l.reasoning").alias("lenient_reasoning"))


def judgments(spark, d):
    return judged(spark, d).where("rank is not null").select("run_id", "method", "query_id", F.col("rank").cast("long").alias("rank"), "id", "grade", (F.col("grade") >= 2).alias("relevant"))


def judged_hits(spark, d):
    return judge.judge_pairs(_hits(spark, d, "contextual").drop("score")).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score", "reasoning")


def response_docs_block(spark, d):
    r = results(spark, d)
    return r.select("run_id", T.docs_list("documents").alias("docs_list"), F.md5(T.docs_block("documents")).alias("docs_block_md5"))


def rank_prompt(spark, d):
    e = examples(spark, d)
    p = T.relevance_prompt(F.col("query"), F.col("document_reference"), F.col("document_text"))
    return e.select("example_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("prompt_length"))


# --- metrics


def precision_at_k(spark, d):
    long = metrics.long_form(_queries_table(spark, d)).where("metric = 'precision'")
    return long.select("run_id", F.col("k").cast("long").alias("k"), _r("value").alias("value"))


def reciprocal_rank(spark, d):
    return _queries_table(spark, d).select("run_id", _r("rr").alias("rr"))


def dcg_ndcg(spark, d):
    return _rounded(metrics.dcg_at(judged(spark, d), 5))


def query_metrics(spark, d):
    q = _queries_table(spark, d).withColumn("num_relevant", F.col("num_relevant").cast("long")).withColumn("num_retrieved", F.col("num_retrieved").cast("long"))
    return _rounded(q.drop("query"))


def aggregate_metrics(spark, d):
    return _rounded(metrics.aggregate(_queries_table(spark, d)))


def _values(spark, d):
    return compare.by_query(_queries_table(spark, d))


def paired_ttest(spark, d):
    t = compare.paired_tests(_values(spark, d), (("legacy", "contextual"),))
    return _rounded(t.select("metric", "n", "t_stat", "df", "p_value"))


def comparison_matrix(spark, d):
    return _rounded(compare.paired_tests(_values(spark, d)).drop("t_stat", "df"))


def by_type(spark, d):
    r = results(spark, d).select("run_id", F.lit(None).cast("string").alias("x"))
    # categories by the letter of test query ids, which stand for the query texts here
    q = _queries_table(spark, d).join(r.drop("x"), "run_id")
    named = asked(spark, d).groupBy("query").agg(F.min("query_id").alias("tid"))
    return _rounded(compare.by_type(q.join(named, "query", "left").withColumn("query_id", F.coalesce("tid", "query_id"))))


def improvement(spark, d):
    return _rounded(compare.improvements(metrics.aggregate(_queries_table(spark, d))).withColumn("step", F.col("step").cast("long")))


def worst_queries(spark, d):
    w = compare.worst_queries(_queries_table(spark, d))
    return w.select("method", F.col("rank").cast("long").alias("rank"), "query_id", "run_id", T.preview("query", 50).alias("query"), _r("avg_relevance").alias("avg_relevance"))


def overlap_at_k(spark, d):
    methods = ("legacy", "contextual", "contextual_rerank", "hybrid_rrf", "dense", "sparse")
    return _rounded(compare.overlap(lists(spark, d, *methods), "contextual_rerank"))


def mean_overlap(spark, d):
    return _rounded(overlap_at_k(spark, d).groupBy("method").agg(F.avg("overlap").alias("mean_overlap"), F.count(F.lit(1)).alias("queries")))


def latency_stats(spark, d):
    r = results(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("runs"), F.avg("latency_ms").alias("mean_latency_ms"), F.stddev_pop("latency_ms").alias("std_latency_ms"))
    return _rounded(r)


def summary_report(spark, d):
    c = report.summary_cells(metrics.aggregate(_queries_table(spark, d)))
    return c.select("metric", "method", "cell")


# --- training


def training_examples(spark, d):
    e = examples(spark, d)
    judged_ = e.select("example_id", F.col("relevance_score").alias("raw_score"))
    out = training.assemble(e.select("example_id", "query", "document_id", "query_type"), judged_, ["example_id"])
    return _rounded(out.select("example_id", "query", "document_id", "raw_score", "label", training.query_type_key(F.col("query_type")).alias("query_type")))


def soft_labels(spark, d):
    e = rows(spark, d)
    return e.select("row_id", training.soft_label(F.col("raw_score")).alias("soft_label"), training.raw_score(F.col("raw_score"), F.col("label")).alias("raw"))


def train_test_split(spark, d):
    return training.split(rows(spark, d).select("row_id"), "row_id")


def class_weights(spark, d):
    return _rounded(training.class_weights(rows(spark, d)))


def eval_samples(spark, d):
    r = rows(spark, d).where("query is not null and document is not null")
    e = training.eval_samples(r, "row_id")
    return e.select("query", F.md5(F.array_join("positive", "\x01")).alias("positive_md5"), F.size("positive").cast("long").alias("n_positive"), F.md5(F.array_join("documents", "\x01")).alias("documents_md5"), F.size("documents").cast("long").alias("n_documents"))


def dataset_stats(spark, d):
    return training.dataset_stats(examples(spark, d), "relevance_score")


def score_histogram(spark, d):
    return _rounded(training.shares(examples(spark, d), F.col("relevance_score"), "score"))


def query_type_histogram(spark, d):
    return _rounded(training.shares(rows(spark, d), F.coalesce(training.query_type_key(F.col("query_type")), F.lit("unknown")), "query_type"))


def tsv_export(spark, d):
    r = rows(spark, d).select("row_id", "query", "document", "reference", F.col("raw_score").alias("score"), "query_type")
    return training.tsv_lines(r, "row_id")


def pair_dataset(spark, d):
    return _rounded(training.pairs(rows(spark, d).where("label is not null")))


def reranker_fit_predict(spark, d):
    r = rows(spark, d).where("query is not null and document is not null").withColumn("label", training.soft_label(F.col("raw_score"))).select("row_id", "query", "document", "label")
    model = training.fit_reranker(r)
    return training.predict(model, r).select("row_id", _r("prediction_score").alias("score"))


_ALL = (
    flatten_passages, chapter_text, chapter_counts, chapter_summaries, contextualize, context_extract, slug_ids, display_names, token_counts_rollup, normalize_sections, normalize_map, batch_assignment,
    index_records, upsert_merge, index_stats, dense_topk, lsh_topk, inverted_index, bm25_topk, rrf_fusion, hybrid_rrf, rerank_topn, hybrid_rerank, retrieve_all, legacy_vs_contextual, small_hybrid, evaluation_run, built_training_set, sparse_vs_dense,
    judge_parse, judgments, judged_hits, response_docs_block, rank_prompt, precision_at_k, reciprocal_rank, dcg_ndcg, query_metrics, aggregate_metrics, paired_ttest, comparison_matrix, by_type, improvement, worst_queries, overlap_at_k, mean_overlap, latency_stats, summary_report,
    training_examples, soft_labels, train_test_split, class_weights, eval_samples, dataset_stats, score_histogram, query_type_histogram, tsv_export, pair_dataset, reranker_fit_predict,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lectern.plans import artifacts  # it builds on the queries above

    return {f.__name__: f for f in _ALL} | artifacts.queries()


def oracle_sql() -> dict[str, str]:
    return {**oracle.sql(), **oracle_search.sql(), **oracle_artifacts.sql()}
