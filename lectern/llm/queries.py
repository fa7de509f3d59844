"""The queries of the training-data problems; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import canonical, mixing, neighbors, overlap, packing, rankagg, sampling, spam, spans
from lectern.runtime import materialize, table

MIN_SPAN = 120


def _shared(spark: SparkSession, d: str) -> spans.SharedSpans:
    used = table(spark, d, "training_examples").select(F.col("document_id").alias("id"), F.col("document_text").alias("text"))
    shown = table(spark, d, "retrieval_results").select(F.explode("documents").alias("x")).select("x.id", "x.text")
    return spans.SharedSpans(used.union(shown), min_len=MIN_SPAN)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).pairs()


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).coverage()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.most_similar(table(spark, d, "index_records"), latest="upserted_at")
    return near.select("id", "rank", "other", F.round("cosine", 4).alias("cosine"))  # the index keeps single precision


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(neighbors.most_similar(table(spark, d, "index_records"), latest="upserted_at"))


SCORES = ["sparse_score", "dense_score", "rerank_score", "raw_score"]


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = rankagg.rank_lists(table(spark, d, "hybrid_results"), "result_id", "documents", "id", SCORES)
    return r.select(F.col("list_id").alias("result_id"), F.col("item").alias("doc_id"), F.col("position").cast("long").alias("position"), F.round("significance", 6).alias("significance"), F.round("evidence", 6).alias("evidence"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_ranking(spark, d).where("position <= 3").select("result_id", "doc_id")


def _overlap(spark: SparkSession, d: str) -> overlap.CrossSplitOverlap:
    rows = table(spark, d, "training_rows").select(F.col("row_id").alias("key"), "query", "document", "split", "source", F.col("loaded_at").alias("at"))
    return overlap.CrossSplitOverlap(rows, table(spark, d, "test_queries").select(F.col("id").alias("key"), "query"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).pairs()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).report()


def _canonical(spark: SparkSession, d: str, values: DataFrame) -> DataFrame:
    return canonical.match_values(values, "value", table(spark, d, "query_types"), "type_id", "type_name", "aliases")


def _latest(df: DataFrame, key: str, at: str, *cols: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at).alias("__at"), *cols)).alias("x")).select(key, *(f"x.{c}" for c in cols))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    asked = _latest(table(spark, d, "test_queries"), "id", "added_at", "type").select(F.col("id").alias("origin_key"), F.col("type").alias("raw_value"))
    typed = table(spark, d, "training_stats").select(F.col("run_id").alias("origin_key"), F.explode(F.map_keys("query_type_distribution")).alias("raw_value")).distinct()
    values = materialize(asked.union(typed).where(F.length(F.regexp_replace("raw_value", r"[\s\p{Z}\p{C}]+", "")) > 0))
    found = _canonical(spark, d, values.select(F.col("raw_value").alias("value")))
    return values.join(found, values.raw_value == found.value).select("origin_key", "raw_value", F.col("entry_id").alias("type_id"))


def p6_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All entries within the distance of each value of the test queries, nearest first."""
    asked = table(spark, d, "test_queries").select(F.col("type").alias("value"))
    found = canonical.all_matches(asked, "value", table(spark, d, "query_types"), "type_id", "type_name", "aliases")
    return found.select("value", F.col("entry_id").alias("type_id"), "distance", F.col("rank").cast("long").alias("rank"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that are no entry, with how often they were typed."""
    return p6_found(spark, d).where("type_id = 0").groupBy("raw_value").agg(F.count(F.lit(1)).alias("uses"))


def _targets(spark: SparkSession, d: str) -> sampling.TargetSample:
    rows = _latest(table(spark, d, "training_rows"), "row_id", "loaded_at", "raw_score", "label", "query_type")
    types = materialize(_canonical(spark, d, rows.select(F.col("query_type").alias("value"))))
    names = types.where("entry_id > 0").join(table(spark, d, "query_types"), F.col("entry_id") == F.col("type_id")).select("value", "type_name")
    rows = rows.join(names, F.col("query_type") == F.col("value"), "left").select("row_id", F.col("raw_score").cast("string").alias("raw_score"), F.round("label", 3).cast("string").alias("label"), F.col("type_name").alias("query_type"))
    return sampling.TargetSample(materialize(rows), table(spark, d, "sample_targets"), "row_id", ["raw_score", "label", "query_type"])


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).sample().withColumnRenamed("id", "row_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).report()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "container_sizes"))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="supply")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).records()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("is_spam").select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p2_neighbours, p3_found, p3_ranking, p4_found, p4_report, p5_sample, p5_report, p6_found, p6_candidates, p6_unmatched, p7_containers, p7_report, p8_mixture, p8_report, p9_found, p9_scores)}
