"""Retrieval metrics of graded hit lists, for all methods and queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.stats import discount, gain

KS = (1, 3, 5, 10)


def _dcg(grades: Column, k: int | None = None) -> Column:
    part = grades if k is None else F.slice(grades, 1, k)
    terms = F.transform(part, lambda g, i: gain(g) / discount(i + 1))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def per_query(hits: DataFrame, ks: tuple[int, ...] = KS, threshold: int = 2) -> DataFrame:
    """One row per run: p@k and ndcg@k (null where the list is shorter than k), rr, avg_relevance, counts, latency.

    One shuffle gathers a run's hits, a list of top_k entries at most; all metrics are then computed in the row.
    The ideal order is that of the list itself. Precision divides by k.
    """
    entry = F.when(F.col("rank").isNotNull(), F.struct("rank", "grade"))
    runs = hits.groupBy("run_id", "method", "query_id", "query").agg(F.first("latency_ms").alias("latency_ms"), F.sort_array(F.collect_list(entry)).alias("e"))
    runs = runs.withColumn("g", F.transform("e", lambda x: x["grade"])).withColumn("ideal", F.sort_array("g", asc=False)).withColumn("n", F.size("g"))
    relevant = lambda g: F.size(F.filter(g, lambda x: x >= threshold))
    first = F.array_position(F.transform("g", lambda x: x >= threshold), True)
    at_k = []
    for k in ks:
        ideal = _dcg(F.col("ideal"), k)
        at_k.append(F.when(F.col("n") >= k, relevant(F.slice("g", 1, k)) / F.lit(float(k))).alias(f"p_{k}"))
        at_k.append(F.when(F.col("n") >= k, F.when(ideal > 0, _dcg(F.col("g"), k) / ideal).otherwise(F.lit(0.0))).alias(f"ndcg_{k}"))
    total = F.aggregate("g", F.lit(0), lambda s, x: s + x)
    return runs.select(
        "run_id", "method", "query_id", "query", "latency_ms", *at_k, F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0)).alias("rr"),
        F.when(F.col("n") > 0, total / F.col("n").cast("double")).otherwise(F.lit(0.0)).alias("avg_relevance"), relevant(F.col("g")).alias("num_relevant"), F.col("n").alias("num_retrieved"),
    )


def dcg_at(hits: DataFrame, k: int) -> DataFrame:
    """DCG, ideal DCG and NDCG at k of each run, short lists included."""
    runs = hits.where("rank is not null").groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("rank", "grade"))).alias("e"))
    runs = runs.withColumn("g", F.transform("e", lambda x: x["grade"]))
    dcg, ideal = _dcg(F.col("g"), k), _dcg(F.sort_array("g", asc=False), k)
    return runs.select("run_id", dcg.alias("dcg"), ideal.alias("idcg"), F.when(ideal > 0, dcg / ideal).otherwise(F.lit(0.0)).alias("ndcg"))


def long_form(queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(run_id, method, query_id, metric, k, value), absent values left out."""
    parts = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"{c}_{k}").alias("value")) for k in ks for m, c in (("precision", "p"), ("ndcg", "ndcg"))]
    return queries.select("run_id", "method", "query_id", F.explode(F.array(*parts)).alias("x")).select("run_id", "method", "query_id", "x.metric", "x.k", "x.value").where("value is not null")


def aggregate(queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per method. A run too short for k counts as 0; a k that no run of the method reaches is null. The latency's deviation is the population's."""
    mean = lambda c: F.when(F.count(c) > 0, F.avg(F.coalesce(F.col(c), F.lit(0.0)))).alias(f"mean_{c}")
    return queries.groupBy("method").agg(
        F.count(F.lit(1)).alias("num_queries"), *(mean(f"{m}_{k}") for k in ks for m in ("p", "ndcg")), F.avg("rr").alias("mrr"), F.avg("avg_relevance").alias("mean_avg_relevance"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.stddev_pop("latency_ms").alias("std_latency_ms"), F.sum("num_relevant").alias("total_relevant"), F.sum("num_retrieved").alias("total_retrieved"),
    )
