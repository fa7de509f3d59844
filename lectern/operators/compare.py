"""Comparisons between methods: paired tests, overlap, improvements, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.stats import percent_improvement, t_test_p
from lectern.operators.relational import top

#: The pairs and metrics that are compared, and the category of a query id's first letter.
PAIRS = (("legacy", "contextual"), ("contextual", "contextual_rerank"), ("contextual_rerank", "hybrid_rrf"), ("contextual_rerank", "hybrid_rerank"), ("hybrid_rrf", "hybrid_rerank"))
METRICS = ("avg_relevance", "rr", "p_5", "ndcg_10")
CATEGORIES = {"F": "factual", "T": "thematic", "X": "cross_reference"}


def by_query(queries: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(method, query_id, metric, value): the mean over a query's runs, absent values as 0."""
    means = queries.groupBy("method", "query_id").agg(*(F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics))
    return means.select("method", "query_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")).select("method", "query_id", "x.metric", "x.value")


def paired_tests(values: DataFrame, pairs: tuple[tuple[str, str], ...] = PAIRS, alpha: float = 0.05) -> DataFrame:
    """One row per pair of methods and metric, paired by query: means, improvement in percent, t, degrees of freedom, two-sided p, significance.

    A single pair, or differences without variance, has a null t and p and isn't significant; a pair without common queries has no row.
    """
    spark = values.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(pairs), "method_a string, method_b string"))  # the request itself
    a = values.select(F.col("method").alias("method_a"), "query_id", "metric", F.col("value").alias("a")).join(wanted, "method_a")
    b = values.select(F.col("method").alias("method_b"), "query_id", "metric", F.col("value").alias("b"))
    joined = a.join(b, ["method_b", "query_id", "metric"]).withColumn("d", F.col("b") - F.col("a"))
    stat = joined.groupBy("method_a", "method_b", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd"))
    t = F.when((F.col("n") > 1) & (F.col("sd") > 1e-12), F.try_divide("mean_d", F.col("sd") / F.sqrt("n")))
    out = stat.withColumn("t_stat", t).withColumn("df", (F.col("n") - 1).cast("long")).withColumn("p_value", t_test_p(F.col("t_stat"), F.col("df")))
    return out.select("method_a", "method_b", "metric", "n", "mean_a", "mean_b", percent_improvement(F.col("mean_a"), F.col("mean_b")).alias("improvement_pct"), "t_stat", "df", "p_value", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"))


def by_type(queries: DataFrame) -> DataFrame:
    """Runs, mean relevance and mean reciprocal rank per method and category of the query id."""
    letter = F.substring("query_id", 1, 1)
    kind = F.coalesce(*(F.when(letter == c, name) for c, name in CATEGORIES.items()), F.lit("unknown"))
    return queries.groupBy("method", kind.alias("query_type")).agg(F.count(F.lit(1)).alias("queries"), F.avg("avg_relevance").alias("avg_relevance"), F.avg("rr").alias("mrr"))


def improvements(methods: DataFrame, order: tuple[str, ...] = ("legacy", "contextual", "contextual_rerank")) -> DataFrame:
    """Each method against the one before it in ``order``: improvement in percent where the base is positive, latency as a difference."""
    spark = methods.sparkSession
    steps = F.broadcast(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(order, order[1:], strict=False))], "step int, method_a string, method_b string"))
    cols = ["mrr", "mean_avg_relevance", "mean_p_5", "mean_ndcg_10"]
    a = methods.select(F.col("method").alias("method_a"), *(F.col(c).alias(f"a_{c}") for c in [*cols, "mean_latency_ms"]))
    b = methods.select(F.col("method").alias("method_b"), *(F.col(c).alias(f"b_{c}") for c in [*cols, "mean_latency_ms"]))
    joined = steps.join(a, "method_a").join(b, "method_b")
    rise = [F.when(F.col(f"a_{c}") > 0, (F.col(f"b_{c}") - F.col(f"a_{c}")) / F.col(f"a_{c}") * 100).alias(f"{c}_pct") for c in cols]
    return joined.select("step", "method_a", "method_b", *rise, (F.col("b_mean_latency_ms") - F.col("a_mean_latency_ms")).alias("latency_diff_ms"))


def worst_queries(queries: DataFrame, n: int = 3) -> DataFrame:
    """The n runs of each method with the lowest mean relevance, ties by query and run."""
    return top(queries, ["method"], [F.asc("avg_relevance"), F.asc("query_id"), F.asc("run_id")], n).select("method", "rank", "query_id", "run_id", "query", "avg_relevance")


def overlap(hits: DataFrame, baseline: str, k: int = 10) -> DataFrame:
    """(query_id, method, overlap): common references of the first k, divided by k; 0 where a list is empty."""
    refs = hits.groupBy("query_id", "method").agg(F.collect_set(F.when(F.col("rank") <= k, F.col("reference"))).alias("refs"))
    base = refs.where(F.col("method") == baseline).select("query_id", F.col("refs").alias("base"))
    return refs.where(F.col("method") != baseline).join(base, "query_id").select("query_id", "method", (F.size(F.array_intersect("refs", "base")) / F.lit(float(k))).alias("overlap"))


def side_by_side(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Two lists of (query_id, rank, reference, score, text) next to each other by rank: scores rounded, texts cut."""
    from lectern.functions.text import truncate

    one = lambda df, p, digits: df.select("query_id", "rank", F.col("reference").alias(f"{p}_reference"), F.round("score", digits).alias(f"{p}_score"), truncate("text", 100).alias(f"{p}_text"))
    return one(sparse, "sparse", 2).join(one(dense, "dense", 4), ["query_id", "rank"], "full")
