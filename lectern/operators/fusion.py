"""Weighted reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.relational import top


def fuse(lists: DataFrame, weights: dict[str, float], k: int = 60, limit: int | None = None, query_id: str = "query_id", key: str = "reference") -> DataFrame:
    """``lists``: query_id, source, rank, reference and payload columns, one row per hit; a reference standing twice in a list adds twice.

    Gives per query and reference rrf_score, sources, source_ranks (the last rank of a source), in_both, the payload
    of the first list (in the order of ``weights``) that has it, and rank: by score, ties by first appearance.
    """
    order = list(weights)
    at = F.coalesce(*(F.when(F.col("source") == s, i) for i, s in enumerate(order)))
    weight = F.coalesce(*(F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()))
    payload = [c for c in lists.columns if c not in (query_id, key, "source", "rank")]
    hits = lists.where(F.col("source").isin(order) & F.col(key).isNotNull()).withColumn("__h", F.struct(at.alias("l"), F.col("rank").alias("r"), (weight / (k + F.col("rank"))).alias("s"), F.col("source").alias("n"), *(F.col(c) for c in payload)))
    # a reference has a handful of hits per query at most: one per list and repetition
    grouped = hits.groupBy(query_id, key).agg(F.array_sort(F.collect_list("__h"), lambda a, b: F.when(a["l"] != b["l"], a["l"] - b["l"]).otherwise(a["r"] - b["r"])).alias("h"))
    score = F.aggregate("h", F.lit(0.0), lambda s, x: s + x["s"])
    names = F.transform("h", lambda x: x["n"])
    ranks = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("key"), F.array_max(F.transform(F.filter("h", lambda x: x["n"] == n), lambda x: x["r"])).alias("value"))))
    first = F.element_at("h", 1)
    fused = grouped.select(query_id, key, F.round(score, 9).alias("rrf_score"), names.alias("sources"), ranks.alias("source_ranks"), (F.size(F.array_distinct(names)) > 1).alias("in_both"), first["l"].alias("__l"), first["r"].alias("__r"), *(first[c].alias(c) for c in payload))
    order_by = [F.desc("rrf_score"), F.asc("__l"), F.asc("__r")]
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order_by))) if limit is None else top(fused, [query_id], order_by, limit)
    return ranked.drop("__l", "__r")


def counts(lists: DataFrame, fused: DataFrame | None = None, query_id: str = "query_id", sparse: str = "sparse", dense: str = "dense") -> DataFrame:
    """Hits of each list per query and, with ``fused``, fused references."""
    n = lists.groupBy(query_id).agg(F.count(F.when(F.col("source") == sparse, 1)).alias("sparse_count"), F.count(F.when(F.col("source") == dense, 1)).alias("dense_count"))
    if fused is None:
        return n
    return n.join(fused.groupBy(query_id).agg(F.count(F.lit(1)).alias("fusion_count")), query_id, "left").withColumn("fusion_count", F.coalesce("fusion_count", F.lit(0)))
