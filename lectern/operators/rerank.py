"""Reranking the survivors of a first pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.relational import top

Scorer = Callable[[Column, Column], Column]


def overlap_scorer(query: Column, text: Column) -> Column:
    """The default: share of the query's distinct words that the text has."""
    q, t = F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def rerank(hits: DataFrame, n: int, scorer: Scorer = overlap_scorer, query_id: str = "query_id", query: str = "query", text: str = "text", initial: int | None = None) -> DataFrame:
    """The best n of each query by the scorer, ties by first-pass rank; original_rank and original_score keep the first pass.

    The scorer runs after the first ``initial`` hits were cut off, on the text and never on its context.
    """
    kept = hits if initial is None else hits.where(F.col("rank") <= initial)
    scored = kept.withColumnsRenamed({"rank": "original_rank", "score": "original_score"}).withColumn("score", F.round(scorer(F.col(query), F.col(text)), 9))
    return top(scored, [query_id], [F.desc("score"), F.asc("original_rank")], n)
