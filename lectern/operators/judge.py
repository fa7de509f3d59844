"""Judging relevance of documents and responses through a pluggable judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

Judge = Callable[[Column, Column], Column]


def overlap_judge(query: Column, text: Column) -> Column:
    """The default offline judge: a grade from 0 to 3 by the share of the query's words in the text, as a JSON answer."""
    q = F.array_distinct(T.tokens(query))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(q, F.array_distinct(T.tokens(text)))).cast("double"), F.size(q).cast("double")), F.lit(0.0))
    grade = F.when(share >= 0.75, 3).when(share >= 0.5, 2).when(share >= 0.25, 1).otherwise(0)
    return F.to_json(F.struct(grade.alias("score"), F.concat(F.lit("Shares "), F.round(share * 100).cast("int").cast("string"), F.lit(" percent of the query's words.")).alias("reasoning")))


def judge_pairs(pairs: DataFrame, judge: Judge = overlap_judge, lenient: bool = False, query: str = "query", text: str = "text") -> DataFrame:
    """``pairs`` with score and reasoning. Each pair of texts is judged once, however many methods retrieved it; the rank stays on the row, so order needs no restoring."""
    # 128 bits over both texts, null and empty told apart
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.md5(c)), F.lit("-"))
    key = F.md5(F.concat(part(query), part(text)))
    parse = T.parse_judgment_lenient if lenient else T.parse_judgment
    once = pairs.groupBy(key.alias("__k")).agg(F.min(query).alias("__q"), F.min(text).alias("__t")).select("__k", parse(judge(F.col("__q"), F.col("__t"))).alias("__j"))
    return pairs.withColumn("__k", key).join(once, "__k").select(*pairs.columns, F.col("__j.score").alias("score"), F.col("__j.reasoning").alias("reasoning"))


def grades_by_document(examples: DataFrame, id_col: str = "document_id", score: str = "relevance_score") -> DataFrame:
    """The best grade each document got, clamped to 0..3."""
    return examples.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.greatest(F.lit(0), F.least(F.lit(3), F.max(score))).alias("grade"))


def grade_results(results: DataFrame, grades: DataFrame) -> DataFrame:
    """One row per hit of ``results`` (run_id, method, query_id, query, latency_ms, documents) with its grade, 0 if never graded; a run without hits keeps one row with a null rank."""
    hits = results.select("run_id", "method", "query_id", "query", "latency_ms", F.posexplode_outer("documents").alias("p", "x"))
    flat = hits.select("run_id", "method", "query_id", "query", "latency_ms", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.reference").alias("reference"))
    return flat.join(grades, "id", "left").withColumn("grade", F.when(F.col("rank").isNotNull(), F.coalesce("grade", F.lit(0))))
