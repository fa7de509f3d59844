"""Reranker training sets: labels, splits, weights, evaluation samples, statistics, and a pair model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Soft labels of the grades.
SOFT = {0: 0.0, 1: 0.2, 2: 0.7, 3: 1.0}


def assemble(candidates: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with their judgments; the label is the grade in thirds."""
    return candidates.join(judged, keys).withColumn("label", F.col("raw_score") / 3.0)


def soft_label(score: Column) -> Column:
    return F.coalesce(*(F.when(score == k, v) for k, v in SOFT.items()), F.lit(0.0))


def raw_score(raw: Column, label: Column) -> Column:
    """The raw score, else the label in thirds, cut off."""
    return F.coalesce(raw.cast("int"), (label * 3).cast("int"))


def split(rows: DataFrame, key: str, share: float = 0.1, name: str = "test") -> DataFrame:
    """``rows`` with a flag that exactly ceil(share * n) rows have: the smallest by hash of the key.

    Hash buckets are counted first and only the bucket in which the limit falls is ranked, so no
    task sorts all rows. Keys must be unique and not null.
    """
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int")
    marked = rows.withColumn("__m", F.md5(F.col(key).cast("string"))).withColumn("__b", h)
    sizes = marked.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # at most 65,536 rows
    total = sizes.agg(F.ceil(F.sum("__n") * F.lit(share)).cast("long").alias("__want"))
    before = sizes.select("__b", "__n", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before")).join(F.broadcast(total))
    placed = marked.join(before.select("__b", "__n", "__before", "__want"), "__b")
    edge = (F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__n") > F.col("__want"))
    sure = placed.where(~edge).withColumn(name, F.col("__before") + F.col("__n") <= F.col("__want"))
    some = placed.where(edge).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__m"))).withColumn(name, F.col("__before") + F.col("__r") <= F.col("__want")).drop("__r")
    return sure.unionByName(some).select(*rows.columns, name)


def class_weights(rows: DataFrame, label: str = "label", cap: float = 5.0) -> DataFrame:
    """Counts above and below one half and the weight of a positive, at most ``cap``."""
    pos = F.count(F.when(F.col(label) > 0.5, 1))
    counts = rows.agg(pos.alias("positives"), (F.count(F.lit(1)) - pos).alias("negatives"))
    return counts.withColumn("pos_weight", F.least(F.lit(cap), F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))))


def eval_samples(rows: DataFrame, order: str, positives: int = 3, negatives: int = 10) -> DataFrame:
    """Per query that has both: its first positive and negative documents in the given order.

    The documents are cut to the first few by a ranked filter before they are gathered, so a query with a tenth
    of all rows gathers no more than the others.
    """
    graded = rows.withColumn("positive", raw_score(F.col("raw_score"), F.coalesce("label", F.lit(0.0))) >= 2).select("query", "positive", "document", order)
    ranked = graded.withColumn("r", F.row_number().over(Window.partitionBy("query", "positive").orderBy(order))).where((F.col("positive") & (F.col("r") <= positives)) | (~F.col("positive") & (F.col("r") <= negatives)))
    docs = lambda flag: F.transform(F.sort_array(F.collect_list(F.when(F.col("positive") == flag, F.struct("r", "document")))), lambda x: x["document"])
    return ranked.groupBy("query").agg(docs(True).alias("positive"), docs(False).alias("documents")).where((F.size("positive") > 0) & (F.size("documents") > 0))


def dataset_stats(rows: DataFrame, score: str) -> DataFrame:
    """Totals, distinct queries and a histogram of the grades 0 to 3, in one row."""
    return rows.agg(F.count(F.lit(1)).alias("total_examples"), F.count_distinct("query").alias("unique_queries"), *(F.count(F.when(F.col(score) == s, 1)).alias(f"score_{s}") for s in range(4)))


def shares(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """(value, count, percent of all) of a column."""
    counts = rows.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("__all"))  # one row
    return counts.join(F.broadcast(total)).select(name, "count", (F.col("count") / F.col("__all") * 100).alias("percent"))


def query_type_key(column: Column) -> Column:
    """One spelling of a query type: lower case, dashes and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[-\s]+", "_")


def tsv_lines(rows: DataFrame, id_col: str) -> DataFrame:
    """One tab-separated line per example."""
    line = F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in (T.tsv_field("query"), T.tsv_field("document"), T.tsv_field("reference", newlines=False), F.col("score").cast("string"), F.col("query_type"))))
    return rows.select(id_col, line.alias("line"))


def pairs(rows: DataFrame) -> DataFrame:
    """The (text1, text2, label) shape."""
    return rows.select(F.col("query").alias("text1"), F.col("document").alias("text2"), "label")


FEATURES = ["f_overlap", "f_jaccard", "f_phrase", "f_length"]


def _features(query: Column, text: Column) -> dict[str, Column]:
    """Lexical features of a pair, all as expressions."""
    q, t = F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(text))
    both = F.size(F.array_intersect(q, t)).cast("double")
    grams = lambda c: F.zip_with(T.tokens(c), F.slice(T.tokens(c), F.lit(2), F.greatest(F.size(T.tokens(c)), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return {
        "f_overlap": F.coalesce(F.try_divide(both, F.size(q).cast("double")), F.lit(0.0)), "f_jaccard": F.coalesce(F.try_divide(both, F.size(F.array_union(q, t)).cast("double")), F.lit(0.0)),
        "f_phrase": F.size(F.array_intersect(grams(query), grams(text))).cast("double"), "f_length": F.log1p(T.token_count(text).cast("double")),
    }


def pair_features(rows: DataFrame, query: str = "query", text: str = "document") -> DataFrame:
    return rows.withColumns(_features(F.col(query), F.col(text)))


def fit_reranker(rows: DataFrame, label: str = "label", seed: int = 42) -> PipelineModel:
    """Logistic regression on pair features; a soft label y is a positive of weight y and a negative of weight 1 - y, positives weighed up as the classes ask."""
    weight = class_weights(rows, label).first()["pos_weight"]
    f = pair_features(rows).select(*FEATURES, F.col(label).alias("y"))
    both = f.select(*FEATURES, F.lit(1.0).alias("target"), (F.col("y") * max(weight, 1e-6)).alias("weight")).union(f.select(*FEATURES, F.lit(0.0), 1 - F.col("y"))).where("weight > 0")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), LogisticRegression(labelCol="target", weightCol="weight", maxIter=20, regParam=0.01)]).fit(both)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(pair_features(rows))
    return out.withColumn("prediction_score", vector_to_array("probability")[1]).select(*rows.columns, "prediction_score")


def model_scorer(model: PipelineModel) -> Callable[[Column, Column], Column]:
    """The fitted model as a reranking scorer: its probability as one expression, so that it runs where the hits are."""
    fit = model.stages[-1]
    weights = [float(w) for w in fit.coefficients]

    def score(query: Column, text: Column) -> Column:
        f = _features(query, text)
        z = sum((F.lit(w) * f[name] for name, w in zip(FEATURES, weights, strict=True)), F.lit(float(fit.intercept)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    return score
