"""Pluggable models with deterministic offline defaults.

An embedder turns a batch of texts into vectors, a summarizer or responder a batch of prompts into
texts. They run in ``mapInPandas`` on batches; a failing call is tried again with growing, jittered waits.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.runtime import materialize

Embedder = Callable[[list[str]], np.ndarray]
Writer = Callable[[list[str]], list[str]]
_WORD = re.compile(r"[^\W_]+")


def retrying(call: Callable, attempts: int = 6, least: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried up to ``attempts`` times; the wait is random below a bound that doubles from ``least`` to ``most`` seconds."""

    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception:
                if n + 1 == attempts:
                    raise
                sleep(random.uniform(0, min(most, least * 2**n)))

    return run


@lru_cache(maxsize=100_000)
def _slot(word: str) -> tuple[int, float]:
    h = hashlib.md5(word.encode()).digest()
    return int.from_bytes(h[:4], "big"), 1.0 if h[4] & 1 else -1.0


def hashed_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of words, unit length; texts without a word get a zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                slot, sign = _slot(w)
                out[i, slot % dim] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, name: str = "vector", batch: int = 100) -> DataFrame:
    """``df`` with the vector of a column; which column is embedded is all that tells the indexes apart."""
    model = embedder or hashed_embedder()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retrying(model)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            vectors = [v for at in range(0, len(texts), batch) for v in call(texts[at : at + batch])]
            yield pdf.assign(**{name: vectors})

    return df.mapInPandas(run, schema)


def write_texts(df: DataFrame, prompt: str, writer: Writer, name: str, batch: int = 100) -> DataFrame:
    """``df`` with the writer's answer to each prompt."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retrying(writer)
        for pdf in batches:
            prompts = pdf[prompt].fillna("").tolist()
            yield pdf.assign(**{name: [a for at in range(0, len(prompts), batch) for a in call(prompts[at : at + batch])]})

    return df.mapInPandas(run, schema)


PairModel = Callable[[list[tuple[str, str]]], Sequence[float]]


def batched_scorer(load: Callable[[], PairModel], batch: int = 64, attempts: int = 6, least: float = 1.0) -> Callable[[Column, Column], Column]:
    """A reranking scorer from a model of pairs. ``load`` is called once a task, the model on ``batch`` pairs at a time; both are tried again if they fail. Nulls are empty texts."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = retrying(retrying(load, attempts, least)(), attempts, least)
        for query, text in pairs:
            both = list(zip(query.fillna(""), text.fillna(""), strict=True))
            scores = [float(x) for at in range(0, len(both), batch) for x in model(both[at : at + batch])]
            yield pd.Series(scores, dtype="float64")

    return F.pandas_udf(run, "double")


def word_jaccard(pairs: list[tuple[str, str]]) -> list[float]:
    """A model of pairs that needs no training: common words by all words."""
    out = []
    for query, text in pairs:
        q, t = set(_WORD.findall(query.lower())), set(_WORD.findall(text.lower()))
        out.append(len(q & t) / len(q | t) if q | t else 0.0)
    return out


def generate_queries(spark: SparkSession, writer: Writer, count: int, batch: int = 50, rounds: int = 10) -> DataFrame:
    """(query, type): ``count`` queries by a writer that answers in JSON, asked for ``batch`` at a time and again for what is missing, ``rounds`` times at most; fewer if it gives no more."""
    found, have, number = None, 0, 0
    for _ in range(rounds):
        if have >= count:
            break
        asks = [(number + i, min(batch, count - have - i * batch)) for i in range(-(-(count - have) // batch))]
        number += len(asks)
        prompts = spark.createDataFrame(asks, "ask long, n int").withColumn("prompt", T.query_generation_prompt(F.col("n")))
        said = write_texts(prompts, "prompt", writer, "answer").select("ask", F.posexplode(T.parse_queries("answer")).alias("at", "x")).select("ask", "at", "x.query", "x.type").where("query is not null")
        said = materialize(said)
        found = said if found is None else found.union(said)
        have = found.count()
    if found is None:
        return spark.createDataFrame([], "query string, type string")
    return found.orderBy("ask", "at").limit(count).select("query", "type")  # the number asked for


def answer_with(hits: DataFrame, queries: DataFrame, writer: Writer, n: int = 20) -> DataFrame:
    """(query_id, answer) by a writer from each query's first n hits; a query without hits is asked without passages."""
    docs = hits.where(F.col("rank") <= n).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "reference", "text"))), lambda x: F.struct(x["reference"].alias("reference"), x["text"].alias("text"))).alias("d"))
    none = F.array().cast("array<struct<reference:string,text:string>>")
    asked = queries.join(docs, "query_id", "left").select("query_id", T.answer_prompt(F.coalesce("query", F.lit("")), F.coalesce("d", none)).alias("prompt"))
    return write_texts(asked, "prompt", writer, "answer").select("query_id", "answer")


def extractive_answer(hits: DataFrame, n: int = 3) -> DataFrame:
    """The default responder: each query's first n hits, cited."""
    best = hits.where(F.col("rank") <= n).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "reference", "text"))).alias("d"))
    return best.select("query_id", F.array_join(F.transform("d", lambda x: F.concat(x["text"], F.lit(" ["), x["reference"], F.lit("]"))), "\n").alias("answer"))


def topic_queries(passages: DataFrame, count: int) -> DataFrame:
    """The default query generator: the first words of ``count`` passages, chosen by hash; bounded, so it always ends."""
    first = F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ")
    return passages.where("text is not null").select(F.col("reference").alias("id"), first.alias("query"), F.lit("factual").alias("type")).dropDuplicates(["query"]).orderBy(F.xxhash64("id"), "id").limit(count)
