"""Inverted index and BM25."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.relational import top
from lectern.operators.running import CELLS, Running
from lectern.runtime import materialize, narrowed

#: Query terms, and hits kept, that a task holds at once; a larger query set is searched in parts.
QUERY_TERMS = 4_000_000


def inverted_index(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl). Counted within each document before any shuffle."""
    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), T.tokens(text_col).alias("w"))
    each = words.select("id", F.size("w").alias("dl"), F.explode(F.array_distinct("w")).alias("term"), "w")
    return each.select("term", "id", F.size(F.filter("w", lambda x: x == F.col("term"))).alias("tf"), "dl")


def _scores(queries: pa.Array, terms: dict[str, tuple[float, np.ndarray]], k: int, avgdl: float, k1: float, b: float):
    """The k best documents of a task for each query. Scores are made in tables of CELLS cells at most, queries by documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Running(len(queries), k), None
        step = max(1, CELLS // max(1, len(queries)))
        for batch in batches:
            texts, kind = batch.column("w").to_pylist(), batch.column("id").type
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo in range(0, len(texts), step):
                part = texts[lo : lo + step]
                s = np.zeros((len(part), len(queries)))
                for row, words in enumerate(part):
                    norm = k1 * (1 - b + b * len(words) / avgdl)
                    for term, tf in Counter(words).items():
                        if hit := terms.get(term):
                            s[row, hit[1]] += hit[0] * tf * (k1 + 1) / (tf + norm)
                s = np.round(s, 9)
                j, i = np.nonzero((s > 0) & (s >= best.edge))
                best.add(i, s[j, i], ids[lo + j])
        yield from best.batches(queries, kind)

    return run


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query", id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query, ties by id; a query's distinct terms count.

    The stated query set goes to the tasks in parts of QUERY_TERMS terms at most; every document meets a part once and
    each task keeps a query's best only, so frequent words multiply no rows. Document frequencies are counted of the terms that
    some query has. Null ids are dropped; a query without a known word has no rows.
    """
    q = materialize(queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("id"), F.array_distinct(T.tokens(query_text)).alias("terms")).where(F.size("terms") > 0))
    words = narrowed(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), T.tokens(text_col).alias("w")))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
    n, avgdl = size["n"], size["avgdl"] or 1.0
    vocabulary = q.select(F.explode("terms").alias("term")).distinct()
    df = materialize(words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(vocabulary, "term"))
    parts = max(1, q.agg(F.ceil(F.coalesce(F.sum(F.size("terms") + k), F.lit(0)) / QUERY_TERMS).cast("int").alias("p")).first()["p"])
    schema = f"query_id {q.schema['id'].dataType.simpleString()}, id {words.schema['id'].dataType.simpleString()}, score double"
    found = None
    for p in range(parts):
        mine = q.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        own = mine.toArrow()
        seen = {r["term"]: r["df"] for r in df.join(mine.select(F.explode("terms").alias("term")).distinct(), "term").collect()}  # terms of this part
        where: dict[str, list[int]] = {}
        for i, terms in enumerate(own.column("terms").to_pylist()):
            for t in terms:
                if t in seen:
                    where.setdefault(t, []).append(i)
        held = {t: (math.log(1 + (n - seen[t] + 0.5) / (seen[t] + 0.5)), np.array(at)) for t, at in where.items()}
        ids = own.column("id").combine_chunks()
        hits = words.mapInArrow(_scores(ids, held, k, avgdl, k1, b), schema)
        found = hits if found is None else found.union(hits)
    return top(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
