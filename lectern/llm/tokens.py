"""Sizes of texts in tokens of a public tokenizer, and ranks and running sums that no single task has to hold."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Order buckets for ranks and running sums; a group's rows spread over so many.
BUCKETS = 4096


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("lectern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, tokens): each row's id and the tokens of its whole text; null texts have none."""
    cols = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields if f.name != "__text") + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for batch in batches:
            n = [0 if t is None else len(e.encode_ordinary(t)) for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(tokens=n)

    return spread(cols).mapInPandas(run, schema)


def order_bucket(h: Column) -> Column:
    """The bucket, in order, of a 64-bit hash."""
    return F.shiftright(h, 52) + BUCKETS // 2


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's rank from 0 within ``keys``, in the order of bucket and ``order``: bucket counts are summed up first, rows are ranked within a bucket only."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, bucket, (F.sum("__n").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("__n")).alias("__before"))
    local = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    return local.join(before, [*keys, bucket]).withColumn(name, F.col("__before") + F.col("__r")).drop("__before", "__r")


def summed(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str = "start") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it within ``keys``."""
    counts = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__n"))
    before = counts.select(*keys, bucket, (F.sum("__n").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("__n")).alias("__before"))
    local = df.withColumn("__s", F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order)) - F.col(value))
    return local.join(before, [*keys, bucket]).withColumn(name, F.col("__before") + F.col("__s")).drop("__before", "__s")
