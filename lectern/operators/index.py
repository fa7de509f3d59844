"""Index records, idempotent upserts and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.relational import latest, merge


def records(passages: DataFrame, vector: str | None = None) -> DataFrame:
    """(id, values, metadata): the id is the slug of the reference, so a repeated upsert replaces; missing fields get their defaults."""
    meta = F.struct(F.coalesce("volume", F.lit("Unknown")).alias("volume"), F.coalesce("reference", F.lit("Unknown")).alias("reference"), T.context_or_default("context").alias("context"), F.coalesce("text", F.lit("")).alias("text"))
    return passages.select(T.slug(F.coalesce("reference", F.lit("Unknown"))).alias("id"), *([F.col(vector).alias("values")] if vector else []), meta.alias("metadata"))


def text_records(rows: DataFrame, namespace: str, id_col: str = "_id", text_col: str = "content") -> DataFrame:
    """(namespace, id, text, other columns): text rows of one namespace, to be embedded where they are searched."""
    rest = [c for c in rows.columns if c not in (id_col, text_col)]
    return rows.where(F.col(id_col).isNotNull()).select(F.lit(namespace).alias("namespace"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)


def upsert(index: DataFrame, batch: DataFrame, order: list[str], key: str | list[str] = "id") -> DataFrame:
    """``index`` after inserting or replacing by ``key``; the last row of a key in the batch counts. With a namespace in the key an id is its own in each."""
    return merge(index, latest(batch, key, order), key)


def stats(index: DataFrame, namespace: str = "metadata.volume") -> DataFrame:
    """Vectors per namespace, and all of them."""
    ns = F.coalesce(F.nullif(F.col(namespace), F.lit("")), F.lit("Unknown"))
    counts = index.select(ns.alias("namespace")).rollup("namespace").agg(F.count(F.lit(1)).alias("vectors"))
    return counts.select(F.coalesce("namespace", F.lit("(all)")).alias("namespace"), "vectors")
