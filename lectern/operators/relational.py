"""Keyed merges, latest rows and global numbering, without a task that holds everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import materialize


def latest(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, nulls smallest; rows with a null key are dropped.

    One aggregation with a map-side part, so a key with many repeats costs no sort.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in order + rest)).select(*df.columns)


def merge(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Insert or replace by key: all of ``new``, and what it doesn't replace of ``old``."""
    keys = [key] if isinstance(key, str) else key
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``df`` with its 0-based position in ``order``, by range partitions and their sizes; ``order`` should be unique."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))  # one row per partition
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + local).cast("long")).drop("__part", "__before")


def batches(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """``df`` with the number of its batch of ``size`` rows in ``order``."""
    return numbered(df, order, "__n").withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key; the window's group limit prunes before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
