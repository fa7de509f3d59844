"""One ranking from several differently scaled scores, by robust rank aggregation.

Every score becomes a normalised rank within its list, so no scale or spread counts.
Of an item's sorted normalised ranks r(1) <= ... <= r(m), the j-th order statistic of m
uniform ranks is at most r(j) with probability P_j, a binomial tail (a beta
distribution). ``rho`` is the corrected minimum, min(1, m * min P_j).

Ranked by ``rho`` alone one lucky score can carry an item, as the minimum lets the best
order statistic decide; that isn't a ranking in which all scores count alike. The items
are therefore ranked by the mean logarithm of all P_j, and ``rho`` is given as their
significance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tail(r: Column, j: int, m: int) -> Column:
    """Probability that at least j of m uniform numbers are at most r."""
    return sum((F.lit(float(math.comb(m, i))) * F.pow(r, F.lit(float(i))) * F.pow(F.lit(1.0) - r, F.lit(float(m - i))) for i in range(j, m + 1)), F.lit(0.0))


def rank_lists(df: DataFrame, list_col: str, items_col: str, item_id: str, scores: list[str], least: int = 4) -> DataFrame:
    """(list_id, item, position, significance, evidence, n): one row per list and item, position 1 leads.

    ``items_col`` is an array of structs with ``item_id`` and ``scores``; higher scores are better. Rows with
    a null list id are dropped; of repeated lists the first by content counts. An item standing twice in a
    list counts once, with its highest scores; null items and null ids are dropped. A null or NaN score counts
    as the lowest of that score in the list; a score nobody has is a tie of all. Lists below ``least``
    items, empty and null lists have no rows. Equal scores share the mean of their ranks, equal evidence
    is ordered by id. Each list is ranked inside its own row, so no list or id can skew a shuffle.
    """
    m = len(scores)
    clean = F.transform(F.filter(F.col(items_col), lambda x: x.isNotNull() & x[item_id].isNotNull()), lambda x: F.struct(x[item_id].cast("string").alias("id"), *(F.when(F.isnan(x[s].cast("double")), None).otherwise(x[s].cast("double")).alias(f"s{i}") for i, s in enumerate(scores))))
    lists = df.select(F.col(list_col).alias("list_id"), F.array_sort(clean).alias("raw")).where("list_id is not null").groupBy("list_id").agg(F.min("raw").alias("raw"))
    ids = F.array_distinct(F.transform("raw", lambda x: x["id"]))

    def best(i: Column, k: int) -> Column:
        return F.array_max(F.transform(F.filter("raw", lambda x: x["id"] == i), lambda x: x[f"s{k}"])).alias(f"s{k}")

    def filled(k: int) -> Column:
        values = F.transform("items", lambda x: x[f"s{k}"])
        return F.transform(values, lambda v: F.coalesce(v, F.array_min(values), F.lit(0.0)))

    once = F.transform(ids, lambda i: F.struct(i.alias("id"), *(best(i, k) for k in range(m))))
    lists = lists.select("list_id", once.alias("items")).where(F.size("items") >= least).withColumn("n", F.size("items"))
    lists = lists.withColumns({f"v{k}": filled(k) for k in range(m)})
    flat = lists.select("list_id", "n", *(f"v{k}" for k in range(m)), F.posexplode("items").alias("p", "x"))

    def rank(k: int) -> Column:
        mine = F.element_at(f"v{k}", F.col("p") + 1)
        above, equal = F.size(F.filter(f"v{k}", lambda v: v > mine)), F.size(F.filter(f"v{k}", lambda v: v == mine))
        return (above + (equal + 1) / 2 - 0.5) / F.col("n")

    ranked = flat.select("list_id", "n", F.col("x.id").alias("item"), F.array_sort(F.array(*(rank(k) for k in range(m)))).alias("r"))
    tails = [_tail(F.element_at("r", j), j, m) for j in range(1, m + 1)]
    ranked = ranked.select("list_id", "n", "item", *(t.alias(f"p{j}") for j, t in enumerate(tails)))
    p = [F.col(f"p{j}") for j in range(m)]
    low = F.least(*p) if m > 1 else p[0]
    evidence = F.round(sum((F.log(x) for x in p), F.lit(0.0)) / m, 9)
    scored = ranked.select("list_id", "n", "item", F.round(F.least(F.lit(1.0), low * m), 9).alias("significance"), evidence.alias("evidence"))
    order = F.array_sort(F.collect_list(F.struct("evidence", "item", "significance")))
    whole = scored.groupBy("list_id", "n").agg(order.alias("o"))
    return whole.select("list_id", "n", F.posexplode("o").alias("p", "o")).select("list_id", F.col("o.item").alias("item"), (F.col("p") + 1).alias("position"), F.col("o.significance").alias("significance"), F.col("o.evidence").alias("evidence"), "n")
