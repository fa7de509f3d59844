"""Filling containers of fixed capacity, by bulk-synchronous best fit.

All documents of one size are interchangeable, so a sweep matches sizes with gaps rather
than documents: the sizes are taken in falling order, all documents of a size at once, each
to the smallest gap that holds it (its successor among the gaps). The state of a sweep is
a count per size and a run of containers per gap, at most ``capacity`` sizes, whatever the
corpus. The gaps a size doesn't fill are updated and the next size follows. Which document goes
where is settled by its rank among the documents of its size, in a distributed pass.
This gives, in one sweep over the sizes, exactly the result of best fit decreasing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import VOCABULARY, order_bucket, ranked, sized
from lectern.runtime import materialize, small


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, low, high, first container, documents a container): documents of ranks low <= r < high of a size fill successive containers."""
    gaps: list[int] = []  # sorted gaps that have containers
    free: dict[int, list[tuple[int, int]]] = {}  # gap: (first container, containers)
    opened, runs = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in free:
                free[gap] = []
                insort(gaps, gap)
            free[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = free[gap].pop()
                if not free[gap]:
                    del free[gap], gaps[at]
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // size))
                opened += n
            each = gap // size
            full, rest = min(n, left // each), 0
            if full < n and full * each < left:
                rest = left - full * each
            taken = full * each + rest
            runs.append((size, rank, rank + taken, first, each))
            put(gap - each * size, first, full)
            if rest:
                put(gap - rest * size, first + full, 1)
            used = full + bool(rest)
            put(gap, first + used, n - used)
            rank, left = rank + taken, left - taken
    return runs


def pack(documents: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind_col: str = "container_kind", capacity_col: str = "capacity_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, doc_id, piece, start, tokens, container_id): where every document goes, for each kind of container.

    A text longer than the capacity is cut into full containers and a remainder, which is packed like a
    document; any other text is one piece. Ids must be unique; rows with a null id are dropped. A null or
    blank-free empty text has no tokens and one row with a null container. Kinds that are null or hold
    less than one token are dropped, of a repeated kind the largest capacity counts. Empty tables give no rows.
    """
    spark = documents.sparkSession
    sizes = materialize(sized(documents.where(F.col(id_col).isNotNull()), id_col, text_col, [], vocabulary).withColumn("b", order_bucket(F.xxhash64("id"))))
    kinds = {r["k"]: r["c"] for r in containers.groupBy(F.col(kind_col).alias("k")).agg(F.max(F.col(capacity_col).cast("long")).alias("c")).where("k is not null and c >= 1").collect()}
    runs: list[tuple[str, int, int, int, int, int]] = []
    parts: DataFrame | None = None
    for kind, capacity in sorted(kinds.items()):
        rest = F.when(F.col("tokens") <= capacity, F.col("tokens")).otherwise(F.col("tokens") % capacity)
        items = sizes.withColumn("size", rest).where("size > 0")
        counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` sizes
        runs += [(kind, *r) for r in best_fit(counts, capacity)]
        part = sizes.select(F.lit(kind).alias("kind"), "id", "b", "tokens", rest.alias("size"), F.lit(capacity).cast("long").alias("capacity"))
        parts = part if parts is None else parts.union(part)
    out = "container_kind string, doc_id bigint, piece int, start long, tokens long, container_id string"
    if parts is None:
        return spark.createDataFrame([], out).withColumn("doc_id", F.col("doc_id").cast(documents.schema[id_col].dataType))
    # a run for each size and gap it met; their number is bounded by the capacities, not by the corpus
    table = spark.createDataFrame(runs, "kind string, size long, low long, high long, first long, each long")
    placed = ranked(parts.where("size > 0"), ["kind", "size"], "b", ["id"])
    placed = placed.join(small(table), ["kind", "size"]).where("rank >= low and rank < high")
    box = F.concat(F.lit("mixed-"), (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("string"))
    last = placed.select("kind", "id", F.floor((F.col("tokens") - F.col("size")) / F.col("capacity")).cast("int").alias("piece"), (F.col("tokens") - F.col("size")).alias("start"), F.col("size").alias("tokens"), box.alias("container_id"))
    whole = parts.where("tokens > size").select("kind", "id", "capacity", F.explode(F.sequence(F.lit(0), (F.floor((F.col("tokens") - F.col("size")) / F.col("capacity")) - 1).cast("int"))).alias("piece"))
    full = whole.select("kind", "id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"), F.concat(F.lit("full-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"))
    none = parts.where("tokens = 0").select("kind", "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("container_id"))
    return last.union(full).union(none).select(F.col("kind").alias("container_kind"), F.col("id").alias("doc_id"), "piece", "start", "tokens", "container_id")


def fill_report(packed: DataFrame, containers: DataFrame, kind_col: str = "container_kind", capacity_col: str = "capacity_tokens") -> DataFrame:
    """One row per kind: containers used, tokens in them, unused tokens, share filled."""
    used = packed.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    kinds = containers.groupBy(F.col(kind_col).alias("container_kind")).agg(F.max(F.col(capacity_col).cast("long")).alias("capacity_tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return used.join(kinds, "container_kind").select("container_kind", "capacity_tokens", "containers", "tokens", (room - F.col("tokens")).alias("unused_tokens"), F.round(F.col("tokens") / room, 6).alias("filled_share"))
