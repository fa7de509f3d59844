"""The k most similar vectors of every vector, by multi-index hashing.

Unit vectors are turned by several learned rotations (iterative quantization on a
bounded sample); the signs are the code, of BITS bits whatever the collection. They aren't centred: a large group of alike vectors
would pull the mean to itself and lose its own angles. The code is cut into bytes, of which as many as ``recall`` asks for are each
the key of an index: codes that agree in a byte meet in its bucket. There the whole codes are searched: all against all
while they are few, else by an index of their own, of longer substrings in whose buckets and neighbouring buckets (one bit
apart) a code is looked up. With m substrings every code of the bucket within 2 m - 1 bits is retrieved for certain (pigeonhole).
Pairs within the Hamming radius are reranked with the floats.
What is sent is a code for each byte used, so bytes a vector don't grow with the collection; the search within a bucket
grows in memory only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import by_size, materialize

#: Vectors collected to learn the rotations.
SAMPLE = 20_000
#: Bits of a code.
BITS = 288
#: Bits of a substring that is the key of a bucket.
KEY = 8
#: A bucket above this many codes is searched in pairs of chunks, each pair its own group; the chunks grow only beyond 4,095 of them.
CHUNK = 1 << 20
#: Codes of a group that are compared all against all; more have an index of their own.
LOCAL = 2_048
#: Probability with which that index finds a pair at the least wanted cosine.
LOCAL_RECALL = 0.97
#: Tables of exceptions (hot buckets, copies) are broadcast up to so many rows, joined by shuffle beyond.
BROADCAST = 200_000


def index_shape(n: int, recall: float, recall_at: float) -> tuple[int, int]:
    """(bits of a substring, substrings) of an index of ``n`` codes without probing: buckets stay near 2**8 codes on average whatever n is; the number of substrings follows from the recall."""
    bits = min(24, max(12, math.ceil(math.log2(max(n, 2))) - 8))
    agree = (1 - math.acos(recall_at) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def local_shape(n: int, recall: float, recall_at: float) -> tuple[int, int]:
    """As ``index_shape``, with probing: as the buckets one bit apart are looked up too, substrings are four bits longer, and their number follows from the probability of at most one differing bit."""
    bits, same = index_shape(n, recall, recall_at)[0] + 4, 1 - math.acos(recall_at) / math.pi
    near = same**bits + bits * (1 - same) * same ** (bits - 1)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def key_tables(recall: float, recall_at: float) -> int:
    """Bytes of the code that are keys: a pair at ``recall_at`` agrees in one of them with probability ``recall``."""
    agree = (1 - math.acos(recall_at) / math.pi) ** KEY
    return min(BITS // KEY, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = 15, seed: int = 11) -> np.ndarray:
    """A (dim, bits) projection: as many independently started rotations, side by side, as ``bits`` needs."""
    dim, x = sample.shape[1], sample.astype(np.float32)
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        for _ in range(rounds if len(x) >= dim else 0):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T.astype(np.float32)
        parts.append(r)
    return np.concatenate(parts, 1)[:, :bits]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _codes(rotation: np.ndarray, tables: int, counts_only: bool):
    dim = len(rotation)

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("v"), dim)
        return np.packbits(x @ rotation > 0, axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((tables, 1 << KEY), dtype=np.int64)
        for batch in batches:
            c = codes(batch)
            for t in range(tables):
                total[t] += np.bincount(c[:, t], minlength=1 << KEY)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["key", "n"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = codes(batch)
            whole = pa.array([r.tobytes() for r in c], pa.binary())
            rid = batch.column("rid")
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(c[:, t].astype(np.int64) + (t << KEY)), rid, whole], ["key", "rid", "code"])

    return count if counts_only else code


def _words(code: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(code, ((0, 0), (0, -code.shape[1] % 8)))).view(np.uint64)


def _distance(word: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = np.zeros(len(i), dtype=np.uint16)
    for w in range(word.shape[1]):
        d += np.bitwise_count(word[i, w] ^ word[j, w])
    return d


def _all_pairs(code: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a ``left`` and a ``right`` code within the radius, in blocks."""
    word = _words(code)
    step = max(1, 2_000_000 // max(1, len(right)))
    for lo in range(0, len(left), step):
        a = left[lo : lo + step]
        d = np.zeros((len(a), len(right)), dtype=np.uint16)
        for w in range(word.shape[1]):
            d += np.bitwise_count(word[a, w][:, None] ^ word[right, w][None, :])
        i, j = np.nonzero(d <= radius)
        yield a[i], right[j]


def _probed_pairs(code: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, shape: tuple[int, int], skip: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_all_pairs``, by an index: each left code is looked up in the bucket of its substring and those one bit apart. ``skip``: the byte in which all agree, which no substring uses. A pair comes once, from the first substring that is near enough."""
    size, count = shape
    free = np.setdiff1d(np.arange(code.shape[1] * 8), np.arange(skip * 8, skip * 8 + 8))
    rng, order = np.random.default_rng(5), []
    while sum(map(len, order)) < size * count:
        order.append(rng.permutation(free))
    at = np.concatenate(order)[: size * count].reshape(count, size)
    bits, weight = np.unpackbits(code, axis=1), (1 << np.arange(size)).astype(np.int64)
    subs = np.stack([bits[:, a].astype(np.int64) @ weight for a in at])
    word, masks = _words(code), np.concatenate(([0], weight))
    for t in range(count):
        there = np.argsort(subs[t, right], kind="stable")
        values = subs[t, right][there]
        for mask in masks:
            wanted = subs[t, left] ^ mask
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = high - low
            ends = np.cumsum(n)
            begin = 0
            while begin < len(left):  # some two million lookups at a time
                done = ends[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + 2_000_000, "right")))
                part = n[begin:stop]
                i = np.repeat(left[begin:stop], part)
                j = right[there[np.repeat(low[begin:stop] - (np.cumsum(part) - part), part) + np.arange(part.sum())]] if len(i) else i
                ok = _distance(word, i, j) <= radius
                i, j = i[ok], j[ok]
                for earlier in range(t):
                    if not len(i):
                        break
                    fresh = np.bitwise_count(subs[earlier, i] ^ subs[earlier, j]) > 1
                    i, j = i[fresh], j[fresh]
                yield i, j
                begin = stop


def _meet(tables: int, radius: int, recall: float, recall_at: float):
    """Over rows sorted by g (bucket, two chunks, side): the pairs of one bucket, or of two chunks of one, within the radius; each pair only in the first key it agrees in."""

    def pairs(key: int, rid: np.ndarray, code: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        table = key >> KEY
        left = np.flatnonzero(side <= 0)
        right = left if side[0] == 0 and (side == 0).all() else np.flatnonzero(side == 1)
        if len(rid) <= LOCAL:
            found = _all_pairs(code, left, right, radius)
        else:
            found = _probed_pairs(code, left, right, radius, local_shape(len(rid), recall, recall_at), table)
        found_a, found_b = [], []
        for i, j in found:
            ok = rid[i] < rid[j] if right is left else rid[i] != rid[j]
            i, j = i[ok], j[ok]
            first = np.argmax(code[i, :tables] == code[j, :tables], axis=1) == table
            found_a.append(i[first])
            found_b.append(j[first])
        i, j = np.concatenate(found_a) if found_a else left[:0], np.concatenate(found_b) if found_b else left[:0]
        return (np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])) if len(i) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, ...]] = []

        def flush(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            key, group, rid, code, side = cols
            cut = np.flatnonzero(np.diff(group)) + 1
            out_a, out_b = [], []
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(group)), strict=True):
                if hi - lo > 1 and (found := pairs(int(key[lo]), rid[lo:hi], code[lo:hi], side[lo:hi])):
                    out_a.append(found[0])
                    out_b.append(found[1])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            g = batch.column("g").to_numpy()
            rest.append((g >> 26, g >> 2, batch.column("rid").to_numpy(), code, (g & 3) - 1))
            if rest[0][1][0] != g[-1] >> 2:
                cols = tuple(np.concatenate(x) for x in zip(*rest, strict=True))
                end = int(np.flatnonzero(cols[1] != cols[1][-1])[-1]) + 1
                rest = [tuple(x[end:] for x in cols)]
                yield from flush(tuple(x[:end] for x in cols))
        if rest:
            yield from flush(tuple(np.concatenate(x) for x in zip(*rest, strict=True)))

    return run


def _cosine(dim: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.einsum("ij,ij->i", _matrix(batch.column("va"), dim).astype(np.float64), _matrix(batch.column("vb"), dim).astype(np.float64))
            ok = c >= least
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("a").to_numpy()[ok]), pa.array(batch.column("b").to_numpy()[ok]), pa.array(np.minimum(c[ok], 1.0))], ["a", "b", "cosine"])

    return run


def _unit(dim: int):
    """Normalised vectors, and a key that is equal for copies up to scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            near = np.round(x * 65536).astype(np.int32)
            keys = pa.array([r.tobytes() for r in near], pa.binary())
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * dim, dim), pa.int32()), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), keys, values], ["id", "near", "v"])

    return run


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, latest: str | None = None) -> DataFrame:
    """(id, v) of the rows with an id and ``dim`` finite numbers that are not all zero; of one id the row with the greatest ``latest`` (else the greatest vector)."""
    v = F.col(vector_col).cast("array<double>")
    kept = df.select(F.col(id_col).cast("string").alias("id"), v.alias("v"), (F.col(latest) if latest else F.lit(0)).alias("at"))
    ok = F.coalesce((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    return kept.where(F.col("id").isNotNull() & ok).groupBy("id").agg(F.max(F.struct("at", F.col("v").cast("array<float>").alias("v"))).alias("x")).select("id", "x.v")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if by_size(df, BROADCAST) else df


def most_similar(
    df: DataFrame, id_col: str = "id", vector_col: str = "values", k: int = 5, min_cosine: float = 0.8, dim: int = 96, latest: str | None = None, recall: float = 0.93, recall_at: float = 0.86, sample: int = SAMPLE
) -> DataFrame:
    """(id, rank, other, cosine): of every valid vector the k most similar other ids with a cosine of at least ``min_cosine``, ties by id.

    Invalid vectors (null, wrong length, null or not finite numbers, all zero) and null ids have no rows;
    repeated rows of an id count once; an empty table gives no rows; other columns are ignored. Vectors
    equal up to scale form a class that is indexed once, so a third of all rows may be copies of one
    vector; a bucket above CHUNK codes is searched chunk against chunk. The index holds every vector;
    only the rotations are learned from a sample of ``sample`` vectors. Recall is approximate by
    design: at ``recall_at`` and above a pair is found with probability ``recall`` at least.
    """
    spark = df.sparkSession
    unit = valid_vectors(df, id_col, vector_col, dim, latest).mapInArrow(_unit(dim), "id string, near binary, v array<float>")
    rows = materialize(unit.withColumn("near", F.unhex(F.md5("near"))).withColumn("rid", F.monotonically_increasing_id()))
    classes = rows.groupBy("near").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    members = materialize(rows.select("near", "rid", "id").join(classes.select("near", "rep"), "near").select("rid", "id", "rep"))
    vectors = rows.select("rid", "v").join(_small(members.where("rid <> rep").select("rid")), "rid", "left_anti")
    n = rows.count()
    # a hash picks a few more than wanted before any is sorted or sent
    share = min(1.0, 1.3 * sample / max(n, 1) + 1e-6)
    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    some = np.array([r["v"] for r in few.orderBy(F.xxhash64("id"), "id").select("v").limit(sample).collect()], dtype=np.float32).reshape(-1, dim)
    tables = key_tables(recall, recall_at)
    rotation = learn_rotations(some, BITS)
    theta = math.acos(min_cosine) / math.pi
    radius = round(BITS * theta + 2.3 * math.sqrt(BITS * theta * (1 - theta)))

    counts = vectors.mapInArrow(_codes(rotation, tables, True), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = materialize(counts.where(F.col("n") > CHUNK).select("key", F.least(F.lit(4095), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunks")))
    codes = vectors.mapInArrow(_codes(rotation, tables, False), "key long, rid long, code binary").join(_small(hot), "key", "left")
    # one number holds bucket, chunks and side, so that little more than the codes is shuffled
    group = lambda i, j, side: F.shiftleft("key", 26) + F.shiftleft(i.cast("long"), 14) + F.shiftleft(j.cast("long"), 2) + side
    own, x = F.pmod(F.xxhash64("rid"), F.col("chunks")), F.col("x")
    split = codes.withColumn("x", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    side = F.when(own == x, 1).when(own < x, 0).otherwise(2)
    g = F.when(F.col("chunks").isNull(), group(F.lit(0), F.lit(0), F.lit(1))).otherwise(group(F.least(own, x), F.greatest(own, x), side))
    buckets = split.select(g.alias("g"), "rid", "code").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.shiftright("g", 2)).sortWithinPartitions("g")
    pairs = buckets.mapInArrow(_meet(tables, radius, max(recall, LOCAL_RECALL), min_cosine), "a long, b long")
    first = pairs.join(vectors.select(F.col("rid").alias("a"), F.col("v").alias("va")), "a")
    scored = first.join(vectors.select(F.col("rid").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb").mapInArrow(_cosine(dim, min_cosine), "a long, b long, cosine double")
    scored = materialize(scored)

    both = scored.select("a", "b", "cosine").union(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k).select("a", "b", "cosine")
    # at most k + 1 ids of a class can matter to any one record
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", "id")
    single = rows.select("rid", "id").join(_small(members.select("rid")), "rid", "left_anti")
    targets = single.select(F.col("rid").alias("b"), F.col("id").alias("other")).union(few.select(F.col("rep").alias("b"), F.col("id").alias("other")))
    owners = single.select(F.col("rid").alias("a"), "id").union(members.select(F.col("rep").alias("a"), "id"))
    across = near.join(targets, "b").select("a", "other", "cosine").join(owners, "a").select("id", "other", "cosine")
    copies = members.join(few.select("rep", F.col("id").alias("other")), "rep").where("id <> other").select("id", "other", F.lit(1.0).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return across.union(copies).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "other", "cosine")


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs in which one is among the neighbours of the other."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
