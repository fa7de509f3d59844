"""Top-k by cosine of a stated query set against all rows, in blocks: of all, or of those within a distance; pairs that meet by hashed signs of random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.relational import top
from lectern.operators.running import CELLS, Running
from lectern.runtime import materialize, narrowed

#: Bytes of query vectors, and of the hits kept for them, that a task holds at once; a larger query set is searched in parts.
QUERY_BYTES = 64 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with a vector of finite numbers that aren't all zero."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return df.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"))


def _directions(dim: int, least: float) -> np.ndarray | None:
    """Random orthonormal directions, as many as keep about all but one in 4,000 pairs of random vectors from seeming to have a cosine of ``least``; none if that takes all dimensions.

    With a share f of the dimensions, such a pair's bound is 1 - f (the rests) and a product of standard deviation sqrt(f / dim): 3.5 of these are to end at ``least``.
    """
    edge = 3.5 / math.sqrt(dim)
    share = ((edge + math.sqrt(edge**2 + 4 * max(0.0, 1 - least))) / 2) ** 2
    return np.linalg.qr(np.random.default_rng((7, dim)).standard_normal((dim, math.ceil(dim * share))))[0] if dim * share < dim - 1 else None


def _sketch(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Of unit vectors the coordinates in the directions and the length of the rest: the product of two sketches is at least that of the vectors (Cauchy-Schwarz)."""
    near = x @ directions
    return np.hstack([near, np.sqrt(np.maximum(0.0, 1 - np.square(near).sum(axis=1, keepdims=True)))]).astype(np.float32)


def _reaching(a: np.ndarray, x: np.ndarray, edge: np.ndarray, sketches: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the rows j of ``x`` that reach the edge of row i of ``a``.

    With sketches only pairs whose bound reaches the edge are scored, unless these are too many to gather within CELLS cells.
    """
    if sketches is not None:
        slack = np.finfo(np.float32).eps * (sketches[0].shape[1] + 8)  # above the rounding errors of the bound and the score
        at = np.flatnonzero(sketches[0] @ sketches[1].T >= (edge - slack).astype(np.float32)[:, None])
        if len(at) * a.shape[1] <= CELLS:
            i, j = np.divmod(at, len(x))
            s = np.round(np.einsum("ij,ij->i", a[i], x[j]), 9) + 0.0
            ok = s >= edge[i]
            return i[ok], j[ok], s[ok]
    s = np.round(a @ x.T, 9) + 0.0  # no negative zero
    i, j = np.nonzero(s >= edge[:, None])
    return i, j, s[i, j]


def _best(queries: dict[int, tuple[pa.Array, np.ndarray]], k: int, least: float = -math.inf):
    """The k best rows of a task for each query, of those with ``least`` or more, per vector length; the product is made in tiles of CELLS cells at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Running(len(ids), k, least) for dim, (ids, _) in queries.items()}
        directions = {dim: _directions(dim, least) for dim in queries}
        sketches = {dim: _sketch(queries[dim][1], d) for dim, d in directions.items() if d is not None}
        kind = None
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            kind = batch.column("id").type
            for dim in np.unique(dims).tolist():
                if dim not in queries:
                    continue
                matrix, own = queries[dim][1], batch.filter(pa.array(dims == dim))
                ids, flat, held = own.column("id").to_numpy(zero_copy_only=False), own.column("v").flatten().to_numpy().reshape(-1, dim), best[dim]
                for low in range(0, len(ids), 1024):
                    x = _unit(flat[low : low + 1024])
                    rough = _sketch(x, directions[dim]) if dim in sketches else None
                    step = max(1, CELLS // len(x))
                    for lo in range(0, len(matrix), step):
                        part = slice(lo, lo + step)
                        i, j, s = _reaching(matrix[part], x, held.edge[part], None if rough is None else (sketches[dim][part], rough))
                        held.add(i + lo, s, ids[low + j])
        for dim, held in best.items():
            yield from held.batches(queries[dim][0], kind)

    return run


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", vector_col: str = "vector", itself: bool = False, least: float = -math.inf) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows of ``corpus`` with ``least`` or more for each query, ties by id.

    The queries go to the tasks in parts of QUERY_BYTES at most; the corpus meets a part in tiles of one matrix
    product each, and a task puts out a query's best once, so what is shuffled is k rows per query and task. Vectors of another
    length than the query's, invalid ones and, unless ``itself``, rows with the query's id don't count.
    """
    q = materialize(_valid(queries, query_id, vector_col).withColumn("dim", F.size("v")))
    rows = narrowed(_valid(corpus, id_col, vector_col).withColumn("dim", F.size("v")))
    schema = f"query_id {q.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    kept = k if itself else k + 1
    n = q.agg(F.ceil(F.coalesce(F.sum(F.col("dim") + 2 * kept), F.lit(0)) * 8 / QUERY_BYTES).cast("int").alias("n")).first()["n"]
    found = None
    for part in range(max(1, n)):
        own = q.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n))) == part).toArrow()
        sizes = own.column("dim").to_numpy()
        held = {}
        for dim in np.unique(sizes).tolist():
            t = own.filter(pa.array(sizes == dim)).combine_chunks()
            held[dim] = t.column("id").combine_chunks(), _unit(t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        hits = rows.mapInArrow(_best(held, kept, least), schema)
        found = hits if found is None else found.union(hits)
    if not itself:
        found = found.where(F.col("query_id") != F.col("id"))
    return top(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


def hash_shape(distance: float, recall: float, tables: int) -> tuple[int, int]:
    """(bits of a table, tables): the most bits with which ``tables`` tables at most meet a pair of unit vectors at ``distance`` with probability ``recall``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, 1 - distance**2 / 2))) / math.pi
    if agree <= 0:
        raise ValueError("the distance must be below that of opposite vectors")
    needed = lambda bits: max(1, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits)))) if agree < 1 else 1
    bits = max((b for b in range(1, 31) if needed(b) <= tables), default=1)
    return bits, needed(bits)


def _signs(bits: int, tables: int, seed: int, name: str):
    weight = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, dim)).standard_normal((dim, bits * tables))
                x = own.column("v").flatten().to_numpy().reshape(-1, dim)
                keys = (x @ planes[dim] > 0).reshape(len(x), tables, bits) @ weight
                keys += np.arange(tables) << bits
                yield pa.RecordBatch.from_arrays([own.column("id").take(pa.array(np.repeat(np.arange(len(x)), tables))), pa.array(keys.ravel()), pa.array(np.full(keys.size, dim, dtype=np.int32))], [name, "key", "dim"])

    return run


def lsh_candidates(queries: DataFrame, corpus: DataFrame, distance: float, recall: float = 0.95, tables: int = 48, seed: int = 7) -> DataFrame:
    """(query_id, id): the pairs that agree in all signs of some table; of vectors of one length only."""
    bits, n = hash_shape(distance, recall, tables)
    kind = lambda df: df.schema["id"].dataType.simpleString()
    q = queries.mapInArrow(_signs(bits, n, seed, "query_id"), f"query_id {kind(queries)}, key long, dim int")
    c = corpus.mapInArrow(_signs(bits, n, seed, "id"), f"id {kind(corpus)}, key long, dim int")
    return q.join(c, ["key", "dim"]).select("query_id", "id").distinct()


def lsh_topk(queries: DataFrame, corpus: DataFrame, k: int, distance: float, query_id: str = "query_id", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, score, rank) of the k most similar rows within ``distance`` (of unit vectors), all of them: none is missed.

    Random projections, with the length of what they leave out, bound each pair's score from above, and only pairs that could be
    within the distance are scored; the nearer the wanted rows, the shorter the projections. Pairs stay within the task that reads the row, as in ``cosine_topk``.
    """
    return cosine_topk(queries, corpus, k, query_id, id_col, vector_col, least=1 - distance**2 / 2)
