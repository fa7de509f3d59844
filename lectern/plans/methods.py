"""The composed retrieval methods, each one plan over all queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import dense, fusion, rerank, sparse
from lectern.runtime import materialize
from lectern.sources import providers

DENSE_WEIGHT, SPARSE_WEIGHT, RRF_K = 1.2, 1.0, 60


class Retrieval:
    """``passages``: id, text, context, reference, volume. ``queries``: query_id, query.

    Two dense indexes, over the texts and over the contexts, and an inverted index; they are embedded
    once and written to the shared folder. ``scorer`` reranks; ``custom`` is an optional second
    scorer, and asking for its method without one is an error.
    """

    def __init__(self, passages: DataFrame, queries: DataFrame, embedder: providers.Embedder | None = None, scorer: rerank.Scorer = rerank.overlap_scorer, custom: rerank.Scorer | None = None):
        self.passages = passages.select("id", "text", F.coalesce("context", "text").alias("context"), "reference", F.coalesce("volume", F.lit("Unknown")).alias("volume"))
        self.queries, self.embedder, self.scorer, self.custom = queries.select("query_id", "query"), embedder, scorer, custom
        self._made: dict[str, DataFrame] = {}
        self._held: dict[str, tuple[int, DataFrame]] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialize(make())
        return self._made[name]

    def _vectors(self, column: str) -> DataFrame:
        return self._once(column, lambda: providers.embed(self.passages.select("id", column), column, self.embedder).select("id", "vector"))

    def _asked(self) -> DataFrame:
        return self._once("asked", lambda: providers.embed(self.queries, "query", self.embedder))

    def _dress(self, hits: DataFrame, method: str, source: str | None = None) -> DataFrame:
        full = hits.join(self.passages, "id").join(self.queries, "query_id")
        return full.select("query_id", "query", F.lit(method).alias("method"), "rank", "id", "score", "text", "reference", "volume", "context", F.lit(source).cast("string").alias("source"))

    def _list(self, name: str, k: int) -> DataFrame:
        """The first k hits of a list; a longer list that is already held is cut, not searched again."""
        if name in self._held and self._held[name][0] >= k:
            return self._held[name][1].where(F.col("rank") <= k)
        if name == "sparse":
            return sparse.bm25_topk(self.queries, self.passages, k, text_col="context")
        return dense.cosine_topk(self._asked(), self._vectors(name), k, itself=True)

    def hold(self, name: str, k: int) -> None:
        """Search once for several methods: the list ``text``, ``context`` or ``sparse`` to depth k."""
        if self._held.get(name, (0,))[0] < k:
            self._held[name] = k, materialize(self._list(name, k))

    def _dense(self, column: str, k: int) -> DataFrame:
        return self._list(column, k)

    def _sparse(self, k: int) -> DataFrame:
        return self._list("sparse", k)

    def legacy(self, k: int = 10) -> DataFrame:
        return self._dress(self._dense("text", k), "legacy").withColumn("context", F.lit(None).cast("string"))

    def contextual(self, k: int = 10) -> DataFrame:
        return self._dress(self._dense("context", k), "contextual")

    def dense(self, k: int = 20) -> DataFrame:
        return self._dress(self._dense("context", k), "dense", "dense")

    def sparse(self, k: int = 20) -> DataFrame:
        return self._dress(self._sparse(k), "sparse", "sparse")

    def _rerank(self, hits: DataFrame, n: int, method: str, scorer: rerank.Scorer) -> DataFrame:
        return rerank.rerank(hits, n, scorer).withColumn("method", F.lit(method))

    def contextual_rerank(self, initial: int = 150, n: int = 20) -> DataFrame:
        return self._rerank(self.contextual(initial), n, "contextual_rerank", self.scorer)

    def contextual_custom_rerank(self, initial: int = 150, n: int = 20) -> DataFrame:
        if self.custom is None:
            raise ValueError("no custom reranker was given")
        return self._rerank(self.contextual(initial), n, "contextual_custom_rerank", self.custom)

    def fused(self, k: int, limit: int) -> DataFrame:
        """Ids are fused; texts join only what survives."""
        both = self._sparse(k).withColumn("source", F.lit("sparse")).unionByName(self._dense("context", k).withColumn("source", F.lit("dense")))
        named = both.join(self.passages.select("id", "reference"), "id").drop("score")
        out = fusion.fuse(named, {"sparse": SPARSE_WEIGHT, "dense": DENSE_WEIGHT}, RRF_K, limit).withColumnRenamed("rrf_score", "score")
        return out.join(self.passages.drop("reference"), "id").join(self.queries, "query_id")

    def hybrid_rrf(self, k: int = 50, n: int = 20) -> DataFrame:
        return self.fused(k, n).withColumn("method", F.lit("hybrid_rrf"))

    def hybrid_rerank(self, k: int = 75, fuse: int = 50, n: int = 20) -> DataFrame:
        return self._rerank(self.fused(k, fuse), n, "hybrid_rerank", self.scorer)

    def small_hybrid(self, k: int = 20, initial: int = 15, n: int = 5) -> DataFrame:
        """The stand-alone flow: reference, text, rerank_score, original_sources."""
        out = rerank.rerank(self.fused(k, k), n, self.scorer, initial=initial)
        return out.select("query_id", "rank", "reference", "text", F.col("score").alias("rerank_score"), F.col("sources").alias("original_sources"))

    def retrieve_all(self, k: int = 10, hybrid: bool = True) -> DataFrame:
        """All methods in one table; the custom reranker only if there is one."""
        cols = ["query_id", "method", "rank", "id", "score", "reference"]
        self.hold("context", max(k, 150))
        if hybrid:
            self.hold("sparse", 75)
        parts = [self.legacy(k), self.contextual(k), self.contextual_rerank()]
        if self.custom is not None:
            parts.append(self.contextual_custom_rerank())
        if hybrid:
            parts += [self.hybrid_rrf(), self.hybrid_rerank()]
        return reduce(DataFrame.unionByName, (p.select(*cols) for p in parts))
