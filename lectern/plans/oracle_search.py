"""DuckDB SQL of the retrieval methods: hashed embeddings, BM25, fusion, reranking, evaluation and training candidates, from the texts on."""

from __future__ import annotations

from lectern.plans.oracle import SHARE, P, Q, _w, metrics_of, tests_of

DIM = 64
SLOT = f"('0x' || substr(md5(term), 1, 8))::ubigint % {DIM}"
SIGN = "CASE WHEN instr('13579bdf', substr(md5(term), 10, 1)) > 0 THEN 1 ELSE -1 END"
BASE = f"{P}, {Q}, ps AS (SELECT reference AS id, text, coalesce(context, text) AS context, reference, coalesce(volume, 'Unknown') AS volume FROM p)"
FIVE = ("legacy", "contextual", "contextual_rerank", "hybrid_rrf", "hybrid_rerank")


def _vectors(name: str, table: str, key: str, column: str) -> str:
    """Components (k, slot, x) of the vectors, scaled to unit length; a text without a word has none."""
    return f"""{name}w AS (SELECT {key} AS k, unnest({_w(column)}) AS term FROM {table}),
      {name}c AS (SELECT k, {SLOT} AS slot, sum({SIGN})::double AS x FROM {name}w GROUP BY 1, 2),
      {name} AS (SELECT k, slot, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM {name}c QUALIFY sum(x * x) OVER (PARTITION BY k) > 0)"""


def _dense(name: str, vectors: str, k: int) -> str:
    """A vector without a common slot has cosine 0 and still counts."""
    return f"""{name}s AS (SELECT qk.k AS query_id, pk.k AS id, round(coalesce(d.x, 0), 9) + 0.0::double AS score FROM (SELECT DISTINCT k FROM qv) qk CROSS JOIN (SELECT DISTINCT k FROM {vectors}) pk
        LEFT JOIN (SELECT a.k AS qk, b.k AS pk, sum(a.x * b.x) AS x FROM qv a JOIN {vectors} b USING (slot) GROUP BY 1, 2) d ON d.qk = qk.k AND d.pk = pk.k),
      {name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


def _sparse(k: int) -> str:
    return f"""bw AS (SELECT id, unnest({_w('context')}) AS term FROM ps), btf AS (SELECT id, term, count(*) AS tf FROM bw GROUP BY 1, 2), bdl AS (SELECT id, len({_w('context')}) AS dl FROM ps),
      bz AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bdl), bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY 1), bq AS (SELECT query_id, unnest(list_distinct({_w('query')})) AS term FROM a),
      bs AS (SELECT bq.query_id, btf.id, round(sum(ln(1 + (bz.n - bdf.df + 0.5) / (bdf.df + 0.5)) * btf.tf * 2.2::double / (btf.tf + 1.2::double * (0.25::double + 0.75::double * bdl.dl / bz.avgdl))), 9) AS score FROM bq JOIN btf USING (term) JOIN bdf USING (term) JOIN bdl USING (id), bz GROUP BY 1, 2),
      sp AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


def _fused(name: str, k: int, limit: int) -> str:
    return f"""{name}x AS (SELECT query_id, id, rank, 0 AS li, 1.0::double / (60 + rank) AS c FROM sp WHERE rank <= {k} UNION ALL SELECT query_id, id, rank, 1, 1.2::double / (60 + rank) FROM dc WHERE rank <= {k}),
      {name}f AS (SELECT query_id, id, round(sum(c), 9) AS score, string_agg(CASE li WHEN 0 THEN 'sparse' ELSE 'dense' END, ',' ORDER BY li, rank) AS sources, min(li * 1000000 + rank) AS first FROM {name}x GROUP BY 1, 2),
      {name} AS (SELECT query_id, id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM {name}f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) <= {limit})"""


def _reranked(name: str, source: str, initial: int, n: int, extra: str = "") -> str:
    """``extra``: columns of the source that are kept, each with a comma before it."""
    share = SHARE.format(_w("a.query"), _w("ps.text"))
    return f"""{name}s AS (SELECT x.query_id, x.id, x.rank AS original_rank{extra}, round({share}, 9) AS score FROM {source} x JOIN a USING (query_id) JOIN ps USING (id) WHERE x.rank <= {initial}),
      {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM {name}s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) <= {n})"""


def _all(k: int) -> str:
    """Tables of the five methods, the first two to depth k."""
    return f"""{BASE}, {_vectors('qv', 'a', 'query_id', 'query')}, {_vectors('tv', 'ps', 'id', 'text')}, {_vectors('cv', 'ps', 'id', 'context')}, {_dense('dt', 'tv', k)}, {_dense('dc', 'cv', 150)}, {_sparse(75)},
      {_fused('h', 50, 20)}, {_fused('g', 75, 50)}, {_reranked('cr', 'dc', 150, 20)}, {_reranked('hr', 'g', 50, 20)},
      every AS (SELECT 'legacy' AS method, query_id, rank, id, score FROM dt UNION ALL SELECT 'contextual', query_id, rank, id, score FROM dc WHERE rank <= {k}
        UNION ALL SELECT 'contextual_rerank', query_id, rank, id, score FROM cr UNION ALL SELECT 'hybrid_rrf', query_id, rank, id, score FROM h UNION ALL SELECT 'hybrid_rerank', query_id, rank, id, score FROM hr)"""


def _graded() -> str:
    share = SHARE.format(_w("a.query"), _w("ps.text"))
    return f"""{_all(20)}, asked AS (SELECT query_id, query FROM a WHERE query IS NOT NULL), ms AS (SELECT DISTINCT method FROM every),
      r AS (SELECT method || '|' || query_id AS run_id, query_id, query, method, NULL::double AS latency_ms FROM asked CROSS JOIN ms),
      h2 AS (SELECT e.method || '|' || e.query_id AS run_id, e.method, e.query_id, e.rank, e.id, {share} AS sh FROM every e JOIN asked a USING (query_id) JOIN ps USING (id)),
      h3 AS (SELECT run_id, method, query_id, rank, id, CASE WHEN sh >= 0.75 THEN 3 WHEN sh >= 0.5 THEN 2 WHEN sh >= 0.25 THEN 1 ELSE 0 END AS grade FROM h2)"""


def sql() -> dict[str, str]:
    dense10 = f"WITH {BASE}, {_vectors('qv', 'a', 'query_id', 'query')}, {_vectors('tv', 'ps', 'id', 'text')}, {_vectors('cv', 'ps', 'id', 'context')}, {_dense('dt', 'tv', 10)}, {_dense('dc', 'cv', 10)}"
    small = f"WITH {BASE}, {_vectors('qv', 'a', 'query_id', 'query')}, {_vectors('cv', 'ps', 'id', 'context')}, {_dense('dc', 'cv', 20)}, {_sparse(20)}, {_fused('h', 20, 20)}, {_reranked('z', 'h', 15, 5, ', x.sources')}"
    share = SHARE.format(_w("o.query"), _w("ps.text"))
    grade = "CASE WHEN sh >= 0.75 THEN 3 WHEN sh >= 0.5 THEN 2 WHEN sh >= 0.25 THEN 1 ELSE 0 END"
    graded = _graded()
    pairs = ", ".join(f"('{x}', '{y}')" for x, y in zip(("legacy", "contextual", "contextual_rerank", "contextual_rerank", "hybrid_rrf"), ("contextual", "contextual_rerank", "hybrid_rrf", "hybrid_rerank", "hybrid_rerank"), strict=True))
    return {
        "lsh_topk": """WITH v AS (SELECT * FROM (SELECT id, "values"::double[] AS x, row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC NULLS LAST, "values" DESC NULLS LAST) k FROM index_records WHERE id IS NOT NULL) WHERE k = 1 AND len(x) = 96 AND list_bool_and(list_transform(x, lambda y: y IS NOT NULL AND isfinite(y))) AND list_bool_or(list_transform(x, lambda y: y <> 0))),
          s AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.x, c.x), 9) AS score FROM v q JOIN v c ON q.id <> c.id WHERE ('0x' || substr(md5(q.id), 1, 4))::int % 20 = 0)
          SELECT query_id, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.8) WHERE rank <= 10""",
        "legacy_vs_contextual": dense10 + " SELECT query_id, 'legacy' AS method, rank, id, score FROM dt UNION ALL SELECT query_id, 'contextual', rank, id, score FROM dc",
        "retrieve_all": f"WITH {_all(10)} SELECT query_id, method, rank, id, score, id AS reference FROM every",
        "small_hybrid": small + " SELECT z.query_id, z.rank, z.id AS reference, ps.text, round(z.score, 6) AS rerank_score, z.sources AS original_sources FROM z JOIN ps USING (id)",
        "evaluation_run": f"WITH {tests_of(metrics_of(graded, 'h3', (1, 3, 5, 10, 20)), pairs)} SELECT method_a, method_b, metric, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(CASE WHEN mean_a > 0 THEN (mean_b - mean_a) / mean_a * 100 ELSE 0 END, 6) AS improvement_pct, round(t_stat, 6) AS t_stat, df, round(p_value, 6) AS p_value, coalesce(p_value < 0.05, false) AS significant FROM o",
        "built_training_set": f"""WITH {BASE}, o AS (SELECT query, min(query_id) AS query_id, (list(type ORDER BY query_id))[1] AS type FROM a WHERE query IS NOT NULL GROUP BY query), {_vectors('qv', 'a', 'query_id', 'query')}, {_vectors('cv', 'ps', 'id', 'context')}, {_dense('dc', 'cv', 50)},
          s AS (SELECT o.query_id, dc.id, o.query, o.type, {share} AS sh FROM dc JOIN o USING (query_id) JOIN ps USING (id))
          SELECT query_id || '|' || id AS example_id, query, id AS reference, round({grade} / 3.0::double, 6) AS label, ({grade})::bigint AS raw_score, regexp_replace(lower(trim(type)), '[-\\s]+', '_', 'g') AS query_type, 'Shares ' || round(sh * 100)::int || ' percent of the query''s words.' AS reasoning FROM s""",
    }
