"""DuckDB SQL of those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

import math

DOCS = """d AS (SELECT id, min(t) AS text FROM (SELECT document_id AS id, document_text AS t FROM training_examples UNION ALL SELECT x.id, x.text FROM (SELECT unnest(documents) AS x FROM retrieval_results)) WHERE id IS NOT NULL AND t IS NOT NULL GROUP BY id),
  w AS (SELECT DISTINCT id, s, substr(text, s, 120) AS run FROM (SELECT id, text, unnest(range(1, length(text) - 118)) AS s FROM d WHERE length(text) >= 120))"""

VECTORS = """v AS (SELECT id, arg_max("values", upserted_at)::double[] AS x FROM index_records WHERE id IS NOT NULL AND len("values") = 96 AND list_bool_and(list_transform("values", lambda y: y IS NOT NULL AND isfinite(y))) AND list_bool_or(list_transform("values", lambda y: y <> 0)) GROUP BY id)"""

SCORES = ("sparse_score", "dense_score", "rerank_score", "raw_score")


def _ranking() -> str:
    lowest = ", ".join(f"coalesce(s{i}, min(s{i}) OVER (PARTITION BY list_id), 0) AS s{i}" for i in range(4))
    ranks = ", ".join(f"(count(*) OVER (PARTITION BY list_id) - rank() OVER (PARTITION BY list_id ORDER BY s{i}) - count(*) OVER (PARTITION BY list_id, s{i}) + 1 + (count(*) OVER (PARTITION BY list_id, s{i}) + 1) / 2.0::double - 0.5::double) / n AS r{i}" for i in range(4))
    tail = lambda j: " + ".join(f"{math.comb(4, i)}::double * pow(r[{j}], {i}) * pow(1 - r[{j}], {4 - i})" for i in range(j, 5))
    return f"""WITH raw AS (SELECT result_id AS list_id, any_value(documents) AS documents FROM hybrid_results WHERE result_id IS NOT NULL GROUP BY 1),
      x AS (SELECT list_id, unnest(documents) AS x FROM raw),
      one AS (SELECT list_id, x.id AS id, {', '.join(f'max(x.{s})::double AS s{i}' for i, s in enumerate(SCORES))} FROM x WHERE x.id IS NOT NULL GROUP BY 1, 2),
      kept AS (SELECT list_id, id, count(*) OVER (PARTITION BY list_id) AS n, {lowest} FROM one),
      rk AS (SELECT list_id, id, n, {ranks} FROM kept WHERE n >= 4),
      so AS (SELECT list_id, id, list_sort([r0, r1, r2, r3]) AS r FROM rk),
      p AS (SELECT list_id, id, [{', '.join(tail(j) for j in range(1, 5))}] AS p FROM so),
      e AS (SELECT list_id, id, round(least(1, 4 * list_min(p)), 9) AS significance, round(list_sum(list_transform(p, lambda y: ln(y))) / 4, 9) AS evidence FROM p),
      o AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY evidence, id) AS position FROM e)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {DOCS}, g AS (SELECT run FROM w GROUP BY run HAVING count(DISTINCT id) > 1), k AS (SELECT DISTINCT run, id FROM w SEMI JOIN g USING (run)) SELECT DISTINCT a.id AS doc_a, b.id AS doc_b FROM k a JOIN k b ON a.run = b.run AND a.id < b.id",
        "p1_coverage": f"""WITH {DOCS}, g AS (SELECT run FROM w GROUP BY run HAVING count(DISTINCT id) > 1), k AS (SELECT id, s, lead(s) OVER (PARTITION BY id ORDER BY s) AS nx FROM w SEMI JOIN g USING (run)),
          c AS (SELECT id, sum(least(120, coalesce(nx - s, 120)))::bigint AS n, count(*) FILTER (nx IS NULL OR nx - s > 120) AS spans FROM k GROUP BY id), cl AS (SELECT text, min(id) AS class_id FROM d GROUP BY text)
          SELECT d.id AS doc_id, class_id, length(d.text) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN round(coalesce(n, 0) / length(d.text)::double, 6) ELSE 0 END AS shared_share, coalesce(spans, 0) AS n_spans FROM d JOIN cl USING (text) LEFT JOIN c USING (id)""",
        "p2_found": f"WITH {VECTORS}, s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.id <> b.id), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS k FROM s WHERE c >= 0.8) SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM t WHERE k <= 5",
        "p2_neighbours": f"WITH {VECTORS}, s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.id <> b.id), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS k FROM s WHERE c >= 0.8) SELECT id, k::int AS rank, other, round(c, 4) AS cosine FROM t WHERE k <= 5",
        "p3_found": _ranking() + " SELECT list_id AS result_id, id AS doc_id FROM o WHERE position <= 3",
        "p3_ranking": _ranking() + " SELECT list_id AS result_id, id AS doc_id, position, round(significance, 6) AS significance, round(evidence, 6) AS evidence FROM o",
    }
