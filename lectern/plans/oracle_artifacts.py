"""DuckDB SQL of the queries that write and read back, and of prompts, writers and reports: from the tables, not from what was written."""

from __future__ import annotations

from lectern.plans.oracle import CLOSE, FUSED, OPEN, PAIRS, SHARE, SUMMARY, L, P, Q, R, T, _aggregate, _metrics, _tests, _w
from lectern.plans.oracle_search import BASE, SIGN, SLOT, _dense, _reranked, _sparse, _vectors
from lectern.sources import readers

QUICK = "('legacy', 'contextual', 'contextual_rerank', 'hybrid_rrf', 'sparse', 'dense')"


def _values(rows: list[tuple], names: str) -> str:
    quoted = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS v({names})"


def _components(table: str, key: str, text: str) -> str:
    return f"SELECT {key}, slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY {key})), 6) AS x FROM (SELECT {key}, ({SLOT})::bigint AS slot, sum({SIGN})::double AS x FROM (SELECT {key}, unnest({_w(text)}) AS term FROM {table}) GROUP BY 1, 2) WHERE x <> 0"


def _jaccard(q: str, t: str) -> str:
    a, b = f"list_distinct({_w(q)})", f"list_distinct({_w(t)})"
    return f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def sql() -> dict[str, str]:
    context = f"{OPEN} || 'The following passage is from **' || p.reference || '** from the **' || coalesce(p.volume, '') || '**. ' || coalesce(s.summary, '') || {CLOSE} || ' \"' || coalesce(p.text, '') || '\"'"
    inner = "'The following passage is from **' || p.reference || '** from the **' || coalesce(p.volume, '') || '**. ' || coalesce(s.summary, '')"
    joined = "p LEFT JOIN s ON p.volume = s.volume AND p.book = s.book AND p.chapter = s.chapter"
    dense = f"WITH {BASE}, {_vectors('qv', 'a', 'query_id', 'query')}, {_vectors('cv', 'ps', 'id', 'context')}"
    share = SHARE.format(_w("query"), _w("text"))
    body = "string_agg(verse || '. ' || coalesce(text, ''), chr(10) ORDER BY verse, reference, text)"
    unit = "CASE WHEN volume = 'Doctrine and Covenants' THEN 'section' ELSE 'chapter' END"
    prompt = _summary_prompt(unit)
    chapters = f"{P}, c AS (SELECT volume, book, chapter, concat_ws(' ', book, chapter) AS ref, count(*) AS n, {body} AS body FROM p WHERE volume IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT *, {unit} AS unit FROM c)"
    rises = " UNION ALL ".join(f"SELECT step, {i} AS row, method_a, method_b, CASE WHEN coalesce(a.{c}, 0) > 0 THEN printf('- {label}: %.3f -> %.3f (%+.1f%%)', a.{c}, coalesce(b.{c}, 0), (coalesce(b.{c}, 0) - a.{c}) / a.{c} * 100) END AS line FROM w JOIN s a ON a.method = method_a JOIN s b ON b.method = method_b" for i, (label, c) in enumerate((("MRR", "mrr"), ("Avg Relevance", "mean_avg_relevance"), ("Precision@5", "mean_p_5"), ("NDCG@10", "mean_ndcg_10"))))
    steps = "w(step, method_a, method_b) AS (VALUES (0::bigint, 'legacy', 'contextual'), (1::bigint, 'contextual', 'contextual_rerank'))"
    table_rows = (("MRR", "mrr", "%.3f"), ("Precision@1", "mean_p_1", "%.3f"), ("Precision@3", "mean_p_3", "%.3f"), ("Precision@5", "mean_p_5", "%.3f"), ("Precision@10", "mean_p_10", "%.3f"), ("NDCG@5", "mean_ndcg_5", "%.3f"), ("NDCG@10", "mean_ndcg_10", "%.3f"), ("Avg Relevance", "mean_avg_relevance", "%.3f"), ("Avg Latency (ms)", "mean_latency_ms", "%.1f"))
    cell = lambda m, c, fmt: f"coalesce((SELECT CASE WHEN {c} IS NULL THEN '-' ELSE printf('{fmt}', {c}::double) END FROM s WHERE method = '{m}'), '-')"
    lines = " UNION ALL ".join(["SELECT '| Metric | legacy | contextual | contextual_rerank | absent |' AS line", *(f"SELECT '| {label} | ' || {cell('legacy', c, fmt)} || ' | ' || {cell('contextual', c, fmt)} || ' | ' || {cell('contextual_rerank', c, fmt)} || ' | - |'" for label, c, fmt in table_rows)])
    kept = f"{T}, x AS (SELECT * FROM t WHERE query IS NOT NULL AND document IS NOT NULL)"
    docs = "list_aggregate(list_transform(documents[1:5], lambda x: '- [' || coalesce(x.reference, '') || ']: ' || substr(coalesce(x.text, ''), 1, 200) || '...'), 'string_agg', chr(10))"
    asked = f"'Rate the response from 0 to 3 in each respect.' || chr(10) || 'Query: ' || coalesce(query, '') || chr(10) || 'Response:' || chr(10) || coalesce(documents[1].text, '') || chr(10) || 'Documents:' || chr(10) || {docs} || chr(10) || 'Answer with JSON: completeness, citation_accuracy, faithfulness, format_compliance, overall, notes'"
    return {
        "nested_books": f"WITH {P} SELECT volume, book, chapter, verse, reference, text FROM p WHERE volume IS NOT NULL",
        "nested_chapters": f"WITH {P} SELECT volume, book, chapter, verse, reference, text FROM p WHERE volume IS NOT NULL",
        "summary_files": f"WITH {SUMMARY} SELECT volume, chapter_ref, verse_count, summary FROM s",
        "sectioned_files": f"WITH {P} SELECT 'Sections' AS book, chapter AS section, verse, reference, text FROM p",
        "mapped_files": f"WITH {P} SELECT book, chapter, verse, book || ' ' || chapter || ':' || verse AS reference, coalesce(text, '') AS text FROM p WHERE book IS NOT NULL",
        "context_files": f"WITH {SUMMARY} SELECT p.reference, p.text, {context} AS context FROM {joined}",
        "embedding_files": f"WITH {P} {_components('p', 'reference', 'text')}",
        "embedded_queries": f"WITH {Q} {_components('a', 'query_id', 'query')}",
        "embedded_order": f"WITH {P} SELECT reference, row_number() OVER (ORDER BY volume NULLS FIRST, book NULLS FIRST, chapter NULLS FIRST, verse NULLS FIRST, reference) - 1 AS position FROM p",
        "query_files": "WITH q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC NULLS LAST, query DESC NULLS LAST) AS rn FROM test_queries WHERE id IS NOT NULL) SELECT id, query, type, coalesce(array_to_string(expected_volumes, '|'), '') AS volumes, coalesce(array_to_string(expected_topics, '|'), '') AS topics FROM q WHERE rn = 1",
        "quick_queries": _values(readers.QUICK_QUERIES, "id, query, type"),
        "shown_queries": _values([r for r in readers.QUICK_QUERIES if r[0] in ("exact_1", "semantic_1", "doctrinal_1")], "id, query, type"),
        "sample_records": _values(readers.SAMPLES, "_id, content, category"),
        "run_settings": "SELECT * FROM (VALUES ('top_k', 12::bigint), ('rerank_initial_k', 150), ('rerank_top_n', 20), ('relevance_threshold', 1), ('k_1', 1), ('k_7', 7), ('k_12', 12), ('judge', 0)) AS v(name, value)",
        "pipeline_index": f"WITH {SUMMARY} SELECT trim(regexp_replace(lower(p.reference), '[^a-zA-Z0-9]+', '-', 'g'), '-') AS id, coalesce(p.volume, 'Unknown') AS volume, p.reference, {inner} AS context, coalesce(p.text, '') AS text, 64::bigint AS dims FROM {joined}",
        "namespace_upsert": """WITH r AS (SELECT id, coalesce(metadata.text, '') AS text, upserted_at, upserted_at < '2025-07-01' AS early FROM index_records WHERE id IS NOT NULL),
          m AS (SELECT 'main' AS namespace, id, text, row_number() OVER (PARTITION BY id ORDER BY early IS NOT TRUE DESC, upserted_at DESC NULLS LAST, text DESC) AS k FROM r WHERE early IS NOT NULL),
          l AS (SELECT 'late' AS namespace, id, text, row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC NULLS LAST, text DESC) AS k FROM r WHERE NOT early)
          SELECT namespace, id, text FROM m WHERE k = 1 UNION ALL SELECT namespace, id, text FROM l WHERE k = 1""",
        "dense_hits": f"{dense}, {_dense('dc', 'cv', 20)} SELECT query_id, query, 'dense' AS method, rank, id, score, text, reference, volume, context, 'dense' AS source FROM dc JOIN ps USING (id) JOIN a USING (query_id)",
        "sparse_hits": f"WITH {BASE}, {_sparse(20)} SELECT query_id, query, 'sparse' AS method, rank, id, round(score, 6) AS score, text, reference, volume, context, 'sparse' AS source FROM sp JOIN ps USING (id) JOIN a USING (query_id)",
        "integrated_rerank": f"{dense}, {_dense('dc', 'cv', 150)}, {_reranked('z', 'dc', 150, 10)} SELECT query_id, rank, id, score, original_rank FROM z",
        "custom_rerank": f"{dense}, {_dense('dc', 'cv', 150)}, zs AS (SELECT dc.query_id, dc.id, dc.rank AS original_rank, round({_jaccard('a.query', 'ps.text')}, 9) AS score FROM dc JOIN a USING (query_id) JOIN ps USING (id)) SELECT query_id, 'contextual_custom_rerank' AS method, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank, id, score, original_rank FROM zs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) <= 20",
        "full_rerank": f"""WITH {FUSED}, u AS (SELECT query_id, 'contextual' AS list, reference, rank AS original_rank, {share} AS score FROM l WHERE method = 'contextual' AND rank <= 150 UNION ALL SELECT query_id, 'fused', reference, rank, {share} FROM fr WHERE rank <= 50),
          o AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY round(score, 9) DESC, original_rank) AS rank FROM u) SELECT query_id, list, reference, round(score, 6) AS score, rank, original_rank::bigint AS original_rank FROM o WHERE rank <= 20""",
        "page_content": f"WITH {L} SELECT query_id, rank::bigint AS rank, text AS page_content, reference, 'V' AS volume, round(score, 6) AS score FROM l WHERE method = 'contextual'",
        "hit_lines": f"WITH {L} SELECT query_id, method, string_agg(printf('%s (%.4f)', reference, round(score, 4)), ' / ' ORDER BY rank, printf('%s (%.4f)', reference, round(score, 4))) AS lines FROM l WHERE method IN {QUICK} AND rank <= 5 GROUP BY 1, 2",
        "quick_files": f"""WITH {L}, y AS (SELECT method, avg(latency_ms) AS ms FROM r WHERE method IN {QUICK} GROUP BY 1), s AS (SELECT query_id, method, list_distinct(list(reference) FILTER (rank <= 10)) AS refs FROM l WHERE method IN {QUICK} GROUP BY 1, 2),
          o AS (SELECT x.method, avg(len(list_intersect(x.refs, b.refs)) / 10.0::double) AS overlap FROM s x JOIN s b ON b.query_id = x.query_id AND b.method = 'contextual_rerank' WHERE x.method <> 'contextual_rerank' GROUP BY 1)
          SELECT method, round(ms, 6) AS mean_latency_ms, round(overlap, 6) AS mean_overlap FROM y LEFT JOIN o USING (method)""",
        "run_files": f"""WITH {_aggregate()}, n AS (SELECT method, count(*) AS n FROM h GROUP BY 1), pr(a, b) AS (VALUES {PAIRS}), tc AS (SELECT p.a AS method, count(DISTINCT p.b) * 4 AS n FROM pr p JOIN m x ON x.method = p.a JOIN m y ON y.method = p.b AND y.query_id = x.query_id GROUP BY 1),
          u AS (SELECT method, 'raw' AS artifact, n FROM n UNION ALL SELECT method, 'judgments', n FROM n UNION ALL SELECT method, 'metrics', 1 FROM s UNION ALL SELECT method, 'comparisons', n FROM tc) SELECT method, artifact, n, round(mrr, 6) AS mrr FROM u LEFT JOIN s USING (method)""",
        "run_stamps": f"WITH {R} SELECT run_id, strftime(run_at, '%Y%m%d_%H%M%S') AS stamp FROM r",
        "relevance_tests": f"WITH {_tests(PAIRS)} SELECT method_a, method_b, printf('%+.1f%%', round(CASE WHEN mean_a > 0 THEN (mean_b - mean_a) / mean_a * 100 ELSE 0 END, 6)) AS change, round(p_value, 6) AS p_value, coalesce(p_value < 0.05, false) AS significant FROM o WHERE metric = 'avg_relevance'",
        "improvement_report": f"WITH {_aggregate()}, {steps}, x AS ({rises} UNION ALL SELECT step, 4, method_a, method_b, printf('- Latency: %.1f ms -> %.1f ms (%+.1f ms)', coalesce(a.mean_latency_ms, 0), coalesce(b.mean_latency_ms, 0), coalesce(b.mean_latency_ms, 0) - coalesce(a.mean_latency_ms, 0)) FROM w JOIN s a ON a.method = method_a JOIN s b ON b.method = method_b) SELECT step, row::bigint AS row, line FROM x WHERE line IS NOT NULL",
        "type_report": f"WITH {_metrics()}, {Q}, nm AS (SELECT query, min(query_id) AS tid FROM a GROUP BY 1), k AS (SELECT m.*, substr(coalesce(nm.tid, m.query_id), 1, 1) AS c FROM m LEFT JOIN nm ON m.query = nm.query), y AS (SELECT method, CASE c WHEN 'F' THEN 'factual' WHEN 'T' THEN 'thematic' WHEN 'X' THEN 'cross_reference' ELSE 'unknown' END AS query_type, count(*) AS n, round(avg(avg_relevance), 6) AS r, round(avg(rr), 6) AS q FROM k GROUP BY 1, 2) SELECT method, query_type, printf('- **%s** (%d queries): Avg Relevance=%.3f, MRR=%.3f', query_type, n, r, q) AS line FROM y",
        "report_file": f"WITH {_aggregate()} {lines}",
        "summary_prompts": f"WITH {chapters} SELECT volume, ref AS chapter_ref, md5({prompt}) AS prompt_md5 FROM k",
        "written_summaries": f"WITH {chapters} SELECT volume, ref AS chapter_ref, n AS verse_count, 'A text of ' || length({prompt}) || ' characters.' AS summary FROM k",
        "written_answers": f"WITH {L} SELECT query_id, coalesce(string_agg(reference, '; ' ORDER BY rank, reference, text) FILTER (rank <= 4), '') AS answer FROM l WHERE method = 'contextual' GROUP BY 1",
        "cited_answers": f"WITH {L} SELECT query_id, string_agg(text || ' [' || reference || ']', chr(10) ORDER BY rank, reference, text) AS answer FROM l WHERE method = 'contextual' AND rank <= 3 GROUP BY 1",
        "judged_responses": f"WITH {R}, z AS (SELECT run_id::varchar AS query_id, length({asked}) AS n FROM r WHERE method = 'contextual' AND len(documents) > 0) SELECT query_id, CASE WHEN n % 7 = 0 THEN 0 ELSE least(3, n % 5) END::int AS completeness, 0 AS citation_accuracy, 0 AS faithfulness, 0 AS format_compliance, CASE WHEN n % 7 = 0 THEN 0 ELSE n % 3 END::int AS overall, CASE WHEN n % 7 = 0 THEN 'Failed to parse: no' ELSE 'seen' END AS notes FROM z",
        "query_pool": f"WITH {Q} SELECT query, type FROM a WHERE query IS NOT NULL UNION ALL SELECT 'written ' || n, 'thematic' FROM (SELECT unnest(range(50)) AS n UNION ALL SELECT unnest(range(50)) UNION ALL SELECT unnest(range(20)))",
        "training_files": f"""WITH {kept}, c AS (SELECT count(*) AS n, ceil(count(*) * 0.1)::bigint AS test, count(DISTINCT query) AS q FROM x) SELECT unnest(['json', 'parquet', 'pairs', 'text', 'renamed', 'stats_total_examples']) AS form, n FROM c
          UNION ALL SELECT unnest(['test', 'stats_test_examples']), test FROM c UNION ALL SELECT unnest(['train', 'stats_train_examples']), n - test FROM c UNION ALL SELECT 'stats_unique_queries', q FROM c""",
        "eval_head": f"WITH {kept}, k AS (SELECT query, coalesce(raw_score::int, trunc(coalesce(label, 0) * 3)::int) >= 2 AS pos FROM x), o AS (SELECT query, least(3, count(*) FILTER (pos)) AS n_positive, least(10, count(*) FILTER (NOT pos)) AS n_documents FROM k GROUP BY 1) SELECT * FROM o WHERE n_positive > 0 AND n_documents > 0 ORDER BY query LIMIT 100",
        "scored_pairs": f"WITH {kept} SELECT row_id, round({_jaccard('query', 'document')}, 6) AS score FROM x",
        "label_pairs": f"WITH {kept} SELECT query AS text1, document AS text2, CASE raw_score WHEN 0 THEN 0.0::double WHEN 1 THEN 0.2::double WHEN 2 THEN 0.7::double WHEN 3 THEN 1.0::double ELSE 0.0::double END AS label FROM x",
    }


def _summary_prompt(unit: str) -> str:
    nl = "chr(10)"
    return f"'[' || unit || ' ' || chapter || ' of ' || book || ', ' || volume || '] ' || ref || '. Verses: ' || n || {nl} || {nl} || body || {nl} || {nl} || 'Say in two or three sentences what this ' || unit || ' tells.'"
