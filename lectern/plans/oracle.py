"""DuckDB SQL of the core queries, written independently of the plans."""

from __future__ import annotations

KS = (1, 3, 5, 10)
P = """p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST, context DESC NULLS LAST) rn FROM passages WHERE reference IS NOT NULL) WHERE rn = 1)"""
R = """r AS (SELECT result_id AS run_id, query_id, query, method, latency_ms, documents, run_at FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY run_at DESC) rn FROM retrieval_results WHERE result_id IS NOT NULL) WHERE rn = 1)"""
E = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY generated_at DESC NULLS LAST, document_id DESC NULLS LAST) rn FROM training_examples WHERE example_id IS NOT NULL) WHERE rn = 1)"""
T = """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST, query DESC NULLS LAST, document DESC NULLS LAST) rn FROM training_rows WHERE row_id IS NOT NULL) WHERE rn = 1)"""
Q = """a AS (SELECT id AS query_id, query, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC NULLS LAST, query DESC NULLS LAST) rn FROM test_queries WHERE id IS NOT NULL) WHERE rn = 1)"""
G = f"""{E}, g AS (SELECT document_id AS id, greatest(0, least(3, max(relevance_score))) AS grade FROM e WHERE document_id IS NOT NULL GROUP BY 1)"""
H = f"""{R}, {G}, h AS (SELECT u.run_id, u.method, u.query_id, u.rank, u.x.id AS id, coalesce(g.grade, 0) AS grade FROM (SELECT run_id, method, query_id, generate_subscripts(documents, 1) AS rank, unnest(documents) AS x FROM r) u LEFT JOIN g ON u.x.id = g.id)"""
L = f"""{R}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY run_at DESC, run_id DESC) k FROM r) WHERE k = 1), l AS (SELECT query_id, query, method, x.rank AS rank, x.id AS id, x.score AS score, x.text AS text, x.reference AS reference FROM (SELECT query_id, query, method, unnest(documents) AS x FROM newest))"""
WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _w(c: str) -> str:
    return WORDS.format(c)


def _metrics() -> str:
    return metrics_of(H, "h", KS)


def metrics_of(before: str, hits: str, ks: tuple[int, ...]) -> str:
    """One row per run: m, from the tables r and ``hits`` that ``before`` makes."""
    n = "count(h.rank)"
    cols = []
    for k in ks:
        cols.append(f"CASE WHEN {n} >= {k} THEN count(CASE WHEN h.rank <= {k} AND h.grade >= 2 THEN 1 END) / {k}::double END AS p_{k}")
        dcg = f"coalesce(sum(CASE WHEN h.rank <= {k} THEN (pow(2, h.grade) - 1) / log2(h.rank + 1) END), 0)"
        ideal = f"coalesce(sum(CASE WHEN h.ideal <= {k} THEN (pow(2, h.grade) - 1) / log2(h.ideal + 1) END), 0)"
        cols.append(f"CASE WHEN {n} >= {k} THEN CASE WHEN {ideal} > 0 THEN {dcg} / {ideal} ELSE 0 END END AS ndcg_{k}")
    return f"""{before}, hi AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY grade DESC, rank) AS ideal FROM {hits}),
    m AS (SELECT r.run_id, r.method, r.query_id, any_value(r.query) AS query, any_value(r.latency_ms) AS latency_ms, {', '.join(cols)},
      coalesce(1.0::double / min(CASE WHEN h.grade >= 2 THEN h.rank END), 0) AS rr, coalesce(avg(h.grade), 0) AS avg_relevance,
      count(CASE WHEN h.grade >= 2 THEN 1 END) AS num_relevant, {n} AS num_retrieved
      FROM r LEFT JOIN hi h ON r.run_id = h.run_id GROUP BY r.run_id, r.method, r.query_id)"""


def _aggregate() -> str:
    means = ", ".join(f"CASE WHEN count({c}_{k}) > 0 THEN avg(coalesce({c}_{k}, 0)) END AS mean_{c}_{k}" for k in KS for c in ("p", "ndcg"))
    return f"""{_metrics()}, s AS (SELECT method, count(*) AS num_queries, {means}, avg(rr) AS mrr, avg(avg_relevance) AS mean_avg_relevance, avg(latency_ms) AS mean_latency_ms, stddev_pop(latency_ms) AS std_latency_ms, sum(num_relevant)::bigint AS total_relevant, sum(num_retrieved)::bigint AS total_retrieved FROM m GROUP BY method)"""


def _tests(pairs: str) -> str:
    return tests_of(_metrics(), pairs)


def tests_of(before: str, pairs: str) -> str:
    """Paired tests: o, from the table m that ``before`` makes."""
    odd = "2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * list_sum(list_transform(range(0, (df - 3) // 2 + 1), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(cos(th), 2 * k))) ELSE 0 END)"
    even = "sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos(th), 2 * k)))"
    return f"""{before}, v AS (UNPIVOT (SELECT method, query_id, avg(coalesce(avg_relevance, 0)) AS avg_relevance, avg(coalesce(rr, 0)) AS rr, avg(coalesce(p_5, 0)) AS p_5, avg(coalesce(ndcg_10, 0)) AS ndcg_10 FROM m GROUP BY 1, 2) ON avg_relevance, rr, p_5, ndcg_10 INTO NAME metric VALUE value),
    w(method_a, method_b) AS (VALUES {pairs}),
    j AS (SELECT w.method_a, w.method_b, va.metric, va.value AS a, vb.value AS b, vb.value - va.value AS d FROM w JOIN v va ON va.method = w.method_a JOIN v vb ON vb.method = w.method_b AND vb.query_id = va.query_id AND vb.metric = va.metric),
    st AS (SELECT method_a, method_b, metric, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS md, stddev_samp(d) AS sd FROM j GROUP BY 1, 2, 3),
    tt AS (SELECT *, CASE WHEN n > 1 AND sd > 1e-12 THEN md / (sd / sqrt(n)) END AS t_stat, n - 1 AS df FROM st),
    th AS (SELECT *, CASE WHEN t_stat IS NOT NULL THEN atan(abs(t_stat) / sqrt(df)) END AS th FROM tt),
    o AS (SELECT *, CASE WHEN th IS NULL THEN NULL WHEN df % 2 = 1 THEN greatest(0, 1 - ({odd})) ELSE greatest(0, 1 - ({even})) END AS p_value FROM th)"""


PAIRS = "('legacy', 'contextual'), ('contextual', 'contextual_rerank'), ('contextual_rerank', 'hybrid_rrf'), ('contextual_rerank', 'hybrid_rerank'), ('hybrid_rrf', 'hybrid_rerank')"
CLOSE = "'\"' || chr(10) || '**Verse**:'"
OPEN = "'**Context**: \"'"
SUMMARY = f"""{P}, words AS (SELECT volume, book, chapter, unnest({_w('text')}) AS term FROM p),
  tf AS (SELECT volume, book, chapter, term, count(*) AS n FROM words WHERE length(term) >= 5 GROUP BY 1, 2, 3, 4),
  best AS (SELECT volume, book, chapter, string_agg(term, ', ' ORDER BY n DESC, term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY volume, book, chapter ORDER BY n DESC, term) k FROM tf) WHERE k <= 5 GROUP BY 1, 2, 3),
  s AS (SELECT c.volume, c.book, c.chapter, concat_ws(' ', c.book, c.chapter) AS chapter_ref, verse_count, 'This chapter contains ' || verse_count || ' verses and covers ' || coalesce(terms, 'nothing') || '.' AS summary FROM (SELECT volume, book, chapter, count(*) AS verse_count FROM p GROUP BY 1, 2, 3) c LEFT JOIN best b ON c.volume IS NOT DISTINCT FROM b.volume AND c.book = b.book AND c.chapter = b.chapter)"""
FUSED = f"""{L}, x AS (SELECT *, CASE method WHEN 'sparse' THEN 0 ELSE 1 END AS li, CASE method WHEN 'sparse' THEN 1.0::double ELSE 1.2::double END / (60 + rank) AS c FROM l WHERE method IN ('sparse', 'dense') AND reference IS NOT NULL),
  f AS (SELECT query_id, reference, round(sum(c), 9) AS rrf_score, string_agg(method, ',' ORDER BY li, rank) AS sources, max(CASE WHEN li = 0 THEN rank END)::bigint AS sparse_rank, max(CASE WHEN li = 1 THEN rank END)::bigint AS dense_rank, count(DISTINCT li) > 1 AS in_both, arg_min(id, li * 1000000 + rank) AS id, arg_min(text, li * 1000000 + rank) AS text, arg_min(query, li * 1000000 + rank) AS query, min(li * 1000000 + rank) AS first FROM x GROUP BY 1, 2),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first) AS rank FROM f)"""
SHARE = "coalesce(len(list_intersect(list_distinct({0}), list_distinct({1})))::double / nullif(len(list_distinct({0})), 0), 0)"


def sql() -> dict[str, str]:
    q, t = _w("query"), _w("text")
    share = SHARE.format(q, t)
    rescored = f"round({share}, 9)"
    return {
        "flatten_passages": f"WITH {P} SELECT volume, book, chapter, verse, reference, text FROM p",
        "chapter_text": f"WITH {P} SELECT volume, concat_ws(' ', book, chapter) AS chapter_ref, count(*)::int AS verse_count, string_agg(verse || '. ' || coalesce(text, ''), chr(10) ORDER BY verse, reference, text) AS body FROM p GROUP BY volume, book, chapter",
        "chapter_counts": f"WITH {P}, c AS (SELECT volume, book, chapter, count(*) AS v FROM p GROUP BY 1, 2, 3) SELECT CASE WHEN grouping(volume) = 1 THEN 'Total' ELSE coalesce(volume, 'Unknown') END AS volume, count(*) AS chapters, sum(v)::bigint AS verses FROM c GROUP BY ROLLUP (volume)",
        "chapter_summaries": f"WITH {SUMMARY} SELECT volume, chapter_ref, verse_count, summary FROM s",
        "contextualize": f"WITH {SUMMARY} SELECT p.reference, {OPEN} || 'The following passage is from **' || p.reference || '** from the **' || coalesce(p.volume, '') || '**. ' || coalesce(s.summary, '') || {CLOSE} || ' \"' || coalesce(p.text, '') || '\"' AS context FROM p LEFT JOIN s ON p.volume = s.volume AND p.book = s.book AND p.chapter = s.chapter",
        "context_extract": f"WITH {P} SELECT reference, coalesce(nullif(CASE WHEN contains(context, {OPEN}) AND contains(context, {CLOSE}) THEN substr(context, instr(context, {OPEN}) + length({OPEN}), instr(context, {CLOSE}) - instr(context, {OPEN}) - length({OPEN})) ELSE context END, ''), 'No context') AS context FROM p",
        "slug_ids": f"WITH {P} SELECT reference, trim(regexp_replace(lower(reference), '[^a-zA-Z0-9]+', '-', 'g'), '-') AS slug FROM p",
        "display_names": "WITH v AS (SELECT DISTINCT volume, replace(lower(volume), ' ', '-') AS f FROM passages WHERE volume IS NOT NULL) SELECT volume, list_aggregate(list_transform(string_split(f, '-'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS display_name, f || '-summaries.json' AS summary_file, CASE WHEN volume = 'Doctrine and Covenants' THEN 'section' ELSE 'chapter' END AS unit, CASE WHEN volume = 'Doctrine and Covenants' THEN 'Section' ELSE 'Chapter' END AS unit_title FROM v",
        "token_counts_rollup": f"WITH {P} SELECT CASE WHEN grouping(volume) = 1 THEN 'Total' ELSE coalesce(volume, 'Unknown') END AS volume, count(*) AS verses, sum(len({t}))::bigint AS tokens FROM p GROUP BY ROLLUP (volume)",
        "normalize_sections": f"WITH {P} SELECT 'Sections' AS book, chapter AS section, verse, reference, text FROM p",
        "normalize_map": f"WITH {P} SELECT volume, book, chapter, verse, book || ' ' || chapter || ':' || verse AS reference, coalesce(text, '') AS text FROM p",
        "batch_assignment": f"WITH {P} SELECT reference, (row_number() OVER (ORDER BY reference) - 1) // 100 AS batch FROM p",
        "index_records": f"WITH {P} SELECT trim(regexp_replace(lower(reference), '[^a-zA-Z0-9]+', '-', 'g'), '-') AS id, coalesce(volume, 'Unknown') AS volume, reference, coalesce(nullif(CASE WHEN contains(context, {OPEN}) AND contains(context, {CLOSE}) THEN string_split(string_split(context, {OPEN})[2], {CLOSE})[1] ELSE context END, ''), 'No context') AS context, coalesce(text, '') AS text FROM p",
        "upsert_merge": "SELECT id, text, strftime(upserted_at, '%Y-%m-%d %H:%M:%S') AS upserted_at FROM (SELECT id, metadata.text AS text, upserted_at, row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC, metadata.text DESC NULLS LAST) k FROM index_records WHERE id IS NOT NULL) WHERE k = 1",
        "index_stats": "WITH d AS (SELECT coalesce(nullif(volume, ''), 'Unknown') AS namespace FROM (SELECT metadata.volume AS volume, row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC, metadata.text DESC NULLS LAST) k FROM index_records WHERE id IS NOT NULL) WHERE k = 1) SELECT coalesce(namespace, '(all)') AS namespace, count(*) AS vectors FROM d GROUP BY ROLLUP (namespace)",
        "dense_topk": "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10",
        "inverted_index": f"WITH {P}, w AS (SELECT reference, unnest({t}) AS term, len({t}) AS dl FROM p) SELECT term, reference, count(*) AS tf, any_value(dl)::bigint AS dl FROM w GROUP BY term, reference",
        "bm25_topk": f"""WITH {P}, {Q}, w AS (SELECT reference, unnest({t}) AS term FROM p), tf AS (SELECT reference, term, count(*) AS tf FROM w GROUP BY 1, 2), dl AS (SELECT reference, len({t}) AS dl FROM p), z AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
          qt AS (SELECT query_id, unnest(list_distinct({q})) AS term FROM a),
          sc AS (SELECT qt.query_id, tf.reference, round(sum(ln(1 + (z.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2::double / (tf.tf + 1.2::double * (0.25::double + 0.75::double * dl.dl / z.avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (reference), z GROUP BY 1, 2)
          SELECT query_id, reference, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference) AS rank FROM sc) WHERE rank <= 10""",
        "rrf_fusion": f"WITH {FUSED} SELECT query_id, reference, round(rrf_score, 6) AS rrf_score, sources, sparse_rank, dense_rank, in_both, id, rank FROM fr",
        "hybrid_rrf": f"WITH {FUSED}, n AS (SELECT query_id, count(*) FILTER (method = 'sparse') AS sparse_count, count(*) FILTER (method = 'dense') AS dense_count FROM l WHERE method IN ('sparse', 'dense') GROUP BY 1), k AS (SELECT query_id, count(*) AS fusion_count FROM f GROUP BY 1) SELECT query_id, reference, round(rrf_score, 6) AS rrf_score, rank, sparse_count, dense_count, fusion_count, printf('%s (%.4f)%s', reference, round(rrf_score, 4), CASE WHEN in_both THEN ' [BOTH]' ELSE '' END) AS label FROM fr JOIN n USING (query_id) JOIN k USING (query_id) WHERE rank <= 20",
        "rerank_topn": f"WITH {L}, s AS (SELECT query_id, id, reference, rank AS original_rank, score AS original_score, {rescored} AS score FROM l WHERE method = 'contextual' AND rank <= 8) SELECT query_id, id, reference, round(score, 6) AS score, rank, original_rank::bigint AS original_rank, round(original_score, 6) AS original_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM s) WHERE rank <= 5",
        "hybrid_rerank": f"WITH {FUSED}, s AS (SELECT query_id, reference, rank AS original_rank, rrf_score AS original_score, sources, {rescored} AS score FROM fr WHERE rank <= 15) SELECT query_id, reference, round(score, 6) AS rerank_score, rank, original_rank, round(original_score, 6) AS original_score, sources AS original_sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM s) WHERE rank <= 5",
        "sparse_vs_dense": f"WITH {L}, c AS (SELECT *, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS cut FROM l WHERE rank <= 5), s AS (SELECT * FROM c WHERE method = 'sparse'), d AS (SELECT * FROM c WHERE method = 'dense') SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.rank, d.rank)::bigint AS rank, s.reference AS sparse_reference, round(s.score, 2) AS sparse_score, s.cut AS sparse_text, d.reference AS dense_reference, round(d.score, 4) AS dense_score, d.cut AS dense_text FROM s FULL JOIN d ON s.query_id = d.query_id AND s.rank = d.rank",
        "judge_parse": """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"score": ' || event_id % 5 || ', "reasoning": "r"}' WHEN 1 THEN 'Sure: {"score": 2, "reasoning": "ok"} done' WHEN 2 THEN 'no json ' || event_type WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{"reasoning": "none"}' ELSE '{"score": "' || event_id % 5 || '"}' END AS t FROM events),
          i AS (SELECT *, regexp_extract(t, '(?s)(\\{.*\\})', 1) AS inner_t FROM a),
          o AS (SELECT *, CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END AS ok, coalesce(inner_t <> '' AND json_valid(inner_t), false) AS lok FROM i)
          SELECT event_id, CASE WHEN ok THEN least(3, greatest(0, coalesce(trunc(try_cast(json_extract_string(CASE WHEN ok THEN t END, '$.score') AS double))::int, 0))) ELSE 0 END AS score, CASE WHEN ok THEN coalesce(json_extract_string(CASE WHEN ok THEN t END, '$.reasoning'), '') ELSE 'Failed to parse response: ' || substr(t, 1, 100) END AS reasoning,
          CASE WHEN lok THEN least(3, greatest(0, coalesce(trunc(try_cast(json_extract_string(CASE WHEN lok THEN inner_t END, '$.score') AS double))::int, 0))) ELSE 0 END AS lenient_score, CASE WHEN lok THEN coalesce(json_extract_string(CASE WHEN lok THEN inner_t END, '$.reasoning'), '') ELSE 'Failed to parse judgment' END AS lenient_reasoning FROM o""",
        "judgments": f"WITH {H} SELECT run_id, method, query_id, rank::bigint AS rank, id, grade, grade >= 2 AS relevant FROM h",
        "judged_hits": f"WITH {L}, s AS (SELECT *, {share} AS sh FROM l WHERE method = 'contextual') SELECT query_id, rank::bigint AS rank, id, CASE WHEN sh >= 0.75 THEN 3 WHEN sh >= 0.5 THEN 2 WHEN sh >= 0.25 THEN 1 ELSE 0 END AS score, 'Shares ' || round(sh * 100)::int || ' percent of the query''s words.' AS reasoning FROM s",
        "response_docs_block": f"WITH {R} SELECT run_id, coalesce(list_aggregate(list_transform(documents[1:5], lambda x: '- [' || coalesce(x.reference, '') || ']: ' || substr(coalesce(x.text, ''), 1, 200) || '...'), 'string_agg', chr(10)), '') AS docs_list, md5(coalesce(list_aggregate(list_transform(documents, lambda x: '[' || coalesce(x.reference, '') || ']: ' || coalesce(x.text, '')), 'string_agg', chr(10) || chr(10)), '')) AS docs_block_md5 FROM r",
        "rank_prompt": f"WITH {E}, s AS (SELECT example_id, 'Rate from 0 to 3 how relevant the passage is to the query.' || chr(10) || 'Query: ' || query || chr(10) || 'Reference: ' || coalesce(document_reference, 'Unknown') || chr(10) || 'Text: \"' || coalesce(document_text, '') || '\"' || chr(10) || 'Answer with JSON: {{\"score\": 0-3, \"reasoning\": \"...\"}}' AS s FROM e) SELECT example_id, md5(s) AS prompt_md5, length(s) AS prompt_length FROM s",
        "precision_at_k": f"WITH {H}, n AS (SELECT run_id, count(*) AS n FROM h GROUP BY 1) SELECT h.run_id, k.k::bigint AS k, round(count(CASE WHEN h.rank <= k.k AND h.grade >= 2 THEN 1 END) / k.k::double, 6) AS value FROM h JOIN n USING (run_id) JOIN (SELECT unnest([1, 3, 5, 10]) AS k) k ON n.n >= k.k GROUP BY h.run_id, k.k",
        "reciprocal_rank": f"WITH {_metrics()} SELECT run_id, round(rr, 6) AS rr FROM m",
        "dcg_ndcg": f"WITH {H}, i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY grade DESC, rank) AS ideal FROM h), s AS (SELECT run_id, coalesce(sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) END), 0) AS dcg, coalesce(sum(CASE WHEN ideal <= 5 THEN (pow(2, grade) - 1) / log2(ideal + 1) END), 0) AS idcg FROM i GROUP BY 1) SELECT run_id, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s",
        "query_metrics": f"WITH {_metrics()} SELECT run_id, method, query_id, round(latency_ms, 6) AS latency_ms, {', '.join(f'round({c}_{k}, 6) AS {c}_{k}' for k in KS for c in ('p', 'ndcg'))}, round(rr, 6) AS rr, round(avg_relevance, 6) AS avg_relevance, num_relevant, num_retrieved FROM m",
        "aggregate_metrics": f"WITH {_aggregate()} SELECT method, num_queries, {', '.join(f'round(mean_{c}_{k}, 6) AS mean_{c}_{k}' for k in KS for c in ('p', 'ndcg'))}, round(mrr, 6) AS mrr, round(mean_avg_relevance, 6) AS mean_avg_relevance, round(mean_latency_ms, 6) AS mean_latency_ms, round(std_latency_ms, 6) AS std_latency_ms, total_relevant, total_retrieved FROM s",
        "paired_ttest": "WITH " + _tests("('legacy', 'contextual')") + " SELECT metric, n, round(t_stat, 6) AS t_stat, df, round(p_value, 6) AS p_value FROM o",
        "comparison_matrix": f"WITH {_tests(PAIRS)} SELECT method_a, method_b, metric, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(CASE WHEN mean_a > 0 THEN (mean_b - mean_a) / mean_a * 100 ELSE 0 END, 6) AS improvement_pct, round(p_value, 6) AS p_value, coalesce(p_value < 0.05, false) AS significant FROM o",
        "by_type": f"WITH {_metrics()}, {Q}, nm AS (SELECT query, min(query_id) AS tid FROM a GROUP BY 1), k AS (SELECT m.*, substr(coalesce(nm.tid, m.query_id), 1, 1) AS c FROM m LEFT JOIN nm ON m.query = nm.query) SELECT method, CASE c WHEN 'F' THEN 'factual' WHEN 'T' THEN 'thematic' WHEN 'X' THEN 'cross_reference' ELSE 'unknown' END AS query_type, count(*) AS queries, round(avg(avg_relevance), 6) AS avg_relevance, round(avg(rr), 6) AS mrr FROM k GROUP BY 1, 2",
        "improvement": f"WITH {_aggregate()}, w(step, method_a, method_b) AS (VALUES (0::bigint, 'legacy', 'contextual'), (1::bigint, 'contextual', 'contextual_rerank')) SELECT step, method_a, method_b, {', '.join(f'round(CASE WHEN a.{c} > 0 THEN (b.{c} - a.{c}) / a.{c} * 100 END, 6) AS {c}_pct' for c in ('mrr', 'mean_avg_relevance', 'mean_p_5', 'mean_ndcg_10'))}, round(b.mean_latency_ms - a.mean_latency_ms, 6) AS latency_diff_ms FROM w JOIN s a ON a.method = method_a JOIN s b ON b.method = method_b",
        "worst_queries": f"WITH {_metrics()} SELECT method, rank, query_id, run_id, substr(query, 1, 50) || '...' AS query, round(avg_relevance, 6) AS avg_relevance FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY avg_relevance, query_id, run_id) AS rank FROM m) WHERE rank <= 3",
        "overlap_at_k": f"WITH {L}, s AS (SELECT query_id, method, list_distinct(list(reference) FILTER (rank <= 10)) AS refs FROM l WHERE method IN ('legacy', 'contextual', 'contextual_rerank', 'hybrid_rrf', 'dense', 'sparse') GROUP BY 1, 2) SELECT x.query_id, x.method, round(len(list_intersect(x.refs, b.refs)) / 10.0::double, 6) AS overlap FROM s x JOIN s b ON b.query_id = x.query_id AND b.method = 'contextual_rerank' WHERE x.method <> 'contextual_rerank'",
        "mean_overlap": f"WITH {L}, s AS (SELECT query_id, method, list_distinct(list(reference) FILTER (rank <= 10)) AS refs FROM l WHERE method IN ('legacy', 'contextual', 'contextual_rerank', 'hybrid_rrf', 'dense', 'sparse') GROUP BY 1, 2), o AS (SELECT x.method, len(list_intersect(x.refs, b.refs)) / 10.0::double AS overlap FROM s x JOIN s b ON b.query_id = x.query_id AND b.method = 'contextual_rerank' WHERE x.method <> 'contextual_rerank') SELECT method, round(avg(overlap), 6) AS mean_overlap, count(*) AS queries FROM o GROUP BY 1",
        "latency_stats": f"WITH {R} SELECT method, count(*) AS runs, round(avg(latency_ms), 6) AS mean_latency_ms, round(stddev_pop(latency_ms), 6) AS std_latency_ms FROM r GROUP BY 1",
        "summary_report": "WITH " + _aggregate() + " " + " UNION ALL ".join(f"SELECT '{label}' AS metric, method, CASE WHEN {c} IS NULL THEN '-' ELSE printf('{fmt}', {c}::double) END AS cell FROM s" for label, c, fmt in (("MRR", "mrr", "%.3f"), ("Precision@1", "mean_p_1", "%.3f"), ("Precision@3", "mean_p_3", "%.3f"), ("Precision@5", "mean_p_5", "%.3f"), ("Precision@10", "mean_p_10", "%.3f"), ("NDCG@5", "mean_ndcg_5", "%.3f"), ("NDCG@10", "mean_ndcg_10", "%.3f"), ("Avg Relevance", "mean_avg_relevance", "%.3f"), ("Avg Latency (ms)", "mean_latency_ms", "%.1f"))),
        "training_examples": f"WITH {E} SELECT example_id, query, document_id, relevance_score AS raw_score, round(relevance_score / 3.0::double, 6) AS label, regexp_replace(lower(trim(query_type)), '[-\\s]+', '_', 'g') AS query_type FROM e",
        "soft_labels": f"WITH {T} SELECT row_id, CASE raw_score WHEN 0 THEN 0.0::double WHEN 1 THEN 0.2::double WHEN 2 THEN 0.7::double WHEN 3 THEN 1.0::double ELSE 0.0::double END AS soft_label, coalesce(raw_score::int, trunc(label * 3)::int) AS raw FROM t",
        "train_test_split": f"WITH {T} SELECT row_id, row_number() OVER (ORDER BY md5(row_id)) <= ceil(count(*) OVER () * 0.1::double) AS test FROM t",
        "class_weights": f"WITH {T}, c AS (SELECT count(CASE WHEN label > 0.5 THEN 1 END) AS positives, count(*) - count(CASE WHEN label > 0.5 THEN 1 END) AS negatives FROM t) SELECT positives, negatives, round(least(5.0::double, negatives::double / greatest(positives, 1)), 6) AS pos_weight FROM c",
        "eval_samples": f"""WITH {T}, k AS (SELECT query, document, row_id, coalesce(raw_score::int, trunc(coalesce(label, 0) * 3)::int) >= 2 AS pos FROM t WHERE query IS NOT NULL AND document IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY row_id) AS n FROM k)
          SELECT query, md5(string_agg(document, chr(1) ORDER BY n) FILTER (pos AND n <= 3)) AS positive_md5, count(*) FILTER (pos AND n <= 3) AS n_positive, md5(string_agg(document, chr(1) ORDER BY n) FILTER (NOT pos AND n <= 10)) AS documents_md5, count(*) FILTER (NOT pos AND n <= 10) AS n_documents FROM o GROUP BY query HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0""",
        "dataset_stats": f"WITH {E} SELECT count(*) AS total_examples, count(DISTINCT query) AS unique_queries, {', '.join(f'count(*) FILTER (relevance_score = {s}) AS score_{s}' for s in range(4))} FROM e",
        "score_histogram": f"WITH {E} SELECT relevance_score AS score, count(*) AS count, round(count(*) * 100.0::double / sum(count(*)) OVER (), 6) AS percent FROM e GROUP BY 1",
        "query_type_histogram": f"WITH {T} SELECT coalesce(regexp_replace(lower(trim(query_type)), '[-\\s]+', '_', 'g'), 'unknown') AS query_type, count(*) AS count, round(count(*) * 100.0::double / sum(count(*)) OVER (), 6) AS percent FROM t GROUP BY 1",
        "tsv_export": f"WITH {T} SELECT row_id, coalesce(translate(query, chr(9) || chr(10), '  '), '') || chr(9) || coalesce(translate(document, chr(9) || chr(10), '  '), '') || chr(9) || coalesce(translate(reference, chr(9), ' '), '') || chr(9) || coalesce(raw_score::varchar, '') || chr(9) || coalesce(query_type, '') AS line FROM t",
        "pair_dataset": f"WITH {T} SELECT query AS text1, document AS text2, round(label, 6) AS label FROM t WHERE label IS NOT NULL",
    }
