"""Markdown reports from small metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the summary table, with their format.
ROWS = (("MRR", "mrr", "%.3f"), ("Precision@1", "mean_p_1", "%.3f"), ("Precision@3", "mean_p_3", "%.3f"), ("Precision@5", "mean_p_5", "%.3f"), ("Precision@10", "mean_p_10", "%.3f"), ("NDCG@5", "mean_ndcg_5", "%.3f"), ("NDCG@10", "mean_ndcg_10", "%.3f"), ("Avg Relevance", "mean_avg_relevance", "%.3f"), ("Avg Latency (ms)", "mean_latency_ms", "%.1f"))


def summary_cells(methods: DataFrame) -> DataFrame:
    """(row, metric, method, cell): the formatted cells; absent values are a dash."""
    cells = [F.struct(F.lit(i).alias("row"), F.lit(label).alias("metric"), F.coalesce(F.format_string(fmt, F.col(c).cast("double")), F.lit("-")).alias("cell"), F.col(c).isNull().alias("none")) for i, (label, c, fmt) in enumerate(ROWS)]
    return methods.select("method", F.explode(F.array(*cells)).alias("x")).select("x.row", "x.metric", "method", F.when(F.col("x.none"), "-").otherwise(F.col("x.cell")).alias("cell"))


def markdown(methods: DataFrame, order: list[str]) -> str:
    """The summary table for the given methods; one that has no metrics is a column of dashes."""
    got = {(r["metric"], r["method"]): r["cell"] for r in summary_cells(methods).collect()}  # nine rows per method
    lines = ["| Metric | " + " | ".join(order) + " |", "| --- |" + " --- |" * len(order)]
    return "\n".join(lines + ["| " + " | ".join([label, *(got.get((label, m), "-") for m in order)]) + " |" for label, _, _ in ROWS]) + "\n"


#: Measures of the improvement section.
RISES = (("MRR", "mrr"), ("Avg Relevance", "mean_avg_relevance"), ("Precision@5", "mean_p_5"), ("NDCG@10", "mean_ndcg_10"))


def improvement_lines(methods: DataFrame, order: tuple[str, ...] = ("legacy", "contextual", "contextual_rerank")) -> DataFrame:
    """(step, row, line): each method against the one before it, with signed percent; measures whose base isn't positive are left out, latency is a signed difference."""
    spark = methods.sparkSession
    steps = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(order, order[1:], strict=False))], "step int, method_a string, method_b string"))
    cols = [c for _, c in RISES] + ["mean_latency_ms"]
    side = lambda p: methods.select(F.col("method").alias(f"method_{p}"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{p}_{c}") for c in cols))
    both = steps.join(side("a"), "method_a").join(side("b"), "method_b")
    lines = [F.when(F.col(f"a_{c}") > 0, F.format_string(f"- {label}: %.3f -> %.3f (%+.1f%%)", F.col(f"a_{c}"), F.col(f"b_{c}"), (F.col(f"b_{c}") - F.col(f"a_{c}")) / F.col(f"a_{c}") * 100)) for label, c in RISES]
    lines.append(F.format_string("- Latency: %.1f ms -> %.1f ms (%+.1f ms)", "a_mean_latency_ms", "b_mean_latency_ms", F.col("b_mean_latency_ms") - F.col("a_mean_latency_ms")))
    return both.select("step", "method_a", "method_b", F.posexplode(F.array(*lines)).alias("row", "line")).where("line is not null")


def type_lines(by_type: DataFrame) -> DataFrame:
    """(method, query_type, line) from ``compare.by_type``."""
    line = F.format_string("- **%s** (%d queries): Avg Relevance=%.3f, MRR=%.3f", "query_type", "queries", "avg_relevance", "mrr")
    return by_type.select("method", "query_type", line.alias("line"))


def summary_lines(methods: DataFrame, comparisons: DataFrame, metric: str = "avg_relevance") -> list[str]:
    """What a run prints at its end: a block per method, and the paired tests of one metric; a star marks significance."""
    out = []
    for r in methods.orderBy("method").collect():  # a row per method
        got = [f"{label} {r[c]:{fmt}}" if c in r and r[c] is not None else f"{label} -" for label, c, fmt in (("MRR", "mrr", ".3f"), ("P@5", "mean_p_5", ".3f"), ("NDCG@10", "mean_ndcg_10", ".3f"), ("relevance", "mean_avg_relevance", ".3f"), ("ms", "mean_latency_ms", ".1f"))]
        out.append(f"{r['method']}: " + ", ".join(got))
    for r in comparisons.where(F.col("metric") == metric).orderBy("method_a", "method_b").collect():  # a row per pair
        p = "-" if r["p_value"] is None else f"{r['p_value']:.4f}"
        out.append(f"{r['method_a']} / {r['method_b']}: {r['mean_a']:.3f} -> {r['mean_b']:.3f} ({r['improvement_pct']:+.1f}%), p {p}{' *' if r['significant'] else ''}")
    return out


def full(run_id: str, methods: DataFrame, queries: DataFrame, order: list[str], when: str, by_type: DataFrame, worst: DataFrame, steps: tuple[str, ...] = ("legacy", "contextual", "contextual_rerank")) -> str:
    """The whole report: head, summary table, improvements, kinds of queries, worst queries, method. A run without queries has the head and empty sections."""
    n = queries.select("query_id").distinct().count()
    out = [f"# Retrieval comparison {run_id}", "", f"Made {when}; {n} queries.", "", "## Metrics", "", markdown(methods, order), "## Improvements"]
    for r in improvement_lines(methods, steps).orderBy("step", "row").collect():  # five lines a step
        head = f"### {r['method_a']} -> {r['method_b']}"
        out += ([] if head in out else ["", head, ""]) + [r["line"]]
    out += ["", "## Kinds of queries"]
    for r in type_lines(by_type).orderBy("method", "query_type").collect():  # four lines a method
        head = f"### {r['method']}"
        out += ([] if head in out else ["", head, ""]) + [r["line"]]
    out += ["", "## Worst queries"]
    for method in sorted({r["method"] for r in worst.select("method").distinct().collect()}):
        out += ["", f"### {method}: lowest relevance", "", *worst_lines(worst.where(F.col("method") == method))]
    out += ["", "## Method", "", "Each query and text is judged once, from 0 to 3; grades of 2 and more are relevant. Methods are compared by paired t tests over queries, at 0.05.", ""]
    return "\n".join(out)


def worst_lines(worst: DataFrame) -> list[str]:
    return [f'- **{r["query_id"]}**: "{(r["query"] or "")[:50]}..." (Avg Rel: {r["avg_relevance"]:.2f})' for r in worst.orderBy("method", "rank").collect()]  # a few rows per method
