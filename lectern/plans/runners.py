"""Command line of everything that runs by itself: index, evaluate, report, compare, search, training data, training.

    python -m lectern.plans.runners COMMAND ...

Tables are Parquet: passages with reference, volume, book, chapter, verse, text, context; queries with id, query, type.
Paths may name any file system that the session's Hadoop configuration knows.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import compare, metrics, report, training
from lectern.plans import evaluation, pipeline
from lectern.plans.methods import Retrieval
from lectern.runtime import session
from lectern.sources import providers, readers, runs, storage

SHORT = ("legacy", "contextual", "contextual_rerank", "hybrid_rrf", "hybrid_rerank")


def _retrieval(spark: SparkSession, passages: str, queries: DataFrame, reranker: str | None = None) -> Retrieval:
    """A missing or unreadable reranker leaves its method out."""
    p = spark.read.parquet(passages).select(F.col("reference").alias("id"), "text", "context", "reference", "volume")
    model = evaluation.load_reranker(reranker)
    return Retrieval(p, queries.select("query_id", "query"), custom=training.model_scorer(model) if model else None)


def _asked(spark: SparkSession, path: str) -> DataFrame:
    q = readers.query_set(spark, path) if path.endswith(".json") else spark.read.parquet(path)
    return q.where("query is not null").select(F.col("id").alias("query_id"), "query", "type").dropDuplicates(["query_id"])


def _methods(r: Retrieval, c: readers.RunConfig) -> dict[str, Callable[[], DataFrame]]:
    made = {
        "legacy": lambda: r.legacy(c.top_k), "contextual": lambda: r.contextual(c.top_k), "contextual_rerank": lambda: r.contextual_rerank(c.rerank_initial_k, c.rerank_top_n),
        "hybrid_rrf": lambda: r.hybrid_rrf(n=c.top_k), "hybrid_rerank": lambda: r.hybrid_rerank(n=c.rerank_top_n),
    }
    if r.custom is not None:
        made["contextual_custom_rerank"] = lambda: r.contextual_custom_rerank(c.rerank_initial_k, c.rerank_top_n)
    return made


def build_index(spark: SparkSession, passages: str, root: str, start: int = 1, skip_summaries: bool = False, dry_run: bool = False, say=print) -> list[str]:
    return pipeline.run(spark, pipeline.default_stages(lambda s: s.read.parquet(passages)), root, start, skip_summaries, dry_run, say)


def evaluate(spark: SparkSession, passages: str, queries: str, root: str, config: str | None = None, reranker: str | None = None, say=print) -> str:
    """Run every method, judge, measure and compare; the artifacts go to a new run folder, whose path is returned."""
    c = readers.run_config(config) if config else readers.RunConfig()
    asked = _asked(spark, queries)
    r = _retrieval(spark, passages, asked, reranker)
    hits, latencies = evaluation.timed(_methods(r, c), asked)
    pairs = compare.PAIRS + ((("contextual_rerank", "contextual_custom_rerank"),) if r.custom is not None else ())
    e = evaluation.evaluate(hits, asked.select("query_id", "query"), config=c, latencies=latencies, pairs=pairs)
    path = runs.new_run(root)
    e.write(path)
    e.queries.write.mode("overwrite").parquet(f"{path}/queries")
    for line in report.summary_lines(e.methods, e.comparisons):
        say(line)
    return path


def write_report(spark: SparkSession, root: str, run: str | None = None, now: datetime | None = None) -> str:
    """The Markdown report of a run, the newest one by default; the path of the file."""
    path = run or runs.latest_run(root)
    if path is None:
        raise FileNotFoundError(f"no run under {root}")
    queries = spark.read.parquet(f"{path}/queries")
    ks = tuple(sorted(int(c[2:]) for c in queries.columns if c.startswith("p_")))
    methods = metrics.aggregate(queries, ks)
    for _, column, _ in report.ROWS:  # a depth that the run didn't measure is a dash
        if column not in methods.columns:
            methods = methods.withColumn(column, F.lit(None).cast("double"))
    order = list(dict.fromkeys([*SHORT[:3], *sorted(r["method"] for r in methods.select("method").collect())]))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    text = report.full(name, methods, queries, order, f"{now or datetime.now():%Y-%m-%d %H:%M:%S}", compare.by_type(queries), compare.worst_queries(queries))
    out = f"{path}/report.md"
    storage.write_text(out, text)
    return out


def quick(spark: SparkSession, passages: str, out: str, queries: DataFrame | None = None, k: int = 10, say=print) -> None:
    """The quick comparison: hits, latencies and overlaps without any judge; the shown queries are printed."""
    asked = (readers.quick_queries(spark) if queries is None else queries).select(F.col("id").alias("query_id"), "query", "type")
    r = _retrieval(spark, passages, asked)
    hits, latencies = evaluation.timed(_methods(r, readers.RunConfig(top_k=k, rerank_top_n=k)), asked)
    summary = evaluation.quick_comparison(hits, latencies, k=k)
    lines = evaluation.top_lines(hits, 5).join(asked, "query_id")
    runs.write_quick(lines, summary, out)
    for r_ in lines.where(F.col("query_id").isin(*readers.SHOWN)).orderBy("query_id", "method").collect():  # three queries
        say(f"{r_['query_id']} {r_['method']}: " + "; ".join(r_["lines"][:3]))


def search(spark: SparkSession, passages: str, lines=sys.stdin, k: int = 10, say=print) -> int:
    """Answer queries line by line with the contextual search; vectors of the passages are made once."""
    first = spark.createDataFrame([("q", "")], "query_id string, query string")
    r = _retrieval(spark, passages, first)
    r._vectors("context")

    def answer(query: str) -> list[str]:
        r.queries = spark.createDataFrame([("q", query)], "query_id string, query string")
        r._made.pop("asked", None)
        r._held.clear()
        found = runs.page_content(r.contextual(k)).orderBy("rank").collect()  # k rows
        return [f"{x['rank']}. {x['metadata']['reference']} ({x['metadata']['score']:.4f}): {x['pageContent'] or ''}" for x in found] or ["nothing found"]

    return pipeline.search_loop(answer, lines, say)


def training_data(spark: SparkSession, passages: str, queries: str, out: str, count: int = 0, k: int = 50, writer: providers.Writer | None = None, now: datetime | None = None) -> str:
    """Candidates of the given queries, and of as many generated ones as ``count`` lacks, judged, labelled and written in all forms; the stamp of the files."""
    asked = _asked(spark, queries)
    lacks = count - asked.count()
    if lacks > 0:
        p = spark.read.parquet(passages)
        made = providers.generate_queries(spark, writer, lacks).select(F.concat(F.lit("G"), F.md5("query")).alias("query_id"), "query", "type") if writer else providers.topic_queries(p, lacks).select(F.concat(F.lit("G"), F.col("id")).alias("query_id"), "query", "type")
        asked = asked.unionByName(made)
    stamp = (now or datetime.now()).strftime(runs.STAMP)
    examples = evaluation.build_training_set(_retrieval(spark, passages, asked), asked, k)
    runs.write_training_set(examples, out, "example_id", stamp)
    return stamp


def train(spark: SparkSession, root: str, out: str) -> str:
    """Fit the reranker on the newest training set under ``root`` and save it; the training set's path."""
    path = runs.latest_training_set(root)
    if path is None:
        raise FileNotFoundError(f"no training set under {root}")
    rows = readers.training_set(spark, path)
    if "split" in rows.columns:
        rows = rows.where("split = 'train'")
    evaluation.save_reranker(training.fit_reranker(rows.where("query is not null and document is not null and label is not null")), out)
    return path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *args: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=help_)
        for a in args:
            sub.add_argument(a)
        return sub

    c = command("index", "passages to summaries, contexts and embedded records", "passages", "root")
    c.add_argument("--start-from", type=int, default=1)
    c.add_argument("--skip-summaries", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c = command("evaluate", "run, judge and compare all methods", "passages", "queries", "root")
    c.add_argument("--config")
    c.add_argument("--reranker")
    command("report", "Markdown of a run", "root").add_argument("--run")
    command("compare", "quick comparison without a judge", "passages", "out")
    command("search", "answer queries line by line", "passages").add_argument("-k", type=int, default=10)
    command("training-data", "judged candidates in all forms", "passages", "queries", "out").add_argument("--count", type=int, default=0)
    command("train", "fit and save the reranker", "root", "out")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "index":
        build_index(spark, a.passages, a.root, a.start_from, a.skip_summaries, a.dry_run)
    elif a.command == "evaluate":
        print(evaluate(spark, a.passages, a.queries, a.root, a.config, a.reranker))
    elif a.command == "report":
        print(write_report(spark, a.root, a.run))
    elif a.command == "compare":
        quick(spark, a.passages, a.out)
    elif a.command == "search":
        search(spark, a.passages, k=a.k)
    elif a.command == "training-data":
        print(training_data(spark, a.passages, a.queries, a.out, a.count))
    else:
        print(train(spark, a.root, a.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
