"""Stages that hand Parquet to each other, with dry run, skip and resume; and the command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import corpus, index
from lectern.sources import providers, storage


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[SparkSession, str], DataFrame]  # reads earlier stages' folders under the root
    skippable: bool = False


def _done(root: str, name: str) -> bool:
    return storage.complete(f"{root}/{name}")


def default_stages(read: Callable[[SparkSession], DataFrame]) -> list[Stage]:
    """Passages, summaries, contexts, embedded index records."""
    at = lambda s, root, name: s.read.parquet(f"{root}/{name}")
    return [
        Stage("passages", lambda s, root: read(s)),
        Stage("summaries", lambda s, root: corpus.summarize(at(s, root, "passages")), skippable=True),
        Stage("contexts", lambda s, root: corpus.with_context(at(s, root, "passages"), at(s, root, "summaries"))),
        Stage("index", lambda s, root: index.records(providers.embed(at(s, root, "contexts"), "context"), "vector")),
    ]


def run(spark: SparkSession, stages: list[Stage], root: str, start: int = 1, skip_done: bool = False, dry_run: bool = False, say: Callable[[str], None] = print) -> list[str]:
    """Run the stages from the ``start``-th on and return the names of those that ran (or would).

    With ``skip_done`` a skippable stage whose output is complete isn't run again. A failing stage stops the run; what was written stays, so a later run can start there.
    """
    ran = []
    for n, stage in enumerate(stages, 1):
        if n < start or (skip_done and stage.skippable and _done(root, stage.name)):
            say(f"{n}. {stage.name}: skipped")
            continue
        say(f"{n}. {stage.name}" + (": would run" if dry_run else ""))
        ran.append(stage.name)
        if not dry_run:
            stage.run(spark, root).write.mode("overwrite").parquet(f"{root}/{stage.name}")
    return ran


def search_loop(search: Callable[[str], list[str]], lines=sys.stdin, say: Callable[[str], None] = print) -> int:
    """Answer queries line by line until quit, exit or q; blank lines are passed over."""
    n = 0
    for line in lines:
        query = line.strip()
        if query.lower() in {"quit", "exit", "q"}:
            break
        if query:
            n += 1
            for row in search(query):
                say(row)
    return n


def main(argv: list[str] | None = None) -> int:
    from lectern.runtime import session

    p = argparse.ArgumentParser(description="Build the index from a Parquet table of passages.")
    p.add_argument("passages")
    p.add_argument("root")
    p.add_argument("--start-from", type=int, default=1)
    p.add_argument("--skip-summaries", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    run(session(), default_stages(lambda s: s.read.parquet(a.passages)), a.root, a.start_from, a.skip_summaries, a.dry_run)
    return 0


if __name__ == "__main__":
    sys.exit(main())
