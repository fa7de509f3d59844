"""The mixture of all listed tokens: exhausted sources, and the records against SQL over the table of token counts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing

DOCS = "doc_id long, text string, source string"
MIX = "source string, target_share double, max_repeats int"
SQL = """
WITH s AS (SELECT source, sum(tokens)::bigint AS supply FROM used WHERE pass_no = 0 GROUP BY 1),
a AS (SELECT u.*, (sum(tokens) OVER (PARTITION BY source, pass_no ORDER BY h, id))::bigint - tokens + pass_no * supply AS start_at FROM used u JOIN s USING (source)),
b AS (SELECT *, unnest(range(start_at // $block, (start_at + tokens - 1) // $block + 1)) AS block_no FROM a),
p AS (SELECT source, block_no, id AS doc_id, pass_no, greatest(start_at, block_no * $block) AS low, least(start_at + tokens, (block_no + 1) * $block) AS high, start_at FROM b),
c AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block_no FROM slots)
SELECT slot, source, doc_id, pass_no, (low - start_at)::bigint AS start, (high - low)::bigint AS tokens FROM c JOIN p USING (source, block_no)
"""


@pytest.fixture
def mixture(spark):
    texts = [(i, " ".join(["word"] * (3 + i * 7 % 40)), "big") for i in range(300)] + [(1000 + i, "six seven eight " * (i + 1), "small") for i in range(6)] + [(2000, "rare leaf", "rare"), (3000, "x y", "unlisted")]
    targets = [("big", 0.5, 2), ("small", 0.2, 3), ("rare", 0.2, 16), ("none", 0.1, 4)]
    return mixing.Mixture(spark.createDataFrame(texts, DOCS), spark.createDataFrame(targets, MIX), size="supply", block=16)


def test_exhausted_sources_give_all_and_are_reported(mixture):
    rows = mixture.records().collect()
    rep = {r["source"]: r for r in mixture.report().collect()}
    assert mixture.total == sum(mixture.supply.values())
    assert {s: r["status"] for s, r in rep.items()} == {"big": "met", "small": "short", "rare": "short", "none": "no documents"}
    assert rep["rare"]["passes"] == 16
    assert rep["rare"]["tokens"] == mixture.supply["rare"] * 16  # no token it may give is left out
    assert rep["small"]["tokens"] == mixture.supply["small"] * 3
    assert sum(r["tokens"] for r in rows) == sum(r["tokens"] for r in rep.values())
    assert len({(r["doc_id"], r["pass_no"], r["start"]) for r in rows}) == len(rows)


def test_records_equal_sql_over_the_token_table(spark, mixture):
    used = mixture.sizes.select("id", "source", "tokens", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pass_no")).withColumn("h", F.xxhash64(F.lit(mixture.seed), "pass_no", "id")).toPandas()
    used = used[[p < mixture.most[s] for p, s in zip(used["pass_no"], used["source"], strict=True)]]
    db = duckdb.connect()
    slots, point = [], 0
    edges = list(mixture.weight.items())
    for slot in range(mixture.slots):
        at, source = point / 2**62, edges[-1][0]
        for s, w in edges:
            if at < w:
                source = s
                break
            at -= w
        slots.append((slot, source))
        point = (point + mixing.GOLDEN) % 2**62
    db.execute("create table slots(slot bigint, source varchar)")
    db.executemany("insert into slots values (?, ?)", slots)
    db.register("used", used)
    cols = ["slot", "source", "doc_id", "pass_no", "start", "tokens"]
    want = sorted(db.execute(SQL.replace("$block", "16")).fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in mixture.records().collect()) == want


def test_unknown_size_is_refused(spark):
    with pytest.raises(ValueError, match="reachable"):
        mixing.Mixture(spark.createDataFrame([], DOCS), spark.createDataFrame([], MIX), size="big")


def test_empty_tables(spark):
    m = mixing.Mixture(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], MIX), size="supply")
    assert m.records().count() == 0
    assert [r["status"] for r in m.report().collect()] == ["no documents"]
