"""Mixing sources to target shares of all tokens, by a low-discrepancy schedule.

Slot n of the mixture gets the point frac(n / golden ratio); mapped through the cumulative
shares it names the slot's source, so every stretch of the mixture has nearly the target
shares. The documents of a source are shuffled anew in every pass, laid end to end and cut into
blocks of equal size; the r-th slot of a source takes its r-th block.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import VOCABULARY, order_bucket, ranked, sized, summed
from lectern.runtime import materialize, small

#: The golden ratio's fraction as a 62-bit integer; slot n lies at n * GOLDEN mod 2**62.
GOLDEN = 2850178377206449221
_SPAN = 1 << 62


class Mixture:
    """``targets``: source, target_share, max_repeats. ``total_tokens``: size of the mixture; ``size`` sets it where
    that is none: "reachable" is the largest at which every listed source that has tokens reaches its share,
    "supply" all tokens of the listed sources. A source that can't reach its share gives all it may, its other
    slots stay empty, the rest keep their schedule, and the report says so. Sources of equal name count once (largest share, then
    repeats); null sources, and shares or repeats that are null or not positive, are dropped; shares are
    taken relative to their sum. Documents of unlisted sources, null ids and empty texts aren't used. Ids must be unique.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, size: str = "reachable", block: int = 256, seed: int = 17, vocabulary: str = VOCABULARY):
        self.spark, self.block, self.seed = documents.sparkSession, block, seed
        wanted = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).where("source is not null and share > 0 and most > 0")
        rows = wanted.groupBy("source").agg(F.max(F.struct("share", "most")).alias("x")).select("source", "x.share", "x.most").orderBy("source").collect()  # one row per listed source
        whole = sum(r["share"] for r in rows)
        docs = documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("t")).where(F.col("id").isNotNull() & F.col("source").isin([r["source"] for r in rows]))
        self.sizes = materialize(sized(docs, "id", "t", ["source"], vocabulary).where("tokens > 0"))
        have = {r["source"]: r["n"] for r in self.sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        self.share = {r["source"]: r["share"] / whole for r in rows}
        self.most = {r["source"]: r["most"] for r in rows}
        self.supply = {s: have.get(s, 0) for s in self.share}
        filled = [s for s in self.share if self.supply[s]]
        weight = sum(self.share[s] for s in filled)
        if size not in ("reachable", "supply"):
            raise ValueError(f"size is reachable or supply, not {size}")
        if total_tokens is None and size == "supply":
            total_tokens = sum(self.supply.values())
        elif total_tokens is None:
            total_tokens = int(min((self.supply[s] * self.most[s] * weight / self.share[s] for s in filled), default=0))
        self.total = total_tokens
        self.slots = total_tokens // block
        # a source without tokens gets no slots; the others keep their proportions
        self.weight = {s: self.share[s] / weight for s in filled}

    def schedule(self) -> DataFrame:
        """(slot, source, block_no): the source of each slot, and how many slots it had before."""
        point = F.expr(f"cast(pmod(cast(id as decimal(38,0)) * {GOLDEN}, {_SPAN}) as bigint)")
        source, edge = F.lit(None).cast("string"), Fraction(0)
        bounds = []
        for s, w in self.weight.items():
            edge += Fraction(w)
            bounds.append((s, min(_SPAN, int(edge * _SPAN))))
        for s, high in reversed(bounds):
            source = F.lit(s) if source is None or (s, high) == bounds[-1] else F.when(F.col("point") < high, F.lit(s)).otherwise(source)
        slots = self.spark.range(self.slots).select(F.col("id").alias("slot"), point.alias("point")).select("slot", source.alias("source")).where("source is not null")
        return ranked(slots.withColumn("b", F.shiftright("slot", 14)), ["source"], "b", ["slot"], "block_no").drop("b")

    def records(self) -> DataFrame:
        """(slot, source, doc_id, pass_no, start, tokens): the pieces of documents that fill each slot; pass_no counts the uses of a document from 0."""
        if not self.weight:
            return self.spark.createDataFrame([], "slot long, source string, doc_id long, pass_no int, start long, tokens long")
        plan = self.spark.createDataFrame([(s, min(self.most[s], -(-int(self.slots * w + 2) * self.block // self.supply[s])), self.supply[s]) for s, w in self.weight.items()], "source string, passes int, supply long")
        used = self.sizes.join(small(plan), "source").select("id", "source", "tokens", "supply", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass_no"))
        used = used.withColumn("h", F.xxhash64(F.lit(self.seed), "pass_no", "id")).withColumn("b", order_bucket(F.col("h")))
        laid = summed(used, ["source", "pass_no"], "b", ["h", "id"], "tokens", "at").withColumn("at", F.col("at") + F.col("pass_no") * F.col("supply"))
        block_no = F.explode(F.sequence(F.floor(F.col("at") / self.block), F.floor((F.col("at") + F.col("tokens") - 1) / self.block)))
        pieces = laid.select("source", "id", "pass_no", "at", "tokens", block_no.alias("block_no"))
        low, high = F.greatest("at", F.col("block_no") * self.block), F.least(F.col("at") + F.col("tokens"), (F.col("block_no") + 1) * self.block)
        pieces = pieces.select("source", "block_no", F.col("id").alias("doc_id"), F.col("pass_no"), (low - F.col("at")).alias("start"), (high - low).alias("tokens"))
        return self.schedule().join(pieces, ["source", "block_no"]).select("slot", "source", "doc_id", "pass_no", "start", "tokens")

    def report(self, records: DataFrame | None = None) -> DataFrame:
        """One row per listed source: its target share, the share due and the share reached, tokens, passes, and a status.

        Due is the target share once what exhausted sources can't give is left to the others in proportion. The status is ``no documents``,
        ``short`` (all it may give is less than its target), or ``met`` if the share due is reached within two blocks, two thousandths or a thirtieth.
        """
        records = self.records() if records is None else records
        got = records.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("pass_no") + 1).alias("passes"))
        wanted = {s: self.weight.get(s, 0.0) * self.slots * self.block for s in self.share}
        gives = {s: min(wanted[s], float(self.supply[s] * self.most[s])) for s in self.share}
        whole = sum(gives.values()) or 1.0
        rows = [(s, self.share[s], gives[s] / whole, self.most[s], self.supply[s], gives[s] + 2 * self.block < wanted[s]) for s in self.share]
        listed = self.spark.createDataFrame(rows, "source string, target_share double, due double, max_repeats int, source_tokens long, exhausted boolean")
        all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
        out = listed.join(got, "source", "left").join(F.broadcast(all_tokens))  # one row
        reached = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
        met = F.abs(reached - F.col("due")) <= F.greatest(F.lit(0.002), 2.0 * self.block / F.col("all_tokens"), F.col("due") * 0.03)
        status = F.when(F.col("source_tokens") == 0, "no documents").when(F.col("exhausted"), "short").when(met, "met").when(reached < F.col("due"), "short").otherwise("over")
        return out.select("source", F.round("target_share", 6).alias("target_share"), F.round("due", 6).alias("due_share"), F.round(reached, 6).alias("reached_share"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source_tokens", F.coalesce("passes", F.lit(0)).alias("passes"), "max_repeats", status.alias("status"))
