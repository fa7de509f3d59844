"""Long exact spans shared between records, by recompression.

Every text is parsed bottom-up in rounds. A round first names short runs of one
symbol and then names pairs: the symbols are split into left and right ones by a
bit of their name, and each adjacent (left, right) becomes one symbol. Names are
hashes of the children's names, so all tasks give equal strings equal names without
exchanging a dictionary, and a whole parse is one narrow pass. As only symbols up
to a round's cap may merge, a parse is local: whether a symbol boundary stands
somewhere depends on at most ``reach`` characters around it, and no symbol is longer
than ``gap``. With 2 * reach + gap <= min_len, every span of ``min_len`` characters
holds a boundary whose surroundings of ``half`` characters to either side lie in the
span. Those surroundings are the high-level symbol that equal spans share, so no
span is missed; longer windows around shared symbols then decide exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.runtime import materialize

CAPS = (1, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
RUNS = {0: 4, 3: 6}
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """caps: of each round; runs: longest run named in a round; half: characters on either side of a boundary that make a symbol."""

    min_len: int
    caps: tuple[int, ...]
    runs: tuple[int, ...]
    half: int

    @property
    def spare(self) -> int:
        return self.min_len - 2 * self.half


def plan(min_len: int) -> Plan:
    if min_len < 8:
        raise ValueError("min_len must be at least 8")
    best, reach = 0, 0
    for n, cap in enumerate(CAPS):
        reach += cap + RUNS.get(n, 0)
        if 2 * reach + 2 * max(cap, RUNS.get(n, 0)) <= min_len:
            best = n + 1
    caps = CAPS[:best] or (1,)
    runs = tuple(RUNS.get(n, 0) if best else 0 for n in range(len(caps)))
    gap = max(2 * caps[-1], *runs)
    return Plan(min_len, caps, runs, (min_len - gap) // 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def boundaries(codes: np.ndarray, doc: np.ndarray, p: Plan) -> np.ndarray:
    """Positions in ``codes`` at which a symbol begins after all rounds; nothing merges across ``doc``."""
    start = np.arange(len(codes))
    sym = _mix(codes.astype(np.uint64) + _BASE)
    size = np.ones(len(codes), dtype=np.int64)
    for r, (cap, longest) in enumerate(zip(p.caps, p.runs, strict=True)):
        if longest and len(sym) > 1:
            first = np.ones(len(sym), dtype=bool)
            first[1:] = (sym[1:] != sym[:-1]) | (doc[start[1:]] != doc[start[:-1]])
            head = np.flatnonzero(first)
            count = np.diff(np.append(head, len(sym)))
            named = (count > 1) & (count * size[head] <= longest)
            keep = first | ~np.repeat(named, count)
            sym, size = sym.copy(), size.copy()
            sym[head[named]] = _mix(sym[head[named]] * _M2 + count[named].astype(np.uint64))
            size[head[named]] *= count[named]
            sym, size, start = sym[keep], size[keep], start[keep]
        if len(sym) < 2:
            break
        right = (_mix(sym ^ np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        small = size <= cap
        pair = ~right[:-1] & right[1:] & small[:-1] & small[1:] & (doc[start[:-1]] == doc[start[1:]])
        at = np.flatnonzero(pair)
        sym, size = sym.copy(), size.copy()
        sym[at] = _mix(sym[at] * _M1 + _mix(sym[at + 1]))
        size[at] += size[at + 1]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, size, start = sym[keep], size[keep], start[keep]
    return start


def symbols(texts: list[str], p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, boundary in it, name of its surroundings) of every boundary with ``half`` characters on both sides."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), length)
    begin = np.concatenate(([0], np.cumsum(length)))
    cut = boundaries(codes, doc, p)
    pos = cut - begin[doc[cut]]
    ok = (pos >= p.half) & (pos + p.half <= length[doc[cut]])
    cut, pos = cut[ok], pos[ok]
    power = np.cumprod(np.full(len(codes) + 1, _BASE | np.uint64(1)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + _BASE) * power[:-1])))
    a, b = cut - p.half, cut + p.half
    inverse = np.uint64(pow(int(_BASE | np.uint64(1)), -1, 1 << 64))
    back = np.cumprod(np.full(len(codes) + 1, inverse))
    return doc[cut], pos, _mix((total[b] - total[a]) * back[a])


def _name_symbols(min_len: int):
    p = plan(min_len)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, lo = batch["d"].to_numpy(), batch["text"].tolist(), 0
            while lo < len(texts):  # about two million characters at a time
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) < 2_000_000):
                    chars += len(texts[hi])
                    hi += 1
                d, pos, name = symbols(texts[lo:hi], p)
                yield pd.DataFrame({"d": ids[lo:hi][d], "pos": pos.astype(np.int32), "h": name.view(np.int64)})
                lo = hi

    return run


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id with a text; of differing texts of one id the smallest counts."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))


def _spread(df: DataFrame) -> DataFrame:
    """As many partitions as the session shuffles into: the parse costs far more a byte than a scan."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "d")


def _member(text: Column) -> Column:
    return F.sha2(text, 256)


class SharedSpans:
    """The spans of at least ``min_len`` characters that stand in more than one record of ``df``.

    Nulls in either column drop the row, repeated rows of one id count once, texts shorter than
    ``min_len`` share nothing, an empty table gives empty results. Equal texts form a class named by
    its smallest id; only one text of a class is parsed. Spans compare by code point, exactly as stored.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", text_col: str = "text", min_len: int = 120):
        self.plan, self.min_len = plan(min_len), min_len
        docs = materialize(_documents(df, id_col, text_col).withColumn("k", _member(F.col("text"))))
        classes = docs.groupBy("k").agg(F.min("id").alias("d"), F.count(F.lit(1)).alias("copies"))
        self.members = materialize(docs.select("id", "k", F.length("text").alias("n_chars")).join(classes, "k").select("id", "d", "n_chars", "copies"))
        self.texts = docs.join(self.members.where("id = d").select("id", "d"), "id").where(F.length("text") >= min_len).select("d", "text")
        self._windows: DataFrame | None = None

    def windows(self) -> DataFrame:
        """(d, s, h1, h2): each run of ``min_len`` characters of a class that may stand in another class, and its two hashes."""
        if self._windows is None:
            p, schema = self.plan, "d string, pos int, h long"
            named = materialize(_spread(self.texts).mapInPandas(_name_symbols(self.min_len), schema))
            shared = named.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").select("h")
            around = named.join(shared, "h", "left_semi").groupBy("d").agg(F.collect_set("pos").alias("at"))
            starts = F.array_distinct(F.flatten(F.transform("at", lambda c: F.sequence(F.greatest(c + p.half - p.min_len, F.lit(0)), F.least(c - p.half, F.length("text") - p.min_len)))))
            runs = self.texts.join(around, "d").select("d", "text", F.explode(starts).alias("s")).withColumn("w", F.substring("text", F.col("s") + 1, F.lit(p.min_len)))
            all_runs = runs.select("d", "s", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"))
            self._windows = materialize(all_runs)
        return self._windows

    def _groups(self) -> tuple[DataFrame, DataFrame]:
        one = self.windows().select("h1", "h2", "d").distinct()
        sets = one.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "d")).alias("y"), F.min("d").alias("lo")).where("n > 1")
        return one, sets

    def class_pairs(self) -> DataFrame:
        """(a, b), a < b: the classes that share a span. Runs with the same set of classes give the same pairs, so one of them is expanded."""
        one, sets = self._groups()
        chosen = sets.groupBy("n", "x", "y", "lo").agg(F.min(F.struct("h1", "h2")).alias("g")).select("g.h1", "g.h2")
        in_group = one.join(chosen, ["h1", "h2"])
        left, right = in_group.select("h1", "h2", F.col("d").alias("a")), in_group.select("h1", "h2", F.col("d").alias("b"))
        return left.join(right, ["h1", "h2"]).where("a < b").select("a", "b").distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: all ids that share a span, copies of a text expanded."""
        ids = self.members.select("id", "d", "n_chars")
        across = self.class_pairs().join(ids.select(F.col("id").alias("p"), F.col("d").alias("a")), "a").join(ids.select(F.col("id").alias("q"), F.col("d").alias("b")), "b")
        copies = self.members.where(f"copies > 1 and n_chars >= {self.min_len}").select("id", "d")
        within = copies.select(F.col("id").alias("p"), "d").join(copies.select(F.col("id").alias("q"), "d"), "d").where("p < q")
        return across.select("p", "q").union(within.select("p", "q")).select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"))

    def spans(self) -> DataFrame:
        """(d, start, length): the maximal stretches of a class text that are covered by shared runs; start counts from 0."""
        _, sets = self._groups()
        hit = self.windows().join(sets.select("h1", "h2"), ["h1", "h2"], "left_semi").select("d", "s").distinct()
        m = self.min_len
        merged = F.aggregate(
            F.array_sort("at"),
            F.expr("cast(array() as array<struct<s:int,e:int>>)"),
            lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= s), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), (s + m).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(s.alias("s"), (s + m).alias("e"))))),
        )
        return hit.groupBy("d").agg(F.collect_list("s").alias("at")).select("d", F.explode(merged).alias("x")).select("d", F.col("x.s").alias("start"), (F.col("x.e") - F.col("x.s")).alias("length"))

    def coverage(self) -> DataFrame:
        """One row per id: its class, its length, how many of its characters are found elsewhere (all, if the text has a copy), the share, and its spans."""
        by_class = self.spans().groupBy("d").agg(F.sum("length").alias("c"), F.count(F.lit(1)).alias("n"))
        whole = (F.col("copies") > 1) & (F.col("n_chars") >= self.min_len)
        shared = F.when(whole, F.col("n_chars").cast("long")).otherwise(F.coalesce("c", F.lit(0)).cast("long"))
        return self.members.join(by_class, "d", "left").select(
            F.col("id").alias("doc_id"), F.col("d").alias("class_id"), F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"),
            F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_share"), F.when(whole, 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
        )
