"""Same or nearly same records across splits, by winnowing fingerprints.

A text is normalised to words. Its selected fingerprints are the minima, by a global order in which rare words come
first, over a window that is the whole text: e edits destroy e of its words at most, so of two nearly same texts at least
one of the e + 1 least words of either stands in both, and two of the e + 2 least. (Minima of short windows give
no such bound: edits may be spread so that no window survives.) Rarity is read from a sketch of SKETCH counters.
Where a group of texts is small, as the documents of one query are, one shared seed makes a candidate. In a large group
seeds are chained first: a key is two of the e + 2 least words in the order in which they stand, so only collinear pairs
of seeds meet. Pairs of words grow with the square of a text's length, so texts beyond CHAIN words are
fingerprinted by the rolling hash of two neighbouring words instead, of which an edit destroys three at most.
Word-set signatures discard candidates that can't be within a fifth, and the rest is extended by alignment: matching words are
chained in order (the longest common subsequence), words outside the chain are the edits.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.runtime import materialize, small, spread

#: Counters of the sketch of word frequencies; words that share one count together, alike in all texts.
SKETCH = 1 << 20
#: Words of the longest text whose seeds are chained in pairs.
CHAIN = 80
#: Documents of a query up to which one shared seed makes a candidate.
GROUP = 256
_TAG = re.compile(r"<[^<>]+>")
_VERSE = re.compile(r"^\s*[\[(]?\d{1,3}(?::\d{1,3})?[\])]?[.:)]?\s+")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=20_000)
def normalise(text: str) -> str:
    """Lower-case words with single spaces; without markup, entities, accents, punctuation and a leading verse number."""
    plain = _VERSE.sub("", _TAG.sub(" ", html.unescape(html.unescape(text))))
    plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return " ".join(_WORD.findall(plain.replace("’", "").replace("'", "").casefold()))


@F.pandas_udf(T.StringType())
def normalised(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalise(t))


def _signature(words: list[str]) -> tuple[int, int]:
    bits = 0
    for w in words:
        bits |= 1 << (xxhash.xxh64_intdigest(w, 3) & 127)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (bits & (1 << 64) - 1, bits >> 64))


@lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def hashes(words: list[str]) -> np.ndarray:
    return np.array([_hash(w) for w in words], dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two, in this order."""
    return a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def edit_limit(n: int) -> int:
    return n // 5


def _tolerated(n: int) -> int:
    """The edits of a pair that a text of n words may be in: the other may be up to a quarter longer."""
    return edit_limit(n + n // 4 + 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        for t in batch["text"]:
            total[np.unique(hashes(t.split()) & np.uint64(SKETCH - 1)).astype(np.int64)] += 1
    at = np.flatnonzero(total)
    yield pd.DataFrame({"k": at, "n": total[at]})


def sketch(texts: DataFrame) -> np.ndarray:
    """How many texts have a word of each counter; SKETCH numbers, whatever the corpus."""
    rows = spread(texts.select("text")).mapInPandas(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, dtype=np.int64)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out


def seeds(words: list[str], counts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n least (word hash, occurrence) of a text, rare words first; a word that stands twice is two seeds."""
    h = hashes(words)
    rare = counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
    seen: dict[int, int] = {}
    out = []
    for c, x in zip(rare.tolist(), h.tolist(), strict=True):
        seen[x] = seen.get(x, 0) + 1
        out.append((c, x, seen[x]))
    out.sort()
    return [(x, k) for _, x, k in out[:n]]


def single_keys(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Of two nearly same texts one key at least is common."""
    least = seeds(words, counts, _tolerated(len(words)) + 1)
    return _mix(np.array([x for x, _ in least], dtype=np.uint64), np.array([k for _, k in least], dtype=np.uint64))


def chained_keys(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Of two nearly same texts of five words or more one key at least is common; shorter ones are nearly the same only if they are equal."""
    n, e, out = len(words), _tolerated(len(words)), []
    if n <= CHAIN:
        least = seeds(words, counts, e + 2)
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for at, x in enumerate(hashes(words).tolist()):
            first.setdefault(x, at)
            last[x] = at
        for i, (x, _) in enumerate(least):
            for y, _ in least[i + 1 :]:
                if first[x] < last[y]:
                    out.append((x, y))
                if first[y] < last[x] and x != y:
                    out.append((y, x))
        out = list(dict.fromkeys(out))
        out = [_mix(np.array([x for x, _ in out], dtype=np.uint64), np.array([y for _, y in out], dtype=np.uint64))]
    if n > CHAIN * 4 // 5 - 1:  # and those that may be near to a longer one
        h = hashes(words)
        g = _mix(h[:-1], h[1:])
        rare = counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
        order = np.lexsort((g, np.minimum(rare[:-1], rare[1:])))
        _, once = np.unique(g[order], return_index=True)
        out.append(g[order][np.sort(once)[: 3 * e + 1]])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _select(counts: Broadcast, chained: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = chained_keys if chained else single_keys
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for t, text in zip(batch["t"], batch["text"], strict=True):
                words = text.split()
                g = keys(words, counts.value)
                x, y = _signature(words)
                out.append((np.full(len(g), t), g.view(np.int64), np.full(len(g), len(words), np.int32), np.full(len(g), x), np.full(len(g), y)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            yield pd.DataFrame(dict(zip("tgnxy", cols, strict=True)))

    return run


def fingerprints(texts: DataFrame, counts: Broadcast, chained: bool) -> DataFrame:
    """(t, g, n, x, y) from (t, text): the keys g of each text, its number of words and its word-set signature."""
    return spread(texts.select("t", "text")).mapInPandas(_select(counts, chained), "t long, g long, n int, x long, y long")


def _can_match() -> Column:
    """Necessary for a chain of four fifths: lengths, and at most a fifth of the words lacking in the other's signature."""
    e = F.floor(F.greatest("n_a", "n_b") / 5)
    lacks = lambda p, q: F.bit_count(F.col(f"x_{p}").bitwiseAND(F.bitwise_not(f"x_{q}"))) + F.bit_count(F.col(f"y_{p}").bitwiseAND(F.bitwise_not(f"y_{q}")))
    return (F.abs(F.col("n_a") - F.col("n_b")) <= e) & (lacks("a", "b") <= e) & (lacks("b", "a") <= e)


def chain(a: list[str], b: list[str]) -> int:
    """Words of the longest chain of equal words that stand in the same order in both; bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.IntegerType())
def chained(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([chain(p.split(), q.split()) for p, q in zip(a, b, strict=True)], dtype="int32")


def _verified(pairs: DataFrame, texts: DataFrame, keep: list[str]) -> DataFrame:
    """``pairs`` (a, b, ...) whose texts are within a fifth, with coverage, the share of the longer text's words in the chain."""
    with_a = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("t").alias("b"), F.col("text").alias("text_b")), "b")
    words = lambda c: F.size(F.split(c, " "))
    scored = both.withColumn("n", F.greatest(words(F.col("text_a")), words(F.col("text_b")))).withColumn("c", chained("text_a", "text_b"))
    return scored.where(F.col("n") - F.col("c") <= F.floor(F.col("n") / 5)).select("a", "b", *keep, F.round(F.col("c") / F.col("n"), 6).alias("coverage"))


def near_texts(texts: DataFrame) -> DataFrame:
    """(a, b, coverage) from (t, text, left, right): each pair of a ``left`` and a ``right`` text that are the same or nearly the same."""
    counts = texts.sparkSession.sparkContext.broadcast(sketch(texts))
    marks = materialize(fingerprints(texts, counts, True).join(texts.select("t", "left", "right"), "t"))
    a = marks.where("left").select("g", *(F.col(c).alias(f"{'a' if c == 't' else c + '_a'}") for c in ("t", "n", "x", "y")))
    b = marks.where("right").select("g", *(F.col(c).alias(f"{'b' if c == 't' else c + '_b'}") for c in ("t", "n", "x", "y")))
    pairs = a.join(b, "g").where((F.col("a") != F.col("b")) & _can_match()).select("a", "b").distinct()
    same = texts.where("left and right").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("coverage"))
    return _verified(pairs, texts, []).union(same)


class CrossSplitOverlap:
    """Records of evaluation splits, and test queries, that repeat train records.

    ``rows`` has ``key, query, document, split, source`` and, to choose among repeated rows of a key, ``at``;
    ``queries`` has ``key, query``. Null keys are dropped and repeated keys count once; a null text, or one
    without a word, matches nothing; a null split is no split. Splits other than ``train`` count as
    evaluation. Equal normalised texts are one text, so copies are compared once.
    """

    def __init__(self, rows: DataFrame, queries: DataFrame, train: str = "train"):
        key = lambda c: F.unhex(F.md5(c))
        r = rows.select(F.col("key").cast("string").alias("key"), "split", "source", "at", normalised("query").alias("nq"), normalised("document").alias("nd")).where("key is not null and split is not null")
        r = materialize(r.withColumn("kq", key("nq")).withColumn("kd", key("nd")))
        q = materialize(queries.select(F.col("key").cast("string").alias("key"), normalised("query").alias("nq")).where("key is not null").withColumn("kq", key("nq")))
        is_train = F.col("split") == train
        asked = r.select("kq", "nq", (~is_train).alias("l"), is_train.alias("r")).union(q.select("kq", "nq", F.lit(True), F.lit(False))).where("nq <> ''")
        number = lambda df, k, text: materialize(df.groupBy(k).agg(F.first(text).alias("text"), F.bool_or("l").alias("left"), F.bool_or("r").alias("right")).withColumn("t", F.monotonically_increasing_id()))
        self.query_texts = number(asked, "kq", "nq")
        self.doc_texts = number(r.where("nd <> ''").select("kd", "nd", (~is_train).alias("l"), is_train.alias("r")), "kd", "nd")
        tq, td = self.query_texts.select("kq", F.col("t").alias("q")), self.doc_texts.select("kd", F.col("t").alias("d"))
        once = r.groupBy("key").agg(F.max(F.struct("at", "split", "source", "kq", "kd")).alias("x")).select("key", "x.split", "x.source", "x.kq", "x.kd")
        self.rows = materialize(once.join(tq, "kq", "left").join(td, "kd", "left").select("key", "split", "source", "q", "d").withColumn("train", F.col("split") == train))
        self.queries = q.groupBy("key").agg(F.max("kq").alias("kq")).join(tq, "kq").select("key", "q")
        self.query_links = materialize(near_texts(self.query_texts))
        self._docs: DataFrame | None = None

    def document_links(self) -> DataFrame:
        """(a, b, coverage): nearly same documents, an evaluation row's and a train row's, whose queries are linked too."""
        if self._docs is None:
            link = self.query_links.select(F.col("a").alias("q"), F.col("b").alias("to"))
            tested = self.rows.where("not train and q is not null and d is not null").select("q", "d").distinct().join(link, "q").select(F.col("to").alias("q"), "d").distinct()
            trained = self.rows.where("train and q is not null and d is not null").select("q", "d").distinct().join(tested.select("q").distinct(), "q", "left_semi")
            asked = materialize(tested.withColumn("train", F.lit(False)).union(trained.withColumn("train", F.lit(True))))
            large = small(materialize(asked.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("q")))
            counts = self.doc_texts.sparkSession.sparkContext.broadcast(sketch(self.doc_texts))
            pairs = None
            for chained, how in ((False, "left_anti"), (True, "left_semi")):
                own = asked.join(large, "q", how)
                texts = self.doc_texts.join(own.select(F.col("d").alias("t")).distinct(), "t", "left_semi")
                marks = materialize(fingerprints(materialize(texts.select("t", "text")), counts, chained).withColumnRenamed("t", "d"))
                side = lambda is_train, name: own.where(F.col("train") == is_train).join(marks, "d").select("q", "g", F.col("d").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in "nxy"))  # noqa: B023, E731
                met = side(False, "a").join(side(True, "b"), ["q", "g"]).where((F.col("a") != F.col("b")) & _can_match()).select("a", "b")
                pairs = met if pairs is None else pairs.union(met)
            pairs = pairs.distinct()
            same = self.doc_texts.where("left and right").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("coverage"))
            self._docs = materialize(_verified(pairs, self.doc_texts, []).union(same))
        return self._docs

    def record_pairs(self) -> DataFrame:
        """(key, split, source, train_key, query_coverage, document_coverage): evaluation rows with train rows, both texts nearly the same."""
        e = self.rows.where("not train").select("key", "split", "source", "q", "d")
        t = self.rows.where("train").select(F.col("key").alias("train_key"), F.col("q").alias("tq"), F.col("d").alias("td"))
        docs = self.document_links().select(F.col("a").alias("d"), F.col("b").alias("td"), F.col("coverage").alias("document_coverage"))
        asks = self.query_links.select(F.col("a").alias("q"), F.col("b").alias("tq"), F.col("coverage").alias("query_coverage"))
        return e.join(docs, "d").join(t, "td").join(asks, ["q", "tq"]).select("key", "split", "source", "train_key", "query_coverage", "document_coverage")

    def query_pairs(self) -> DataFrame:
        """(key, train_key, query_coverage): test queries with every train row whose query is nearly the same."""
        t = self.rows.where("train").select(F.col("key").alias("train_key"), F.col("q").alias("tq"))
        return self.queries.join(self.query_links.select(F.col("a").alias("q"), F.col("b").alias("tq"), F.col("coverage").alias("query_coverage")), "q").join(t, "tq").select("key", "train_key", "query_coverage")

    def pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b."""
        both = self.record_pairs().select("key", "train_key").union(self.query_pairs().select("key", "train_key"))
        return both.select(F.least("key", "train_key").alias("key_a"), F.greatest("key", "train_key").alias("key_b"))

    def report(self) -> DataFrame:
        """One row per split and source of evaluation rows, and one for the test queries: records, and those that repeat train exactly or nearly."""
        best = self.record_pairs().groupBy("key").agg(F.max(F.least("query_coverage", "document_coverage")).alias("c"))
        marked = self.rows.where("not train").join(best, "key", "left").select("split", "source", "c")
        # whether a test query has a partner needs no train rows, only the linked text
        linked = self.query_links.groupBy(F.col("a").alias("q")).agg(F.max("coverage").alias("c"))
        asked = self.queries.join(linked, "q", "left").select(F.lit("test_queries").alias("split"), F.lit(None).cast("string").alias("source"), "c")
        n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
        return marked.union(asked).groupBy("split", "source").agg(
            F.count(F.lit(1)).alias("records"), n(F.col("c") == 1).alias("same"), n(F.col("c") < 1).alias("nearly_same"), F.round(F.avg(F.when(F.col("c").isNotNull(), 1.0).otherwise(0.0)), 6).alias("overlap_share"), F.round(F.avg("c"), 6).alias("mean_coverage")
        )
