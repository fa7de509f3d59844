"""Freely typed values mapped to a list of names and aliases, by a trie and a Levenshtein automaton.

All names and aliases, written without separators, are paths of one trie; a path for the
name without its inner vowels is an alias too. The automaton is run down the trie row
by row and leaves a branch as soon as every state is beyond the allowed distance, so all
entries within the distance of a value come out. The distance allows swapped
neighbours and depends on the length of the entry.

Words that people add around a value are learned from the values themselves: an affix is what
stands before or after an exactly written entry, and one that leaves an entry in at least
LEAVES of the values it begins or ends is taken off before the automaton is run.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.relational import numbered
from lectern.runtime import materialize, small

#: Entries in one trie; a longer list is searched in parts of that many.
TRIE_ENTRIES = 50_000
#: Words of an affix at most, on either side of an entry.
AFFIX_WORDS = 3
#: Share of the values with an affix in which it must leave an entry.
LEAVES = 0.2
#: Share of all distinct values in which it must do so; as a value has AFFIX_WORDS of them on either side at most, this bounds their number.
SUPPORT = 1e-4
#: Different entries beside an affix that are evidence enough.
DIVERSE = 10
Affixes = frozenset[tuple[str, tuple[str, ...]]]
_DIGITS = str.maketrans("01345", "oieas")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d+")


def allowed(length: int) -> int:
    """Edits allowed against an entry of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


def fold(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _CAMEL.sub(" ", text)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(fold(text).casefold())


def skeleton(word: str) -> str:
    return word[:1] + re.sub("[aeiou]", "", word[1:])


class Trie:
    """entries: (id, text) of names and aliases; of one text under several ids the smallest counts."""

    def __init__(self, entries: list[tuple[int, str]]):
        self.root: dict = {}
        self.sorted: dict[tuple[str, ...], int] = {}
        self.letters: dict[str, int] = {}
        words: list[str] = []
        for i, text in sorted(entries, key=lambda e: (e[0], e[1])):
            parts = tokens(text)
            word = "".join(parts)
            if not word:
                continue
            self._add(word, i, len(word))
            words.append(word)
            bare = "".join(skeleton(w) for w in parts)
            if len(bare) > 4 and len(bare) < len(word):
                self._add(bare, i, 0)
                words.append(bare)
            self.sorted.setdefault(tuple(sorted(parts)), i)
        for c in sorted({c for w in words for c in w}):
            self.letters[c] = len(self.letters)
        self.bags = np.array([self._bag(w) for w in words], dtype=np.int16).reshape(len(words), len(self.letters) + 1)
        self.slack = np.array([max(allowed(len(w)), 0) for w in words])
        self.longest = max((len(w) + allowed(len(w)) for w in words), default=0)  # no longer reading is within the distance of an entry

    def _add(self, word: str, i: int, length: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", (i, allowed(length), word))

    def _bag(self, word: str) -> list[int]:
        bag = [0] * (len(self.letters) + 1)
        for c in word:
            bag[self.letters.get(c, -1)] += 1
        return bag

    def may_match(self, word: str) -> bool:
        """Whether the letters of ``word``, in whatever order, are near enough to any entry's; no edit changes more than one letter."""
        if not len(self.bags):
            return False
        d = np.array(self._bag(word), dtype=np.int16) - self.bags
        return bool((np.maximum(np.where(d > 0, d, 0).sum(1), np.where(d < 0, -d, 0).sum(1)) <= self.slack).any())

    def alike(self, word: str) -> bool:
        """Whether some entry has three quarters of its letters in common with ``word``, in whatever order."""
        if not len(self.bags):
            return False
        both = np.minimum(np.array(self._bag(word), dtype=np.int16)[:-1], self.bags[:, :-1]).sum(1)
        return bool((both >= 0.75 * np.maximum(self.bags.sum(1), len(word))).any())

    def within(self, word: str) -> list[tuple[int, float, int]]:
        """(distance, distance a letter, id) of all entries whose allowed distance covers ``word``."""
        found: list[tuple[int, float, int]] = []
        n, far = len(word), 1 << 20
        # a row holds the distances to the prefixes of ``word`` whose length is within 3 of the depth
        stack = [(self.root, "", 0, {k: k for k in range(min(n, 3) + 1)}, {})]
        while stack:
            node, last, depth, row, before = stack.pop()
            if (end := node.get("")) and row.get(n, far) <= end[1]:
                found.append((row[n], row[n] / len(end[2]), end[0]))
            for c, child in node.items():
                if not c:
                    continue
                new: dict[int, int] = {}
                for k in range(max(0, depth - 2), min(n, depth + 4) + 1):
                    d = row.get(k, far) + 1
                    if k:
                        d = min(d, new.get(k - 1, far) + 1, row.get(k - 1, far) + (word[k - 1] != c))
                        if k > 1 and depth and word[k - 1] == last and word[k - 2] == c:
                            d = min(d, before.get(k - 2, far) + 1)
                    if d <= 3:
                        new[k] = d
                if new or any(v <= 2 for v in row.values()):
                    stack.append((child, c, depth + 1, new, row))
        return found

    def within_orders(self, words: list[str]) -> list[tuple[int, float, int]]:
        """As ``within``, over all orders of ``words``: orders that have used the same words so far share their states, and words that leave none are not followed."""

        def widen(states: dict) -> dict:
            stack = [v for k, v in states.items() if not k[1]]
            while stack:
                d, node = stack.pop()
                for c, child in node.items():
                    if c and d < min(3, states.get((id(child), ""), (4,))[0] - 1):
                        states[id(child), ""] = d + 1, child
                        stack.append((d + 1, child))
            return states

        def step(states: dict, letter: str) -> dict:
            new: dict = {}

            def put(d: int, node: dict, due: str) -> None:
                if d < new.get((id(node), due), (4,))[0]:
                    new[id(node), due] = d, node

            for (_, due), (d, node) in states.items():
                if due:  # the second of two swapped letters
                    if letter == due:
                        put(d, node, "")
                    continue
                put(d + 1, node, "")
                for c, child in node.items():
                    if c:
                        put(d + (c != letter), child, "")
                        if c != letter and letter in child:
                            put(d + 1, child[letter], c)
            return widen(new)

        level = {(): widen({(id(self.root), ""): (0, self.root)})}
        for _ in words:
            after: dict[tuple[int, ...], dict] = {}
            for used, states in level.items():
                tried = set()
                for i, word in enumerate(words):
                    if i in used or word in tried:
                        continue
                    tried.add(word)
                    now = states
                    for letter in word:
                        now = step(now, letter)
                    if now:
                        own = after.setdefault(tuple(sorted((*used, i))), {})
                        for key, v in now.items():
                            if v[0] < own.get(key, (4,))[0]:
                                own[key] = v
            level = after
        ends = [(d, node[""]) for states in level.values() for (_, due), (d, node) in states.items() if not due and "" in node]
        return [(d, d / len(end[2]), end[0]) for d, end in ends if d <= end[1]]

    def completions(self, word: str) -> set[int]:
        """Ids of the entries of which ``word`` is more than half, from the start."""
        node = self.root
        for c in word:
            if c not in node:
                return set()
            node = node[c]
        ids, stack = set(), [(node, len(word))]
        while stack:
            node, depth = stack.pop()
            for c, child in node.items():
                if c:
                    stack.append((child, depth + 1))
                elif depth <= len(word) * 1.8 and child[1]:
                    ids.add(child[0])
        return ids


def _bare(raw: str) -> tuple[str, str]:
    """The folded value, and it without notes in brackets or after dashes."""
    text = fold(raw.replace("\\n", " ").replace("\\t", " "))
    return text, re.sub(r"\[[^\]]*\]|\([^)]*\)|\s--\s.*$", " ", text)


def _shape(words: tuple[str, ...]) -> tuple[str, ...]:
    """Words of an affix, all numbers alike."""
    return tuple(_NUMBER.sub("0", w) for w in words)


def _stripped(words: list[str], affixes: Affixes) -> list[str]:
    """``words`` without learned affixes and numbers at its ends, longest first; never all of it."""
    while len(words) > 1:
        for n in range(min(AFFIX_WORDS, len(words) - 1), 0, -1):
            if ("<", _shape(tuple(words[:n]))) in affixes or n == 1 and words[0].isdigit():
                words = words[n:]
                break
            if (">", _shape(tuple(words[-n:]))) in affixes or n == 1 and words[-1].isdigit():
                words = words[:-n]
                break
        else:
            break
    return words


def _readings(raw: str, affixes: Affixes = frozenset()) -> list[list[str]]:
    """What the value may say, likeliest first: all of it, without notes in brackets or after dashes, without affixes, written twice, each of its parts."""
    text, bare = _bare(raw)
    parts = [tokens(p) for p in re.split(r"[,;|=:]|\s/\s|\s--\s|/", bare)]
    core = tokens(bare)
    inner = _stripped(core, affixes)
    out = [tokens(text), core, inner]
    for words in (core, inner):
        half = len(words) // 2
        if half and words[:half] == words[half:]:
            out.append(words[:half])
    out += parts + [_stripped(p, affixes) for p in parts]
    seen: set[tuple[str, ...]] = set()
    return [w for w in out if w and not (tuple(w) in seen or seen.add(tuple(w)))]


def every_match(trie: Trie, raw: str, affixes: Affixes = frozenset()) -> list[tuple[float, int]]:
    """(distance a letter, id), nearest first: of the first reading that has any, all entries within their distance; an entry that a reading equals up to word order comes first."""
    readings = _readings(raw, affixes)
    equal = next((i for words in readings if (i := trie.sorted.get(tuple(sorted(words))))), 0)
    for words in readings:
        found: dict[int, float] = {equal: 0.0} if equal and trie.sorted.get(tuple(sorted(words))) == equal else {}
        if equal and not found:
            continue  # a reading that equals an entry decides
        if sum(map(len, words)) <= trie.longest:
            orders = itertools.permutations(words) if 1 < len(words) <= 4 else [words]
            hope: dict[str, bool] = {}  # by letters: all orders of the same words share it
            for order in dict.fromkeys(["".join(words), *("".join(o) for o in orders)]):
                forms = [order]
                if any(c.isdigit() for c in order) and sum(c.isdigit() for c in order) * 3 <= len(order):
                    forms.append(order.translate(_DIGITS))
                letters = "".join(sorted(order))
                if letters not in hope:
                    hope[letters] = any(trie.may_match(f) for f in forms)
                if not hope[letters]:
                    continue
                exact = False
                for form in forms:
                    if len(words) > 4:
                        form = [w if form == order else w.translate(_DIGITS) for w in words]
                    for d, ratio, i in trie.within(form) if len(words) <= 4 else trie.within_orders(form):
                        exact |= d == 0
                        found[i] = min(ratio, found.get(i, 9.0))
                if exact:
                    break
        if not found:
            word = "".join(words)
            if len(word) > 4 and len(ids := trie.completions(word)) == 1:
                found[ids.pop()] = 0.5
        if found:
            return sorted((ratio, i) for i, ratio in found.items())
    return []


def match(trie: Trie, raw: str, affixes: Affixes = frozenset()) -> tuple[int, float]:
    """(id, distance a letter) of the closest of ``every_match``, or (0, 1.0). Where a reading equals an entry, no other need be looked for."""
    for words in _readings(raw, affixes):
        if i := trie.sorted.get(tuple(sorted(words))):
            return i, 0.0
    found = every_match(trie, raw, affixes)
    return (found[0][1], found[0][0]) if found else (0, 1.0)


def _key(words: list[str] | tuple[str, ...]) -> str:
    return " ".join(sorted(words))


def _parts(names: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The numbered entries (n, i, s) in stretches of TRIE_ENTRIES."""
    for part in range(-(-names.count() // TRIE_ENTRIES)):
        yield [(r["i"], r["s"]) for r in names.where((F.col("n") >= part * TRIE_ENTRIES) & (F.col("n") < (part + 1) * TRIE_ENTRIES)).collect()]


def learn_affixes(distinct: DataFrame, names: DataFrame) -> Affixes:
    """Affixes of the values, by what they leave. ``distinct``: value; ``names``: n, i, s, the numbered names and aliases.

    An affix that is seen with fewer than DIVERSE entries must have no word that is much like a word of an entry: it may be part of one.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for v in batch["value"]:
                words = tuple(tokens(_bare(v)[1]))
                for n in range(1, min(AFFIX_WORDS, len(words) - 1) + 1):
                    for m in range(min(AFFIX_WORDS, len(words) - n - 1) + 1):  # words that stand at the other end
                        rows += [("<", "\x01".join(_shape(words[:n])), _key(words[n : len(words) - m]), not m), (">", "\x01".join(_shape(words[-n:])), _key(words[m:-n]), not m)]
            yield pd.DataFrame(rows, columns=["side", "affix", "rest", "alone"])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"i": batch["i"], "rest": [_key(tokens(s)) for s in batch["s"]]})

    known = names.select("i", "s").mapInPandas(keys, "i long, rest string").where("rest <> ''").groupBy("rest").agg(F.min("i").alias("i"))
    seen = distinct.mapInPandas(ends, "side string, affix string, rest string, alone boolean").join(small(known), "rest", "left").groupBy("side", "affix").agg(F.count_if("alone").alias("n"), F.count("i").alias("hits"), F.count_distinct("i").alias("entries"))
    least = max(1.0, distinct.count() * SUPPORT)
    kept = materialize(seen.where((F.col("hits") >= least) & (F.col("hits") >= F.col("n") * LEAVES)))
    doubt = kept.where(F.col("entries") < DIVERSE).select("affix").distinct()
    near = None
    for entries in _parts(names):
        trie = Trie([(1, w) for w in sorted({w for _, s in entries for w in tokens(s)})])

        def close(batches: Iterator[pd.DataFrame], trie: Trie = trie) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[[any(trie.alike(w) for w in a.split("\x01")) for a in batch["affix"]]]

        part = doubt.mapInPandas(close, "affix string")
        near = part if near is None else near.union(part)
    if near is None:
        return frozenset()
    good = kept.join(near.distinct().withColumn("near", F.lit(1)), "affix", "left").where((F.col("entries") >= DIVERSE) | F.col("near").isNull())
    out = {(r["side"], tuple(r["affix"].split("\x01"))) for r in good.select("side", "affix").collect()}  # at most 2 * AFFIX_WORDS * (AFFIX_WORDS + 1) / SUPPORT
    # what stands inside a shorter one says nothing of its own
    return frozenset((side, words) for side, words in out if not any((side, words[:n] if side == "<" else words[-n:]) in out for n in range(1, len(words))))


def all_matches(values: DataFrame, value_col: str, reference: DataFrame, id_col: str, name_col: str, aliases_col: str, nearest: bool = False) -> DataFrame:
    """(value, entry_id, distance, rank): of each distinct value all entries within their distance, nearest first, ties by id; with ``nearest`` the first of them only.

    Null and blank values have no row, nor have values without an entry. Entries with a null id are dropped, null names and aliases are
    no paths. The reference is numbered once and cut into tries of TRIE_ENTRIES entries, each sent to the tasks in a pass of its own,
    so its size isn't bounded by what one task can hold.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(F.col(value_col).cast("string").alias("value")).where(F.length(F.trim("value")) > 0).distinct()
    distinct = materialize(distinct.repartition(parts))  # a value costs far more than its bytes tell
    names = reference.select(F.col(id_col).cast("long").alias("i"), F.explode(F.concat(F.array(F.col(name_col).cast("string")), F.coalesce(F.col(aliases_col).cast("array<string>"), F.array().cast("array<string>")))).alias("s")).where("i is not null and s is not null").distinct()
    names = materialize(numbered(names, ["i", "s"]))
    affixes = learn_affixes(distinct, names)
    found = None
    for entries in _parts(names):
        trie = Trie(entries)

        def run(batches: Iterator[pd.DataFrame], trie: Trie = trie) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if nearest:
                    best = [(v, *match(trie, v, affixes)) for v in batch["value"]]
                    rows = [b for b in best if b[1]]
                else:
                    rows = [(v, i, ratio) for v in batch["value"] for ratio, i in every_match(trie, v, affixes)]
                yield pd.DataFrame(rows, columns=["value", "entry_id", "distance"])

        hits = distinct.mapInPandas(run, "value string, entry_id long, distance double")
        found = hits if found is None else found.union(hits)
    if found is None:
        return distinct.limit(0).select("value", F.lit(0).cast("long").alias("entry_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    once = found.groupBy("value", "entry_id").agg(F.min("distance").alias("distance"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("value").orderBy("distance", "entry_id")))
    ranked = ranked.where("rank = 1") if nearest else ranked
    return ranked.select("value", "entry_id", F.round("distance", 6).alias("distance"), "rank")


def match_values(values: DataFrame, value_col: str, reference: DataFrame, id_col: str, name_col: str, aliases_col: str) -> DataFrame:
    """(value, entry_id, distance), one row per distinct value: the nearest of ``all_matches``, or 0 and distance 1.

    Null and blank values have no row; an empty reference leaves every value unmatched. Equally close entries are settled by the smaller id.
    """
    best = materialize(all_matches(values, value_col, reference, id_col, name_col, aliases_col, nearest=True))
    distinct = values.select(F.col(value_col).cast("string").alias("value")).where(F.length(F.trim("value")) > 0).distinct()
    return distinct.join(best, "value", "left").select("value", F.coalesce("entry_id", F.lit(0).cast("long")).alias("entry_id"), F.coalesce("distance", F.lit(1.0)).alias("distance"))
