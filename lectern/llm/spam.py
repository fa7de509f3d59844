"""Keyword-stuffed and link-list pages, by a robust Mahalanobis distance.

A text is cut into stretches of some sixty words. Each has densities of links, of tags and
product marks and of disguised words, a lack of function words, and the excess repetition
and low entropy of its content words. Per language the centre is the median of its stretches
and the scale of a feature comes from the deviations in the spam-directed half: their CLEAN
quantile as that of a normal distribution, and beside it the size of a single occurrence (a low
quantile of the deviations that aren't zero), which is all there is where most stretches have
none of a feature. The correlation is that of the CLEAN share of stretches with the least
distance, taken anew after each of some concentration steps. A scale is pooled, by
numbers of stretches, with that of all languages, and that one with PRIOR.
A stretch is an outlier if its distance, taken over the deviations in the spam-directed
half (more links, tags, disguise and repetition, less function words and entropy), is
beyond ``cutoff``; a page is spam if outliers make up more than half of its text.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.relational import top
from lectern.runtime import materialize, small, spread

#: Common function words. Words that two languages share in other roles are left out where they would mislead.
FUNCTION_WORDS = {
    "en": "a about after against all am among an and any are as at be because been before behold being beside between beyond both but by can could did do does during each either every few for from had has have he her hers him his how i if in into is it its let like may me might more most must my near neither no nor not now of off on once only or other our out over own said same shall she should so some such than that the their them then there these they this those though through to together told toward under until unto up upon us was we were what when where which while who whoever whom whose why will with within without would yet you your".split(),
    "es": "a al algo ante aquel aquella aquellas aquellos antes asi así aun aunque bajo cada como con contra cual cuando de del desde donde durante e el él ella ellas ellos en entre era eran es esa ese eso esta estaba este esto estos fue ha hasta hay junto la las le les lo los mas más me mi mientras muy nada ni no nos nuestro o otra otro para pero por porque que quien quienes se según ser si sí sin sobre son su sus también tan te ti toda todo todos tras tu tus u un una uno unos y ya yo".split(),
    "pt": "a ao aos aquela aquelas aquele aqueles aquilo as assim até cada com como contra da das de dela dele deles depois desde do dos durante e é ela elas ele eles em entre era eram essa esse esta está este eu foi há isso isto junto lhe mais mas me mesmo meu minha muito na nas não naquele naqueles nem no nos nós o onde os ou para pela pelas pelo pelos por porque quando que quem se sem ser seu seus si sob sobre sua suas também te tem todo todos tu um uma umas uns".split(),
    "de": "ab aber alle allen als also am an auch auf aus bei beim bin bis da damit dann das dass dem den denn der des die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen einer eines er es euch für gegen hat hatte hier ich ihm ihn ihnen ihr ihre ihrem ihren im in ist ja jede jedem jeden jeder jene jenem jenen jener kein keine keinen kann man mein mich mir mit nach nicht noch nun nur ob oder ohne sehr sein seine seinem seinen seiner sich sie sind so sondern über um und uns unter vom von vor war waren was weil wenn wer wie wir wird wo zu zum zur zwischen".split(),
}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
WORDS = 60
#: At least so large a share of a language's stretches is taken to be no spam; scale and correlation come from it.
CLEAN = 0.95
#: The quantile of the deviations above zero that stands for a single occurrence.
ONCE = 0.05
#: Scales before any text was seen, and the number of stretches that they, and then those of all languages, weigh as much as.
PRIOR = {"links": 0.08, "tags": 0.05, "odd": 0.05, "bare": 0.055, "repeated": 0.1, "flat": 0.12}
PRIOR_STRETCHES = 10_000
#: The same for the centre of a language, drawn to that of all.
CENTRE_STRETCHES = 100
STEPS = 2
#: Function words learned for a language without a list: the most widespread of the words in a tenth of its documents or more.
LEARNED, WIDESPREAD = 120, 0.1

_LINK = re.compile(r"<a\b[^>]*>.*?</a>|\[url=[^\]]*\].*?\[/url\]|\[[^\[\]\n]*\]\([^()\n]*\)|https?://\S+|www\.\S+|\b[\w-]+(?:\.[\w-]+)+/\S*|(?-i:(?<![\w@.])[a-z0-9-]{2,}(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?!\w)\S*)", re.I | re.S)
_TAG = re.compile(r"#\w[\w-]*|\bSKU[-\s]?\w+|(?:(?:from|ab|desde)\s)?(?:\$|€|£|EUR|USD|R\$)\s?\d+(?:[.,]\d+)?|\(\d+\)", re.I)
_ODD = re.compile(r"\b(?:\w-){3,}\w\b|\b\w*[^\W\d_][@0134$][^\W\d_]\w*\b|\b\w*[@$][^\W\d_]\w*|\b\w+_\w+(?:\+[\w ]+)?|\b[^\W\d_][@013][^\W\d_]?\w*\b|[»›](?![^»›\n]*«)[^»›\n]*")
_REFERENCE = re.compile(r"\b\d+:\d+(?:-\d+)?\b")
_MARKUP = re.compile(r"<(?!/?a\b)[^<>]+>", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Private characters that stand for what was found.
LINK, TAG, ODD, REFERENCE = "\ue000", "\ue001", "\ue002", "\ue003"
_DOMAIN = re.compile(r"[a-z0-9-]\.[a-z]{2}")
_LEET, _SPELT = re.compile(r"(?<=[^\W\d_])[0134]"), re.compile(r"-\w-")


def _has(text: str, *parts: str) -> bool:
    return any(p in text for p in parts)


#: What is marked, a cheap test (on lower case) without which there is none of it, and the pattern.
_MARKS = (
    (LINK, lambda t: _has(t, "://", "www.", "<a", "[url", "](", "/") or _DOMAIN.search(t), _LINK),
    (TAG, lambda t: _has(t, "#", "$", "€", "£", "(", "sku", "eur", "usd"), _TAG),
    (ODD, lambda t: _has(t, "@", "$", "_", "»", "›") or _LEET.search(t) or "-" in t and _SPELT.search(t), _ODD),
    (REFERENCE, lambda t: ":" in t, _REFERENCE),
)
FEATURES = ("links", "tags", "odd", "bare", "repeated", "flat")
MARKS = FEATURES[:3]


Lists = dict[str, frozenset[str]]


def language(lang: str | None, words: list[str], lists: Lists = _SETS) -> str:
    """``lang`` if its function words are known, else the language whose function words are most frequent, the first of equals."""
    if lang in lists:
        return lang
    n = Counter(words)
    return max(lists, key=lambda k: sum(c for w, c in n.items() if w in lists[k]))


def stretches(text: str, lang: str | None, lists: Lists = _SETS) -> tuple[str, list[tuple[int, list[float]]]]:
    """The language, and (characters, features) of each stretch of about WORDS words."""
    marked = html.unescape(html.unescape(text)) if "&" in text else text
    if "<" in marked:
        marked = _MARKUP.sub(" ", marked)
    # links, tags and disguised words are marked by one private character each and counted by their length
    sizes: list[int] = []

    def mark(sign: str):
        def replace(m: re.Match) -> str:
            sizes.append(len(m[0]))
            return f" {sign} "

        return replace

    order: dict[str, Iterator[int]] = {}
    low = marked.casefold()
    for sign, hint, pattern in _MARKS:
        if hint(low):
            sizes = []
            marked = pattern.sub(mark(sign), marked)
            order[sign] = iter(sizes)
    pieces = (marked.casefold() if order else low).split()
    if lang not in lists:
        lang = language(lang, _WORD.findall(" ".join(pieces)), lists)
    known, out = lists[lang], []
    cut = max(1, round(len(pieces) / WORDS))
    step = math.ceil(len(pieces) / cut) if pieces else 1
    for at in range(0, len(pieces), step):
        part = pieces[at : at + step]
        joined = " ".join(part)
        total, chars = len(joined), dict.fromkeys((LINK, TAG, ODD, REFERENCE), 0)
        n_ref = 0
        for sign in order:
            n = joined.count(sign)
            if n:
                chars[sign] = sum(itertools.islice(order[sign], n))
                total += chars[sign] - n
                n_ref += n * (sign == REFERENCE)
        content = Counter(_WORD.findall(joined))
        words = content.total() + part.count("&")
        for w in content.keys() & known:
            del content[w]
        counts = sorted(content.values(), reverse=True)
        n = sum(counts)
        function = words - n
        often = sum(c for c in counts[1:] if c > 2) + (counts[0] if counts and counts[0] * 2 > n > 3 else 0)
        entropy = -sum(c / n * math.log(c / n) for c in counts) / math.log(n) if n > 1 else 1.0
        prose = min(1.0, (function + 4 * n_ref) / words) if words else 0.0
        # few words say little about their language: draw a short stretch toward the usual share
        prose = (prose * words + 0.36 * 6) / (words + 6) if words else 0.36
        out.append((total, [chars[LINK] / total, chars[TAG] / total, chars[ODD] / total, -prose, often / max(n, 12), -entropy]))
    return lang, out


def _measure(lists: Lists):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True):
                lang, parts = stretches(text, lang, lists)
                rows += [(i, lang, chars, *f) for chars, f in parts]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "chars", *FEATURES])

    return run


def _learned(kept: DataFrame) -> Lists:
    """The function words of the languages in ``kept`` that have no list. Only their texts are read, and only where there are any."""
    unlisted = F.col("lang").isNotNull() & ~F.col("lang").isin(list(_SETS))
    codes = [r["lang"] for r in kept.select("lang").where(unlisted).groupBy("lang").count().where("count > 1").collect()]  # two or three letters, so there are 18,278 of them at most
    if not codes:
        return {}
    mine = kept.where(F.col("lang").isin(codes))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    total = mine.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    often = mine.select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).join(small(total), "lang").where((F.col("n") > 1) & (F.col("n") >= F.col("texts") * WIDESPREAD))
    out: dict[str, set[str]] = {c: set() for c in codes}
    for r in top(often, ["lang"], [F.desc("n"), F.asc("w")], LEARNED).select("lang", "w").collect():  # LEARNED words a language
        out[r["lang"]].add(r["w"])
    return {c: frozenset(w) for c, w in out.items() if w}


def _correlation(core: DataFrame) -> dict[str, np.ndarray]:
    """Per language the correlation of the clipped standard deviations, drawn to independence as PRIOR_STRETCHES asks."""
    clip = lambda f: F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col(f)))
    size = len(FEATURES)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    out = {}
    for r in core.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.avg(clip(FEATURES[i]) * clip(FEATURES[j])).alias(f"c{i}_{j}") for i, j in pairs)).collect():  # one row per language
        m, weight = np.eye(size), r["n"] / (r["n"] + PRIOR_STRETCHES)
        for i, j in pairs:
            size_ = math.sqrt(r[f"c{i}_{i}"] * r[f"c{j}_{j}"])
            if i != j and size_ > 0:
                m[i, j] = m[j, i] = weight * r[f"c{i}_{j}"] / size_
        out[r["lang"]] = m
    return out


def _with_distance(z: DataFrame, correlation: dict[str, np.ndarray]) -> DataFrame:
    """``z`` with d, its distance over the deviations in the spam-directed half; a language without a correlation has independent features."""
    size = len(FEATURES)
    toward = [F.greatest(F.lit(0.0), F.col(f)) for f in FEATURES]
    if not correlation:
        return z.withColumn("d", F.sqrt(sum((t * t for t in toward), F.lit(0.0))))
    cols = [f"i{j}" for j in range(size**2)]
    rows = [(lang, *np.linalg.inv(m).ravel().tolist()) for lang, m in correlation.items()]
    inverse = z.sparkSession.createDataFrame(rows, "lang string, " + ", ".join(f"{c} double" for c in cols))
    d2 = sum((toward[i] * toward[j] * F.col(cols[i * size + j]) for i in range(size) for j in range(size)), F.lit(0.0))
    return z.join(small(inverse), "lang").withColumn("d", F.sqrt(F.greatest(d2, F.lit(0.0)))).drop(*cols)


def _frame(parts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and scale of the features, per language."""
    groups = parts.withColumn("lang", F.explode(F.array("lang", F.lit("*"))))
    medians = {r["lang"]: (r["n"], np.array([r[f] for f in FEATURES])) for r in groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f, 0.5, 2000).alias(f) for f in FEATURES)).collect()}  # one row per language, and one
    if not medians:
        return {}
    centre = {lang: (n * m + CENTRE_STRETCHES * medians["*"][1]) / (n + CENTRE_STRETCHES) for lang, (n, m) in medians.items() if lang != "*"}
    table = parts.sparkSession.createDataFrame([(lang, *m.tolist()) for lang, m in centre.items()], "lang string, " + ", ".join(f"m_{f} double" for f in FEATURES))
    off = parts.join(small(table), "lang").select(F.explode(F.array("lang", F.lit("*"))).alias("lang"), *((F.col(f) - F.col(f"m_{f}")).alias(f) for f in FEATURES))
    over = lambda f: F.when(F.col(f) > 1e-9, F.col(f))
    widths = off.groupBy("lang").agg(*(F.percentile_approx(F.greatest(F.lit(0.0), F.col(f)), CLEAN, 2000).alias(f"q_{f}") for f in FEATURES), *(F.percentile_approx(over(f), ONCE, 2000).alias(f"u_{f}") for f in FEATURES)).collect()
    # a mark is a mark: the size of one occurrence is taken over all three kinds
    marks = off.select("lang", F.explode(F.array(*(over(f) for f in MARKS))).alias("x")).where("x is not null").groupBy("lang").agg(F.percentile_approx("x", ONCE, 2000).alias("u")).collect()
    once = {r["lang"]: r["u"] for r in marks}
    normal = NormalDist().inv_cdf(CLEAN)
    own = {r["lang"]: np.array([math.hypot(r[f"q_{f}"] / normal, (once.get(r["lang"]) if f in MARKS else r[f"u_{f}"]) or 0.0) for f in FEATURES]) for r in widths}

    def pooled(mine: np.ndarray, n: int, other: np.ndarray) -> np.ndarray:
        mine = np.where(mine > 0, mine, other)
        return np.exp((n * np.log(mine) + PRIOR_STRETCHES * np.log(other)) / (n + PRIOR_STRETCHES))

    every = pooled(own["*"], medians["*"][0], np.array([PRIOR[f] for f in FEATURES]))
    return {lang: (centre[lang], pooled(own[lang], medians[lang][0], every)) for lang in centre}


def spam_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cutoff: float = 4.5) -> DataFrame:
    """(doc_id, lang, n_stretches, spam_share, worst, is_spam), one row per document with a word or link.

    Rows with a null id or text are dropped, blank texts have no row. Languages are compared by their first two or three letters; one
    that has no list of function words gets one learned from its documents, a null or otherwise unknown one is
    taken to be the language whose function words are most frequent. Repeated rows of an id must be settled
    before. Scales hold while no more than 1 - CLEAN of a language's stretches are spam. A language with one stretch, or an
    empty table, is no error: its centre and scales are those of all languages, and at first the PRIOR ones.
    """
    spark = documents.sparkSession
    code = F.regexp_extract(F.lower(F.col(lang_col).cast("string")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    kept = documents.select(F.col(id_col).alias("doc_id"), F.nullif(code, F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and length(trim(text)) > 0")
    lists = _SETS | _learned(kept)
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, lang string, chars long, " + ", ".join(f"{f} double" for f in FEATURES)
    parts = materialize(spread(kept).mapInPandas(_measure(lists), schema))
    frame = _frame(parts)
    cols = [f"{k}_{f}" for k in "ms" for f in FEATURES]
    table = spark.createDataFrame([(lang, *m.tolist(), *s.tolist()) for lang, (m, s) in frame.items()], "lang string, " + ", ".join(f"{c} double" for c in cols))
    z = parts.join(small(table), "lang").select("doc_id", "lang", "chars", *(((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}")).alias(f) for f in FEATURES))
    correlation: dict[str, np.ndarray] = {}
    for _ in range(STEPS):
        near = _with_distance(z, correlation)
        edge = near.groupBy("lang").agg(F.percentile_approx("d", CLEAN, 2000).alias("edge"))
        correlation = _correlation(near.join(small(edge), "lang").where("d <= edge"))
    out = _with_distance(z, correlation).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.count(F.lit(1)).alias("n_stretches"), (F.sum(F.when(F.col("d") > cutoff, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("spam_share"), F.max("d").alias("worst"))
    return out.select("doc_id", "lang", "n_stretches", F.round("spam_share", 6).alias("spam_share"), F.round("worst", 4).alias("worst"), (F.col("spam_share") > 0.5).alias("is_spam"))
