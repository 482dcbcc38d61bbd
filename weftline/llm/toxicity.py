"""Toxicity scores from a learned weighted lexicon matched by Aho-Corasick.

Folding: code points are lower-cased, look-alike letters of other scripts
become Latin ones, digits and signs that stand for letters become these, and
everything else that isn't a letter becomes a blank. A word is a run of letters
and such substitutes with a letter in it. All substitutes between its first and
last letter count, and so do those before and after with two exceptions that keep
numbers numbers: digits alone after the last letter, if fewer than what stands
before them (``covid19`` is ``covid``, ``h3110`` is ``heiio``), and digits alone
before the first, unless fewer than what follows (``10km`` is ``km``, ``5hit`` is
``shit``).

Lexicon: whole words (`` word ``) and word beginnings of 3 to 10 letters
(`` wor``), since inflected forms share a stem. An entry's weight is the
smoothed log ratio of its rates in toxic and clean training texts; it needs
``MIN_SUPPORT`` toxic texts and a weight of at least ``MIN_WEIGHT``, and is
dropped if a shorter kept entry says the same. Every entry with this support is
kept; their number is bounded by the words of the training rows.

Exception phrases: a hit together with the word before it is an exception if
the pair occurs in at least ``MIN_SUPPORT`` clean training texts and at most a
tenth of its texts are toxic. Exceptions are matched by the same automaton and
cancel the hits inside them. Further phrases may be given.

Score: logistic in (weight of hits per word, log of their summed weight), both
0 without hits, fitted by Newton steps.

Training rows: labelled rows, at most ``SAMPLE`` of them by hash order of their
ids (a documented bound: the lexicon and a three-parameter curve do not need
more), equal texts once. Two thirds give the lexicon, the others the curve.

Defined results: a null or empty text, and one without letters, has no hits
and gets the score of a text without hits. Without labelled rows of both
classes every score is the share of toxic labels, or 0 without labels.
Repeated rows are scored alike; labels of one id that disagree count as toxic;
entries of equal weight are ordered by name; an empty table gives no rows;
further columns, whatever their names, pass through ``predict`` and are ignored
by the query; a very long text is folded and matched whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import fold, map_text, table
from weftline.llm.textarrays import blocks, letters

SAMPLE = 40_000
MIN_SUPPORT = 5
MIN_WEIGHT = 2.5
PREFIXES = range(3, 11)

# Look-alike letters of other scripts and the Latin letters they resemble.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ℓ": "l",
}
# Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_FOLDS: dict[str, np.ndarray] = {}


def _folds() -> tuple[np.ndarray, np.ndarray]:
    if not _FOLDS:
        plain = letters().copy()
        for a, b in HOMOGLYPHS.items():
            plain[ord(a)] = ord(b)
            plain[ord(a.upper()[0])] = ord(b)
        for i in range(26):  # full-width letters
            plain[0xFF21 + i] = plain[0xFF41 + i] = 97 + i
        inner = np.zeros(0x110000, dtype=np.uint32)
        for a, b in SUBSTITUTES.items():
            inner[ord(a)] = ord(b)
        _FOLDS["plain"], _FOLDS["inner"] = plain, inner
    return _FOLDS["plain"], _FOLDS["inner"]


def fold_texts(parts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The folded parts as one string, each between blanks; the starts of the parts; their numbers of words."""
    flat = np.frombuffer((" " + " \0".join(parts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain, inner = _folds()
    low = plain[flat]
    stand = inner[flat]
    letter = low != 0
    member = letter | (stand != 0)
    edge = np.diff(member.astype(np.int8), prepend=0, append=0)
    start, end, at = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), np.flatnonzero(letter)
    count = np.searchsorted(at, end) - np.searchsorted(at, start)
    start, end = start[count > 0], end[count > 0]  # the rest are numbers and signs
    first, last = at[np.searchsorted(at, start)], at[np.searchsorted(at, end) - 1] + 1
    digits = np.append(0, np.cumsum((flat >= 48) & (flat <= 57)))
    number = (digits[first] - digits[start] == first - start) & (first - start >= end - first)
    tail = (digits[end] - digits[last] == end - last) & (end - last < last - start)
    inside = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(inside, np.where(number, first, start), 1)
    np.add.at(inside, np.where(tail, last, end), -1)
    low = np.where((np.cumsum(inside[:-1]) > 0) & ~letter, stand, low)
    letter = low != 0
    low = np.where(letter, low, 32)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 2
    starts = np.cumsum(lengths) - lengths
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    words = np.add.reduceat(begins.astype(np.int64), starts) if len(parts) else np.zeros(0, dtype=np.int64)
    return low.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), starts, words


@dataclass
class Lexicon:
    weights: dict[str, float]  # " word " or " wor"
    exceptions: list[str] = field(default_factory=list)  # "before word"
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (term, w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (f" {phrase} ", None))
        a.make_automaton()
        return a


def hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the heaviest entry at each word that none of the exceptions covers."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    covered: list[tuple[int, int]] = []
    for end, (term, w) in automaton.iter(text):
        start = end - len(term) + 1
        if w is None:
            covered.append((start, end))
        elif start not in best or w > best[start][1]:
            best[start] = (end, w)
    out = [(s, e, w) for s, (e, w) in best.items()]
    if covered:
        firsts = {s for a, b in covered for s in range(a, b)}
        out = [x for x in out if x[0] not in firsts]
    return out


def features(automaton: ahocorasick.Automaton, texts: list[str | None]) -> np.ndarray:
    """Weight of hits and words of each text."""
    out = np.zeros((len(texts), 2))
    for rows, parts in blocks(texts):
        text, starts, words = fold_texts(parts)
        np.add.at(out[:, 1], rows, words)
        found = hits(automaton, text)
        if found:
            at = np.searchsorted(starts, [s for s, _, _ in found], side="right") - 1
            np.add.at(out[:, 0], rows[at], [w for _, _, w in found])
    return out


def _shape(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), 100 * x[:, 0] / np.maximum(x[:, 1], 1), np.log1p(x[:, 0])])


def score(curve: tuple[float, float, float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_shape(x) @ np.asarray(curve), -40, 40)))


def _words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, toxic and clean texts that have it), summed over a partition's part."""
    tox: Counter = Counter()
    clean: Counter = Counter()

    def flush():
        words = list(tox.keys() | clean.keys())
        for i in range(0, len(words), 100_000):
            some = words[i : i + 100_000]
            yield pd.DataFrame({"word": some, "tox": [tox[w] for w in some], "clean": [clean[w] for w in some]})

    for pdf in batches:
        for text, toxic in zip(pdf["text"].tolist(), pdf["toxic"].tolist()):
            words: set[str] = set()
            for _, parts in blocks([text]):
                words.update(fold_texts(parts)[0].split())
            (tox if toxic else clean).update(words)
        if len(tox) + len(clean) > 400_000:
            yield from flush()
            tox, clean = Counter(), Counter()
    yield from flush()


def _prune(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """The entries that say something of their own.

    A word beginning goes if one longer entry has nine tenths of its texts: the
    longer one is as good a witness and strikes fewer innocent words. Then an
    entry goes if a shorter kept one covers it at about the same weight.
    """
    support = {term: n for term, n, _ in rows}
    beginnings: dict[str, int] = {}
    for term, n in support.items():
        stem = term.strip()
        whole = term.endswith(" ")
        for k in range(1, len(stem) + whole):
            beginnings[" " + stem[:k]] = max(beginnings.get(" " + stem[:k], 0), n)
    rows = [r for r in rows if r[0].endswith(" ") or beginnings.get(r[0], 0) < 0.9 * r[1]]
    kept: dict[str, float] = {}
    for term, _, w in sorted(rows, key=lambda r: (len(r[0].strip()), r[0])):
        stem = term.strip()
        if not any(kept.get(" " + stem[:k], -9) >= w - 0.7 for k in range(1, len(stem) + 1)):
            kept[term] = w
    return kept


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic and part (0, 1, 2) of the training rows: bounded by ``sample`` ids."""
    ids = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample).drop("order")
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")  # bounded by `sample`
    return rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(3)).alias("part"))


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    rows = labelled(docs, labels)
    once = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.first("part").alias("part")
    ).drop("h").persist()
    try:
        sizes = {(r["part"] == 0, r["toxic"]): r["n"] for r in once.groupBy((F.col("part") == 0).alias("part"), "toxic").agg(F.count("*").alias("n")).collect()}
        n_tox, n_clean = (sum(n for (_, t), n in sizes.items() if t == k) for k in (1, 0))
        if not n_tox or not n_clean:
            return Lexicon({}, [], (30.0 if n_tox else -30.0, 0.0, 0.0))
        t, c = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
        words = once.where("part <> 0").select("text", "toxic").mapInPandas(_words_of, "word string, tox long, clean long")
        words = words.groupBy("word").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
        terms = words.select(
            F.explode(
                F.concat(
                    F.array(F.concat(F.lit(" "), "word", F.lit(" "))),
                    F.transform(
                        F.filter(F.array(*[F.lit(k) for k in PREFIXES]), lambda k: k <= F.length("word")),
                        lambda k: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), k)),
                    ),
                )
            ).alias("term"),
            "tox",
            "clean",
        ).groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
        weight = F.log((F.col("tox") + 0.5) / (t + 1.0)) - F.log((F.col("clean") + 0.5) / (c + 1.0))
        top = terms.where(F.col("tox") >= MIN_SUPPORT).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
        lexicon = Lexicon(_prune([(r["term"], r["tox"], r["weight"]) for r in top.collect()]))  # by support at most a fifth of the sample's words
        lexicon.exceptions = sorted({*exceptions, *_exceptions(once, lexicon)})
        lexicon.curve = _curve(once.where("part = 0"), lexicon)
        return lexicon
    finally:
        once.unpersist()


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs (word right before, hit) that clean texts have and toxic texts hardly do."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            out: Counter = Counter()
            for text, toxic in zip(pdf["text"].tolist(), pdf["toxic"].tolist()):
                seen = set()
                for _, parts in blocks([text]):
                    folded = fold_texts(parts)[0]
                    for start, _, _ in hits(automaton, folded):
                        if start and folded[start - 1] != " ":
                            before = folded[folded.rfind(" ", 0, start) + 1 : start]
                            seen.add(f"{before} {folded[start + 1 : folded.index(' ', start + 1)]}")
                out.update((x, toxic) for x in seen)
            yield pd.DataFrame([(p, int(t == 1) * n, int(t == 0) * n) for (p, t), n in out.items()], columns=["phrase", "tox", "clean"])

    found = rows.select("text", "toxic").mapInPandas(pairs, "phrase string, tox long, clean long").groupBy("phrase").agg(
        F.sum("tox").alias("tox"), F.sum("clean").alias("clean")
    )
    top = found.where((F.col("clean") >= MIN_SUPPORT) & (F.col("tox") * 9 <= F.col("clean")))
    return [r["phrase"] for r in top.collect()]  # by support bounded by the sample


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Penalised logistic regression on the features of at most ``SAMPLE`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            x = features(automaton, pdf["text"].tolist())
            yield pd.DataFrame({"w": x[:, 0], "n": x[:, 1], "toxic": pdf["toxic"]})

    got = rows.select("text", "toxic").mapInPandas(run, "w double, n double, toxic int").toPandas()  # three numbers a row, at most SAMPLE rows
    if not len(got):
        return (-3.0, 1.0, 1.0)
    x, y = _shape(got[["w", "n"]].to_numpy()), got["toxic"].to_numpy(dtype=float)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    xs = x / scale
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(xs @ beta, -35, 35)))
        step = np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + ridge, xs.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    beta = beta / scale
    return tuple(float(v) for v in beta)


def predict(spark: SparkSession, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with score, from its column text alone."""
    shared = spark.sparkContext.broadcast(lexicon)  # entries and exceptions bounded by the sample

    def make():
        automaton = shared.value.automaton()
        return lambda texts: [score(shared.value.curve, features(automaton, texts))]

    return map_text(docs, make, "score double")


def fit_on_documents(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Fit on the labelled rows whose fold (of 5) isn't 0."""
    return fit(docs, labels.where(fold("doc_id", 5) != 0))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lexicon = fit_on_documents(docs, table(spark, sf_dir, "labels"))
    out = predict(spark, docs, lexicon)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
