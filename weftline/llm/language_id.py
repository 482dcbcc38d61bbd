"""Language identification with bit-sliced Bloom filters of character n-grams.

Fit: letter trigrams, padded with word borders, are counted per language over
all training rows. A language holds an n-gram if the n-gram makes up at least
``MIN_RATE`` of that language's n-grams and at least ``SHARE`` of the highest
rate that any language has for it. Rates of a language add up to 1, so it holds
at most 1 / ``MIN_RATE`` n-grams: the filter has a proven bound at any corpus
size, and its size is a parameter.

Filter: one slot is a bit mask with one bit per language; an n-gram sets its
languages' bits in ``HASHES`` slots. Looking it up is one AND over these slots
and returns all languages that contain the n-gram at once.

Decision: per document and language, the n-grams whose mask has the bit are
counted. A language's bit is wrongly set at the rate f = (share of slots with
the bit) ** HASHES, so the count h of n n-grams becomes (h - n f) / (1 - f).
The language with the largest corrected count wins, ties to the smaller name;
the score is that count divided by n.

Defined results: a null text, an empty text and a text without letters give
``und`` and score 0; so does every text if there is nothing to learn from.
Rows are treated one by one (repeated rows give repeated results); rows with
null ids are kept; further columns are ignored by the query; a very long text
is counted whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import fold, map_text, table
from weftline.llm.textarrays import blocks, code_points, letters, mix, sums

SLOT_BITS = 20
HASHES = 3
MIN_RATE = 2e-6
SHARE = 0.3
#: Languages in one 64-bit mask.
WIDTH = 62


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # slots x words
    false_rate: np.ndarray  # by language


def trigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all padded letter trigrams of the parts, and how many each part has.

    A trigram has a letter in its middle, so none of them spans two words.
    """
    flat, starts = code_points(parts)
    low = letters()[flat]
    centre = np.flatnonzero(low)
    before = np.where(centre > 0, low[centre - 1], 0).astype(np.uint64)  # the first of all has nothing before it
    code = (before << np.uint64(42)) | (low[centre].astype(np.uint64) << np.uint64(21)) | low[centre + 1].astype(np.uint64)
    counts = np.diff(np.searchsorted(centre, np.append(starts, len(flat))))
    return mix(code), counts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(pairs):
        keys = np.concatenate([k for k, _ in pairs])
        n = np.concatenate([c for _, c in pairs])
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, weights=n).astype(np.int64)

    def flush():
        for lang, pairs in held.items():
            keys, n = merged(pairs)
            for i in range(0, len(keys), 1 << 18):
                yield pd.DataFrame({"lang": lang, "gram": keys[i : i + (1 << 18)].view(np.int64), "n": n[i : i + (1 << 18)]})

    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            for _, parts in blocks(texts.tolist()):
                keys, n = np.unique(trigrams(parts)[0], return_counts=True)
                pairs = held.setdefault(lang, [])
                pairs.append((keys, n))
                size += len(keys)
                if len(pairs) >= 16:
                    size -= sum(len(k) for k, _ in pairs)
                    held[lang] = [merged(pairs)]
                    size += len(held[lang][0][0])
        if size > 4_000_000:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def fit_filters(rows: DataFrame) -> Filters:
    """Learn from (text, lang); rows with a null text or lang teach nothing."""
    rows = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInPandas(_count, "lang string, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # one row per n-gram with its counts by language; kept for the two passes below
    grams = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("ns")).persist()
    try:
        total = {r["lang"]: r["n"] for r in grams.select(F.explode("ns").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).collect() if r["n"]}
        languages = sorted(total)
        words = max(1, -(-len(languages) // WIDTH))
        masks = np.zeros((1 << SLOT_BITS, words), dtype=np.int64)
        if not languages:
            return Filters([], masks, np.zeros(0))
        known = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(total[lang]))])
        place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
        rated = grams.select(
            "gram",
            F.transform("ns", lambda x: F.struct(place[x["lang"]].alias("i"), (x["n"] / known[x["lang"]]).alias("rate"))).alias("rs"),
        ).withColumn("top", F.array_max(F.transform("rs", lambda r: r["rate"])))
        holding = rated.select(
            "gram", F.explode(F.filter("rs", lambda r: (r["rate"] >= MIN_RATE) & (r["rate"] >= SHARE * F.col("top")))).alias("r")
        ).select("gram", F.floor(F.col("r.i") / WIDTH).cast("int").alias("word"), (F.col("r.i") % WIDTH).alias("bit"))
        slots = (
            holding.groupBy("gram", "word")
            .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
            .select(F.explode(F.array(*[_slot(k) for k in range(HASHES)])).alias("slot"), "word", "mask")
            .groupBy("slot", "word")
            .agg(F.expr("bit_or(mask)").alias("mask"))
        )
        got = slots.toArrow()  # at most 2 ** SLOT_BITS rows a mask word
        masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy()
    finally:
        grams.unpersist()
    used = np.array([np.mean((masks[:, i // WIDTH] >> (i % WIDTH)) & 1) for i in range(len(languages))])
    return Filters(languages, masks, used**HASHES)


def _slot(k: int):
    """The k-th slot of a hashed n-gram: other bits of the same 64-bit hash."""
    return F.expr(f"cast(shiftrightunsigned(gram, {k * 21}) & {(1 << SLOT_BITS) - 1} as int)")


def _lookup(filters: Filters, grams: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << SLOT_BITS) - 1)
    out = filters.masks[(grams & low).astype(np.int64)]
    for k in range(1, HASHES):
        out = out & filters.masks[((grams >> np.uint64(21 * k)) & low).astype(np.int64)]
    return out


def decide(filters: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n_lang = len(filters.languages)
    hits = np.zeros((len(texts), max(1, n_lang)))
    total = np.zeros(len(texts))
    for rows, parts in blocks(texts):
        grams, counts = trigrams(parts)
        some = counts > 0
        if not some.any():
            continue
        rows, counts = rows[some], counts[some]
        starts = np.cumsum(counts) - counts
        np.add.at(total, rows, counts)
        found = _lookup(filters, grams)
        for i in range(n_lang):
            bits = ((found[:, i // WIDTH] >> (i % WIDTH)) & 1).astype(np.int32)
            np.add.at(hits[:, i], rows, sums(bits, starts))
    if not n_lang:
        return ["und"] * len(texts), np.zeros(len(texts))
    fixed = np.clip((hits - total[:, None] * filters.false_rate) / (1 - np.minimum(filters.false_rate, 0.999)), 0, None)
    best = fixed.argmax(axis=1)
    score = np.where(total > 0, fixed[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
    return [filters.languages[b] if n else "und" for b, n in zip(best, total)], np.clip(score, 0, 1)


def predict(spark: SparkSession, docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with lang_pred and score, from its column text alone."""
    shared = spark.sparkContext.broadcast(filters)  # of fixed size: 2 ** SLOT_BITS slots
    return map_text(docs, lambda: lambda texts: decide(shared.value, texts), "lang_pred string, score double")


def fit_on_documents(docs: DataFrame) -> Filters:
    """Fit on the documents whose fold (of 3) isn't 1."""
    return fit_filters(docs.where(fold("doc_id", 3) != 1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit_on_documents(docs)
    out = predict(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), filters)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
