"""Document fingerprints by consistent weighted sampling.

Terms of a text, alike at every length: its words (weight 1/2 per occurrence)
and its runs of three words, the first ones padded (weight 1 per occurrence).

Sample k draws for each term r and c from Gamma(2, 1) and b from (0, 1), the
same for the term in every text, and takes the term with the least

    ln a = ln c - r (t + 1 - b),   t = floor(ln w / r + b)

for its weight w. Two texts draw the same (term, t) with a probability equal to
their generalised Jaccard similarity, the sum of minima of the weights over the
sum of maxima. The variates come from seeded tables with a row for each value
of a few hash bits; r, c and b use different bits.

A fingerprint has ``SAMPLES`` samples, each kept as 16 bits of a hash of
(term, t), written in hex. Its likeness to another is the share of equal
samples. Texts without any word share one fingerprint, so equal texts always
have equal ones.

Next documents: rows are range-partitioned by descending id and sorted inside
their partition, so a row's next is the row after it. A partition gives its
first and its last row besides; these, two a partition, are joined to each
other by partition number. Nothing about single rows comes to the driver.

Defined results: a null text is empty; rows of one id (and all rows without
one, which come last) are ordered by a hash of their text, then by the text, so
even they may spread over partitions; repeated rows give repeated results; of
one document alone the next is itself; an empty table gives no rows; further
columns, whatever their names, are ignored; a very long text is fingerprinted
whole, in parts of a few thousand terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, table
from weftline.llm.textarrays import mix
from weftline.llm.wordhash import word_hashes

SAMPLES = 48
ROW_BITS = 12
_DRAWN: dict[str, np.ndarray] = {}


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _DRAWN:
        g = np.random.Generator(np.random.PCG64(20_240_613))
        shape = (1 << ROW_BITS, SAMPLES)
        _DRAWN["r"] = g.gamma(2.0, 1.0, shape).astype(np.float32)
        _DRAWN["c"] = np.log(g.gamma(2.0, 1.0, shape)).astype(np.float32)
        _DRAWN["b"] = g.random(shape, dtype=np.float32)
    return _DRAWN["r"], _DRAWN["c"], _DRAWN["b"]


def weighted_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, weight), sorted by text and term, each term once a text."""
    words, counts = word_hashes(texts)
    which = np.repeat(np.arange(len(texts)), counts)
    one = np.zeros(len(words), dtype=np.uint64)
    two = one.copy()
    if len(words) > 1:
        one[1:] = np.where(which[1:] == which[:-1], words[:-1], 0)
    if len(words) > 2:
        two[2:] = np.where(which[2:] == which[:-2], words[:-2], 0)
    runs = mix(words * np.uint64(3) + one * np.uint64(0x2545F4914F6CDD1D) + two * np.uint64(0x9E3779B97F4A7C15))
    # the text's number above the term's 46 bits; the lowest bit tells words (1) from runs (0)
    number = np.concatenate([which, which]).astype(np.uint64)
    term = np.concatenate([words | np.uint64(1), runs & ~np.uint64(1)]) & np.uint64((1 << 46) - 1)
    packed = np.sort((number << np.uint64(46)) | term)
    if not len(packed):
        return np.zeros(0, dtype=np.int64), packed, np.zeros(0, dtype=np.float32)
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    times = np.diff(np.append(first, len(packed))).astype(np.float32)
    packed = packed[first]
    term = packed & np.uint64((1 << 46) - 1)
    number = (packed >> np.uint64(46)).astype(np.int64)
    return number, term, times * np.where(term & np.uint64(1), np.float32(0.5), np.float32(1))


def _sample(texts: list[str], part: int = 4096) -> np.ndarray:
    number, term, weight = weighted_terms(texts)
    r, c, b = _draws()
    best = np.full((len(texts), SAMPLES), np.inf, dtype=np.float32)
    sign = np.full((len(texts), SAMPLES), 0xFFFF, dtype=np.uint16)
    low = np.uint64((1 << ROW_BITS) - 1)
    log_w = np.log(weight)
    hashed = mix(term)
    for at in range(0, len(term), part):
        h, n = hashed[at : at + part], number[at : at + part]
        rr = r[(h & low).astype(np.int64)]
        bb = b[((h >> np.uint64(ROW_BITS)) & low).astype(np.int64)]
        t = np.floor(log_w[at : at + part, None] / rr + bb)
        value = c[((h >> np.uint64(2 * ROW_BITS)) & low).astype(np.int64)] - rr * (t + np.float32(1) - bb)
        mark = ((h >> np.uint64(40)).astype(np.uint32)[:, None] + t.astype(np.int32).view(np.uint32) * np.uint32(40_503)).astype(np.uint16)
        starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        least = np.minimum.reduceat(value, starts, axis=0)
        lengths = np.diff(np.append(starts, len(n)))
        marks = np.minimum.reduceat(np.where(value == np.repeat(least, lengths, axis=0), mark, np.uint16(0xFFFF)), starts, axis=0)
        who = n[starts]
        old, old_mark = best[who], sign[who]
        sign[who] = np.where(least < old, marks, np.where(least == old, np.minimum(marks, old_mark), old_mark))
        best[who] = np.minimum(least, old)
    return sign


def fingerprints(texts: list[str], limit: int = 1 << 20) -> np.ndarray:
    """One row of ``SAMPLES`` 16-bit samples for each text."""
    out, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit or len(held) >= 10_000:
            out.append(_sample(held))
            held, size = [], 0
    if held or not out:
        out.append(_sample(held))
    return np.concatenate(out)


def written(sign: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sign.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A partition's first and last row also come with their text.
EDGES = f"{RESULT}, part int, edge string, text string"


def _compared(ids: list, own: list[str], following: list[str], a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """The columns of ``RESULT`` for texts with fingerprints ``a`` and the texts after them with ``b``."""
    changed = [edited(x, y) for x, y in zip(own, following)]
    new = fingerprints(changed)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(x) for x in own], pa.int64()),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], pa.string()),
        pa.array(written(a), pa.string()),
        pa.array(written(new), pa.string()),
        pa.array(likeness(a, new), pa.float64()),
        pa.array(likeness(a, b), pa.float64()),
    ]


NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted partition but the last, compared with its next; then the first and the last."""
    part = TaskContext.get().partitionId()
    first = last = sign = None

    def edge(row: tuple, name: str) -> pa.RecordBatch:
        columns = [pa.array([row[0]], pa.int64()), *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int32()), pa.array([name]), pa.array([row[1]], pa.string())], names=[*NAMES, "part", "edge", "text"])

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            b = batch.slice(at, 500)
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            signs = fingerprints(texts)
            if last is None:
                first = (ids[0], texts[0])
            else:
                ids, texts, signs = [last[0], *ids], [last[1], *texts], np.concatenate([sign[None], signs])
            last, sign = (ids[-1], texts[-1]), signs[-1]
            n = len(ids) - 1
            if n:
                done = _compared(ids[:-1], texts[:-1], texts[1:], signs[:-1], signs[1:])
                yield pa.RecordBatch.from_arrays([*done, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*NAMES, "part", "edge", "text"])
    if last is not None:
        yield edge(first, "first")
        yield edge(last, "last")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, own, following = (b.column(i).to_pylist() for i in range(3))
        yield pa.RecordBatch.from_arrays(_compared(ids, own, following, fingerprints(own)[: len(own)], fingerprints(following)[: len(own)]), names=NAMES)


def fingerprint_documents(spark: SparkSession, docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``RESULT`` for every row of (doc_id, text); ``ranges`` fixes the number of partitions."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    parted = docs.repartitionByRange(ranges, *key) if ranges else docs.repartitionByRange(*key)
    rows = materialize(spark, parted.sortWithinPartitions(*key, "text").mapInArrow(_chain, EDGES), "fingerprints")
    firsts = rows.where("edge = 'first'").select("part", F.col("text").alias("following"))  # one row a partition
    order = Window.orderBy("part")  # over one number a partition
    after = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order)).alias("after"))
    ends = rows.where("edge = 'last'").select("part", "doc_id", "text").join(after, "part").join(firsts.withColumnRenamed("part", "after"), "after")
    return rows.where("edge IS NULL").select(*NAMES).unionByName(ends.select("doc_id", "text", "following").mapInArrow(_pairs, RESULT))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark, table(spark, sf_dir, "documents"))
