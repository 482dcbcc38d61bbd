"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

What is packed is a histogram: pieces of one length are interchangeable, and
there are at most ``CAPACITY`` lengths however many documents there are. The
histogram is counted by Spark, the plan is made for it on the driver (bins of
one pattern together, with their number), and every piece then finds its place
from its rank among the pieces of its length. No piece list ever meets in one
place.

Reduction: for a piece of length L with room r = C - L left beside it, a set of
partners is fixed for good if it dominates every other set that could share its
sequence: a piece of length exactly r; nothing, if nothing fits; the longest
piece that fits, if no two others fit together, or if it is at least as long as
any two that fit together and no three fit. In each case the others could be
moved to where the fixed partner came from. What remains is packed best fit
decreasing: into the fullest sequence with room.

Ranks are counted in salted groups of (length, salt), so a length that a third
of all pieces have is ranked by many tasks; the groups' offsets come from their
counts.

Defined results: a null text is empty and gives one piece with the single id 0;
a document of more than ``CAPACITY`` ids, however long, is cut into full pieces
and one last piece; repeated rows are packed separately, and so are pieces of one
length, in the order of their numbers; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, table
from weftline.llm.word_ids import WordIds

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: ``row`` numbers all pieces: the task above, its pieces below.
NUMBERED = f"{PIECES}, row long"
#: Pieces ranked by one task of a length.
GROUP = 50_000


@dataclass
class Plan:
    """Per length: from which rank on, in which sequences, how many a sequence, at which offset."""

    lengths: list[int] = field(default_factory=list)
    first_rank: list[int] = field(default_factory=list)
    first_sequence: list[int] = field(default_factory=list)
    per_sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0  # sequences that the reduction fixed


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns fixed by dominance, with their numbers, and the counts that remain."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, c in counts.items():
        n[length] += c
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...], k: int) -> None:
        fixed.append((pattern, k))
        for length in pattern:
            n[length] -= k

    def least(without: int, k: int) -> list[int]:
        """The k shortest pieces left beside one of length ``without``."""
        out: list[int] = []
        for length in np.flatnonzero(n):
            have = int(n[length]) - (length == without)
            out += [int(length)] * min(have, k - len(out))
            if len(out) == k:
                break
        return out

    def longest(limit: int, without: int) -> int:
        for length in np.flatnonzero(n[: limit + 1])[::-1]:
            if n[length] - (length == without) > 0:
                return int(length)
        return 0

    def best_pair(limit: int, without: int) -> int:
        left = n.copy()
        left[without] -= 1
        have = np.flatnonzero(left[: limit + 1] > 0)
        best, j = 0, len(have) - 1
        for i, a in enumerate(have):
            while j >= 0 and a + have[j] > limit:
                j -= 1
            if j < i:
                break
            if j > i or left[a] > 1:
                best = max(best, int(a + have[j]))
        return best

    changed = True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while n[length] > 0:
                room = capacity - length
                if room == 0:
                    k, pattern = int(n[length]), (length,)
                elif n[room] - (room == length) > 0:
                    k = int(n[length]) // 2 if room == length else int(min(n[length], n[room]))
                    pattern = (length, room)
                else:
                    short = least(length, 3)
                    if not short or short[0] > room:
                        k = int(n[length]) if 2 * length > capacity else 1
                        pattern = (length,)
                    else:
                        partner = longest(room, length)
                        if len(short) < 2 or short[0] + short[1] > room:
                            k, pattern = (int(min(n[length], n[partner])) if partner != length else int(n[length]) // 2), (length, partner)
                        elif (len(short) < 3 or sum(short) > room) and partner >= best_pair(room, length):
                            # taking such pairs away only shrinks what could share the sequence, so it holds until one of the two runs out
                            k, pattern = (int(min(n[length], n[partner])) if partner != length else int(n[length]) // 2), (length, partner)
                        else:
                            break
                fix(pattern, k)
                changed = True
    return fixed, {int(x): int(n[x]) for x in np.flatnonzero(n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: patterns and their numbers."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(room: int, pattern: tuple[int, ...], k: int) -> None:
        by_room.setdefault(room, []).append((pattern, k))
        rooms[room] = True

    for length in sorted(counts, reverse=True):
        c = counts[length]
        while c:
            at = np.flatnonzero(rooms[length:])
            if not len(at):
                each = capacity // length
                full, rest = divmod(c, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = length + int(at[0])
            pattern, k = by_room[room].pop()
            if not by_room[room]:
                rooms[room] = False
            each = room // length
            full = min(k, c // each)
            if full:
                put(room - each * length, pattern + (length,) * each, full)
                c -= full * each
            if k > full and 0 < c < each:
                put(room - c * length, pattern + (length,) * c, 1)
                full, c = full + 1, 0
            if k > full:
                put(room, pattern, k - full)
    return [x for groups in by_room.values() for x in groups]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, rest = reduce_counts(counts, capacity)
    plan = Plan(fixed=sum(k for _, k in fixed))
    used: dict[int, int] = {}
    for pattern, k in [*fixed, *best_fit(rest, capacity)]:
        offset, i = 0, 0
        while i < len(pattern):
            j = i
            while j < len(pattern) and pattern[j] == pattern[i]:
                j += 1
            length, each = pattern[i], j - i
            plan.lengths.append(length)
            plan.first_rank.append(used.get(length, 0))
            plan.first_sequence.append(plan.sequences)
            plan.per_sequence.append(each)
            plan.offset.append(offset)
            used[length] = used.get(length, 0) + each * k
            offset += each * length
            i = j
        plan.sequences += k
    return plan


def place(plan: Plan, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    of, first = np.asarray(plan.lengths, dtype=np.int64), np.asarray(plan.first_rank, dtype=np.int64)
    order = np.lexsort((first, of))
    of, first = of[order], first[order]
    shift = np.int64(1) << np.int64(45)
    at = np.searchsorted(of * shift + first, lengths * shift + ranks, side="right") - 1
    at, nth = order[at], ranks - first[at]
    each = np.asarray(plan.per_sequence, dtype=np.int64)[at]
    return np.asarray(plan.first_sequence, dtype=np.int64)[at] + nth // each, np.asarray(plan.offset, dtype=np.int64)[at] + (nth % each) * lengths


_WORDS: dict[int, WordIds] = {}


def cut_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> the numbered pieces of every document."""
    with open(tokenizer_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(data.value)
        if key not in _WORDS:
            _WORDS[key] = WordIds(data.value)
        words, step = _WORDS[key], 4 * capacity
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = words.ids(text or "") + bytes(4)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, type=t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), *[pa.int64()] * 3))]
            columns.append(pa.array(np.arange(number, number + len(row))))
            number += len(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, type=pa.int64())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, NUMBERED)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Numbered pieces with sequence_id and offset. ``pieces`` is read three times: pass a written table."""
    total = pieces.count()
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(max(8, -(-total // GROUP)))).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(plan_packing(counts, capacity))  # a few entries a length
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    ranked = salted.withColumn("nth", rank - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = place(plan.value, b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(spark, materialize(spark, cut_documents(spark, docs, tokenizer_path), "pieces"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
