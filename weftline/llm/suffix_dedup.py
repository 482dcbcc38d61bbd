"""Removal of repeated byte strings by suffix arrays, sorted in two stages.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller doc_id, or same document and earlier start) is removed. Overlaps count
and strings are judged on the input, not on what is left.

1. *Anchors.* A window of ``length`` bytes is known by the least hash among its
   k-mers, its key. Windows of equal bytes have equal keys, and neighbouring
   windows mostly share theirs, so a text falls into segments of windows of one
   key, one for about 40 bytes. Keys that occur once can't belong to a repeat.
2. *Segments* of the keys that are left are dealt out by key with the bytes that
   their windows span, equal ones merged and all of them packed before the shuffle.
3. *Suffix arrays.* A task joins its segments in blocks of whole keys and sorts
   the suffixes of a block in two stages: only suffixes smaller than their
   successors are sorted directly, by words of eight bytes; all others are
   induced by one scan over the buckets of first bytes. Adjacent common prefixes
   of at least ``length`` bytes then give the classes of equal windows, and each
   class's first window stays.
4. Windows of the segments of step 2 are repeats unless step 3 kept them, so only
   kept ranges go back to the documents.

Defined results: null text is empty; texts are UTF-8 bytes of any length, read
whole; a null doc_id counts as the least (as -2**63); rows of one doc_id are
ordered by a hash of id and text, and rows equal in both are one document, each
with that document's result; an empty table gives no rows; further columns are
ignored. Documents are known by 64-bit hashes of id and text.

Scale: heavy keys (more than about 1 in ``HEAVY`` of all segments) are found in
a first pass by tasks, at most ``2 * HEAVY`` a level in all, and are the only data
sent to all tasks. Their segments are dealt by document instead of by key in step
1; in step 2 they are cut anew with longer k-mers (``LEVELS``, the last being the
whole window) until a key is no longer heavy, so a line that stands in a third of
all documents among unlike text isn't one group. Windows of one text share a
segment at every level, and equal segments are merged. Blocks hold about
``BLOCK`` bytes. Text is shuffled once, compressed, into buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, materialize, table

LENGTH = 100
#: Lengths of k-mers as hundredths of a window: the first for all segments, the others for those of heavy keys.
LEVELS = (24, 60, 84, 94, 98, 100)
#: A key is heavy from about this part of all segments on.
HEAVY = 4096
#: Most windows in a segment.
STRETCH = 128
CHUNK, SLICE = 1 << 16, 1 << 20
#: Bytes of text that are cut into segments at a time, and that one suffix array covers.
PIECE = 2 << 20
BLOCK = 2 << 20
#: Segments of all texts to one part of the keys, at most about: what a task holds at a time, equal ones once.
PART = 1 << 19
LEAST_ID = -(2**63)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x *= _ODD
    x ^= x >> np.uint64(29)
    return x


def window_keys(text: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the least hash of its k-mers, and whether its last k-mer has it."""
    out = np.empty(max(len(text) - length + 1, 0), np.uint64)
    last = np.empty(len(out), bool)
    for a in range(0, len(out), CHUNK):
        h = _BYTES[text[a : a + CHUNK + length - 1]]
        size = 1
        while size < k:
            step = min(size, k - size)
            h = _mixed(h[:-step] * np.uint64(3) + h[step:])
            size += step
        ends = h[length - k :]
        size = 1
        while size < length - k + 1:
            step = min(size, length - k + 1 - size)
            h = np.minimum(h[:-step], h[step:])
            size += step
        out[a : a + CHUNK], last[a : a + CHUNK] = h, h == ends
    return out, last


def segments(texts: list[bytes], level: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one key: text number, first window, number of windows, key, whether windows may be equal.

    Works on about ``SLICE`` bytes at a time; in a longer text a run ends at every multiple of that.
    Two equal windows of one run hold its least k-mer in several places, the last
    of which comes in as the last k-mer of a window after the run's first.
    """
    found, held, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), SLICE):
            held.append((i, at, text if len(text) <= SLICE else text[at : at + SLICE + length - 1]))
            size += len(held[-1][2])
            if size >= SLICE:
                found.append(_segments(held, level, length))
                held, size = [], 0
    if held:
        found.append(_segments(held, level, length))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none, none, none.astype(bool))


def _segments(slices: list[tuple[int, int, bytes]], level: int, length: int):
    """``segments`` of (text number, offset, bytes)."""
    sizes = np.fromiter((len(x) for *_, x in slices), np.int64, len(slices))
    windows = sizes - length + 1
    part = np.repeat(np.arange(len(slices), dtype=np.int32), windows)
    place = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    keys, last = window_keys(np.frombuffer(b"".join(x for *_, x in slices), np.uint8), max(LEVELS[level] * length // 100, 1), length)
    at = place + np.repeat(np.cumsum(sizes) - sizes, windows)
    keys, last = keys[at], np.cumsum(last[at], dtype=np.int32)
    begins = np.ones(len(keys), bool)
    begins[1:] = (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])
    runs = np.flatnonzero(begins)
    widths = np.diff(np.append(runs, len(keys)))
    parts = -(-widths // STRETCH)
    inside = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
    first = np.repeat(runs, parts) + inside
    count = np.minimum(np.repeat(widths, parts) - inside, STRETCH)
    salted = _mixed(keys[first] ^ np.uint64(level + 1)).view(np.int64)
    owner, offset = (np.array([x[k] for x in slices], np.int64)[part[first]] for k in (0, 1))
    return owner, place[first] + offset, count, salted, last[first + count - 1] > last[first]


def _grams(text: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros following the text."""
    w = np.concatenate([text, np.zeros(beyond + 8, np.uint8)]).astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        w = (w[:-step] << np.uint64(bits)) | w[step:]
    return w


def suffix_order(text: np.ndarray, depth: int, grams: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes, in order up to ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    grams = _grams(text, depth + 8) if grams is None else grams
    # a suffix compares with its successor as its first byte with the next other byte
    differs = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.append(text[:-1] < text[1:], False)[at]

    # first stage: suffixes smaller than their successors, by eight bytes and then, where these tie, by five more at a time
    direct = np.flatnonzero(smaller)
    key = grams[direct]
    order = np.argsort(key)
    direct, key = direct[order], key[order]
    head = np.ones(len(direct), bool)
    head[1:] = key[1:] != key[:-1]
    tied = np.arange(len(direct))
    for reach in range(8, depth, 5):
        several = ~(head & np.append(head[1:], True))
        group, tied = np.cumsum(head)[several].astype(np.uint64), tied[several]
        if not len(tied):
            break
        key = (group << np.uint64(40)) | (grams[direct[tied] + reach] >> np.uint64(24))
        order = np.argsort(key)
        direct[tied], key = direct[tied[order]], key[order]
        head = np.ones(len(tied), bool)
        head[1:] = key[1:] != key[:-1]

    # second stage: all others follow from their successors, bucket by bucket
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found, level = [], np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(level):
            found.append(level)
            level = level[level > 0] - 1
            level = level[text[level] == c]
        bucket = np.concatenate([*found, direct[edges[c] : edges[c + 1]]])
        waiting[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(grams: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, at most ``cap``; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, cap, 8):
        odd = grams[order[live] + at] ^ grams[order[live - 1] + at]
        equal = sum((odd < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8)) + (odd == 0)
        shared[live] = at + equal
        live = live[equal == 8]
        if not len(live):
            break
    return np.minimum(shared, cap)


def first_windows(texts: list[bytes], counts: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows that are the first of their bytes: (text number, from, to).

    Text i has ``counts[i]`` windows, window j of which lies at ``place[i] + j``
    of the common order.
    """
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(text)) - begins[owner]
    grams = _grams(text, length + 16)
    order = suffix_order(text, length, grams)
    order = order[inside[order] < counts[owner[order]]]
    heads = np.flatnonzero(common_prefixes(grams, order, length) < length)
    at = place[owner[order]] + inside[order]
    first = np.minimum.reduceat(at, heads)
    kept = np.sort(order[at == np.repeat(first, np.diff(np.append(heads, len(order))))])
    begin = np.ones(len(kept), bool)
    begin[1:] = np.diff(kept) != 1
    runs = np.flatnonzero(begin)
    a, b = kept[runs], kept[np.append(runs[1:], len(kept)) - 1] + 1
    return owner[a], inside[a], inside[a] + (b - a)


def removed_spans(windows: list[tuple[int, int]], kept: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that are in ``windows`` but in no range of ``kept``."""
    spans: list[list[int]] = []
    kept, k = sorted(kept), 0

    def cover(a: int, b: int) -> None:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length - 1)
        else:
            spans.append([a, b + length - 1])

    for a, b in sorted(windows):
        while k < len(kept) and kept[k][1] <= a:
            k += 1
        j = k
        while a < b and j < len(kept) and kept[j][0] < b:
            if kept[j][0] > a:
                cover(a, kept[j][0])
            a, j = kept[j][1], j + 1
        if a < b:
            cover(a, b)
    return [(a, b) for a, b in spans]


def _pieces(values: list, sizes: Callable) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``PIECE`` bytes."""
    a, total = 0, 0
    for i, v in enumerate(values):
        total += sizes(v)
        if total >= PIECE:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(values):
        yield a, len(values)


def _distinct(owner, first, count, keys, texts: list[bytes], length: int) -> dict[tuple[int, bytes], tuple[int, int]]:
    """(key, bytes) -> (text number, first window) of the earliest of equal segments; texts are in order."""
    out: dict[tuple[int, bytes], tuple[int, int]] = {}
    for o, f, c, k in zip(owner.tolist(), first.tolist(), count.tolist(), keys.tolist()):
        out.setdefault((k, texts[o][f : f + c + length - 1]), (o, f))
    return out


def _heavy_in_tasks(length: int):
    """Rows (key, n) of keys frequent in a piece of a task's text, finer levels of them, and (null, number of segments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _pieces(texts, len):
                part = texts[a:b]
                owner, first, count, keys, _ = segments(part, 0, length)
                least = max(4, len(keys) / (2 * HEAVY))
                names, ns = [None], [len(keys)]
                for level in range(len(LEVELS) - 1):
                    found, times = np.unique(keys, return_counts=True)
                    many = times >= least
                    names += found[many].tolist()
                    ns += times[many].tolist()
                    mine = np.isin(keys, found[many])
                    if not mine.any():
                        break
                    part = [x for _, x in _distinct(owner[mine], first[mine], count[mine], keys[mine], part, length)]
                    owner, first, count, keys, _ = segments(part, level + 1, length)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ns, pa.int64())], names=["key", "n"])

    return run


def _anchors(length: int, heavy: np.ndarray):
    """(ident, text) -> (key, salt, ident, at): a row for each segment.

    A heavy key's rows are dealt out by ``salt``, which is 0 for all others. ``at``
    is 256 times the first window, plus 128 if windows may be equal, plus the
    number of windows less one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _pieces(texts, len):
                owner, first, count, keys, within = segments(texts[a:b], 0, length)
                salt = np.where(np.isin(keys, heavy), 1 + (np.arange(len(keys)) & 0xFFFF), 0)
                at = (first << 8) | (np.asarray(within, np.int64) << 7) | (count - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, salt.astype(np.int32), ident[a:b][owner], at)], names=["key", "salt", "ident", "at"])

    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        packed = [press(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["ident", "doc_id", "packed"])


def _split_off(finish: Callable[[bytes], object], kind: pa.DataType):
    """Documents without candidates are finished at once and lose their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            packed, whole = batch.column("packed").to_pylist(), batch.column("segments").is_null().to_pylist()
            sizes, done = [], []
            for i, x in enumerate(packed):
                text = open_(x)
                sizes.append(len(text))
                done.append(finish(text) if whole[i] else None)
                if whole[i]:
                    packed[i] = None
            yield pa.RecordBatch.from_arrays(
                [batch.column("ident"), batch.column("doc_id"), pa.array(packed, pa.binary()), batch.column("segments"), pa.array(sizes, pa.int64()), pa.array(done, kind)],
                names=["ident", "doc_id", "packed", "segments", "n_bytes", "kept"],
            )

    return run


def _listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of segments as flat arrays, row number, first window, number of windows and key, in order of the first two."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at, key = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in column.flatten().flatten())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((at, owner))
    return owner[order], at[order] >> 8, (at[order] & 127) + 1, key[order]


def _segments_of(length: int, heavy: np.ndarray, parts: int):
    """(ident, doc, packed, segments) -> (part, blob): the segments (key, bytes, doc, ident, first) of a piece and a part of the keys, equal ones merged.

    ``heavy`` and keys are the upper halves of keys here: those that agree share a
    group, which costs nothing but work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(3).compress
        for batch in batches:
            # documents in their order, so that the earliest of equal segments comes first
            batch = batch.take(pa.compute.sort_indices(pa.table(batch.columns[:2], names=["ident", "doc"]), [("doc", "ascending"), ("ident", "ascending")]))
            ident, doc, texts = (batch.column(i).to_pylist() for i in range(3))
            texts = [open_(x) for x in texts]
            listed = _listed(batch.column(3))
            for a, b in _pieces(texts, len):
                rows = range(a, b)
                lo, hi = np.searchsorted(listed[0], (a, b))
                owner, first, count, keys = (x[lo:hi] for x in listed)
                found = _distinct(owner - a, first, count, keys, texts[a:b], length)
                out = []
                for level in range(1, len(LEVELS) + 1):
                    hot = set(heavy[np.isin(heavy, np.fromiter({k for k, _ in found}, np.int64))].tolist()) if level < len(LEVELS) else set()
                    out += [(k, x, o, f) for (k, x), (o, f) in found.items() if k not in hot]
                    left = [(x, of) for (k, x), of in found.items() if k in hot]
                    if not left:
                        break
                    # segments are in order of their first window, so the earliest of equal ones comes first again
                    left.sort(key=lambda y: y[1])
                    owner, first, count, keys, _ = segments([x for x, _ in left], level, length)
                    keys >>= 32
                    found = {k: (left[o][1][0], left[o][1][1] + f) for k, (o, f) in _distinct(owner, first, count, keys, [x for x, _ in left], length).items()}
                if not out:
                    continue
                out.sort()  # neighbouring keys share no text, but a key's own segments do
                place = np.fromiter((k for k, *_ in out), np.int64, len(out)) % parts
                blobs = []
                for p in np.unique(place).tolist():
                    mine = [out[i] for i in np.flatnonzero(place == p)]
                    numbers = [np.array(x, np.int64) for x in zip(*((k, len(x), doc[rows[o]], ident[rows[o]], f) for k, x, o, f in mine))]
                    blobs.append((p, press(np.array([len(mine)], np.int64).tobytes() + b"".join(x.tobytes() for x in numbers) + b"".join(x for _, x, *_ in mine))))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["part", "blob"])

    return run


def _kept_in(rows: dict[tuple[int, bytes], tuple[int, int, int]], length: int) -> pa.RecordBatch:
    """One block: (key, bytes) -> earliest (doc, ident, first) gives the ranges of first windows."""
    texts = [x for _, x in rows]
    doc, ident, first = (np.array(x, np.int64) for x in zip(*rows.values()))
    order = np.lexsort((ident, doc))
    rank = np.zeros(len(order), np.int64)
    rank[order[1:]] = np.cumsum((np.diff(doc[order]) != 0) | (np.diff(ident[order]) != 0))
    counts = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
    owner, a, b = first_windows(texts, counts, (rank << 32) | first, length)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ident[owner], (first[owner] + a).astype(np.int32), (first[owner] + b).astype(np.int32))], names=["ident", "a", "b"])


def _blocks(length: int):
    """The blobs of a part -> kept ranges (ident, a, b), in blocks of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        found: dict[int, dict[bytes, tuple[int, int, int]]] = {}
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                raw = open_(blob)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                keys, sizes, *at = np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n)
                ends = 8 + 40 * n + np.cumsum(sizes)
                for key, a, b, *where in zip(keys.tolist(), (ends - sizes).tolist(), ends.tolist(), *(x.tolist() for x in at)):
                    mine, text, where = found.setdefault(key, {}), raw[a:b], tuple(where)
                    if where < mine.get(text, (where[0] + 1,)):
                        mine[text] = where
        rows: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        size = 0
        for key in sorted(found):
            for text, where in found.pop(key).items():
                rows[key, text] = where
                size += len(text)
            if size >= BLOCK:
                yield _kept_in(rows, length)
                rows, size = {}, 0
        if rows:
            yield _kept_in(rows, length)

    return run


def _finished(finish: Callable[[bytes], object], kind: pa.DataType, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = batch.column("doc_id")
            packed, ranges, done = (batch.column(n).to_pylist() for n in ("packed", "ranges", "kept"))
            spans: list[list[dict]] = [[] for _ in packed]
            owner, first, count, _ = _listed(batch.column("segments"))
            edges = np.searchsorted(owner, np.arange(len(packed) + 1))
            for i, x in enumerate(packed):
                if x is None:
                    continue
                text, s = open_(x), slice(edges[i], edges[i + 1])
                found = removed_spans(list(zip(first[s].tolist(), (first[s] + count[s]).tolist())), [(r["a"], r["b"]) for r in ranges[i] or []], length)
                spans[i] = [{"start": a, "end": b} for a, b in found]
                at, left = 0, []
                for a, b in [*found, (len(text), len(text))]:
                    left.append(text[at:a])
                    at = b
                done[i] = finish(b"".join(left))
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, batch.column("n_bytes"), pa.array(spans, kinds), pa.array(done, kind)], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, digests: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, spans (start, end of removed runs), kept.

    ``kept`` holds the bytes that are left or, with ``digests``, their SHA-256
    in hex, which spares the texts of untouched documents a shuffle.
    """
    finish, kind, ddl = (lambda x: hashlib.sha256(x).hexdigest(), pa.string(), "string") if digests else (bytes, pa.binary(), "binary")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.xxhash64(doc_id, text).alias("ident"), doc_id.alias("doc_id"), text.cast("binary").alias("text"))
    order = F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc")
    with Scratch(spark) as scratch:
        # a cheap, complete count of what is frequent in some task; its sums bound the number of heavy keys
        counts = scratch.keep(docs.select("text").mapInArrow(_heavy_in_tasks(length), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
        total = counts.where("key is null").agg(F.sum("n")).first()[0] or 0
        heavy = np.array([r["key"] for r in counts.where((F.col("n") * 2 * HEAVY >= total) & F.col("key").isNotNull()).select("key").collect()], np.int64)

        anchors = docs.select("ident", "text").mapInArrow(_anchors(length, heavy), "key long, salt int, ident long, at long")
        often = F.count(F.lit(1)).over(Window.partitionBy("key", "salt")) > 1
        firsts = anchors.withColumn("often", often).where("often or salt > 0 or at & 128 > 0").groupBy("ident").agg(F.collect_set(F.struct("at", F.shiftright("key", 32).cast("int").alias("key"))).alias("segments"))
        packed = docs.mapInArrow(_zipped, "ident long, doc_id long, packed binary")
        split = packed.join(firsts, "ident", "left").mapInArrow(_split_off(finish, kind), f"ident long, doc_id long, packed binary, segments array<struct<at: long, key: int>>, n_bytes long, kept {ddl}")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        split = scratch.bucketed(split, "documents", "ident", buckets)
        parts = max(buckets, -(-total // PART))
        pieces = split.where("packed is not null").select("ident", order, "packed", "segments").mapInArrow(_segments_of(length, np.unique(heavy >> 32), parts), "part int, blob binary")
        ranges = pieces.repartitionById(parts, "part").mapInArrow(_blocks(length), "ident long, a int, b int")
        ranges = ranges.groupBy("ident").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
        found = split.join(ranges, "ident", "left").select("doc_id", "n_bytes", "packed", "segments", "ranges", "kept")
        found = found.mapInArrow(_finished(finish, kind, length), f"doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept {ddl}")
        return materialize(spark, found, "suffix-dedup")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark, table(spark, sf_dir, "documents"), digests=True)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))
