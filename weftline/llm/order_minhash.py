"""Near-duplicate documents by Order MinHash and banded alignment.

Words: runs of non-blank bytes, A-Z as a-z. A document's k-mers are its runs of
``WORDS`` words (all its words, if fewer), each labelled with its occurrence
number. Sketch j takes the ``TAKEN`` labelled k-mers with the least values of
the j-th hash and keeps them in their order in the text, so two documents agree
in a sketch only if they share these k-mers in the same order. With a Jaccard
similarity of 0.8, a sketch agrees with a probability of about 0.8 ** TAKEN =
0.51, so all ``SKETCHES`` = 20 differ for about 6 pairs in ten million.

Documents with the same words form one class from the start and go on as one
text with a number of its own, so ids may repeat or be null. Texts that agree in
a sketch form a bucket. In the first pass every member is compared with the
bucket's best-connected text, the one whose buckets are largest together: the
text that a group's others were made from. The second pass looks at buckets
whose members are still not all connected. In those of at most ``SMALL`` members
all unconnected pairs are compared. The members of all larger ones go through
one exact join: k-mers are put in an order by how rare they are, and two texts
can only be similar if they share one of their first k-mers in that order, a
fifth of the longer text's and a ninth of the shorter one's, early enough in
both. Pairs that are connected already are not made: of the texts with a k-mer,
only those outside its largest class are paired with the others. So every
similar pair that agrees in a sketch ends in one class, whatever the size of its
buckets.

A pair is linked if the Jaccard similarity of its k-mers is at least
``SIMILAR`` and so is the share of words that an alignment within a diagonal
band matches. The alignment is the bit-parallel longest common subsequence over
a window that moves along the diagonal; the band starts narrow and widens, up to
what such a pair can need, only while the words aren't enough.

A best-connected text that many members are compared with is dealt, by their
hash, to several tasks. Joins on a bucket's key have one row a key on one side,
which is what adaptive execution splits by itself.

Classes are the connected components of the links; a class's id is its least
document id.

Defined results: a null text is empty; all texts without words form one class;
repeated rows give repeated rows; rows of one id with unlike texts may fall in
different classes; a class without any id has the null id; an empty table gives
no rows; further columns, whatever their names, are ignored by the query and
kept by ``one_of_each``; a very long text is sketched and compared whole; of
equally connected texts of a bucket the one with the least number leads.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, map_text, materialize, table
from weftline.llm.graph import connected_components
from weftline.llm.textarrays import mix
from weftline.llm.wordhash import word_hashes

WORDS, TAKEN, SKETCHES, SIMILAR = 5, 3, 20, 0.8
#: Buckets of so many members are compared in full.
SMALL = 12
#: Members of a bucket that one task compares with its best-connected text.
SHARE = 2_000
#: Counters of k-mers for their order.
SLOTS = 1 << 20


def kmers(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers of each text in order, and their numbers (none for a text without words)."""
    n = np.where(counts > 0, np.maximum(counts - WORDS + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, n)
    begin = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    end = np.repeat(np.cumsum(counts), n)
    h = np.zeros(len(begin), dtype=np.uint64)
    for k in range(WORDS):
        there = begin + k < end
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(there, words[np.minimum(begin + k, len(words) - 1)], np.uint64(k)) if len(words) else h
    return mix(h), n


def _labelled(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """k-mers told apart by their occurrence number in their text."""
    order = np.lexsort((h, of))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])])
    if not same.any():
        return h
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    nth = np.empty(len(h), dtype=np.uint64)
    nth[order] = run.astype(np.uint64)
    return np.where(nth > 0, mix(h + nth * np.uint64(0xD6E8FEB86659FD93)), h)


def _keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two hashes of each text's sequence of words, 0 for a text without words."""
    keys = np.zeros((len(counts), 2), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.cumsum(counts) - counts
        place = (np.arange(len(words)) - np.repeat(starts, counts)).astype(np.uint64)
        for i, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            keys[some, i] = mix(np.add.reduceat(mix(words ^ mix(place + np.uint64(salt))), starts[some]) + counts[some].astype(np.uint64))
    return keys


def sketch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of equal word sequences (two a text), numbers of k-mers, and the sketches (uint64)."""
    words, counts = word_hashes(texts)
    keys = _keys(words, counts)
    h, n = kmers(words, counts)
    of = np.repeat(np.arange(len(texts)), n)
    h = _labelled(h, of)
    out = np.zeros((len(texts), SKETCHES), dtype=np.uint64)
    if not len(h):
        return keys, n, out
    # only values under a bound can be among the least; about 16 of a text are
    share = np.minimum(16.0 / np.maximum(n, 1), 1.0)
    bound = np.where(share < 1, (share * 2.0**64).clip(max=2.0**64 - 4096), 2.0**64 - 4096).astype(np.uint64)
    bound = np.where(n <= 16, np.uint64(0xFFFFFFFFFFFFFFFF), bound)[of]
    need = np.minimum(n, TAKEN)
    first = np.cumsum(n) - n
    for j in range(SKETCHES):
        v = (h ^ mix(np.asarray([j + 1], dtype=np.uint64))[0]) * np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(33)
        v *= np.uint64(0xC4CEB9FE1A85EC53)
        at = np.flatnonzero(v <= bound)
        got = np.bincount(of[at], minlength=len(texts))
        short = np.flatnonzero(got < need)
        if len(short):  # too few under the bound: take all of these texts
            more = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in short])
            at = np.union1d(at, more)
        at = at[np.lexsort((at, v[at], of[at]))]
        o = of[at]
        begins = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at = np.sort(at[rank < TAKEN])  # text order
        o = of[at]
        begins = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        out[o[begins], j] = mix(np.add.reduceat(mix(h[at] + (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7)), begins) + np.uint64(j))
    return keys, n, out


def _in_blocks(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= 1 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sketches(texts: list[str | None]) -> list:
    parts = [sketch(held) for held in _in_blocks(texts)]
    if not parts:
        return [[], [], [], []]
    keys, n, s = (np.concatenate(x) for x in zip(*parts))
    flat = pa.array(s.view(np.int64).ravel())
    return [keys[:, 0].view(np.int64), keys[:, 1].view(np.int64), n, pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, SKETCHES), pa.int32()), flat)]


def _only_keys(texts: list[str | None]) -> list:
    keys = np.concatenate([np.zeros((0, 2), dtype=np.uint64), *(_keys(*word_hashes(held)) for held in _in_blocks(texts))])
    return [keys[:, 0].copy().view(np.int64), keys[:, 1].copy().view(np.int64)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words matched by the best alignment whose matches lie within ``band`` diagonals of the main one."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :] == b[len(b) - n :]
    tail = n if same.all() else int(same[::-1].argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, list[int]] = {}
    for i, w in enumerate(a.tolist()):
        where.setdefault(w, []).append(i)
    # bit i of the window is position low + i of a; a cleared bit is one more match there
    width = 2 * band + 1
    full = (1 << width) - 1
    free, matched = full, 0
    for j, w in enumerate(b.tolist()):
        if j:
            matched += not free & 1
            free = free >> 1 | 1 << width - 1
        at = where.get(w)
        if at is None:
            continue
        low = j - band
        u = 0
        for k in range(bisect_left(at, low), len(at)):
            if at[k] - low >= width:
                break
            u |= 1 << at[k] - low
        u &= free
        if u:
            free = ((free + u) | (free - u)) & full
    return head + tail + matched + width - free.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences are near-duplicates."""
    long = max(len(a), len(b))
    if min(len(a), len(b)) < SIMILAR * long - WORDS:
        return False
    ka, kb = kmers(a, np.asarray([len(a)]))[0], kmers(b, np.asarray([len(b)]))[0]
    if jaccard(ka, kb) < SIMILAR:
        return False
    (wa, ca), (wb, cb) = (np.unique(x, return_counts=True) for x in (a, b))
    _, i, j = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
    if np.minimum(ca[i], cb[j]).sum() < SIMILAR * long:
        return False
    band, widest = 32, int((1 - SIMILAR) * long) + 1
    while True:
        band = min(band, widest)
        if aligned(a, b, band) >= SIMILAR * long:
            return True
        if band == widest:
            return False
        band *= 4


def texts_of(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of the representatives (id, doc_id, k1, k2): one row of (doc_id, text) with that id and these words each."""
    reps = reps.select("id", F.col("doc_id").alias("rep_doc"), F.col("k1").alias("rep_k1"), F.col("k2").alias("rep_k2"))
    keys = "k1 bigint, k2 bigint"
    named = map_text(docs.join(reps, F.col("doc_id") == F.col("rep_doc")), lambda: _only_keys, keys).where("k1 = rep_k1 AND k2 = rep_k2")
    bare = map_text(docs.where("doc_id IS NULL"), lambda: _only_keys, keys).join(reps.where("rep_doc IS NULL"), (F.col("k1") == F.col("rep_k1")) & (F.col("k2") == F.col("rep_k2")))
    return named.select("id", "text").unionByName(bare.select("id", "text")).dropDuplicates(["id"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, tasks) pairs of numbers -> a, b, near: whether their texts are near-duplicates.

    ``tasks`` says by how many tasks the pairs of one ``b`` are compared.
    """
    copies = pairs.groupBy("b").agg(F.max("tasks").alias("tasks"))
    right = texts.withColumnRenamed("id", "b").join(copies, "b").select("b", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))
    left = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.col("tasks")).cast("int").alias("salt")).join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            near = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b not in known:
                    if held > 2_000_000:
                        known, held = {}, 0
                    known[b] = word_hashes([y.as_py() or ""])[0]
                    held += len(known[b])
                near.append(similar(word_hashes([x.as_py() or ""])[0], known[b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return both.mapInArrow(run, "a long, b long, near boolean")


def _alike(x: str, y: str):
    """Whether two numbers of k-mers allow the similarity."""
    return F.least(x, y) >= SIMILAR * F.greatest(x, y) - WORDS


def _pair(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _within(members: DataFrame) -> DataFrame:
    """Pairs of differently labelled members of each small bucket of (key, id, n, label)."""
    other = members.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    return members.join(other, "key").where("id < id2 AND label <> label2").where(_alike("n", "n2")).select(*_pair("id", "id2"))


def _sets(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct k-mers of the texts in blocks: bounds of the block, text numbers in it, k-mers."""
    begin, size = 0, 0
    for end, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= 1 << 20 or end == len(texts):
            h, n = kmers(*word_hashes([x or "" for x in texts[begin:end]]))
            of = np.repeat(np.arange(end - begin), n)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])[: len(h)]
            yield begin, end, of[new], h[new]
            begin, size = end, 0


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _joined(spark: SparkSession, texts: DataFrame, held: Scratch) -> DataFrame:
    """All pairs of differently labelled rows of (id, label, text) that can have similar sets of k-mers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, _, _, h in _sets(batch.column(0).to_pylist()):
                held += np.bincount(_slots(h), minlength=SLOTS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["slot", "c"])

    got = texts.select("text").mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, dtype=np.int64)
    often[got["slot"].to_numpy()] = got["c"].to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, of, h in _sets(batch.column(2).to_pylist()):
                order = np.lexsort((h, shared.value[_slots(h)], of))
                h = h[order]
                n = np.bincount(of, minlength=end - begin)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                at = np.flatnonzero(place <= (n - np.ceil(SIMILAR * n - 1e-9))[of])
                rows = pa.array(of[at] + begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(n[of[at]]), pa.array(place[at])], names=["g", "id", "label", "n", "place"]
                )

    rows = held.keep(texts.select("id", "label", "text").mapInArrow(first, "g long, id long, label long, n long, place long"), "prefixes")
    classes = rows.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels"))
    rows = rows.join(classes.where("labels > 1").select("g", F.col("m.label").alias("most")), "g")
    other = rows.select("g", *[F.col(c).alias(f"{c}2") for c in ("id", "label", "n", "place")])
    both = rows.where("label <> most").join(other, "g").where("label <> label2 AND (label2 = most OR id < id2)")
    shorter = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    n, place = F.when(shorter, F.col("n")).otherwise(F.col("n2")), F.when(shorter, F.col("place")).otherwise(F.col("place2"))
    share = SIMILAR / (1 + SIMILAR)
    both = both.where(F.least("n", "n2") >= SIMILAR * F.greatest("n", "n2") - 1e-9).where(place <= n - F.ceil(2 * share * n - 1e-9))
    both = both.where(F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= share * (F.col("n") + F.col("n2")) - 1e-9)
    return both.select(*_pair("id", "id2"))


def _classes(spark: SparkSession, docs: DataFrame, held: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2) of all documents, and the class of each word sequence: k1, k2, doc_id (its least), label."""
    made = map_text(docs, lambda: _sketches, "k1 bigint, k2 bigint, n bigint, sketches array<bigint>").drop("text")
    rows = held.keep(made, "sketches")
    reps = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    reps = held.keep(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")
    members = reps.where("n > 0").select("id", "n", F.explode("sketches").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    inside = held.keep(members.join(sizes, "key"), "buckets")
    shared = inside.select("id").distinct()
    texts = held.keep(texts_of(reps.select("id", "doc_id", "k1", "k2").join(shared, "id"), docs), "texts")

    # first pass: all members of a bucket against its best-connected one
    known = inside.groupBy("id").agg(F.sum("size").alias("known"))
    lead = inside.join(known, "id").groupBy("key").agg(F.max(F.struct("known", (-F.col("id")).alias("minus"), "n")).alias("m"))
    lead = held.keep(lead.select("key", (-F.col("m.minus")).alias("lead"), F.col("m.n").alias("n_lead")), "leads")
    star = inside.join(lead, "key").where("id <> lead").where(_alike("n", "n_lead"))
    star = star.groupBy(*_pair("id", "lead")).agg(F.max(F.struct(F.ceil(F.col("size") / SHARE).cast("int").alias("tasks"), "lead")).alias("m"))
    star = star.select((F.col("a") + F.col("b") - F.col("m.lead")).alias("a"), F.col("m.lead").alias("b"), F.col("m.tasks").alias("tasks"))
    tested = held.keep(verify(star, texts), "links")
    links = tested.where("near").select("a", "b")
    labels = connected_components(links, held)

    # second pass: members of a bucket that aren't connected yet
    named = inside.join(labels, "id", "left").select("key", "size", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    named = held.keep(named.join(mixed, "key", "left_semi"), "open")
    more = _within(named.where(F.col("size") <= SMALL).select("key", "id", "n", "label"))
    large = held.keep(named.where(F.col("size") > SMALL).select("id", "label").distinct(), "large")
    if large.limit(1).count():
        more = more.unionByName(_joined(spark, large.join(texts, "id"), held))
    done = tested.select(*_pair("a", "b"))
    more = more.distinct().join(done, ["a", "b"], "left_anti").withColumn("tasks", F.lit(1))
    found = held.keep(verify(held.keep(more, "pairs"), texts).where("near").select("a", "b"), "links")
    if found.limit(1).count():
        labels = connected_components(links.unionByName(found), held)
    return rows.select("doc_id", "k1", "k2"), reps.join(labels, "id", "left").select("k1", "k2", "doc_id", F.coalesce("label", "id").alias("label"))


def near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with Scratch(spark) as held:
        rows, classes = _classes(spark, docs, held)
        names = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
        classes = classes.join(names, "label").select("k1", "k2", "class_id")
        return materialize(spark, rows.join(classes, ["k1", "k2"]).select("doc_id", "class_id"), "classes")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: one with the class's least id, or one without an id if it has none."""
    wrapped = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as held:
        rows, classes = _classes(spark, wrapped.select("doc_id", "text"), held)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("m")
        kept = held.keep(classes.groupBy("label").agg(first).select("m.*"), "kept")
        same = [F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), F.col("x.k1") == F.col("y.k1"), F.col("x.k2") == F.col("y.k2")]
        times = rows.alias("x").join(kept.alias("y"), same, "left_semi").groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("times"))
        repeated = held.keep(times.where("times > 1").drop("times"), "repeated")
        keyed = map_text(wrapped, lambda: _only_keys, "k1 bigint, k2 bigint").drop("text")
        out = keyed.alias("x").join(kept.alias("y"), same, "left_semi")
        if repeated.limit(1).count():
            once = out.alias("x").join(repeated.alias("y"), same, "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
            out = out.alias("x").join(repeated.alias("y"), same, "left_anti").unionByName(once)
        return materialize(spark, out.select("row.*"), "kept")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, table(spark, sf_dir, "documents"))
