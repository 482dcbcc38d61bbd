"""Language-model scores of texts from a hashed maximum-entropy model.

Tokens: runs of bytes other than blank and U+0009 to U+000D, A-Z as a-z, then
one end token; a token is known by a 64-bit hash (V distinct tokens meet with a
chance of V**2 / 2**65).

Counts: every training token is counted; partitions count first, then one
grouped sum. The ``HEAD`` most frequent tokens, a table of proven size, are
broadcast; the counts of all others are joined to the tokens that need them, so
the vocabulary may grow without bound.

Model: P(token | history) = P(class | history) P(token | class, history). The
``CLASSES`` * ``CLASS_SIZE`` most frequent tokens fall into classes by rank, all
others into one more class, within which a token has its smoothed share
(c + 1) / (T + V' + 1) of that class. Features of a history are its last token
(bigram), the one before (skip) and both (trigram), hashed into rows of two
weight tables: one for the class, one for the token within the class. A rare
history token is seen by its last three bytes. Biases are the log counts, so an
untrained model is the unigram model.

Training: every training document takes part. They are dealt by a hash of id and
text into ``ROUNDS`` parts and these into shards of about ``SHARD`` tokens, at least
``LEAST_SHARDS``; how many shards there are follows from the number of training tokens alone. In round
j every shard of part j takes gradient steps from the shared weights, its
documents in order of their hash, and the shards' weights are averaged row by row,
each with the number of times that it used the row. So the model depends neither
on files nor on partitions, and a task may go through any number of shards: it
sums their weights up before they leave it. Averaging many short runs is also what
makes the model good: one long run ends in the noise of its last steps. Only the
averaged tables, of fixed size, come to the driver.

Scoring: sparse batches; each token gathers its few rows.

Defined results: a null text is empty and has the end token alone; without
training rows N and V are 0 and the base score is 0 for every text; rows with
null ids count as the id '' for the split; repeated rows are scored alike; equal
counts are ranked by hash; an empty table gives no rows; further columns are
ignored; a very long text is one block of tokens, trained on and scored in
batches of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import fold, materialize, table
from weftline.llm.textarrays import mix
from weftline.llm.wordhash import word_hashes

HEAD = 1 << 20
CLASSES, CLASS_SIZE = 32, 64
CLASS_ROWS, WORD_ROWS = 1 << 12, 1 << 13
ROUNDS = 3
RATE, BATCH = 0.3, 2048
#: Tokens of a shard, about, and least number of shards in a round.
SHARD, LEAST_SHARDS = 200_000, 4
END = np.uint64(0x5851F42D4C957F2D)
BLOCK = 1 << 20


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with their ends, each token's history form if it is rare, and tokens by text."""
    words, counts, tails = word_hashes(texts, tail=3)
    n = counts + 1
    out = np.full(int(n.sum()), END, dtype=np.uint64)
    rare = out.copy()
    at = np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)
    out[at], rare[at] = words, tails
    return out, rare, n


def _blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= limit or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


class Head:
    """Frequent tokens: rank and count by open addressing over hashes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """In the order of their ranks."""
        bits = max(4, int(2 * max(1, len(hashes)) - 1).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.ranks = np.full(1 << bits, -1, dtype=np.int32)
        self.counts = counts.astype(np.float64)
        left = np.arange(len(hashes))
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.ranks[slot[left]] < 0
            tried = left[free]
            self.ranks[slot[tried]] = tried  # of several for one slot the last stays
            won = self.ranks[slot[tried]] == tried
            self.keys[slot[tried[won]]] = hashes[tried[won]]
            placed = np.zeros(len(hashes), dtype=bool)
            placed[tried[won]] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks, -1 where a token isn't among them."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        left = np.arange(len(hashes))
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            s = slot[left]
            rank, same = self.ranks[s], self.keys[s] == hashes[left]
            hit = (rank >= 0) & same
            out[left[hit]] = rank[hit]
            left = left[(rank >= 0) & ~same]
            slot[left] = (slot[left] + 1) & self.mask
        return out


@dataclass
class Model:
    head: Head
    complete: bool  # the head holds every training token
    total: int
    distinct: int
    other_total: float  # tokens and distinct tokens of the last class
    other_distinct: int
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_weights: np.ndarray
    word_weights: np.ndarray


@dataclass
class Events:
    rank: np.ndarray
    cls: np.ndarray
    features: np.ndarray  # events x 3
    per_text: np.ndarray
    token: np.ndarray


def events(model: Model, texts: list[str]) -> Events:
    token, rare, n = tokens(texts)
    rank = model.head.find(token)
    inner = (rank >= 0) & (rank < CLASSES * CLASS_SIZE)
    seen = np.where(inner, token, rare)
    first = np.cumsum(n) - n
    place = np.arange(len(token)) - np.repeat(first, n)
    one, two = np.zeros_like(seen), np.zeros_like(seen)
    one[1:] = seen[:-1]
    two[2:] = seen[:-2]
    one = np.where(place >= 1, one, np.uint64(11))
    two = np.where(place >= 2, two, np.uint64(13))
    features = np.column_stack(
        [mix(one + np.uint64(1)), mix(two + np.uint64(0x632BE59BD9B4E019)), mix(one * np.uint64(3) + two * np.uint64(0x9E3779B97F4A7C15))]
    )
    return Events(rank, np.where(inner, rank // CLASS_SIZE, CLASSES), features, n, token)


def _normal(z: np.ndarray) -> np.ndarray:
    """Log probabilities along the last axis."""
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _class_rows(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(CLASS_ROWS - 1)).astype(np.int64)


def _word_rows(features: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return (((features >> np.uint64(20)) + cls[:, None].astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(WORD_ROWS - 1)).astype(np.int64)


def _gather(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return weights[rows[:, 0]] + weights[rows[:, 1]] + weights[rows[:, 2]]


def log_probabilities(model: Model, e: Events, part: int = 4096) -> np.ndarray:
    """Natural logs of P(class) P(token | class); in the last class of P(class) alone."""
    out = np.empty(len(e.rank), dtype=np.float64)
    for a in range(0, len(out), part):
        f, cls, rank = e.features[a : a + part], e.cls[a : a + part], e.rank[a : a + part]
        got = _normal(model.class_bias + _gather(model.class_weights, _class_rows(f)))[np.arange(len(cls)), cls].astype(np.float64)
        inner = np.flatnonzero(cls < CLASSES)
        if len(inner):
            c = cls[inner]
            z = _normal(model.word_bias[c] + _gather(model.word_weights, _word_rows(f[inner], c)))
            got[inner] += z[np.arange(len(inner)), rank[inner] % CLASS_SIZE]
        out[a : a + part] = got
    return out


def _summed(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, pairwise in a tree (overwrites ``rows``)."""
    nth = np.arange(len(rows)) - np.repeat(starts, lengths)
    left = np.flatnonzero(nth)
    step = 1
    while len(left):
        odd = nth[left] % (2 * step) == step
        at = left[odd]
        rows[at - step] += rows[at]
        left, step = left[~odd], 2 * step
    return rows[starts]


class Trainer:
    """A task's weights, with the gradients and uses of their rows so far."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = [model.class_weights.copy(), model.word_weights.copy()]
        self.past = [np.zeros(len(w), dtype=np.float32) for w in self.tables]
        self.uses = [np.zeros(len(w), dtype=np.int64) for w in self.tables]

    def _step(self, t: int, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
        """One step on the rows of a batch; each row's step shrinks with its past gradients."""
        weights = self.tables[t]
        p = weights.take(rows[:, 0], axis=0)
        p += weights.take(rows[:, 1], axis=0)
        p += weights.take(rows[:, 2], axis=0)
        p += bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        flat = rows.astype(np.uint16).ravel()
        order = flat.argsort(kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        uses = np.diff(np.append(starts, len(flat)))
        g = _summed(p.take(order // 3, axis=0), starts, uses)
        u = flat[starts].astype(np.int64)
        self.uses[t][u] += uses
        self.past[t][u] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        g *= (RATE / np.sqrt(self.past[t][u] + 1e-2))[:, None]
        weights[u] -= g

    def learn(self, texts: list[str]) -> None:
        """One pass of steps over a block of texts."""
        m = self.model
        e = events(m, texts)
        class_rows, word_rows = _class_rows(e.features), _word_rows(e.features, e.cls)
        order = np.random.Generator(np.random.PCG64(len(e.rank))).permutation(len(e.rank))
        for at in range(0, len(order), BATCH):
            i = order[at : at + BATCH]
            self._step(0, class_rows[i], m.class_bias, e.cls[i])
            i = i[e.cls[i] < CLASSES]
            if len(i):
                self._step(1, word_rows[i], m.word_bias[e.cls[i]], e.rank[i] % CLASS_SIZE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys = np.concatenate([k for k, _ in held])
        n = np.concatenate([c for _, c in held])
        order = keys.argsort()
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.add.reduceat(n, starts)

    def flush():
        keys, n = merged()
        for i in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)].view(np.int64)), pa.array(n[i : i + (1 << 18)])], names=["token", "c"])

    for batch in batches:
        for some in _blocks(batch.column(0).to_pylist()):
            t = np.sort(tokens(some)[0])
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            held.append((t[starts], np.diff(np.append(starts, len(t))).astype(np.int64)))
            size += len(starts)
            if size > 6_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 3_000_000:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def count_tokens(spark: SparkSession, train: DataFrame) -> DataFrame:
    """token, c over all rows of (text), written."""
    counts = train.select("text").mapInArrow(_count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    return materialize(spark, counts, "tokens")


def fit(spark: SparkSession, train: DataFrame, counts: DataFrame) -> Model:
    """From training rows (doc_id, text) and their token counts."""
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the count that HEAD tokens reach: from the numbers of tokens by size class, then by exact order within the bound
    top = counts
    if whole["v"] > HEAD:
        sizes = counts.groupBy(F.least("c", F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()  # at most 2 ** 20 rows, in fact few
        room, least = HEAD, None
        for r in sizes:
            if r["n"] > room:
                break
            room -= r["n"]
            least = r["c"]
        top = counts.where(F.col("c") >= least) if least is not None else counts.orderBy(F.desc("c"), "token").limit(HEAD)
    got = top.toArrow()  # at most HEAD rows
    hashes, n = got["token"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    k = CLASSES * CLASS_SIZE
    inner = np.zeros(k)
    inner[: min(k, len(n))] = n[:k]
    inner = inner.reshape(CLASSES, CLASS_SIZE)
    other = float(whole["n"] - inner.sum())
    with np.errstate(divide="ignore"):
        class_bias = np.log(np.append(inner.sum(axis=1), other + 1.0))
        word_bias = np.log(inner)
    class_bias[~np.isfinite(class_bias)] = -1e4
    word_bias[~np.isfinite(word_bias)] = -1e4
    model = Model(
        Head(hashes, n), whole["v"] <= len(n), whole["n"], whole["v"], other, max(0, whole["v"] - k), class_bias.astype(np.float32), word_bias.astype(np.float32),
        np.zeros((CLASS_ROWS, CLASSES + 1), dtype=np.float32), np.zeros((WORD_ROWS, CLASS_SIZE), dtype=np.float32),
    )
    shards = max(LEAST_SHARDS, -(-model.total // (ROUNDS * SHARD)))
    dealt = F.xxhash64("doc_id", "text")
    train = train.where("text IS NOT NULL").select("text", dealt.alias("h"))
    train = train.select("text", "h", F.pmod("h", F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"))
    for j in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # HEAD entries and weights of fixed size
        model.class_weights, model.word_weights = _round(train.where(F.col("round") == j), shared)
    return model


def _round(train: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """One round over (shard, h, text): every shard's weights, averaged row by row."""
    width = max(CLASSES + 1, CLASS_SIZE)
    names = ["row", "uses", *(f"w{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = [np.zeros((len(w), width)) for w in (model.class_weights, model.word_weights)]
        uses = [np.zeros(len(w), dtype=np.int64) for w in sums]
        held: list[str] = []
        now = None

        def learn(texts: list[str]) -> None:
            trainer = Trainer(model)
            for some in _blocks(texts):
                trainer.learn(some)
            for total, count, weights, n in zip(sums, uses, trainer.tables, trainer.uses):
                used = np.flatnonzero(n)
                total[used, : weights.shape[1]] += weights[used] * n[used, None]
                count += n

        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now and held:
                    learn(held)
                    held = []
                now = shard
                held.append(text)
        if held:
            learn(held)
        first = 0  # the rows of both tables are numbered together
        for total, count in zip(sums, uses):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used + first), pa.array(count[used]), *(pa.array(total[used, i].astype(np.float32)) for i in range(width))], names=names)
            first += len(total)

    train = train.repartition("shard").sortWithinPartitions("shard", "h", "text").select("shard", "text")
    found = train.mapInArrow(run, "row long, uses long, " + ", ".join(f"{n} float" for n in names[2:]))
    found = found.groupBy("row").agg(F.sum("uses").alias("uses"), *[F.sum(n).alias(n) for n in names[2:]]).toArrow()  # one row a row of the two tables
    out, first = [], 0
    row, uses = found["row"].to_numpy(), found["uses"].to_numpy()
    w = np.column_stack([found[n].to_numpy() for n in names[2:]])
    for old in (shared.value.class_weights, shared.value.word_weights):
        new = old.copy()
        mine = np.flatnonzero((row >= first) & (row < first + len(old)))
        new[row[mine] - first] = w[mine, : old.shape[1]] / uses[mine, None]
        out.append(new)
        first += len(old)
    return out[0], out[1]


def score(spark: SparkSession, docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text)."""
    shared = spark.sparkContext.broadcast(model)  # HEAD entries and weights of fixed size
    log10 = np.log(10.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_count = np.log10(m.head.counts + 1)
        other = np.log10(m.other_total + m.other_distinct + 1)
        task = TaskContext.get().partitionId() << 40
        done = 0
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            missing: list[np.ndarray] = []
            for some in _blocks(batch.column(1).to_pylist()):
                e = events(m, some)
                first = np.cumsum(e.per_text) - e.per_text
                found = e.rank >= 0
                own = np.where(found, log_count[e.rank] if len(log_count) else 0.0, 0.0)
                last = e.cls == CLASSES
                model_part = log_probabilities(m, e) / log10 + np.where(last, own - other, 0.0)
                for held, x in zip(columns, (e.per_text, found.astype(np.int64), own, model_part)):
                    held.append(x if x is e.per_text else np.add.reduceat(x, first))
                if not m.complete:
                    cut = np.cumsum(np.add.reduceat((~found).astype(np.int64), first))[:-1]
                    missing += np.split(e.token[~found].view(np.int64), cut)
                else:
                    missing += [np.zeros(0, dtype=np.int64)] * len(some)
            n, known, own, got = (np.concatenate(c) if c else np.zeros(0) for c in columns)
            sizes = np.fromiter(map(len, missing), dtype=np.int64, count=len(missing))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(missing) if missing else np.zeros(0, dtype=np.int64)))
            rows = pa.array(task + done + np.arange(batch.num_rows), pa.int64())
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), rows, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(own, pa.float64()), pa.array(got, pa.float64()), lists],
                names=["doc_id", "row", "n_tokens", "known", "own", "got", "missing"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, row long, n_tokens long, known long, own double, got double, missing array<bigint>")
    per_token = float(np.log10(model.total + model.distinct + 1))
    if model.complete:
        rows = rows.withColumn("more", F.lit(0)).withColumn("extra", F.lit(0.0))
    else:
        rows = materialize(spark, rows, "scored")
        rare = rows.select("row", F.explode("missing").alias("token")).join(counts, "token")  # tokens without a count add nothing
        rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("extra"))
        rows = rows.drop("missing").join(rare, "row", "left")
    extra = F.coalesce("extra", F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("own") + extra - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("got") + extra).alias("score"),
    )


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    train = docs.where(fold("doc_id", 7) != 2)
    counts = count_tokens(spark, train)
    out = score(spark, docs, fit(spark, train, counts), counts)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
