"""Many small networks trained in the same scans: shards dealt by hash, local batches, averaged parameters.

Rows are dealt once into shards by a hash of their key; the number of shards
follows from the number of rows alone. A shard is one row of arrays in order of
the hash, so what a task learns from it depends neither on files nor on
partitions. A pass over the shards takes every model through one epoch: in each
shard it goes through the shard's rows in seeded batches, then Spark averages the
shards' parameters, weighted by their rows. Only models cross the driver.

What a row means to a model (its label, its weight, whether it is held out) is
computed in the tasks, so hundreds of models share one copy of the data and one
scan an epoch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import blocks

SHARD_ROWS = 1 << 15
#: Rows that a task deals out together.
DEALT = 1 << 18
Arrays = dict[str, np.ndarray]


def sharded(df: DataFrame, key: str, columns: tuple[str, ...], rows: int = SHARD_ROWS) -> DataFrame:
    """shard, key (a hash of ``key``), and ``columns``, each an array of doubles; a null becomes NaN."""
    n = df.count()
    shards = max(1, -(-n // rows))
    data = df.select(F.xxhash64(F.col(key)).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])
    dealt = data.select(F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "*")
    names = ["key", *columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.joined(batches, DEALT):
            shard = table["shard"].to_numpy()
            order = np.argsort(shard, kind="stable")
            shard = shard[order]
            found = np.vstack([table[c].to_numpy().view(np.int64)[order] for c in names])
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            parts = [found[:, i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(shard)])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[starts], pa.int32()), pa.array(parts, pa.binary())], names=["shard", "part"])

    def ordered(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(v.as_buffer(), np.int64).reshape(len(names), -1) for v in table["part"]], axis=1)
        found = [found[0], *[v.view(np.float64) for v in found[1:]]]
        order = np.lexsort(found[::-1])
        whole = pa.array([0, len(order)], pa.int32())
        return pa.table([table["shard"].combine_chunks()[:1], *[pa.ListArray.from_arrays(whole, pa.array(v[order])) for v in found]], names=["shard", *names])

    # rows of a shard that lie together are shuffled as one; about ``rows`` rows a group
    return dealt.mapInArrow(cut, "shard int, part binary").groupBy("shard").applyInArrow(ordered, ", ".join(["shard int", "key array<long>", *[f"`{c}` array<double>" for c in columns]]))


def uniform(key: np.ndarray, *seed: object) -> np.ndarray:
    """Numbers in [0, 1) that depend on each key and the seed only."""
    salt = np.uint64(int.from_bytes(hashlib.sha256("|".join(map(str, seed)).encode()).digest()[:8], "little"))
    x = key.view(np.uint64) ^ salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 18)])])


def multiplicities(key: np.ndarray, *seed: object) -> np.ndarray:
    """How often each row is drawn in a bootstrap sample: independent Poisson counts of mean 1."""
    return np.searchsorted(_POISSON, uniform(key, *seed), side="right")


def batches(n: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A permutation of n rows cut into batches: together they hold each row once, only the last may be smaller."""
    order = rng.permutation(n)
    return [order[i : i + size] for i in range(0, n, size)]


def _arrays(batch: pa.RecordBatch, row: int) -> Arrays:
    return {name: batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in batch.schema.names if name not in ("shard", "rows")}


def sums(shards: DataFrame, per_shard: Callable[[int, Arrays], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The vectors that ``per_shard`` gives under each number, added up over all shards in one pass."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in found:
            for row in range(batch.num_rows):
                for m, v in per_shard(batch.column("shard")[row].as_py(), _arrays(batch, row)).items():
                    total[m] = total[m] + v if m in total else v
        yield from vectors(total)

    return summed(shards.mapInArrow(run, VECTORS))


VECTORS = "m int, i int, v double"


def vectors(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Numbered vectors as rows of ``VECTORS``."""
    for m, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), m, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v.astype(np.float64))], names=["m", "i", "v"])


def summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """The vectors of all tasks added up by number."""
    got = rows.groupBy("m", "i").agg(F.sum("v").alias("v")).toArrow().sort_by([("m", "ascending"), ("i", "ascending")])  # a few numbers a parameter
    m, v = got["m"].to_numpy(), got["v"].to_numpy()
    cuts = np.flatnonzero(np.diff(m)) + 1
    return {int(k[0]): x for k, x in zip(np.split(m, cuts), np.split(v, cuts))} if len(m) else {}


def flat(parts: list) -> np.ndarray:
    return np.concatenate([np.ravel(t) for t in parts]).astype(np.float64)


def like(p: list[np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    at = np.cumsum([0, *[np.size(t) for t in p]])
    return [values[a:b].reshape(np.shape(t)) for a, b, t in zip(at, at[1:], p)]


#: (model, its parameters, shard number, the shard's arrays) -> (rows learnt from, parameters, further sums)
Step = Callable[[int, list[np.ndarray], int, Arrays], tuple[float, list[np.ndarray], np.ndarray]]


def averaged_pass(shards: DataFrame, models: dict[int, list[np.ndarray]], step: Step) -> dict[int, tuple[list[np.ndarray], np.ndarray]]:
    """Each model after one step in every shard, averaged by the rows learnt from, and its summed further numbers."""

    def per_shard(shard: int, data: Arrays) -> dict[int, np.ndarray]:
        out = {}
        for m, p in models.items():
            weight, new, more = step(m, p, shard, data)
            out[m] = np.concatenate([[weight], weight * flat(new), more])
        return out

    got, out = sums(shards, per_shard), {}
    for m, p in models.items():
        size = len(flat(p))
        weight, values, more = got[m][0], got[m][1 : 1 + size], got[m][1 + size :]
        out[m] = (like(p, values / weight) if weight > 0 else p), more
    return out


@dataclass(frozen=True)
class Settings:
    hidden: tuple[int, ...] = (24,)
    epochs: int = 30
    batch: int = 256
    rate: float = 0.01
    patience: int = 4


@dataclass(frozen=True)
class Task:
    """One classifier: its input columns and what a row means to it.

    ``weigh`` gets the arrays of a shard and returns labels (0 or 1), weights and
    whether each row is held out for the stopping rule. It runs in the tasks, once
    a shard and pass for all classifiers that share it.
    """

    columns: tuple[str, ...]
    weigh: Callable[[Arrays], tuple[np.ndarray, np.ndarray, np.ndarray]]
    seed: int = 0


@dataclass
class Fit:
    """A classifier at its best epoch; ``losses`` are held-out losses by epoch, epoch 0 before any step."""

    columns: tuple[str, ...]
    scale: dict[str, tuple[float, float]]
    parameters: list[np.ndarray]
    losses: list[float] = field(default_factory=list)

    @property
    def best(self) -> int:
        return int(np.argmin(self.losses))


def network(sizes: list[int], rng: np.random.Generator) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out += [rng.normal(size=(a, b)) * np.sqrt(2 / a) * (0.1 if k == len(sizes) - 2 else 1.0), np.zeros(b)]
    return out


def _inputs(data: Arrays, columns: tuple[str, ...], scale: dict[str, tuple[float, float]]) -> np.ndarray:
    x = np.column_stack([(data[c] - scale[c][0]) / scale[c][1] for c in columns])
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def log_loss(y: np.ndarray, out: np.ndarray) -> np.ndarray:
    v = np.where(y == 1, -out, out)
    return np.maximum(v, 0) + np.log1p(np.exp(-np.abs(v)))


def scales(shards: DataFrame, columns: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the finite values of each column; a constant column has deviation 1."""

    def per_shard(_: int, data: Arrays) -> dict[int, np.ndarray]:
        out = []
        for c in columns:
            v = data[c][np.isfinite(data[c])]
            out += [len(v), v.sum(), (v * v).sum()]
        return {0: np.array(out, float)}

    got = sums(shards, per_shard).get(0, np.zeros(3 * len(columns))).reshape(-1, 3)
    out = {}
    for c, (n, s, q) in zip(columns, got):
        mean = s / n if n else 0.0
        var = q / n - mean * mean if n else 0.0
        out[c] = (float(mean), float(np.sqrt(var)) if var > 1e-12 * max(1.0, mean * mean) else 1.0)
    return out


def fit_all(shards: DataFrame, tasks: dict[int, Task], settings: Settings = Settings()) -> dict[int, Fit]:
    """All classifiers in the same scans, one an epoch until the last has stopped.

    A classifier stops when its held-out loss hasn't fallen for ``patience``
    epochs, and is the one of its best epoch. Without held-out rows of positive
    weight the last epoch counts.
    """
    from weftline.operators.training import Adam, _gradient, _leaving, _run

    columns = tuple(dict.fromkeys(c for t in tasks.values() for c in t.columns))
    scale = scales(shards, columns)
    live = {m: network([len(t.columns), *settings.hidden, 1], np.random.default_rng([t.seed, 1])) for m, t in tasks.items()}
    fits = {m: Fit(t.columns, {c: scale[c] for c in t.columns}, live[m]) for m, t in tasks.items()}
    now: dict = {}  # of one shard: what its classifiers share

    def common(data: Arrays, key: object, make: Callable):
        if now.get("data") is not data:
            now.clear()
            now["data"] = data
        if key not in now:
            now[key] = make()
        return now[key]

    def rows_of(t: Task, data: Arrays) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, labels and weights of the rows to learn from and of those held out."""
        y, w, held = t.weigh(data)
        return [(i, y[i], w[i]) for i in (np.flatnonzero(~held & (w > 0)), np.flatnonzero(held & (w != 0)))]

    def entering(t: Task, data: Arrays, rows: np.ndarray) -> np.ndarray:
        out = np.ones((len(t.columns) + 1, len(rows)))
        for k, c in enumerate(t.columns):
            out[k] = common(data, c, lambda: _inputs(data, (c,), scale)[:, 0])[rows]
        return out

    for epoch in range(settings.epochs + 1):
        train = epoch < settings.epochs

        def step(m: int, p: list[np.ndarray], shard: int, data: Arrays):
            t = tasks[m]
            (mine, y, w), (judge, y_judge, w_judge) = common(data, id(t.weigh), lambda: rows_of(t, data))
            all_of_it = flat(p)
            p = like(p, all_of_it)  # views, so that a step needs no new parameters
            at = np.cumsum([0, *[np.size(v) for v in p]])
            layers = [all_of_it[at[k] : at[k + 2]].reshape(-1, len(p[k + 1])).T for k in range(0, len(p), 2)]
            loss = log_loss(y_judge, _run(layers, entering(t, data, judge))[1])
            more = np.array([w_judge @ loss, w_judge.sum()])
            if not train or not len(mine):
                return 0.0, p, more
            adam = Adam(p, settings.rate / (1 + epoch / 8), (0.9, 0.99))
            order = np.concatenate(batches(len(mine), settings.batch, np.random.default_rng([t.seed, epoch, shard, 2])))
            x, label, weight = entering(t, data, mine[order]), y[order], w[order]
            for i in range(0, len(order), settings.batch):
                b = slice(i, i + settings.batch)
                inputs, out = _run(layers, x[:, b])
                slope = weight[b] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[b]) / max(weight[b].sum(), 1e-12)
                all_of_it -= adam.move(flat(_gradient(inputs, _leaving(layers, inputs)[0], slope)))
            return float(w.sum()), p, more

        got = averaged_pass(shards, live, step)
        stopped = []
        for m, (new, (loss, weight)) in got.items():
            f = fits[m]
            f.losses.append(float(loss / weight) if weight > 0 else float(-epoch))
            if f.best == epoch:
                f.parameters = live[m]
            live[m] = new
            if epoch - f.best >= settings.patience:
                stopped.append(m)
        for m in stopped:
            del live[m]
        if not live:
            break
    return fits


def probabilities(fits: list[Fit]) -> Column:
    """An array of every fit's probability of label 1, in one pass over the batches."""
    from weftline.operators.training import forward

    columns = tuple(dict.fromkeys(c for f in fits for c in f.columns))

    @F.arrow_udf("array<double>")
    def score(v: pa.Array) -> pa.Array:
        flat_values = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(columns))
        data = {c: flat_values[:, i] for i, c in enumerate(columns)}
        outs = [forward(f.parameters, _inputs(data, f.columns, f.scale))[1] for f in fits]
        p = 1 / (1 + np.exp(-np.clip(np.column_stack(outs), -30, 30)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(fits), pa.int32()), pa.array(p.ravel()))

    return score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]))


def network_classifier(settings: Settings = Settings(), held_out: float = 0.2, seed: int = 0, key: str = "row_id") -> Callable:
    """A step classifier for ``reweight.iterate`` and ``reweight.density_ratio``: a weighted network that stops early.

    The frame must have ``key``; a part ``held_out`` of the keys decides when to stop.
    """
    from weftline.operators.reweight import numbers

    def classify(df: DataFrame, label: Column, weight: Column, column: str = "features") -> Column:
        values = numbers(df, column)
        size = df.select(F.size(values).alias("n")).first()["n"]
        names = tuple(f"f{i}" for i in range(size))
        rows = df.select(key, label.cast("double").alias("label"), weight.cast("double").alias("weight"), *[values[i].alias(c) for i, c in enumerate(names)])
        shards = sharded(rows, key, ("label", "weight", *names)).persist()

        def weigh(data: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return data["label"], data["weight"], uniform(data["key"], seed, "held") < held_out

        try:
            fit = fit_all(shards, {0: Task(names, weigh, seed)}, settings)[0]
        finally:
            shards.unpersist()
        return _on_array(fit, values)

    return classify


def _on_array(fit: Fit, values: Column) -> Column:
    from weftline.operators.training import forward

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(fit.columns))
        out = forward(fit.parameters, _inputs({c: x[:, i] for i, c in enumerate(fit.columns)}, fit.columns, fit.scale))[1]
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(values)
