"""Adversarial training of event weights: a generator of weights from truth columns against a critic of detector columns.

``train`` takes full gradients: every step is one pass over all rows, tasks sum
gradients over their partitions, the sums are merged by Spark, and a number a
parameter comes to the driver. ``train_cells`` takes shuffled batches: one pass an
epoch, in which each shard of the rows trains both networks batch by batch and
Spark averages the shards' parameters; any number of trainings shares the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import blocks, learning, mmd, sampling, sorted_areas

CLASSIFIER, WASSERSTEIN = "classifier", "wasserstein"
#: Weight of the dispersion penalty and Adam's decay rates by objective, weight of the gradient penalty.
DISPERSION = {CLASSIFIER: 0.015, WASSERSTEIN: 0.5}
DECAYS = {CLASSIFIER: (0.5, 0.9), WASSERSTEIN: (0.0, 0.9)}
GRADIENT_PENALTY = 10.0
#: Rows that go through the networks together.
PIECE = 1 << 12


@dataclass(frozen=True)
class Settings:
    objective: str = CLASSIFIER
    generator: tuple[int, ...] = (16,)
    critic: tuple[int, ...] = (16,)
    epochs: int = 12
    critic_steps: int = 2
    rate: float = 0.02
    dispersion: float | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        if self.objective not in DISPERSION:
            raise ValueError(f"objective must be one of {sorted(DISPERSION)}")
        if self.critic_steps < 1:
            raise ValueError("an epoch needs a step of the critic")


@dataclass
class Trained:
    """A finished run: one history entry and one set of generator parameters an epoch, epoch 0 before any step."""

    settings: Settings
    truth: tuple[str, ...]
    reco: tuple[str, ...]
    scale: dict[str, tuple[float, float]]
    history: list[dict] = field(default_factory=list)
    generators: list[list[np.ndarray]] = field(default_factory=list)
    critic: list[np.ndarray] = field(default_factory=list)


def network(sizes: list[int], seed: np.random.Generator, last: float = 1.0) -> list[np.ndarray]:
    """Alternating matrices and offsets of a network with rectified hidden layers."""
    out: list[np.ndarray] = []
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out += [seed.normal(size=(a, b)) * np.sqrt(2 / a) * (last if k == len(sizes) - 2 else 1.0), np.zeros(b)]
    return out


def forward(p: list[np.ndarray], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What enters each layer, and the output."""
    inputs = [x]
    for k in range(0, len(p) - 2, 2):
        inputs.append(np.maximum(inputs[-1] @ p[k] + p[k + 1], 0))
    return inputs, (inputs[-1] @ p[-2] + p[-1])[:, 0]


def backward(p: list[np.ndarray], inputs: list[np.ndarray], g: np.ndarray) -> list[np.ndarray]:
    """Gradient of sum(g * output) in the parameters."""
    out, d = [], g[:, None]
    for k in reversed(range(len(inputs))):
        out = [inputs[k].T @ d, d.sum(axis=0), *out]
        if k:
            d = (d @ p[2 * k].T) * (inputs[k] > 0)
    return out


def slopes(p: list[np.ndarray], inputs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradient of the output in the input, and in what leaves each layer."""
    d = np.ones((len(inputs[0]), 1))
    leaving = []
    for k in reversed(range(len(inputs))):
        leaving = [d, *leaving]
        d = d @ p[2 * k].T
        if k:
            d = d * (inputs[k] > 0)
    return d, leaving


def slope_penalty(p: list[np.ndarray], inputs: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Sum of max(0, |slope| - 1) ** 2 over the rows, and its gradient in the parameters."""
    s, leaving = slopes(p, inputs)
    size = np.sqrt((s * s).sum(axis=1))
    over = np.maximum(size - 1, 0)
    u = s * (2 * over / np.maximum(size, 1e-12))[:, None]
    out = []
    for k in range(len(inputs)):
        out += [u.T @ leaving[k], np.zeros_like(p[2 * k + 1])]
        if k + 1 < len(inputs):
            u = (u @ p[2 * k]) * (inputs[k + 1] > 0)
    return float((over * over).sum()), out


def _flat(parts: list) -> np.ndarray:
    return np.concatenate([np.ravel(t) for t in parts])


def _like(p: list[np.ndarray], flat: np.ndarray) -> list[np.ndarray]:
    at = np.cumsum([0, *[np.size(t) for t in p]])
    return [flat[a:b].reshape(np.shape(t)) for a, b, t in zip(at, at[1:], p)]


class Adam:
    def __init__(self, p: list[np.ndarray], rate: float, decays: tuple[float, float]) -> None:
        self.rate, self.decays, self.turn = rate, decays, 0
        self.m, self.v = np.zeros(len(_flat(p))), np.zeros(len(_flat(p)))

    def move(self, gradient: np.ndarray) -> np.ndarray:
        """What a step takes off the parameters, laid end to end."""
        (a, b), self.turn = self.decays, self.turn + 1
        self.m *= a
        self.m += (1 - a) * gradient
        self.v *= b
        self.v += (1 - b) * (gradient * gradient)
        return self.rate * (self.m / (1 - a**self.turn) / (np.sqrt(self.v / (1 - b**self.turn)) + 1e-8))

    def step(self, p: list[np.ndarray], gradient: np.ndarray) -> list[np.ndarray]:
        return _like(p, _flat(p) - self.move(gradient))


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    return v.flatten().to_numpy().reshape(len(v), width)


def _terms(objective: str, y: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row's critic loss at weight 1 and its derivative in the critic's output."""
    if objective == WASSERSTEIN:
        sign = np.where(y == 1, -1.0, 1.0)
        return sign * out, sign
    return 0.5 * np.logaddexp(0, np.where(y == 1, -out, out)), 0.5 * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y)


def train(df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], settings: Settings = Settings(), held_out: Column | None = None) -> Trained:
    """Trains on rows (y, truth, reco); rows where ``held_out`` is true only give the validation loss.

    Losses count both classes alike; simulated weights have mean 1. Columns are
    standardized by the simulated training rows; a null or NaN counts as their mean.
    Observed truth enters no step. A class without training rows is an error.
    """
    rows = _kept(df, truth, reco, held_out)
    try:
        return _trained(rows, truth, reco, settings)
    finally:
        rows.unpersist()


def train_and_compare(df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], settings: Settings = Settings(), held_out: Column | None = None) -> tuple[Trained, DataFrame]:
    """``train``, and dim, w1 of every column under the last epoch's weights, from the same kept rows: ``df`` is read once."""
    columns = tuple(dict.fromkeys((*truth, *reco)))
    rows = _kept(df, truth, reco, held_out)
    try:
        trained = _trained(rows, truth, reco, settings)
        g, inputs = _layers(trained.generators[-1]), _Inputs(trained)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for found in blocks.unpack_columns(batches):
                w = np.zeros((2, found.shape[1]))
                cut = int(np.searchsorted(found[0], 2))  # observed rows come last
                w[0, cut:] = 1
                for i in range(0, cut, PIECE):
                    here = slice(i, min(i + PIECE, cut))
                    w[1, here] = np.logaddexp(0, _run(g, inputs.of(found[1:, here])[0])[1])
                yield found[1:].T, w

        got = sorted_areas.kept_areas(rows, read, len(columns), 1)
    finally:
        rows.unpersist()
    return trained, got.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("direction")).alias("dim"), "w1")


def _kept(df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], held_out: Column | None) -> DataFrame:
    """Blocks of 2 y + held out, and all columns as they are; rows of neither class take no part."""
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    part = F.col("y").cast("int") * 2 + held.cast("int")
    return blocks.pack_columns(df.where(F.col("y").cast("int").isin(0, 1)).select(part.alias("_part"), *dict.fromkeys((*truth, *reco)))).persist()


class _Inputs:
    """Standardized columns of a piece of kept rows: truth and reco, each (column, row) with ones in a last row."""

    def __init__(self, trained: Trained) -> None:
        columns = list(trained.scale)
        self.places = [[columns.index(c) for c in chosen] for chosen in (trained.truth, trained.reco)]
        self.mean, self.deviation = (np.array([trained.scale[c][k] for c in columns])[:, None] for k in (0, 1))

    def of(self, found: np.ndarray) -> list[np.ndarray]:
        scaled = (found - self.mean) / self.deviation
        missing = np.isnan(found)
        if missing.any():
            scaled[missing] = 0
        out = []
        for chosen in self.places:
            v = np.ones((len(chosen) + 1, found.shape[1]))
            for i, k in enumerate(chosen):
                v[i] = scaled[k]
            out.append(v)
        return out


def _trained(rows: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], settings: Settings) -> Trained:
    out = Trained(settings, tuple(truth), tuple(reco), _scales(rows, list(dict.fromkeys((*truth, *reco)))))
    seed = np.random.Generator(np.random.PCG64(settings.seed))
    g = network([len(truth), *settings.generator, 1], seed, 0.1)
    g[-1] = np.full(1, np.log(np.e - 1))  # softplus of this is 1
    d = network([len(reco), *settings.critic, 1], seed)
    inputs = _Inputs(out)
    steps = {k: Adam(p, settings.rate, DECAYS[settings.objective]) for k, p in (("g", g), ("d", d))}
    dispersion = DISPERSION[settings.objective] if settings.dispersion is None else settings.dispersion

    def record(fitted: float, kept: float) -> None:
        out.history.append({"epoch": len(out.history) + 1, "critic_loss": fitted, "generator_loss": -fitted, "validation_loss": kept})

    out.generators.append(g)
    for epoch in range(1, settings.epochs + 1):
        for turn in range(settings.critic_steps):
            d, mean, *losses = _critic_step(rows, inputs, settings.objective, g, d, steps["d"])
            if epoch > 1 and not turn:  # these losses are those that the epoch before ended with
                record(*losses)
        g = _generator_step(rows, inputs, settings.objective, g, d, steps["g"], mean, dispersion)
        out.generators.append(g)
    if settings.epochs:
        record(*_critic_step(rows, inputs, settings.objective, g, d, None)[2:])
    out.critic = d
    return out


def _sums(rows: DataFrame, run, piece: int = PIECE) -> dict[tuple[int, bool], np.ndarray]:
    """(y, held out) -> the sum of the vectors that ``run`` gives for pieces of these rows; they lie together in a block."""
    parts = [(0, False), (0, True), (1, False), (1, True)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for found in blocks.unpack_columns(batches):
            cuts = np.searchsorted(found[0], np.arange(len(parts) + 1))
            for m, part in enumerate(parts):
                for i in range(cuts[m], cuts[m + 1], piece):
                    got = run(*part, found[1:, i : min(i + piece, cuts[m + 1])])
                    if got is None:
                        break
                    total[m] = total[m] + got if m in total else got
        yield from learning.vectors(total)

    return {parts[m]: v for m, v in learning.summed(rows.mapInArrow(task, learning.VECTORS)).items()}


def _scales(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each column over the simulated training rows; a constant column has deviation 1."""

    def moments(center: np.ndarray, power: int) -> np.ndarray:
        def run(y: int, held: bool, found: np.ndarray) -> np.ndarray | None:
            if y or held:
                return None
            there = ~np.isnan(found)
            return np.concatenate([there.sum(axis=1), np.where(there, (found - center) ** power, 0).sum(axis=1)]).astype(float)

        got = _sums(rows, run, blocks.BLOCK).get((0, False), np.zeros(2 * len(columns))).reshape(2, -1)
        return got[0], got[1] / np.maximum(got[0], 1)

    counts, mean = moments(np.zeros((len(columns), 1)), 1)
    if not counts.all():
        raise ValueError("no simulated training rows")
    deviation = np.sqrt(moments(mean[:, None], 2)[1])
    return {c: (float(m), 1.0 if s <= 1e-12 * abs(m) else float(s)) for c, m, s in zip(columns, mean, deviation)}  # what rounding leaves of a constant counts as none


def _layers(p: list[np.ndarray]) -> list[np.ndarray]:
    """Each layer as one matrix (output, input), the offsets in its last column."""
    return [np.column_stack([p[k].T, p[k + 1]]) for k in range(0, len(p), 2)]


def _run(a: list[np.ndarray], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``forward`` for rows laid side by side, with ones in the last line of what enters a layer."""
    inputs = [x]
    for m in a[:-1]:
        h = np.empty((len(m) + 1, x.shape[1]))
        np.matmul(m, inputs[-1], out=h[:-1])
        np.maximum(h[:-1], 0, out=h[:-1])
        h[-1] = 1
        inputs.append(h)
    return inputs, a[-1][0] @ inputs[-1]


def _leaving(a: list[np.ndarray], inputs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The output's derivatives in what leaves each layer but the last, and where those layers' units are on."""
    on = [h[:-1] > 0 for h in inputs[1:]]
    out: list[np.ndarray] = []
    for k in reversed(range(len(on))):
        m = a[k + 1][:, :-1].T
        out = [np.multiply(m @ out[0] if out else m, on[k]), *out]
    return out, on


def _gradient(inputs: list[np.ndarray], leaving: list[np.ndarray], g: np.ndarray) -> list[np.ndarray]:
    """``backward``: what leaves a layer moves the one output, so it is scaled by g instead of being followed again."""
    return [*[(h * g) @ d.T for h, d in zip(inputs, leaving)], inputs[-1] @ g]


def _penalty(a: list[np.ndarray], inputs: list[np.ndarray], leaving: list[np.ndarray], on: list[np.ndarray]) -> list[np.ndarray]:
    """The gradient of ``slope_penalty``."""
    first = a[0][:, :-1].T
    s = first @ leaving[0] if leaving else np.repeat(first, inputs[0].shape[1], axis=1)
    size = np.sqrt(np.einsum("ij,ij->j", s, s))
    u = s * (2 * np.maximum(size - 1, 0) / np.maximum(size, 1e-12))
    out = []
    for k, m in enumerate(a):
        if k < len(leaving):
            out += [u @ leaving[k].T, np.zeros(len(m))]
            u = (m[:, :-1] @ u) * on[k]
        else:
            out += [u.sum(axis=1), np.zeros(len(m))]
    return out


def _critic_step(rows: DataFrame, inputs: _Inputs, objective: str, g: list, d: list, step: Adam | None) -> tuple[list, float, float, float]:
    """The critic after one step (as it was without ``step``), the mean raw weight, training and validation loss before it."""
    layers = _layers(g), _layers(d)

    def run(y: int, held: bool, found: np.ndarray) -> np.ndarray:
        z, x = inputs.of(found)
        raw = np.ones(x.shape[1]) if y == 1 else np.logaddexp(0, _run(layers[0], z)[1])
        entering, out = _run(layers[1], x)
        loss, slope = _terms(objective, y, out)
        sums = [np.array([x.shape[1], raw.sum(), raw @ loss])]
        if step is not None and not held:
            leaving, on = _leaving(layers[1], entering)
            sums += _gradient(entering, leaving, raw * slope)
            if objective == WASSERSTEIN:
                sums += _penalty(layers[1], entering, leaving, on)
        return _flat(sums)

    got, size = _sums(rows, run), len(_flat(d))
    (n1, s1, l1), (n0, s0, l0), (k1, t1, h1), (k0, t0, h0) = (got.get((c, held), np.zeros(3))[:3] for held in (False, True) for c in (1, 0))
    if not n1 or not n0:
        raise ValueError("training needs rows of both classes")
    if step is not None:
        a, b = got[1, False], got[0, False]
        gradient = a[3 : 3 + size] / s1 + b[3 : 3 + size] / s0
        if objective == WASSERSTEIN:
            gradient = gradient + GRADIENT_PENALTY * (a[3 + size :] + b[3 + size :]) / (n1 + n0)
        d = step.step(d, gradient)
    return d, s0 / n0, l1 / s1 + l0 / s0, h1 / t1 + h0 / t0 if k1 and k0 else float("nan")


def _generator_step(rows: DataFrame, inputs: _Inputs, objective: str, g: list, d: list, step: Adam, mean: float, dispersion: float) -> list:
    """The generator after a step against the critic; the derivative goes through the mean that divides the weights."""
    layers = _layers(g), _layers(d)

    def run(y: int, held: bool, found: np.ndarray) -> np.ndarray | None:
        if y or held:
            return None
        z, x = inputs.of(found)
        entering, out = _run(layers[0], z)
        w = np.logaddexp(0, out) / mean
        pull = -_terms(objective, 0, _run(layers[1], x)[1])[0] + 2 * dispersion * (w - 1)
        soft = _softplus_slope(out)
        leaving = _leaving(layers[0], entering)[0]
        return _flat([np.array([len(w), w @ pull]), *_gradient(entering, leaving, pull * soft), *_gradient(entering, leaving, soft)])

    got = _sums(rows, run)[0, False]
    n, size = got[0], len(_flat(g))
    return step.step(g, (got[2 : 2 + size] - got[1] / n * got[2 + size :]) / (n * mean))


@dataclass(frozen=True)
class Cell:
    """One of several trainings on the same rows.

    ``member`` gets the arrays of a shard (key, y, columns) and returns how often
    each row counts in this training and whether it is held out.
    """

    member: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]
    seed: int = 0


def _softplus_slope(out: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _batch_shares(g: list, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """What each row of a batch counts in the critic's loss: its raw weight as a share of its class."""
    observed = y == 1
    raw = np.where(observed, 1.0, np.logaddexp(0, forward(g, z)[1]))
    return raw / np.where(observed, raw[observed].sum(), raw[~observed].sum())


def _batch_critic(objective: str, share: np.ndarray, d: list, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The critic's gradient on one batch; both classes count alike."""
    inputs, out = forward(d, x)
    slope = np.where(y == 1, -1.0, 1.0) if objective == WASSERSTEIN else 0.5 * (_softplus_slope(out) - y)
    gradient = _flat(backward(d, inputs, slope * share))
    if objective == WASSERSTEIN:
        gradient = gradient + GRADIENT_PENALTY * _flat(slope_penalty(d, inputs)[1]) / len(y)
    return gradient


def _batch_generator(objective: str, g: list, d: list, z: np.ndarray, x: np.ndarray, dispersion: float) -> np.ndarray:
    """The generator's gradient on the simulated rows of one batch."""
    inputs, out = forward(g, z)
    raw = np.logaddexp(0, out)
    mean = raw.mean()
    w = raw / mean
    pull = -_terms(objective, 0, forward(d, x)[1])[0] + 2 * dispersion * (w - 1)
    soft = _softplus_slope(out)
    return (_flat(backward(g, inputs, pull * soft)) - (w * pull).mean() * _flat(backward(g, inputs, soft))) / (len(z) * mean)


def train_cells(df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], cells: dict[int, Cell], settings: Settings = Settings(), batch: int = 512, key: str = "row_id", shard_rows: int = learning.SHARD_ROWS) -> dict[int, Trained]:
    """Every cell's training on rows (key, y, truth, reco), in shuffled batches, one pass an epoch for all of them.

    Batches are drawn in each shard from a permutation seeded by cell, epoch and
    shard; a row that counts several times comes several times. Results depend on
    the rows, not on their files or partitions. Columns are standardized by the
    simulated rows of the whole table, alike in all cells; a null counts as their
    mean. Observed truth isn't read. No rows of a class in a cell is an error.
    """
    cols = list(dict.fromkeys((*truth, *reco)))
    stats = df.where(F.col("y") == 0).agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if stats["m0"] is None:
        raise ValueError("no simulated rows")
    scale = {c: (float(stats[f"m{i}"]), float(stats[f"s{i}"] or 1.0)) for i, c in enumerate(cols)}
    names = {c: f"z{i}" for i, c in enumerate(truth)}, {c: f"x{i}" for i, c in enumerate(reco)}
    rows = df.select(F.col(key).alias("id"), "y", *[F.when(F.col("y") == 0, F.col(c)).alias(n) for c, n in names[0].items()], *[F.col(c).alias(n) for c, n in names[1].items()])
    shards = learning.sharded(rows, "id", ("y", *names[0].values(), *names[1].values()), shard_rows).persist()
    dispersion = DISPERSION[settings.objective] if settings.dispersion is None else settings.dispersion
    split = 2 * (len(settings.generator) + 1)
    models, out = {}, {}
    for m, cell in cells.items():
        rng = np.random.Generator(np.random.PCG64(cell.seed))
        g = network([len(truth), *settings.generator, 1], rng, 0.1)
        g[-1] = np.full(1, np.log(np.e - 1))
        models[m] = [*g, *network([len(reco), *settings.critic, 1], rng)]
        out[m] = Trained(settings, tuple(truth), tuple(reco), scale, generators=[g])

    def inputs_of(data: dict[str, np.ndarray], chosen: dict[str, str]) -> np.ndarray:
        return np.nan_to_num(np.column_stack([(data[n] - scale[c][0]) / scale[c][1] for c, n in chosen.items()]), nan=0.0)

    try:
        for epoch in range(settings.epochs + 1):

            def step(m: int, p: list[np.ndarray], shard: int, data: dict[str, np.ndarray]):
                g, d = p[:split], p[split:]
                y, z, x = data["y"], inputs_of(data, names[0]), inputs_of(data, names[1])
                times, held = cells[m].member(data)
                raw = np.where(y == 1, 1.0, np.logaddexp(0, forward(g, z)[1]))
                loss = _terms(settings.objective, y, forward(d, x)[1])[0]
                more = np.array([(v * times * (y == c) * keep).sum() for keep in (~held, held) for c in (1, 0) for v in (np.ones(len(y)), raw, raw * loss)])
                mine = np.repeat(np.flatnonzero(~held), times[~held])
                if epoch == settings.epochs or not len(mine):
                    return 0.0, p, more
                steps = {k: Adam(q, settings.rate, DECAYS[settings.objective]) for k, q in (("g", g), ("d", d))}
                flat_g, flat_d = _flat(g), _flat(d)
                g, d = _like(g, flat_g), _like(d, flat_d)  # views, so that a step needs no new parameters
                for b in learning.batches(len(mine), batch, np.random.default_rng([cells[m].seed, epoch, shard])):
                    i = mine[b]
                    yi, zi, xi = y[i], z[i], x[i]
                    mc = yi == 0
                    if mc.all() or not mc.any():
                        continue
                    share = _batch_shares(g, yi, zi)
                    for _ in range(settings.critic_steps):
                        flat_d -= steps["d"].move(_batch_critic(settings.objective, share, d, yi, xi))
                    flat_g -= steps["g"].move(_batch_generator(settings.objective, g, d, zi[mc], xi[mc], dispersion))
                return float(len(mine)), [*g, *d], more

            for m, (new, more) in learning.averaged_pass(shards, models, step).items():
                (n1, s1, l1), (n0, s0, l0), (k1, t1, h1), (k0, t0, h0) = more.reshape(4, 3)
                if not n1 or not n0:
                    raise ValueError("training needs rows of both classes")
                if epoch:
                    fitted = l1 / s1 + l0 / s0
                    out[m].history.append({"epoch": epoch, "critic_loss": fitted, "generator_loss": -fitted, "validation_loss": h1 / t1 + h0 / t0 if k1 and k0 else float("nan")})
                if epoch < settings.epochs:
                    models[m] = new
                    out[m].generators.append(new[:split])
                out[m].critic = models[m][split:]
    finally:
        shards.unpersist()
    return out


def train_batched(df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], settings: Settings = Settings(), held_out: float = 0.0, batch: int = 512, key: str = "row_id", shard_rows: int = learning.SHARD_ROWS) -> Trained:
    """One training in batches; a part ``held_out`` of the keys only gives the validation loss."""

    def member(data: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(data["y"]), np.int64), learning.uniform(data["key"], settings.seed, "held") < held_out

    return train_cells(df, truth, reco, {0: Cell(member, settings.seed)}, settings, batch, key, shard_rows)[0]


@dataclass
class Selection:
    """The epoch of least kernel distance on validation rows, and what it and unit weights reach on test rows."""

    epoch: int
    curve: list[dict]
    test: dict
    unweighted: dict


def select(validation: DataFrame, test: DataFrame, trained: Trained, columns: tuple[str, ...], size: int = mmd.SUBSAMPLE, seed: int = 0) -> Selection:
    """Chooses among all epochs on ``validation`` and scores the chosen one again on ``test``, with its own bandwidth.

    Both are (row_id, y, ..) frames without common rows; the choice isn't made on
    the rows that judge it.
    """
    curve = kernel_curve(validation, trained, columns, size, seed)
    epoch = mmd.select_epoch(curve)
    scored = Trained(trained.settings, trained.truth, trained.reco, trained.scale, trained.history, [trained.generators[epoch]], trained.critic)
    ones = [np.zeros_like(t) for t in trained.generators[epoch]]
    plain = Trained(trained.settings, trained.truth, trained.reco, trained.scale, [], [ones], trained.critic)  # a constant: weights of 1
    got, unit = (kernel_curve(test, t, columns, size, seed)[0] for t in (scored, plain))
    return Selection(epoch, curve, {**got, "epoch": epoch}, unit)


def _vector(trained: Trained, columns: tuple[str, ...], where: Column | None = None) -> Column:
    scaled = [(F.col(c).cast("double") - trained.scale[c][0]) / trained.scale[c][1] for c in columns]
    return F.array(*[F.coalesce(s if where is None else F.when(where, s), F.lit(0.0)) for s in scaled])


def _scorer(p: list[np.ndarray]):
    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        return pa.array(forward(p, _matrix(v, len(p[0])))[1])

    return score


def weigh(df: DataFrame, trained: Trained, epoch: int | None = None) -> DataFrame:
    """``df`` with w: the weights of an epoch (the last by default), of mean 1 over simulated rows; 1 for observed ones."""
    score = _scorer(trained.generators[-1 if epoch is None else epoch])(_vector(trained, trained.truth, F.col("y") == 0))
    raw = df.drop("w").withColumn("w", score).withColumn("w", F.when(F.col("y") == 0, F.greatest("w", F.lit(0.0)) + F.log1p(F.exp(-F.abs("w")))))
    mean = raw.agg(F.avg("w").alias("_m"))  # one row: NULL where y = 1
    return raw.crossJoin(F.broadcast(mean)).withColumn("w", F.coalesce(F.col("w") / F.col("_m"), F.lit(1.0))).drop("_m")


def judged(df: DataFrame, trained: Trained) -> DataFrame:
    """``df`` with score, the last critic's output, and slope_<column>, its derivatives in the detector columns."""
    p, scale = trained.critic, np.array([trained.scale[c][1] for c in trained.reco])

    @F.arrow_udf("array<double>")
    def judge(v: pa.Array) -> pa.Array:
        inputs, out = forward(p, _matrix(v, len(p[0])))
        both = np.column_stack([out, slopes(p, inputs)[0] / scale])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * both.shape[1], pa.int32()), pa.array(both.ravel()))

    got = df.withColumn("_j", judge(_vector(trained, trained.reco)))
    return got.withColumns({"score": F.get("_j", F.lit(0)), **{f"slope_{c}": F.get("_j", F.lit(i + 1)) for i, c in enumerate(trained.reco)}}).drop("_j")


def history_table(spark: SparkSession, trained: Trained) -> DataFrame:
    """epoch, critic_loss, generator_loss, validation_loss (NaN without held-out rows of both classes)."""
    return spark.createDataFrame([tuple(float(v) if k != "epoch" else v for k, v in h.items()) for h in trained.history], "epoch int, critic_loss double, generator_loss double, validation_loss double")


def parameter_table(spark: SparkSession, trained: Trained) -> DataFrame:
    """epoch, field, value of the generator's parameters; fields are named layer:index."""
    rows = [(e, f"{k}:{i}", float(v)) for e, p in enumerate(trained.generators) for k, t in enumerate(p) for i, v in enumerate(np.ravel(t))]
    return spark.createDataFrame(rows, "epoch int, field string, value double")


def restored(trained: Trained, parameters: DataFrame, epoch: int) -> Trained:
    """``trained`` with one generator, read back from a parameter table."""
    flat = {r["field"]: r["value"] for r in parameters.where(F.col("epoch") == epoch).select("field", "value").collect()}  # one row a parameter
    g = [np.array([flat[f"{k}:{i}"] for i in range(np.size(t))]).reshape(np.shape(t)) for k, t in enumerate(trained.generators[0])]
    return Trained(trained.settings, trained.truth, trained.reco, trained.scale, trained.history, [g], trained.critic)


def kernel_curve(df: DataFrame, trained: Trained, columns: tuple[str, ...], size: int = mmd.SUBSAMPLE, seed: int = 0) -> list[dict]:
    """The kernel distance on ``columns`` (detector level to select, truth level to diagnose) of each epoch's weights.

    Taken on a subsample of (row_id, y, ..) of a stated size a class.
    """
    some = sampling.small_subsample(df.drop("w").withColumn("w", F.lit(1.0)), size, seed).persist()
    try:
        data, mc = some.where("y = 1"), some.where("y = 0")
        cache = mmd.prepare(data, mc, columns, mmd.median_bandwidth(data, columns))
        z = np.array([r["z"] for r in mc.select("row_id", _vector(trained, trained.truth).alias("z")).orderBy("row_id").collect()])  # a subsample
        ids = [r["row_id"] for r in mc.select("row_id").orderBy("row_id").collect()]
        place = {k: i for i, k in enumerate(ids)}
        order = [place[k] for k in cache.ids]
        return [{"epoch": e, **mmd.weighted_mmd2(cache, np.logaddexp(0, forward(p, z)[1])[order])} for e, p in enumerate(trained.generators)]
    finally:
        some.unpersist()
