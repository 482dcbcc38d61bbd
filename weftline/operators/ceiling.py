"""What any reweighting could reach, and what one has reached: loss floor, oracle, audit, criterion; null calibration of a response test.

Every classifier judges rows that it wasn't fitted on: rows are dealt into folds
by a hash of their key, and the classifier of a fold is fitted on all other folds
but one, which decides when it stops. The classifiers of all folds and diagnostics
are trained in the same scans, and losses, shares and distances come from the same
shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import learning, mmd, sampling, weights
from weftline.operators.sorted_areas import Masses, kept_areas
from weftline.operators.training import forward

LOG2 = float(np.log(2.0))
FOLDS = 5


def _once(make: Callable[[learning.Arrays], object]) -> Callable:
    """``make``, computed once for arrays that are asked about several times in a row."""
    held: dict = {}

    def get(data: learning.Arrays):
        if held.get("of") is not data:
            held.update(of=data, value=make(data))
        return held["value"]

    return get


def fold_of(key: np.ndarray, folds: int, seed: int) -> np.ndarray:
    return np.minimum((learning.uniform(key, seed, "fold") * folds).astype(np.int64), folds - 1)


def cross_fitted(
    shards: DataFrame, named: dict[str, tuple[tuple[str, ...], Callable[[learning.Arrays], tuple[np.ndarray, np.ndarray]]]], folds: int = FOLDS, seed: int = 0, settings: learning.Settings = learning.Settings()
) -> dict[str, list[learning.Fit]]:
    """name -> one classifier a fold, from name -> (columns, arrays of a shard to labels and weights)."""
    if folds < 3:
        raise ValueError("a fold to judge, one to stop and one to fit are needed")

    fold_once = _once(lambda data: fold_of(data["key"], folds, seed))
    named = {name: (columns, _once(means)) for name, (columns, means) in named.items()}

    def task(columns: tuple[str, ...], means, k: int) -> learning.Task:
        def weigh(data: learning.Arrays):
            label, weight = means(data)
            fold = fold_once(data)
            return label, np.where(fold == k, 0.0, weight), fold == (k + 1) % folds

        return learning.Task(columns, weigh, seed * 1000 + k)

    places = [(name, k) for name in named for k in range(folds)]
    got = learning.fit_all(shards, {i: task(*named[name], k) for i, (name, k) in enumerate(places)}, settings)
    return {name: [got[i] for i, (n, _) in enumerate(places) if n == name] for name in named}


def judged_output(data: learning.Arrays, fits: list[learning.Fit], folds: int, seed: int) -> np.ndarray:
    """Each row's output (log odds) by its own fold's classifier."""
    fold = fold_of(data["key"], folds, seed)
    out = np.zeros(len(fold))
    for k, f in enumerate(fits):
        i = np.flatnonzero(fold == k)
        out[i] = forward(f.parameters, learning._inputs({c: data[c][i] for c in f.columns}, f.columns, f.scale))[1]
    return out


def _ratio(out: np.ndarray, clip: float = 1e-6) -> np.ndarray:
    """``weights.likelihood_ratio`` of log odds."""
    p = np.clip(1 / (1 + np.exp(-np.clip(out, -30, 30))), clip, 1 - clip)
    return p / (1 - p)


def diagnostics(
    df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], weight: str = "w", folds: int = FOLDS, seed: int = 0, settings: learning.Settings = learning.Settings(),
    size: int = mmd.SUBSAMPLE, shard_rows: int = learning.SHARD_ROWS,
) -> DataFrame:
    """diagnostic, level, quantity, value for rows (row_id, y, truth of both samples, reco, weight).

    * ``floor``: the loss of a fresh classifier between the samples at detector
      level, and its signal, log 2 less that.
    * ``oracle``: weights from the likelihood ratio of truth, their effective
      share, and each column's W1 without and with them, at both levels.
    * ``audit``: the same classifier against the candidate weights, the signal
      that it still finds and the part of the floor's that the weights removed.
    * ``criterion``: the kernel distance under unit, oracle and candidate weights
      at both levels, on a subsample of ``size`` a class.

    Classes weigh alike in every loss. Nulls count as a column's mean in
    classifiers and are left out of distances. The scale of the candidate weights
    doesn't matter. The table is read three times: to count it, to deal it into
    shards, and for the subsample.
    """
    df = df.select("row_id", "y", F.when(F.col("y") == 0, F.col(weight).cast("double")).otherwise(1.0).alias("w"), *dict.fromkeys((*truth, *reco)))
    shards = learning.sharded(df, "row_id", ("y", "w", *dict.fromkeys((*truth, *reco))), shard_rows).persist()
    try:
        counts = learning.sums(shards, lambda _, d: {0: np.array([(d["y"] == 1).sum(), (d["y"] == 0).sum(), d["w"][d["y"] == 0].sum()], float)}).get(0, np.zeros(3))
        n1, n0, total = counts
        if not n1 or not n0 or not total > 0:
            raise ValueError("rows of both classes and positive weights are needed")

        def even(d):
            return d["y"], np.where(d["y"] == 1, 0.5 / n1, 0.5 / n0) * (n1 + n0)

        def candidate(d):
            return d["y"], np.where(d["y"] == 1, 0.5 / n1, 0.5 * d["w"] / total) * (n1 + n0)

        named = {"floor": (reco, even), "oracle": (truth, even), "audit": (reco, candidate)}
        fits = cross_fitted(shards, named, folds, seed, settings)

        def losses(_: int, d: learning.Arrays) -> dict[int, np.ndarray]:
            out = []
            for name, (_, means) in named.items():
                y, w = means(d)
                judged = judged_output(d, fits[name], folds, seed)
                out += [(w * learning.log_loss(y, judged)).sum(), w.sum()]
                if name == "oracle":
                    spread = [v for u in (_ratio(judged)[y == 0], d["w"][y == 0]) for v in (u.sum(), (u * u).sum())]
            return {0: np.array([*out, *spread])}

        got = learning.sums(shards, losses)[0]
        loss = {name: float(a / b) for name, (a, b) in zip(named, got[: 2 * len(named)].reshape(-1, 2))}
        share = {name: float(a * a / b / n0) for name, (a, b) in zip(("oracle", "w"), got[2 * len(named) :].reshape(-1, 2))}  # effective
        columns = tuple(dict.fromkeys((*truth, *reco)))
        table = np.array([[0.0, 0, 1, 0], [1, 1, 0, 0], [0, 0, 0, 0]])  # simulated, observed, neither: unit and oracle weights; a simulated row's oracle weight is its own

        def read(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    d = learning._arrays(batch, row)
                    own = np.where(d["y"] == 0, _ratio(judged_output(d, fits["oracle"], folds, seed)), 0.0)
                    yield np.column_stack([d[c] for c in columns]), Masses(len(own), {3: own}, np.where(d["y"] == 0, 0, np.where(d["y"] == 1, 1, 2)), table)

        w1 = {(r["weight"], columns[r["direction"]]): r["w1"] for r in kept_areas(shards.withColumn("rows", F.size("key")), read, len(columns), 2).collect()}  # one row a column and weight
    finally:
        shards.unpersist()

    key = F.xxhash64("row_id")

    def scored(part: DataFrame) -> DataFrame:
        judged = part.withColumn("_p", learning.probabilities(fits["oracle"])).withColumn("_fold", _fold_column(key, folds, seed))
        ratio = weights.likelihood_ratio(F.get("_p", F.col("_fold")), 1e-6)
        return judged.withColumn("oracle", F.when(F.col("y") == 0, ratio).otherwise(1.0)).drop("_p", "_fold").withColumn("unit", F.lit(1.0))

    rows = [
        ("floor", "detector", "loss", loss["floor"]), ("floor", "detector", "signal", LOG2 - loss["floor"]),
        ("audit", "detector", "loss", loss["audit"]), ("audit", "detector", "signal", LOG2 - loss["audit"]),
        ("audit", "detector", "removed", 1 - (LOG2 - loss["audit"]) / (LOG2 - loss["floor"]) if loss["floor"] != LOG2 else float("nan")),
        ("oracle", "particle", "loss", loss["oracle"]),
    ]
    rows += [("oracle", "particle", "share", share["oracle"]), ("audit", "particle", "share", share["w"])]
    level = {c: "particle" if c in truth else "detector" for c in columns}
    rows += [("oracle", level[c], f"w1 {c} {name}", float(w1[j, c])) for j, name in enumerate(("unit", "oracle")) for c in columns]
    some = scored(sampling.subsample_of_known(df, size, seed, {1: int(n1), 0: int(n0)})).persist()
    try:
        for place, chosen in (("detector", reco), ("particle", truth)):
            data, mc = (some.where(f"y = {c}").na.drop(subset=list(chosen)) for c in (1, 0))
            width = mmd.median_bandwidth(data, chosen)
            for name, label in (("unit", "unweighted"), ("oracle", "oracle"), ("w", "candidate")):
                cache = mmd.prepare(data.withColumn("w", F.lit(1.0)), mc.withColumn("w", F.col(name)), chosen, width)
                rows.append(("criterion", place, label, float(mmd.weighted_mmd2(cache)["mmd2"])))
    finally:
        some.unpersist()
    return df.sparkSession.createDataFrame(rows, "diagnostic string, level string, quantity string, value double")


def _fold_column(key: Column, folds: int, seed: int) -> Column:
    @F.arrow_udf("int")
    def fold(k: pa.Array) -> pa.Array:
        return pa.array(fold_of(k.to_numpy(), folds, seed).astype(np.int32))

    return fold(key)


def null_calibration(
    df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], repeats: int = 10, strength: float = 1.0, seed: int = 0, settings: learning.Settings = learning.Settings(), shard_rows: int = learning.SHARD_ROWS
) -> DataFrame:
    """source, repeat, nats, se: the response statistic where there is nothing to find.

    Each source (1: observed, 0: simulated) is parted ``repeats`` times into two
    pseudo-domains, by chance with odds that follow a random direction of truth:
    given truth, detector columns then tell nothing. Two nested classifiers, on
    truth and on truth with detector columns, are fitted to every parting, and
    ``nats`` is the second's gain on rows that neither was fitted on. All
    2 x sources x repeats classifiers share their scans. ``se`` is stratified by
    domain.
    """
    columns = tuple(dict.fromkeys((*truth, *reco)))
    shards = learning.sharded(df.select("row_id", "y", *columns), "row_id", ("y", *columns), shard_rows).persist()
    try:
        scale = learning.scales(shards, truth)
        places = [(source, repeat) for source in (1, 0) for repeat in range(repeats)]

        def domain(d: learning.Arrays, source: int, repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Domain, membership and part (0 fit, 1 stop, 2 judge) of every row."""
            direction = np.random.default_rng([seed, source, repeat]).normal(size=len(truth))
            mine = np.flatnonzero(d["y"] == source)  # the others take no part
            key = d["key"][mine]
            z = learning._inputs({c: d[c][mine] for c in truth}, truth, scale) @ (direction / np.linalg.norm(direction))
            label, member, part = np.zeros(len(d["y"])), np.zeros(len(d["y"])), np.full(len(d["y"]), 2)
            label[mine] = learning.uniform(key, seed, "domain", source, repeat) < 1 / (1 + np.exp(-strength * z))
            member[mine] = 1
            part[mine] = np.searchsorted([0.5, 0.65], learning.uniform(key, seed, "part", source, repeat), side="right")
            return label, member, part

        sizes = learning.sums(shards, lambda _, d: {i: np.array([(m * (y == c) * (part == k)).sum() for k in range(3) for c in (1, 0)]) for i, (y, m, part) in ((i, domain(d, *p)) for i, p in enumerate(places))})

        def weighed(i: int) -> Callable:
            def weigh(d: learning.Arrays):
                y, m, part = domain(d, *places[i])
                n = sizes[i].reshape(3, 2)[:2].sum(axis=0)
                return y, m * (part < 2) * np.where(y == 1, 1 / max(n[0], 1), 1 / max(n[1], 1)) * n.sum() / 2, part == 1

            return weigh

        parted = [weighed(i) for i in range(len(places))]  # one for both classifiers of a parting
        tasks = {2 * i + wide: learning.Task(columns if wide else truth, parted[i], seed * 7919 + 2 * i + wide) for i in range(len(places)) for wide in (0, 1)}
        fits = learning.fit_all(shards, tasks, settings)

        def gains(_: int, d: learning.Arrays) -> dict[int, np.ndarray]:
            out = {}
            for i, p in enumerate(places):
                y, m, part = domain(d, *p)
                mine = np.flatnonzero((m > 0) & (part == 2))
                at = {c: d[c][mine] for c in columns}
                gain = np.subtract(*[learning.log_loss(y[mine], forward(f.parameters, learning._inputs(at, f.columns, f.scale))[1]) for f in (fits[2 * i], fits[2 * i + 1])])
                out[i] = np.array([v[y[mine] == c].sum() for c in (1, 0) for v in (np.ones(len(mine)), gain, gain * gain)])
            return out

        rows = []
        for i, v in learning.sums(shards, gains).items():
            by = v.reshape(2, 3)
            n, mean = by[:, 0], by[:, 1] / np.maximum(by[:, 0], 1)
            var = (by[:, 2] - n * mean**2) / np.maximum(n - 1, 1)
            rows.append((*places[i], float(mean.mean()), float(np.sqrt((var / np.maximum(n, 1)).sum()) / 2)))
    finally:
        shards.unpersist()
    return df.sparkSession.createDataFrame(rows, "source int, repeat int, nats double, se double")
