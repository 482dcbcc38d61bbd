"""Kernel two-sample distance with weights, on subsamples of a stated size.

A subsample is the first m rows in hash order, so its points are a broadcast of
bounded size. The sums over all pairs of points are taken by tasks, a block of
rows against all points at a time; no pair is ever a row, and the driver adds up
one number a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBSAMPLE = 16_384
# The widths around the median one.
BRACKET = (0.5, 2**-0.5, 1.0, 2**0.5, 2.0)
COLLAPSED = 1e-6


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d += (a[:, i, None] - b[None, :, i]) ** 2
    return d


def kernel(d2: np.ndarray, widths: tuple[float, ...]) -> np.ndarray:
    """The sum of Gaussian kernels of all widths."""
    return sum(np.exp(-d2 / (2 * s * s)) for s in widths)


def bracket_kernel(d2: np.ndarray, bandwidth: float) -> np.ndarray:
    """``kernel`` of the bracket around a bandwidth: its exponents are 1, 2, 4, 8 and 16 times the widest one's."""
    e = np.exp(d2 / (-8 * bandwidth * bandwidth))
    out = e.copy()
    for _ in BRACKET[1:]:
        e *= e
        out += e
    return out


def _points(df: DataFrame, columns: tuple[str, ...]) -> pa.Table:
    """u, row_id, w of a subsample."""
    w = F.col("w").cast("double") if "w" in df.columns else F.lit(1.0)
    return df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("u"), "row_id", w.alias("w")).orderBy("row_id").toArrow()


def _matrix(points: pa.Table) -> np.ndarray:
    return points["u"].combine_chunks().flatten().to_numpy().reshape(points.num_rows, -1)


def _over_blocks(spark: SparkSession, n: int, work: Callable[[int, int], list[tuple[float, float]]], block: int) -> DataFrame:
    """at, x, y: what ``work`` gives for each block of the rows 0 to n."""
    blocks = -(-n // block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                got = work(i * block, min(n, (i + 1) * block))
                x, y = zip(*got) if got else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int64()), pa.array(x, pa.float64()), pa.array(y, pa.float64())], names=["at", "x", "y"])

    return spark.range(0, blocks, 1, max(1, min(blocks, 256))).mapInArrow(run, "at long, x double, y double")


def median_bandwidth(sample: DataFrame, columns: tuple[str, ...], block: int = 256, bins: int = 1 << 16) -> float:
    """sqrt(median of the squared distances of all pairs / 2), the diagonal among them.

    Tasks count the distances in bins; those of the bins that hold the middle
    are counted value by value.
    """
    u = _matrix(_points(sample, columns))
    spark = sample.sparkSession
    n = len(u) ** 2
    if not n:
        return float("nan")
    shared = spark.sparkContext.broadcast(u)
    top = float(((u.max(axis=0) - u.min(axis=0)) ** 2).sum()) or 1.0
    middle = {(n - 1) // 2, n // 2}

    def bin_of(d2: np.ndarray) -> np.ndarray:
        return np.minimum((d2 * (bins / top)).astype(np.int64), bins - 1)

    def count(a: int, b: int) -> list[tuple[float, float]]:
        c = np.bincount(bin_of(squared_distances(shared.value[a:b], shared.value)).ravel(), minlength=bins)
        at = np.flatnonzero(c)
        return list(zip(at.astype(float).tolist(), c[at].astype(float).tolist()))

    got = _over_blocks(spark, len(u), count, block).groupBy("x").agg(F.sum("y").alias("y")).orderBy("x").toArrow()  # at most ``bins`` rows
    at, upto = got["x"].to_numpy().astype(np.int64), got["y"].to_numpy().cumsum()
    where = {k: int(np.searchsorted(upto, k, side="right")) for k in middle}
    wanted = sorted({int(at[i]) for i in where.values()})

    def values(a: int, b: int) -> list[tuple[float, float]]:
        d2 = squared_distances(shared.value[a:b], shared.value).ravel()
        v, c = np.unique(d2[np.isin(bin_of(d2), wanted)], return_counts=True)
        return list(zip(v.tolist(), c.astype(float).tolist()))

    got = _over_blocks(spark, len(u), values, block).groupBy("x").agg(F.sum("y").alias("y")).orderBy("x").toArrow()  # of one or two bins
    first = min(where.values())
    start = upto[first - 1] if first else 0.0
    v, upto = got["x"].to_numpy(), got["y"].to_numpy().cumsum() + start
    middle_values = [v[int(np.searchsorted(upto, k, side="right"))] for k in sorted(middle)]
    return float(np.sqrt(np.mean(middle_values) / 2))


def widths(bandwidth: float) -> tuple[float, ...]:
    return tuple(bandwidth * f for f in BRACKET)


@dataclass
class Cache:
    """What stays when only weights change: the data's scalar, the simulated points and their mean kernels with the data."""

    spark: SparkSession
    data: float
    points: np.ndarray
    ids: list[str]
    weights: np.ndarray
    cross: np.ndarray
    bandwidth: float
    block: int


def prepare(data: DataFrame, simulated: DataFrame, columns: tuple[str, ...], bandwidth: float, block: int = 256) -> Cache:
    """Kernel terms of two subsamples with (row_id, columns, w)."""
    spark = data.sparkSession
    mc = _points(simulated, columns)
    x, y = _matrix(_points(data, columns)), _matrix(mc)
    shared = spark.sparkContext.broadcast((x, y))

    def within(a: int, b: int) -> list[tuple[float, float]]:
        x = shared.value[0]
        return [(float(bracket_kernel(squared_distances(x[a:b], x), bandwidth).sum()), 0.0)]

    def means(a: int, b: int) -> list[tuple[float, float]]:
        x, y = shared.value
        return list(zip(range(a, b), bracket_kernel(squared_distances(y[a:b], x), bandwidth).mean(axis=1).tolist()))

    m = len(x)
    own = len(BRACKET)  # the kernel of a point with itself
    total = sum(r["x"] for r in _over_blocks(spark, m, within, block).collect())  # one number a block
    got = _over_blocks(spark, len(y), means, block).toArrow()  # one number a point
    cross = np.zeros(len(y))
    cross[got["x"].to_numpy().astype(np.int64)] = got["y"].to_numpy()
    return Cache(spark, (total - own * m) / (m * (m - 1)), y, mc["row_id"].to_pylist(), mc["w"].to_numpy(), cross, bandwidth, block)


def weighted_mmd2(cache: Cache, weights: np.ndarray | None = None) -> dict:
    """mmd2 and ess of the simulated points under weights (their own by default); infinite where one point has all the weight."""
    w = cache.weights if weights is None else weights
    w = w / w.sum()
    cross = float(w @ cache.cross)
    left = 1 - float(w @ w)
    ess = 1 / float(w @ w)
    if left <= COLLAPSED:
        return {"mmd2": float("inf"), "ess": ess, "data": cache.data, "cross": cross}
    shared, bandwidth = cache.spark.sparkContext.broadcast((cache.points, w)), cache.bandwidth

    def within(a: int, b: int) -> list[tuple[float, float]]:
        y, w = shared.value
        return [(float(w[a:b] @ (bracket_kernel(squared_distances(y[a:b], y), bandwidth) @ w)), 0.0)]

    total = sum(r["x"] for r in _over_blocks(cache.spark, len(w), within, cache.block).collect()) - len(BRACKET) * float(w @ w)
    return {"mmd2": cache.data + total / left - 2 * cross, "ess": ess, "data": cache.data, "cross": cross}


def curve(cache: Cache, history: DataFrame) -> list[dict]:
    """weighted_mmd2 for each epoch of (epoch, row_id, w); points without a weight have none."""
    place = {k: i for i, k in enumerate(cache.ids)}
    known = cache.spark.createDataFrame(list(place.items()), "row_id string, at int")  # a subsample
    rows = history.join(F.broadcast(known), "row_id").groupBy("epoch").agg(F.collect_list(F.struct("at", "w")).alias("ws")).orderBy("epoch")
    out = []
    for r in rows.toLocalIterator():
        w = np.zeros(len(cache.ids))
        for x in r["ws"]:
            w[x["at"]] = x["w"]
        out.append({"epoch": r["epoch"], **weighted_mmd2(cache, w)})
    return out


def select_epoch(points: list[dict]) -> int:
    """The first epoch of the least value."""
    return min(points, key=lambda p: (p["mmd2"], p["epoch"]))["epoch"]
