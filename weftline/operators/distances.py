"""Distances between an observed and a simulated sample, one row per dimension.

Inputs are long tables (dim, y, w, v). Only the simulated side is weighted:
pass w = 1 where y = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.expressions import hash_key, improvement
from weftline.operators import blocks, learning, sampling
from weftline.operators.binning import histogram, stretch_cuts, stretch_levels, with_stretch
from weftline.operators.sorted_areas import Masses, areas, kept_areas
from weftline.sources.populations import long


def wasserstein(long: DataFrame, by: tuple[str, ...] = ("dim",), merge: bool = True) -> DataFrame:
    """by, w1: the area between the two distribution functions.

    Running sums go over value stretches: the stretches' sums give each its
    start, so no window spans a dimension. Stretches are cut at approximate
    quantiles, so each has about ``binning.STRETCH`` rows however the values are
    distributed. Equal values are merged before the rows are dealt out, unless
    ``merge`` is off: for projections, which hardly ever repeat, that saves a
    shuffle of all rows.
    """
    y = F.col("y")
    a, b = F.when(y == 1, F.col("w")).otherwise(0.0), F.when(y == 0, F.col("w")).otherwise(0.0)
    largest = long.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = stretch_levels(largest)
    total = long.groupBy(*by).agg(F.sum(a).alias("ta"), F.sum(b).alias("tb"), stretch_cuts("v", levels).alias("_cuts"))
    net = with_stretch(long.join(F.broadcast(total), [*by]), "v", levels)  # one row a dimension
    net = net.select(*by, "v", "_stretch", (a / F.col("ta") - b / F.col("tb")).alias("m"))
    if merge:
        net = net.groupBy(*by, "_stretch", "v").agg(F.sum("m").alias("m"))
    whole = Window.partitionBy(*by).orderBy("_stretch")
    starts = net.groupBy(*by, "_stretch").agg(F.sum("m").alias("m"), F.min("v").alias("first")).select(
        *by, "_stretch", F.coalesce(F.sum("m").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.lead("first").over(whole).alias("then")
    )
    inside = Window.partitionBy(*by, "_stretch").orderBy("v")
    steps = net.join(F.broadcast(starts), [*by, "_stretch"]).select(  # at most binning.MOST_STRETCHES rows a dimension
        *by,
        (F.col("before") + F.sum("m").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))).alias("height"),
        (F.coalesce(F.lead("v").over(inside), F.col("then")) - F.col("v")).alias("width"),
    )
    return steps.groupBy(*by).agg(F.coalesce(F.sum(F.abs(F.col("height")) * F.col("width")), F.lit(0.0)).alias("w1"))


def js_and_triangular(long: DataFrame, bins: int = 100) -> DataFrame:
    """dim, js, triangular from one histogram; js is NaN if a sample has no weight."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2

    def part(a):
        return F.when(a > 0, a * F.log(a / m)).otherwise(0.0)

    return histogram(long, bins).groupBy("dim").agg(
        F.when((F.sum("p") > 0) & (F.sum("q") > 0), (F.sum(part(p)) + F.sum(part(q))) / 2).otherwise(F.lit(float("nan"))).alias("js"),
        F.sum(F.when(p + q > 0, (p - q) * (p - q) / (p + q)).otherwise(0.0)).alias("triangular"),
    )


def metric_set(long: DataFrame, bins: int = 100) -> DataFrame:
    """dim, metric, value for all three metrics."""
    return _by_metric(wasserstein(long).join(js_and_triangular(long, bins), "dim"))


def _by_metric(both: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, c in (("wasserstein", "w1"), ("jensen_shannon", "js"), ("triangular", "triangular"))])
    return both.select("dim", F.explode(pairs).alias("p")).select("dim", "p.metric", "p.value")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """dim, metric, before, after, improvement of two metric sets; a metric of one side only keeps its row."""
    b = before.select("dim", "metric", F.col("value").alias("before"))
    a = after.select("dim", "metric", F.col("value").alias("after"))
    return b.join(a, ["dim", "metric"], "full").withColumn("improvement", improvement(F.col("before"), F.col("after")))


def joint_record(population: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """dim, metric, before, after, improvement: all metrics of ``population`` (y, w, columns) with unit weights and with w."""
    apart = wide_wasserstein(population, columns, {"before": None, "after": F.col("w")}, keep=True)  # one row a column
    before, after = (_by_metric(apart.select("dim", F.col(name).alias("w1")).join(js_and_triangular(long(population, columns, w)), "dim")) for name, w in (("before", None), ("after", "w")))
    return compare(before, after)


def sliced_spread(spark: SparkSession, population: DataFrame, columns: tuple[str, ...], n: int = 128, seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """One row, mean and sd of the sliced distance over ``seeds`` sets of ``n`` random directions."""
    out = None
    for s in seeds:
        one = sliced_wasserstein(spark, population, columns, random_directions(n, len(columns), s))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("sliced_w1").alias("mean"), F.stddev_samp("sliced_w1").alias("sd"))


def random_directions(n: int, dim: int, seed: int = 0) -> list[list[float]]:
    """Unit vectors from normals."""
    g = np.random.Generator(np.random.PCG64(seed)).normal(size=(n, dim))
    return (g / np.linalg.norm(g, axis=1, keepdims=True)).tolist()


def circle_directions(n: int) -> list[list[float]]:
    """n directions in the plane at equal angles of a half turn: any engine can rebuild them."""
    return [[float(np.cos(np.pi * k / n)), float(np.sin(np.pi * k / n))] for k in range(n)]


def _standardized(population: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``population`` beside the observed means and deviations, and the columns in their units."""
    nature = F.col("y") == 1
    stats = population.agg(*[F.avg(F.when(nature, F.col(c))).alias(f"_m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(F.when(nature, F.col(c))).alias(f"_s{i}") for i, c in enumerate(columns)])
    scaled = [(F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i, c in enumerate(columns)]
    return population.crossJoin(F.broadcast(stats)), scaled  # one row


def sliced_wasserstein(spark: SparkSession, population: DataFrame, columns: tuple[str, ...], directions: list[list[float]], weight: str = "w", digits: int | None = None) -> DataFrame:
    """One row, sliced_w1: the mean distance over projections of standardized samples.

    Both samples are standardized by the observed one's mean and deviation. Only
    the simulated side is weighted.
    """
    rows, scaled = _standardized(population, columns)
    return areas(rows, scaled, [F.when(F.col("y") == 0, F.col(weight)).otherwise(1.0)], np.asarray(directions), digits).agg(F.avg("w1").alias("sliced_w1"))


def distances_with_floors(population: DataFrame, columns: tuple[str, ...], n_directions: int = 128, size: int | None = None, repeats: int = 4, seed: int = 0, weight: str = "w") -> DataFrame:
    """metric (sliced, axis), before, after, floor, floor_sd: the distance with unit weights and with ``weight``, and what equal samples read.

    A floor is the mean over ``repeats`` pairs of disjoint draws from the observed
    sample, each of ``size`` rows (by default as many as the smaller sample
    compared, if two such draws are there, else half the observed ones). Draws are
    cut from hash orders without ranking the table. All weights and all draws share
    the passes of ``areas``, standardized by the whole observed sample. Fewer than two draws of ``size`` are an error.

    Values and the first 64 bits of each row's hashes are computed once and kept in
    blocks; rows that share those bits at a cut count in parts on both sides.
    """
    nature = F.col("y") == 1
    double = [F.col(c).cast("double") for c in columns]
    stats = population.agg(
        F.count_if(nature).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"),
        *[f(F.when(nature, v)).alias(f"{name}{i}") for i, v in enumerate(double) for name, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    observed = stats["n1"]
    size = size or min(observed // 2, stats["n0"] or observed)
    if size < 1 or observed < 2 * size:
        raise ValueError(f"two disjoint draws of {size} are needed, there are {observed} observed rows")
    unknown = F.lit(float("nan"))
    scaled = [F.coalesce((v - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0), unknown).alias(f"v{i}") for i, v in enumerate(double)]
    hashes = [F.unhex(hash_key(f"{seed}:null:{i}", F.col("row_id"))).alias(f"h{i}") for i in range(repeats)]
    w = F.when(F.col("y") == 0, F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).otherwise(1.0)
    packed = blocks.pack_typed(population.where(F.col("y").isin(0, 1)).select(F.col("y").cast("byte").alias("y"), w.alias("w"), *scaled, *hashes)).persist()
    n = len(columns)
    types = [np.int8, np.float64, *[np.float64] * n, *[np.uint64] * repeats]
    try:
        cuts = _kept_cuts(packed, lambda batches: ([h[f[0] == 1] for h in f[2 + n :]] for f in blocks.unpack_typed(batches, types)), repeats, (size, 2 * size))
        k = 2 + repeats  # unit weights, the given ones, and each draw's first sample against its second
        shares = [_draw_shares(*c) for c in cuts]
        coded = min(repeats, 2)
        table = np.zeros((1 + 5**coded, 2 * k))
        table[0, k] = 1.0  # simulated rows; their given weights come row by row
        for code in range(5**coded):
            table[1 + code, [0, 1]] = 1.0
            for i in range(coded):
                table[1 + code, [2 + i, k + 2 + i]] = shares[i][code // 5**i % 5]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Masses]]:
            for y, w, *found in blocks.unpack_typed(batches, types, 2 * blocks.BLOCK):
                zone = [sum((h > cut).view(np.int8) + (h >= cut).view(np.int8) for cut in at) for at, h in zip(ends, found[n:])]
                code = np.where(y == 1, 1 + sum(z * np.int8(5**i) for i, z in enumerate(zone[:coded])), 0)
                own = {k + 1: np.where(y == 0, w, 0.0)}
                for i in range(coded, repeats):
                    own |= {j: np.where(y == 1, s[zone[i]], 0.0) for j, s in zip((2 + i, k + 2 + i), shares[i].T)}
                yield np.column_stack(found[:n]), Masses(len(y), own, code, table)

        ends = [np.array([h for h, _ in c], np.uint64) for c in cuts]
        directions = np.concatenate([np.asarray(random_directions(n_directions, n, seed)), np.eye(n)])
        got = kept_areas(packed, read, n, k, directions)
    finally:
        packed.unpersist()
    means = got.groupBy(F.when(F.col("direction") < n_directions, "sliced").otherwise("axis").alias("metric"), "weight").agg(F.avg("w1").alias("v"))
    null = F.when(F.col("weight") >= 2, F.col("v"))
    return means.groupBy("metric").agg(
        F.max(F.when(F.col("weight") == 0, F.col("v"))).alias("before"), F.max(F.when(F.col("weight") == 1, F.col("v"))).alias("after"), F.avg(null).alias("floor"), F.stddev_samp(null).alias("floor_sd")
    )


def _draw_shares(middle: tuple[int, float], end: tuple[int, float]) -> np.ndarray:
    """How much of a row is in the first and in the second sample: below the middle cut, at it, between, at the end cut, above."""
    if middle[0] == end[0]:  # then 2 is at both
        first, both = [1.0, 0.0, middle[1], 0.0, 0.0], [1.0, 0.0, end[1], 0.0, 0.0]
    else:
        first, both = [1.0, middle[1], 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, end[1], 0.0]
    return np.column_stack([first, np.subtract(both, first)])


def _kept_cuts(packed: DataFrame, read, draws: int, ranks: tuple[int, ...]) -> list[list[tuple[int, float]]]:
    """For each draw the hash at the given ranks of its order and the share of that hash's rows up to the rank, as ``sampling.hash_cuts``.

    ``read`` takes the batches of a task and yields each draw's hashes.
    """
    wanted = {(i, r): (0, 0) for i in range(draws) for r in ranks}  # the leading bits so far, and the rows before them
    shift, most = 64, sampling.FEW + 1

    def among(h: np.ndarray, p: int, shift: int) -> np.ndarray:
        return h if shift == 64 else h[h >> np.uint64(shift) == np.uint64(p)]

    while wanted and most > sampling.FEW and shift:
        prefixes, above, shift = sorted({(i, p) for (i, _), (p, _) in wanted.items()}), shift, shift - 16

        def task(batches: Iterator[pa.RecordBatch], prefixes=prefixes, above=above, shift=shift) -> Iterator[pa.RecordBatch]:
            total = {m: np.zeros(1 << 16) for m in range(len(prefixes))}
            for hashes in read(batches):
                for m, (i, p) in enumerate(prefixes):
                    total[m] += np.bincount((among(hashes[i], p, above) >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            yield from learning.vectors(total)

        got, most = learning.summed(packed.mapInArrow(task, learning.VECTORS)), 0  # 2 ** 16 numbers a prefix
        for (i, rank), (p, ahead) in wanted.items():
            upto = got[prefixes.index((i, p))].cumsum() + ahead
            at = int(np.searchsorted(upto, rank))
            if at == len(upto):
                raise ValueError(f"fewer than {rank} rows")
            before = int(upto[at - 1]) if at else ahead
            wanted[i, rank], most = ((p << 16) + at, before), max(most, int(upto[at]) - before)
    prefixes = sorted({(i, p) for (i, _), (p, _) in wanted.items()})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in read(batches):
            for m, (i, p) in enumerate(prefixes):
                h, c = np.unique(among(hashes[i], p, shift), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), m, np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["m", "h", "n"])

    found = packed.mapInArrow(listed, "m int, h long, n long").groupBy("m", "h").agg(F.sum("n").alias("n")).toArrow()  # about FEW rows a wanted rank
    m, h, c = (found[x].to_numpy() for x in ("m", "h", "n"))
    out: list[list[tuple[int, float]]] = [[] for _ in range(draws)]
    for (i, rank), (p, ahead) in wanted.items():
        mine = np.flatnonzero(m == prefixes.index((i, p)))
        mine = mine[np.argsort(h[mine].view(np.uint64))]
        upto = c[mine].cumsum() + ahead
        at = int(np.searchsorted(upto, rank))
        out[i].append((int(h[mine[at]].view(np.uint64)), float((rank - (upto[at] - c[mine[at]])) / c[mine[at]])))
    return out


def wide_wasserstein(population: DataFrame, columns: tuple[str, ...], weights: dict[str, Column | None], keep: bool = False) -> DataFrame:
    """dim and a column of W1 for each named weight of the simulated side (None: 1), all from the same passes.

    ``keep``: see ``areas``.
    """
    used = [F.lit(1.0) if w is None else F.when(F.col("y") == 0, w).otherwise(1.0) for w in weights.values()]
    got = areas(population, [F.col(c) for c in columns], used, keep=keep)
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("direction"))
    return got.groupBy(name.alias("dim")).agg(*[F.max(F.when(F.col("weight") == i, F.col("w1"))).alias(n) for i, n in enumerate(weights)])


def axis_wasserstein(population: DataFrame, columns: tuple[str, ...], weight: str = "w") -> DataFrame:
    """One row, axis_w1: the mean over the axes themselves, standardized as above."""
    eye = [[1.0 if i == j else 0.0 for j in range(len(columns))] for i in range(len(columns))]
    return sliced_wasserstein(population.sparkSession, population, columns, eye, weight).withColumnRenamed("sliced_w1", "axis_w1")
