"""W1 along many directions and under many weights at once, from the masses of value cells.

A pass counts the masses and first moments of both samples in cells of each
direction. Where the distance between the two distribution functions can't change
its sign inside a cell, the cell's area follows from those sums alone and is
exact. Only the other cells are looked at again: they are cut finer, level by
level, until few rows are left in them, and those rows are sorted. So what is
shuffled is a small part of the rows, however many directions there are. How the
cells are cut (from a bounded sample, then evenly) doesn't change the result.

The more rows, the more cells stay open. Open cells don't depend on each other,
so they are followed in lots of bounded size, one lot after the other: the driver
holds the sums of one lot's cells, however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import blocks
from weftline.operators.blocks import BLOCK

#: Rows that one task sorts, about; rows of the sample that spans the first cells.
RANGE_ROWS, SAMPLE = 250_000, 8_192
#: Cells of a level in all (see ``cells_at_most``), of a direction on the first level (more for more than 8 million rows), levels at most.
CELLS, MOST_CELLS, LEVELS = 1 << 18, 4096, 7
#: Values that may be sorted whatever the table; beyond them, half as many as the table has rows.
FEW_VALUES = 1 << 20
#: Cells that an open cell of a full lot is cut into, at least.
FINER = 4


def cells_at_most(k: int) -> int:
    """Cells of a level for ``k`` weights: each has 4 k + 5 numbers, and 16 ``CELLS`` numbers come to the driver."""
    return max(FINER, CELLS * 16 // (4 * k + 5))


@dataclass(frozen=True)
class Level:
    """A grid for every open cell of the level above: numbers of its cells, where they start and how wide they are."""

    start: np.ndarray  # number of the first cell by cell above, -1 for a closed one
    cells: np.ndarray
    lo: np.ndarray
    scale: np.ndarray
    ref: np.ndarray  # moments are taken from here
    bits: bool = False  # even in the order of floating-point numbers, for tails, or even in value

    def total(self) -> int:
        return int((self.start + self.cells)[self.start >= 0].max())

    def parents(self, cell: np.ndarray) -> np.ndarray:
        """Which of the open cells above each cell belongs to."""
        return np.searchsorted(self.start[self.start >= 0], cell, side="right") - 1


@dataclass(frozen=True)
class Masses:
    """The masses of a block's rows, the first sample's weights before the second's: those that a row's code stands for, and others row by row."""

    rows: int
    own: dict[int, np.ndarray]  # by mass
    code: np.ndarray | None = None
    table: np.ndarray | None = None  # code, mass; 0 where the mass is given row by row

    @staticmethod
    def given(w: np.ndarray) -> Masses:
        """Of a matrix (mass, row)."""
        return Masses(w.shape[1], dict(enumerate(w)))

    def negative(self) -> np.ndarray:
        out = np.zeros(self.rows, bool) if self.code is None else (self.table < 0).any(axis=1)[self.code]
        for w in self.own.values():
            out |= w < 0
        return out

    def of(self, at: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` masses (mass, row) of some rows."""
        out = np.zeros((k, len(at))) if self.code is None else np.ascontiguousarray(self.table[self.code[at]].T)
        for j, w in self.own.items():
            out[j] += w[at]
        return out


def _bits(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of ``x`` and about evenly spaced over its magnitudes."""
    i = (x + 0.0).view(np.int64)
    return np.where(i < 0, -(i & np.int64(0x7FFFFFFFFFFFFFFF)), i).astype(np.float64)


def _placed(levels: list[Level], d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the finite values of ``x`` in open cells: their places, themselves, their cells and the cells above."""
    at = np.flatnonzero(np.isfinite(x))
    x = x if len(at) == len(x) else x[at]
    above = cell = np.full(len(x), d)
    for k, level in enumerate(levels):
        if k:
            open_ = np.flatnonzero(level.start[cell] >= 0)
            at, x, cell = at[open_], x[open_], cell[open_]
        above = cell if k else d
        with np.errstate(over="ignore", invalid="ignore"):
            step = ((_bits(x) if level.bits else x) - level.lo[above]) * level.scale[above]
        cell = level.start[above] + np.fmin(np.fmax(step, 0), level.cells[above] - 1).astype(np.int64)
    return at, x, cell, above


def areas(rows: DataFrame, values: list[Column], weights: list[Column | tuple[Column, Column]], directions: np.ndarray | None = None, digits: int | None = None, keep: bool = False) -> DataFrame:
    """direction, weight (numbers from 0), w1 between the rows of y = 1 and y = 0.

    ``rows`` has y; ``weights`` weigh the rows of both classes, null as 0. A pair
    of columns weighs each row in the first and in the second sample, whatever
    its y. A row whose value in a direction is null or not finite takes no part
    there. Without ``directions`` every value is one. A direction or weight that
    leaves a class empty has NaN; an empty table has no rows.

    With ``keep`` values and weights are computed once and held in blocks until
    the areas are there, for rows that are dear to compute.
    """
    n, k = len(values), len(weights)
    y = F.col("y").cast("int")
    sides = [[w[s] if isinstance(w, tuple) else F.when(y == 1 - s, w) for w in weights] for s in (0, 1)]
    packed = rows.select(
        F.array(*[F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in values]).alias("v"), F.array(*[F.coalesce(w.cast("double"), F.lit(0.0)) for side in sides for w in side]).alias("w")
    )
    turn = np.eye(n) if directions is None else np.asarray(directions, float)

    if keep:
        packed = blocks.pack(packed).persist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Masses]]:
        """Values by column and masses."""
        for v, w in blocks.unpack(batches) if keep else map(blocks.matrices, blocks.joined(batches)):
            yield v, Masses.given(np.ascontiguousarray(w.T))

    def projected(v: np.ndarray, d: int) -> np.ndarray:
        x = v[:, d] if directions is None else v @ turn[d]
        return (x if digits is None else x.round(digits)) + 0.0

    try:
        return _areas(rows, packed, read, projected, turn, n, k, keep)
    finally:
        if keep:
            packed.unpersist()


def kept_areas(packed: DataFrame, read, n: int, k: int, directions: np.ndarray | None = None) -> DataFrame:
    """direction, weight, w1 as ``areas`` has them, of rows that the caller keeps in blocks (rows, ..).

    ``read`` takes the batches of a task and yields the values (row, one of ``n``
    columns) and the masses (``k`` weights of the first sample, then of the second; row),
    as a matrix or as ``Masses``. Without ``directions`` every column is one.
    """

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Masses]]:
        for v, w in read(batches):
            yield v, w if isinstance(w, Masses) else Masses.given(w)

    def projected(v: np.ndarray, d: int) -> np.ndarray:
        return (v[:, d] if directions is None else v @ directions[d]) + 0.0

    return _areas(packed, packed, given, projected, np.eye(n) if directions is None else directions, n, k, True)


def _areas(rows: DataFrame, packed: DataFrame, read, projected, turn: np.ndarray, n: int, k: int, keep: bool) -> DataFrame:
    count = (packed.agg(F.sum("rows")).first()[0] or 0) if keep else rows.count()
    cells = 1
    lo = hi = np.zeros(len(turn))
    if count > RANGE_ROWS:
        cells = max(1, min(max(MOST_CELLS, count // 2048), cells_at_most(k) // len(turn)))
        sample = _some(packed, read, count, n) if keep else None
        if sample is None:
            some = packed.orderBy(F.xxhash64("v", "w")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()  # for the spans of cells only
            sample = np.asarray(some.values.to_numpy(zero_copy_only=False)).reshape(-1, n)
        sample = np.column_stack([projected(sample, d) for d in range(len(turn))])
        lo, hi = _spans(np.where(np.isfinite(sample), sample, np.nan))
    known = np.zeros((len(turn), k))
    norm, size = np.ones((len(turn), 2, k)), np.zeros(len(turn))
    enough = max(FEW_VALUES, count // 2)  # values that may be sorted
    # lots of cells to be counted: their level, and by open cell above the height where it starts, the first value after it and its direction
    lots = [([whole(lo, hi, cells)], np.zeros((len(turn), k)), np.full(len(turn), np.nan), np.arange(len(turn)), np.inf, enough)]
    while lots:
        levels, before, then, owner, was, enough = lots.pop()
        found = _masses(packed, read, projected, levels, len(turn), k, owner)
        cell, rows_in, first, last, negative = (found[c].to_numpy() for c in ("c", "n", "first", "last", "negative"))
        mass = np.column_stack([found[f"m{j}"].to_numpy() for j in range(4 * k)]).reshape(len(cell), 2, 2, k)  # mass and moment, sample, weight
        del found
        parent = levels[-1].parents(cell)
        d = owner[parent]
        if len(levels) == 1:
            size = np.bincount(d, rows_in, len(turn))
            sums = np.zeros((len(turn), 2, k))
            np.add.at(sums, d, mass[:, 0])
            with np.errstate(divide="ignore"):
                norm = np.where(sums > 0, 1 / sums, np.nan)  # a class without mass makes all its areas NaN
            known = np.where(np.isnan(norm).any(axis=1), np.nan, 0.0)
        mass *= norm[d][:, None]
        net, moment = mass[:, 0, 0] - mass[:, 0, 1], mass[:, 1, 0] - mass[:, 1, 1]
        heads = np.searchsorted(parent, parent, side="left")
        upto = np.cumsum(np.nan_to_num(net), axis=0)
        height = before[parent] + (upto - np.nan_to_num(net)) - (upto - np.nan_to_num(net))[heads]
        after = np.where(np.append(parent[1:] == parent[:-1], False) if len(parent) else np.zeros(0, bool), np.append(first[1:], np.nan), then[parent])
        to = np.where(np.isnan(after), last, after)
        sure = (height - mass[:, 0, 1] >= 0) | (height + mass[:, 0, 0] <= 0) | np.isnan(net)
        closed = (first == last) | (sure.all(axis=1) & (negative == 0))
        ref = levels[-1].ref[levels[-1].start >= 0][parent]
        area = np.abs(height * (to - first)[:, None] + net * (to - ref)[:, None] - moment)
        np.add.at(known, d[closed], area[closed])
        still = ~closed
        left, now = int(rows_in[still].sum()), int(rows_in.sum())
        if not left:
            continue
        cell, rows_in, first, last, before, then, owner = cell[still], rows_in[still], first[still], last[still], height[still], after[still], d[still]
        del mass, net, moment, upto, height, area
        if left <= enough or len(levels) >= LEVELS or (len(levels) > 3 and left > 0.8 * now and now > 0.8 * was):
            got = _sorted(packed, read, projected, levels, cell, rows_in, before, then, owner, norm, k).groupBy("d", "k").agg(F.sum("w1").alias("w1")).toArrow()  # a few numbers a direction
            np.add.at(known, (got["d"].to_numpy(), got["k"].to_numpy()), got["w1"].to_numpy())
            continue
        most = cells_at_most(k)
        for a in reversed(range(0, len(cell), most // FINER)):
            lot = slice(a, a + most // FINER)
            share = rows_in[lot].sum() / left
            level = finer(levels[-1], cell[lot], rows_in[lot], first[lot], last[lot], bits=len(levels) % 2 == 0, most=most)
            lots.append(([*levels, level], before[lot], then[lot], owner[lot], now * share, enough * share))
    sums = [(int(i), j, float(known[i, j])) for i in np.flatnonzero(size) for j in range(k)]
    return rows.sparkSession.createDataFrame(sums, "direction int, weight int, w1 double")


def _some(packed: DataFrame, read, count: int, n: int) -> np.ndarray:
    """Values of about ``SAMPLE`` rows, evenly from all blocks and at least one from each: for the spans of cells only."""
    step = max(1, count // SAMPLE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, _ in read(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v[::step, i])) for i in range(n)], names=[f"v{i}" for i in range(n)])

    got = packed.mapInArrow(task, ", ".join(f"v{i} double" for i in range(n))).toArrow()
    return np.column_stack([got[f"v{i}"].to_numpy() for i in range(n)])


def _spans(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first cells of each direction begin and end: a sample's middle and a quarter more on both sides."""
    lo, hi = np.zeros(sample.shape[1]), np.zeros(sample.shape[1])
    for d, x in enumerate(sample.T):
        x = x[~np.isnan(x)]
        if len(x):
            a, b = np.quantile(x, [0.005, 0.995])
            lo[d], hi[d] = max(x.min(), a - (b - a) / 4), min(x.max(), b + (b - a) / 4)
    return lo, hi


def whole(lo: np.ndarray, hi: np.ndarray, cells: int = MOST_CELLS) -> Level:
    """The first level: as many even cells for each direction; values beyond its span are in the outer ones."""
    with np.errstate(divide="ignore", over="ignore"):
        scale = np.where(hi > lo, cells / np.where(hi > lo, hi - lo, 1.0), 0.0)
    return Level(np.arange(len(lo)) * cells, np.full(len(lo), cells), lo, scale, lo)


def counts(packed: DataFrame, levels: list[Level]) -> pa.Table:
    """Cells (c) of the last level with their rows (n), least and greatest value, of ``packed`` (v: an array of one number)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Masses]]:
        for (v,) in map(blocks.matrices, blocks.joined(batches)):
            yield v, Masses(len(v), {})

    return _masses(packed, read, lambda v, d: v[:, d] + 0.0, levels, 1, 0)


def finer(level: Level, cell: np.ndarray, rows_in: np.ndarray, first: np.ndarray, last: np.ndarray, bits: bool, most: int | None = None) -> Level:
    """Grids over the cells that stay open, each with cells as it has rows."""
    total = level.total()
    cells = np.clip((rows_in / rows_in.sum() * (most or CELLS)).astype(np.int64), 2, MOST_CELLS)
    a, b = (_bits(first), _bits(last)) if bits else (first, last)
    out = Level(*[np.full(total, f) for f in (-1, 0, 0.0, 0.0, 0.0)], bits)
    out.start[cell] = np.cumsum(cells) - cells
    with np.errstate(divide="ignore", over="ignore"):
        out.cells[cell], out.lo[cell], out.scale[cell], out.ref[cell] = cells, a, np.where(b > a, cells / np.where(b > a, b - a, 1.0), 0.0), first
    return out


def _masses(packed: DataFrame, read, projected, levels: list[Level], directions: int, k: int, owner: np.ndarray | None = None) -> pa.Table:
    """Cell (c) of the last level, its rows (n), least and greatest value, whether a mass is negative, masses and moments, for cells with rows."""
    total = levels[-1].total()
    owners = range(directions) if owner is None else np.unique(owner).tolist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, negative = np.zeros(total, np.int64), np.zeros(total)
        first, last = np.full(total, np.inf), np.full(total, -np.inf)
        sums = np.zeros((4 * k, total))
        for v, w in read(batches):
            below = w.negative()
            any_below = bool(below.any())
            if w.code is not None:
                here_are = np.flatnonzero(np.bincount(w.code, minlength=len(w.table)))
                code = np.zeros(len(w.table), np.int64)
                code[here_are] = np.arange(len(here_are))
                code, table = code[w.code], w.table[here_are].T
            for d in owners:
                at, x, cell, above = _placed(levels, d, projected(v, d))
                if not len(at):
                    continue
                a, b = int(cell.min()), int(cell.max()) + 1
                cell = cell - a
                here = slice(a, b)
                every = len(at) == w.rows
                np.minimum.at(first[here], cell, x)
                np.maximum.at(last[here], cell, x)
                far = x - levels[-1].ref[above]
                if w.code is None:
                    n[here] += np.bincount(cell, minlength=b - a)
                else:
                    width = table.shape[1]
                    both = cell * width + (code if every else code[at])
                    counted = np.bincount(both, minlength=(b - a) * width).reshape(-1, width)
                    n[here] += counted.sum(axis=1)
                    sums[: 2 * k, here] += table @ counted.T
                    sums[2 * k :, here] += table @ np.bincount(both, far, (b - a) * width).reshape(-1, width).T
                for j, m in w.own.items():
                    m = m if every else m[at]
                    sums[j, here] += np.bincount(cell, m, b - a)
                    sums[2 * k + j, here] += np.bincount(cell, m * far, b - a)
                if any_below:
                    negative[here] += np.bincount(cell, below[at], b - a)
        c = np.flatnonzero(n)
        for i in range(0, len(c), BLOCK):
            part = c[i : i + BLOCK]
            m = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * 4 * k, pa.int32()), pa.array(np.ascontiguousarray(sums[:, part].T).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part]), pa.array(first[part]), pa.array(last[part]), pa.array(negative[part]), m], names=["c", "n", "first", "last", "negative", "m"])

    got = packed.mapInArrow(task, "c long, n long, first double, last double, negative double, m array<double>")
    got = got.groupBy("c").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("negative").alias("negative"), *[F.sum(F.get("m", F.lit(j))).alias(f"m{j}") for j in range(4 * k)])
    return got.toArrow().sort_by("c")  # at most ``CELLS`` rows and one more an open cell


def _sorted(packed: DataFrame, read, projected, levels: list[Level], cell, rows_in, before, then, owner, norm, k: int) -> DataFrame:
    """d, k, w1: the areas of the open cells, whose rows are sorted in groups of neighbouring cells."""
    group = ((np.cumsum(rows_in) - rows_in) // RANGE_ROWS).astype(np.int64)
    total = levels[-1].total()
    number = np.full(total, -1)
    number[cell] = np.arange(len(cell))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, w in read(batches):
            for d in np.unique(owner):
                at, x, c, _ = _placed(levels, d, projected(v, d))
                c = number[c]
                mine = np.flatnonzero(c >= 0)
                if not len(mine):
                    continue
                mine = mine[np.argsort(c[mine], kind="stable")]
                at, x, c = at[mine], x[mine], c[mine]
                m = w.of(at, 2 * k)
                m = np.ascontiguousarray((m[:k] * norm[d, 0][:, None] - m[k:] * norm[d, 1][:, None]).T)
                g = group[c]
                cuts = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
                out = [(int(g[a]), c[a:b].astype(np.int32).tobytes(), x[a:b].tobytes(), m[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["g", "c", "x", "m"])

    def summed(_: tuple, table: pa.Table) -> pa.Table:
        c = np.frombuffer(b"".join(table["c"].to_pylist()), np.int32)
        x = np.frombuffer(b"".join(table["x"].to_pylist()))
        m = np.frombuffer(b"".join(table["m"].to_pylist())).reshape(-1, k)
        order = np.lexsort((x, c))
        c, x, m = c[order], x[order], m[order]
        heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(c))))
        upto = np.cumsum(m, axis=0)
        height = before[c] + upto - (upto - m)[heads][of]
        end = then[c]
        following = np.where(np.append(c[1:] == c[:-1], False), np.append(x[1:], np.nan), np.where(np.isnan(end), x, end))
        area = np.add.reduceat(np.abs(height) * (following - x)[:, None], heads, axis=0)
        d = owner[c[heads]]
        return pa.table({"d": pa.array(np.repeat(d, k).astype(np.int32)), "k": pa.array(np.tile(np.arange(k, dtype=np.int32), len(d))), "w1": pa.array(area.ravel())})

    return packed.mapInArrow(dealt, "g long, c binary, x binary, m binary").groupBy("g").applyInArrow(summed, "d int, k int, w1 double")
