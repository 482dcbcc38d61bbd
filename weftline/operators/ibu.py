"""Iterative Bayesian unfolding, one variable at a time, and its event weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.expressions import product
from weftline.operators import blocks
from weftline.operators.binning import saturated_bin

CANDIDATES, MOST_BINS, OFFSET = 100, 50, 0.01
PURITY = 0.5**0.5
EPSILON = 1e-12


def candidate_purities(df: DataFrame, truth: str, reco: str, lo: float, hi: float) -> DataFrame:
    """candidate, c, purity of the possible upper edges of a bin that starts at ``lo``.

    Candidates run evenly from lo + 0.01 (in units of the variable, also where
    that passes ``hi``) to ``hi``. Purity is the share of the events with truth
    in the bin that are also found there. One pass: an event counts for all
    candidates beyond both of its values, so events are counted by the first
    such candidate and summed up over the candidates.
    """
    first, step = lo + OFFSET, (hi - lo - OFFSET) / (CANDIDATES - 1)
    edges = [first + step * i for i in range(CANDIDATES)]
    shown = F.array(*[F.lit(e) for e in edges])
    t, r = F.col(truth), F.col(reco)
    inside = F.when((t >= lo) & (r >= lo), F.greatest(t, r))

    def beyond(v: Column) -> Column:
        """Number of candidates that v isn't below."""
        return F.size(F.filter(shown, lambda e: e <= v)) if step >= 0 else F.size(F.filter(shown, lambda e: e > v))

    counted = df.where(t >= lo).select(beyond(t).alias("a"), F.when(inside.isNotNull(), beyond(inside)).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).collect()  # at most 101 ** 2 rows
    below = np.zeros(CANDIDATES)
    both = np.zeros(CANDIDATES)
    for row in counted:
        for held, at in ((below, row["a"]), (both, row["b"])):
            if at is not None:
                held[at:] += row["n"] if step >= 0 else 0
                if step < 0:
                    held[:at] += row["n"]
    purity = np.divide(both, below, out=np.zeros(CANDIDATES), where=below > 0)
    return df.sparkSession.createDataFrame([(i, edges[i], float(purity[i])) for i in range(CANDIDATES)], "candidate int, c double, purity double")


#: Cells of the index along each axis: a scan brings at most half their square to the driver for each variable.
CELLS = 1024


@dataclass
class Dominance:
    """Counts of events by cells of (least, greatest) of truth and detector value, and of truth alone.

    Prefix sums over both axes bound, for any range [lo, c), how many events have
    truth in it and how many have both values in it; cells that an end of the range
    runs through make the bounds differ.
    """

    edges: np.ndarray
    inside: np.ndarray
    truth: np.ndarray

    @classmethod
    def of(cls, edges: np.ndarray, pairs: np.ndarray, truth: np.ndarray) -> Dominance:
        from_i = np.zeros((CELLS + 1, CELLS + 1), np.int64)
        from_i[:-1, 1:] = np.cumsum(np.cumsum(pairs[::-1], axis=0)[::-1], axis=1)  # events with least >= i and greatest < j
        return cls(edges, from_i, np.append(0, np.cumsum(truth)))

    def _cells(self, lo: float, c: float) -> tuple[int, int, int, int]:
        """First and last (exclusive) cell: of those wholly in [lo, c), and of those touched."""
        first, last = int(np.searchsorted(self.edges, lo, "left")), int(np.searchsorted(self.edges, c, "right")) - 1
        return first, max(last, first), max(int(np.searchsorted(self.edges, lo, "right")) - 1, 0), min(int(np.searchsorted(self.edges, c, "left")), CELLS)

    def purity(self, lo: float, c: float) -> tuple[float, float, float]:
        """Least and greatest possible purity of [lo, c), and a guess; beyond the last cell, which is closed, nothing is known."""
        if c > self.edges[-1]:
            return 0.0, 1.0, 1.0
        a, b, wide_a, wide_b = self._cells(lo, c)
        b = min(b, CELLS - 1)
        a = min(a, b)
        both = int(self.inside[a, b]), int(self.inside[wide_a, wide_b])
        below = int(self.truth[b] - self.truth[a]), int(self.truth[wide_b] - self.truth[wide_a])
        most = min(1.0, both[1] / below[0]) if below[0] else float(both[1] > 0)
        if a == b:
            # less than a cell: as if both values lay evenly in the cells touched
            share = (c - lo) / (self.edges[wide_b] - self.edges[wide_a])
            return 0.0, most, both[1] * share / below[1] if below[1] else 0.0
        return both[0] / below[1] if below[1] else 0.0, most, sum(both) / sum(below) if sum(below) else 0.0


def dominance(df: DataFrame, pairs: dict[str, tuple[str, str]], spans: dict[str, tuple[float, float]]) -> dict[str, Dominance]:
    """The index of every variable, from one scan."""
    names = list(pairs)
    edges = {k: np.linspace(*spans[k], CELLS + 1) for k in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in blocks.joined(batches):
            for i, name in enumerate(names):
                t, r = (batch.column(2 * i + k).to_numpy().astype(np.float64) for k in (0, 1))
                # the last cell is closed at its top, so that the greatest value has one
                cell = [np.clip(np.searchsorted(edges[name], v, "right") - 1, -1, CELLS - 1) for v in (t, np.fmin(t, r), np.fmax(t, r))]
                known, low = ~np.isnan(t), ~np.isnan(t) & ~np.isnan(r) & (np.fmin(t, r) >= edges[name][0]) & (np.fmax(t, r) <= edges[name][-1])
                codes = np.concatenate([cell[0][known & (t >= edges[name][0])] + CELLS * CELLS, cell[1][low] * CELLS + cell[2][low]])
                counted = np.bincount(codes, minlength=CELLS * CELLS + CELLS)
                held[i] = held[i] + counted if i in held else counted
        for i, n in held.items():
            code = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)), pa.array(code), pa.array(n[code])], names=["v", "code", "n"])

    columns = [F.col(c).cast("double").alias(f"c{2 * i + k}") for i, name in enumerate(names) for k, c in enumerate(pairs[name])]
    got = df.select(*[F.coalesce(c, F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "v int, code long, n long").groupBy("v", "code").agg(F.sum("n").alias("n")).toArrow()
    v, code, n = (got[c].to_numpy() for c in ("v", "code", "n"))
    out = {}
    for i, name in enumerate(names):
        flat = np.zeros(CELLS * CELLS + CELLS, np.int64)
        flat[code[v == i]] = n[v == i]
        out[name] = Dominance.of(edges[name], flat[: CELLS * CELLS].reshape(CELLS, CELLS), flat[CELLS * CELLS :])
    return out


def exact_purities(df: DataFrame, pairs: dict[str, tuple[str, str]], asked: list[tuple[str, float, float]]) -> dict[tuple[str, float], np.ndarray]:
    """(name, lo) -> the purity of every candidate of a bin from lo, for (name, lo, hi); one scan for all."""
    names = list(dict.fromkeys(name for name, *_ in asked))
    grids = [candidates(lo, hi) for _, lo, hi in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(asked), 2, CANDIDATES), np.int64)
        for batch in batches:
            for i, (name, lo, _) in enumerate(asked):
                t, r = (batch.column(2 * names.index(name) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for k, v in ((0, t[t >= lo]), (1, np.maximum(t, r)[(t >= lo) & (r >= lo)])):
                    # candidates go down where the last bin is narrower than the offset
                    total[i, k] += (v[:, None] < grids[i]).sum(axis=0) if grids[i][-1] < grids[i][0] else np.cumsum(np.bincount(np.searchsorted(grids[i], v, "right"), minlength=CANDIDATES + 1))[:CANDIDATES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "n"])

    columns = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{2 * i + k}") for i, name in enumerate(names) for k, c in enumerate(pairs[name])]
    got = df.select(*columns).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # 200 numbers a bin asked for
    total = np.zeros(len(asked) * 2 * CANDIDATES)
    total[got["i"].to_numpy()] = got["n"].to_numpy()
    below, both = total.reshape(len(asked), 2, CANDIDATES).transpose(1, 0, 2)
    purity = np.divide(both, below, out=np.zeros_like(both), where=below > 0)
    return {(name, lo): p for (name, lo, _), p in zip(asked, purity)}


def candidates(lo: float, hi: float) -> np.ndarray:
    """Possible upper edges of a bin from ``lo``."""
    first, step = lo + OFFSET, (hi - lo - OFFSET) / (CANDIDATES - 1)
    return np.array([first + step * i for i in range(CANDIDATES)])


def purity_edges_all(df: DataFrame, pairs: dict[str, tuple[str, str]], threshold: float = PURITY) -> dict[str, list[float]]:
    """Every variable's edges from its least truth value up: each next edge is the first candidate purer than the threshold.

    One scan finds the spans, one builds the index, whose bounds decide most
    candidates. The search goes on over the others by a guess, and one scan counts
    all bins that had one exactly, for all variables at once; a wrong guess is
    searched again from there. A variable without truth values has no edges.
    """
    spans = df.agg(*[f(F.when(~F.isnan(F.col(t).cast("double")), F.col(t).cast("double"))).alias(f"{k}{i}") for i, (t, _) in enumerate(pairs.values()) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    known = {name: (spans[f"lo{i}"], spans[f"hi{i}"]) for i, name in enumerate(pairs) if spans[f"lo{i}"] is not None}
    index = dominance(df, {k: pairs[k] for k in known}, known) if known else {}
    exact: dict[tuple[str, float], np.ndarray] = {}

    def search(name: str) -> tuple[list[float], list[tuple[str, float, float]]]:
        (lo, hi), asked = known[name], []
        edges = [lo]
        while hi > known[name][0] and len(edges) <= MOST_BINS:
            lo, found, guessed = edges[-1], None, False
            for i, c in enumerate(candidates(lo, hi)):
                least, most, guess = (exact[name, lo][i],) * 3 if (name, lo) in exact else index[name].purity(lo, c)
                if least <= threshold < most:
                    guessed, least = True, guess
                if least > threshold:
                    found = float(c)
                    break
            if guessed:
                asked.append((name, lo, hi))
            if found is None or found <= lo:
                break
            edges.append(found)
        return edges, asked

    while True:
        got = {name: search(name) for name in known}
        asked = [x for _, more in got.values() for x in more]
        if not asked:
            return {name: got[name][0] if name in got else [] for name in pairs}
        exact |= exact_purities(df, pairs, asked)


def purity_edges(df: DataFrame, truth: str, reco: str, threshold: float = PURITY) -> list[float]:
    return purity_edges_all(df, {"v": (truth, reco)}, threshold)["v"]


def binned_counts(df: DataFrame, column: str, edges: list[float]) -> np.ndarray:
    shown = F.array(*[F.lit(float(e)) for e in edges])
    out = np.zeros(len(edges) - 1)
    for r in df.groupBy(saturated_bin(F.col(column), shown).alias("bin")).agg(F.count("*").alias("n")).collect():  # one row a bin
        out[r["bin"]] = r["n"]
    return out


def response(df: DataFrame, truth: str, reco: str, edges: list[float]) -> np.ndarray:
    """P(reco bin | truth bin); rows without events are 0."""
    shown = F.array(*[F.lit(float(e)) for e in edges])
    n = len(edges) - 1
    out = np.zeros((n, n))
    pairs = df.groupBy(saturated_bin(F.col(truth), shown).alias("t"), saturated_bin(F.col(reco), shown).alias("r")).agg(F.count("*").alias("n"))
    for row in pairs.collect():  # at most n ** 2 rows
        out[row["t"], row["r"]] = row["n"]
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def iterate(prior: np.ndarray, data: np.ndarray, matrix: np.ndarray, rounds: int = 10, strict: bool = False) -> list[np.ndarray]:
    """Unfolded spectra after 0, 1, .. rounds."""
    out = [prior.astype(float)]
    for _ in range(rounds):
        folded = matrix.T @ out[-1]
        if strict and ((folded <= 0) & (data > 0)).any():
            raise ValueError("data in bins that the simulation can't reach")
        share = np.divide(data, folded, out=np.zeros_like(folded), where=folded > 0)
        out.append(out[-1] * (matrix @ share))
    return out


def bin_weights(unfolded: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Unfolded over prior; 0 where the prior is, if nothing was unfolded there."""
    if (unfolded[prior == 0] > EPSILON).any():
        raise ValueError("unfolded events in bins without a prior")
    return np.divide(unfolded, prior, out=np.zeros_like(unfolded), where=prior > 0)


def unfold_variable(df: DataFrame, truth: str, reco: str, rounds: int = 10, threshold: float = PURITY, edges: list[float] | None = None) -> dict:
    """Edges (searched unless given), spectra and bin weights of one variable; status skipped below two bins."""
    edges = purity_edges(df.where("y = 0"), truth, reco, threshold) if edges is None else edges
    return _unfolded(df, {"v": (truth, reco)}, {"v": edges}, rounds)["v"]


def _bin_counts(df: DataFrame, pairs: list[tuple[str, str]], edges: list[np.ndarray]) -> list[np.ndarray]:
    """Per variable: simulated events by truth and detector bin, then observed ones by detector bin; one pass for all."""
    sizes = [len(e) - 1 for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n * n + n, np.int64) for n in sizes]
        for table in blocks.joined(batches):
            y = table.column(0).to_numpy()
            for i, n in enumerate(sizes):
                t, r = (np.clip(np.searchsorted(edges[i], table.column(1 + 2 * i + k).to_numpy(), "right") - 1, 0, n - 1) for k in (0, 1))
                total[i] += np.bincount(np.concatenate([(t * n + r)[y == 0], n * n + r[y == 1]]), minlength=n * n + n)
        for i, v in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["v", "i", "n"])

    # a null is below all edges
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(f"c{2 * i + k}") for i, pair in enumerate(pairs) for k, c in enumerate(pair)]
    got = df.where("y IN (0, 1)").select(F.col("y").cast("int").alias("y"), *columns).mapInArrow(run, "v int, i int, n long").groupBy("v", "i").agg(F.sum("n").alias("n")).toArrow()  # n ** 2 + n rows a variable
    v, at, count = (got[c].to_numpy() for c in ("v", "i", "n"))
    out = [np.zeros(n * n + n) for n in sizes]
    for i, held in enumerate(out):
        held[at[v == i]] = count[v == i]
    return out


def _unfolded(df: DataFrame, pairs: dict[str, tuple[str, str]], edges: dict[str, list[float]], rounds: int) -> dict[str, dict]:
    """``unfold_variable`` of every variable with its edges: one pass counts all bins of all of them."""
    out = {name: {"status": "skipped", "edges": e, "weights": [1.0]} for name, e in edges.items()}
    used = [name for name, e in edges.items() if len(e) >= 3]
    if not used:
        return out
    found = _bin_counts(df, [pairs[name] for name in used], [np.asarray(edges[name], float) for name in used])
    for i, name in enumerate(used):
        n = len(edges[name]) - 1
        both, data = found[i][: n * n].reshape(n, n), found[i][n * n :]
        prior = both.sum(axis=1)
        matrix = np.divide(both, prior[:, None], out=np.zeros((n, n)), where=prior[:, None] > 0)
        steps = iterate(prior, data, matrix, rounds)
        out[name] = {"status": "ok", "edges": edges[name], "prior": prior.tolist(), "unfolded": steps[-1].tolist(), "weights": bin_weights(steps[-1], prior).tolist()}
    return out


def event_weights(df: DataFrame, column: str, result: dict) -> Column:
    """The weight of an event by its truth bin, found by halves among at most 50."""
    if result["status"] == "skipped":
        return F.lit(1.0)
    inner, found = [float(e) for e in result["edges"][1:-1]], [float(w) for w in result["weights"]]
    v = F.col(column)

    def among(a: int, b: int) -> Column:
        if a == b:
            return F.lit(found[a])
        middle = (a + b) // 2
        return F.when(v < inner[middle], among(a, middle)).otherwise(among(middle + 1, b))

    return F.when(v.isNull(), F.lit(found[0])).otherwise(among(0, len(found) - 1))


def unfold_all(df: DataFrame, pairs: dict[str, tuple[str, str]], rounds: int = 10, threshold: float = PURITY, fitted_on: Column | None = None) -> dict[str, dict]:
    """``unfold_variable`` of each name's (truth, reco) columns, on the rows where ``fitted_on`` is true (all by default).

    A sample without rows of both classes is an error.
    """
    rows = df if fitted_on is None else df.where(fitted_on)
    rows = rows.select("y", *dict.fromkeys(c for pair in pairs.values() for c in pair)).persist()
    try:
        n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not n.get(0) or not n.get(1):
            raise ValueError("unfolding needs observed and simulated rows")
        edges = purity_edges_all(rows.where("y = 0"), pairs, threshold)
        return _unfolded(rows, pairs, edges, rounds)
    finally:
        rows.unpersist()


def reweighted(df: DataFrame, pairs: dict[str, tuple[str, str]], results: dict[str, dict]) -> DataFrame:
    """``df`` with w: the product of all variables' weights."""
    return joint_weights(df.drop("w"), {name: event_weights(df, pairs[name][0], r) for name, r in results.items()})


def outcomes(spark: SparkSession, results: dict[str, dict]) -> DataFrame:
    """variable, status, bins."""
    return spark.createDataFrame([(k, r["status"], len(r["edges"]) - 1) for k, r in results.items()], "variable string, status string, bins int")


def bin_table(spark: SparkSession, results: dict[str, dict]) -> DataFrame:
    """variable, bin, lo, hi, prior, unfolded, weight of the variables that were unfolded."""
    rows = [(k, i, *map(float, v)) for k, r in results.items() if r["status"] == "ok" for i, v in enumerate(zip(r["edges"], r["edges"][1:], r["prior"], r["unfolded"], r["weights"]))]
    return spark.createDataFrame(rows, "variable string, bin int, lo double, hi double, prior double, unfolded double, weight double")


def joint_weights(df: DataFrame, weights: dict[str, Column], name: str = "w") -> DataFrame:
    """The product of all variables' weights, of mean 1 over the simulated rows; a factor of 0 stays 0."""
    both = df.withColumn(name, product(F.array(*weights.values())))
    mean = both.where("y = 0").agg(F.avg(name).alias("_m"))  # one row
    return both.crossJoin(F.broadcast(mean)).withColumn(name, F.when(F.col("y") == 0, F.col(name) / F.col("_m")).otherwise(1.0)).drop("_m")
