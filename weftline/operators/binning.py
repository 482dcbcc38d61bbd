"""Histograms. Four binnings differ in their edges and in what falls outside.

* metric bins: uniform over both samples' range, left-closed, the last closed
* saturated bins: given edges, everything outside goes into the end bins
* nudged bins: outer edges moved out by 1e-9 of the span, the rest dropped
* fixed bins: given uniform range, the rest dropped
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expressions import ratio
from weftline.operators import sorted_areas

#: Rows of a dimension that are cumulated or ordered by one task.
STRETCH = 250_000
#: Value ranges of a dimension, at most: the start of each is broadcast.
MOST_STRETCHES = 1 << 16


def edge(lo: Column, hi: Column, i: Column, bins: int) -> Column:
    return lo + (hi - lo) * i / bins


def uniform_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin between two edges that holds v, by a guess and a look at the edges beside it; 0 for a range of no width."""
    guess = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - lo) / (hi - lo) * bins).cast("int")))
    fixed = F.when(v < edge(lo, hi, guess, bins), guess - 1).when(v >= edge(lo, hi, guess + 1, bins), guess + 1).otherwise(guess)
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(bins - 1), fixed))).otherwise(F.lit(0))


def ranges(long: DataFrame) -> DataFrame:
    """dim, lo, hi over both samples."""
    return long.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def histogram(long: DataFrame, bins: int = 100) -> DataFrame:
    """dim, bin, p, q: weights of the observed and the simulated sample in metric bins, each of sum 1 (or 0)."""
    placed = long.join(F.broadcast(ranges(long)), "dim").withColumn("bin", uniform_bin(F.col("v"), F.col("lo"), F.col("hi"), bins))  # one row a dimension
    mass = placed.groupBy("dim", "bin").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("b")
    )
    total = mass.groupBy("dim").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return mass.join(F.broadcast(total), "dim").select("dim", "bin", ratio(F.col("a"), F.col("ta")).alias("p"), ratio(F.col("b"), F.col("tb")).alias("q"))


def saturated_bin(v: Column, edges: Column) -> Column:
    """0-based bin of v among ascending edges; below the first and above the last go to the end bins."""
    return F.greatest(F.lit(0), F.least(F.size(edges) - 2, F.size(F.filter(edges, lambda e: e <= v)) - 1))


def nudged_edges(edges: list[float]) -> list[float]:
    span = edges[-1] - edges[0]
    if not span > 0:
        raise ValueError("a constant column has no bins")
    return [edges[0] - 1e-9 * span, *edges[1:-1], edges[-1] + 1e-9 * span]


def dropping_bin(v: Column, edges: Column) -> Column:
    """0-based bin of v, NULL outside; the last bin is closed."""
    n = F.size(edges)
    inside = (v >= F.get(edges, F.lit(0))) & (v <= F.element_at(edges, -1))
    return F.when(inside, F.least(n - 2, F.size(F.filter(edges, lambda e: e <= v)) - 1))


def stretch_levels(rows: int) -> int:
    """Binary digits of a stretch number, so that a stretch has about ``STRETCH`` rows; there are at most ``MOST_STRETCHES``."""
    return max(0, min(-(-rows // STRETCH), MOST_STRETCHES) - 1).bit_length()


def stretch_cuts(v: str, levels: int) -> Column:
    """Approximate quantiles of v, one less than there are stretches; for one stretch the median, which isn't used."""
    return F.percentile_approx(v, [i / (1 << levels) for i in range(1, 1 << levels)] or [0.5], 10 << levels)


def with_stretch(df: DataFrame, v: str, levels: int) -> DataFrame:
    """``df`` (v, _cuts) with _stretch: the number of cuts below v, found one binary digit at a time. Equal values share a stretch."""
    out = df.withColumn("_stretch", F.lit(0))
    for k in reversed(range(levels)):
        out = out.withColumn("_stretch", F.col("_stretch") + F.when(F.get("_cuts", F.col("_stretch") + ((1 << k) - 1)) < F.col(v), 1 << k).otherwise(0))
    return out


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Linear quantiles by counting: the cells that hold a wanted rank are cut finer, scan by scan, until each holds one value.

    Nulls don't count, NaN is the largest value; a column without values is an error.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(F.array(v).alias("v"))
    inf = float("inf")
    finite = F.when(~F.isnan(v) & (F.abs(v) < inf), v)
    seen = df.agg(F.count(v).alias("n"), F.count_if(v == -inf).alias("low"), F.count(finite).alias("finite"), F.count_if(v == inf).alias("high"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    n, below = seen["n"], seen["low"]
    if not n:
        raise ValueError(f"{column} has no values")
    places = sorted({int(f(s * (n - 1))) for s in shares for f in (np.floor, np.ceil)})
    value = {k: -inf if k < below else inf if k < below + seen["finite"] + seen["high"] else float("nan") for k in places}
    asked = np.array([k for k in places if below <= k < below + seen["finite"]])
    if len(asked):
        lo, hi = np.array([seen["lo"]]), np.array([seen["hi"]])
        levels = [sorted_areas.whole(lo, hi)]
        ahead = np.array([below])  # rows before each open cell
        while len(asked):
            found = sorted_areas.counts(rows, levels)
            cell, inside, first, last = (found[c].to_numpy() for c in ("c", "n", "first", "last"))
            parent = levels[-1].parents(cell)
            upto = np.cumsum(inside)
            start = ahead[parent] + (upto - inside) - (upto - inside)[np.searchsorted(parent, parent, side="left")]
            at = np.searchsorted(start, asked, side="right") - 1
            done = first[at] == last[at]
            value |= {int(k): float(x) for k, x in zip(asked[done], first[at[done]])}
            asked, still = asked[~done], np.unique(at[~done])
            if len(asked):
                ahead = start[still]
                levels.append(sorted_areas.finer(levels[-1], cell[still], inside[still], first[still], last[still], bits=len(levels) % 2 == 0))
    out = []
    for s in shares:
        a = s * (n - 1)
        low, high = value[int(np.floor(a))], value[int(np.ceil(a))]
        out.append(low if low == high else float(low + (a - np.floor(a)) * (high - low)))
    return out


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Edges of bins of equal content: linear quantiles, equal ones once, the outer two nudged."""
    return nudged_edges(sorted(set(exact_quantiles(df, column, [i / bins for i in range(bins + 1)]))))


def response_matrix(df: DataFrame, truth_bin: str, reco_bin: str, bins: int) -> DataFrame:
    """t, r, p: the share of each truth bin that is found in each detector bin; rows without events are all 0."""
    n = df.groupBy(F.col(truth_bin).alias("t"), F.col(reco_bin).alias("r")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    every = spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("t"), (F.col("id") % bins).cast("int").alias("r"))
    total = n.groupBy("t").agg(F.sum("n").alias("total"))
    return every.join(n, ["t", "r"], "left").join(total, "t", "left").select("t", "r", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("p"))


def fixed_histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, weight: str | None = None) -> DataFrame:
    """bin, content over a fixed range; what lies outside is dropped."""
    v = F.col(column)
    inside = df.where((v >= lo) & (v <= hi))
    w = F.lit(1.0) if weight is None else F.col(weight)
    return inside.groupBy(uniform_bin(v, F.lit(lo), F.lit(hi), bins).alias("bin")).agg(F.sum(w).alias("content"))


def bin_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """Content of a over b by bin, NaN where b has none."""
    other = b.select("bin", F.col("content").alias("other"))
    return a.join(other, "bin", "full").select(
        "bin", F.when(F.coalesce("other", F.lit(0.0)) > 0, F.coalesce("content", F.lit(0.0)) / F.col("other")).otherwise(F.lit(float("nan"))).alias("ratio")
    )
