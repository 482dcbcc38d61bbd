"""Exponential tilts: weights exp(-b.T) that match moments of polynomial statistics."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monomials(columns: tuple[str, ...], degree: int) -> dict[str, Column]:
    """All monomials of degree 1..degree, named by their factors."""
    out = {}
    for k in range(1, degree + 1):
        for some in combinations_with_replacement(columns, k):
            c = F.lit(1.0)
            for name in some:
                c = c * F.col(name)
            out["_".join(some)] = c
    return out


def moments(df: DataFrame, statistics: dict[str, Column], w: str = "w") -> DataFrame:
    """statistic, mean: weighted means."""
    total = F.sum(w)
    got = df.agg(*[(F.sum(F.col(w) * c) / total).alias(n) for n, c in statistics.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("mean")) for n in statistics])
    return got.select(F.explode(pairs).alias("p")).select("p.*")


def standardized(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    stats = df.where("y = 0").agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])  # one row
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def exponent(statistics: dict[str, Column], beta: np.ndarray) -> Column:
    z = F.lit(0.0)
    for c, b in zip(statistics.values(), beta):
        z = z - c * float(b)
    return z


def fit(df: DataFrame, statistics: dict[str, Column], targets: np.ndarray, rounds: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """Newton's method for E_w[T] = targets over simulated rows; every step is one aggregate of moments and cross-moments."""
    mc = df.where("y = 0")
    names = list(statistics)
    beta = np.zeros(len(names))
    at = mc.select(*[c.alias(f"t{i}") for i, c in enumerate(statistics.values())]).persist()
    try:
        t = {n: F.col(f"t{i}") for i, n in enumerate(names)}
        for _ in range(rounds):
            z = exponent(t, beta)
            shift = at.agg(F.max(z)).first()[0]
            w = F.exp(z - shift)
            sums = [F.sum(w).alias("s"), *[F.sum(w * F.col(f"t{i}")).alias(f"m{i}") for i in range(len(names))]]
            sums += [F.sum(w * F.col(f"t{i}") * F.col(f"t{j}")).alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
            got = at.agg(*sums).first()
            mean = np.array([got[f"m{i}"] for i in range(len(names))]) / got["s"]
            cov = np.empty((len(names), len(names)))
            for i in range(len(names)):
                for j in range(i + 1):
                    cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] / got["s"] - mean[i] * mean[j]
            gap = mean - targets
            if np.abs(gap).max() < tolerance:
                break
            step = np.linalg.solve(cov + 1e-12 * np.eye(len(names)), gap)
            beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        return beta
    finally:
        at.unpersist()


def apply(df: DataFrame, statistics: dict[str, Column], beta: np.ndarray, name: str = "w") -> DataFrame:
    """Count-preserving weights on simulated rows, shifted before the exponential; 1 on observed rows."""
    z = F.when(F.col("y") == 0, exponent(statistics, beta))
    both = df.withColumn("_z", z)
    shift = both.agg(F.max("_z").alias("_x"))  # one row
    both = both.crossJoin(F.broadcast(shift)).withColumn("_e", F.exp(F.col("_z") - F.col("_x")))
    total = both.agg(F.sum("_e").alias("_t"), F.count("_e").alias("_n"))  # one row
    return both.crossJoin(F.broadcast(total)).withColumn(name, F.coalesce(F.col("_e") * F.col("_n") / F.col("_t"), F.lit(1.0))).drop("_z", "_x", "_e", "_t", "_n")


def moment_transfer(df: DataFrame, column: str, weight: str = "w") -> DataFrame:
    """observed, simulated, weighted mean of a column, and the percentage of their difference that the weights close."""
    v, w, one = F.col(column), F.col(weight), F.col("y") == 1
    out = df.agg(
        F.avg(F.when(one, v)).alias("observed"), F.avg(F.when(~one, v)).alias("simulated"), (F.sum(F.when(~one, v * w)) / F.sum(F.when(~one, w))).alias("weighted")
    )
    gap = F.col("observed") - F.col("simulated")
    return out.withColumn("closed", F.when(gap != 0, 100 * (F.col("weighted") - F.col("simulated")) / gap))
