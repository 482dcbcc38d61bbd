"""Weights from classifiers: density ratios and iterated reweighting.

Features and weights are expressions of a row's own columns. A fit reads them in
a few scans of the table, each of which adds up a handful of numbers; no row is
kept between scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations_with_replacement
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import learning
from weftline.operators.weights import likelihood_ratio

#: Penalty on squared coefficients of features of deviation 1.
PENALTY = 1e-6
#: A fit ends with the step that can lower the mean loss by less than this.
TOLERANCE = 1e-11


def polynomial(values: list[Column], scale: list[tuple[float, float]], degree: int = 2) -> Column:
    """An array: all products of one to ``degree`` of the values, standardized by (mean, deviation); a constant column counts as 0."""
    z = [(v.cast("double") - F.lit(m)) * F.lit(1 / s if s else 0.0) for v, (m, s) in zip(values, scale)]
    return F.array(*[reduce(mul, c) for d in range(1, degree + 1) for c in combinations_with_replacement(z, d)])


def _scales(df: DataFrame, groups: list[dict[str, Column]]) -> tuple[list[list[tuple[float, float]]], dict[int, int]]:
    """Mean and deviation of every column of each group, and the rows of both classes, in one pass."""
    both = [(F.avg(v.cast("double")), F.stddev_samp(v.cast("double"))) for g in groups for v in g.values()]
    found = df.agg(*[F.count_if(F.col("y") == c).alias(f"n{c}") for c in (0, 1)], *[f.alias(f"_{i}_{j}") for i, pair in enumerate(both) for j, f in enumerate(pair)]).first()
    n = {c: found[f"n{c}"] for c in (0, 1)}
    if not n[0] or not n[1]:
        raise ValueError("rows of both classes are needed")
    scale = iter([(float(found[f"_{i}_0"]) if found[f"_{i}_0"] is not None else 0.0, float(found[f"_{i}_1"] or 0.0)) for i in range(len(both))])
    return [[next(scale) for _ in g] for g in groups], n


def numbers(df: DataFrame, column: str) -> Column:
    """An array of doubles, of an array or a vector."""
    from pyspark.ml.functions import vector_to_array

    return F.col(column) if df.schema[column].dataType.typeName() == "array" else vector_to_array(column)


def classify(df: DataFrame, label: Column, weight: Column, column: str = "features", rounds: int = 50) -> Column:
    """Fits a weighted logistic regression on a column of arrays; the probability of label 1, for any frame with that column.

    Newton steps: a scan adds up loss, gradient and curvature at the present
    coefficients. A step that doesn't lower the loss is halved. Labels between 0
    and 1 count in parts as both. Null or non-finite numbers are an error.
    """
    values = numbers(df, column)
    size = df.select(F.size(values).alias("n")).first()["n"]
    data = df.select(label.cast("double").alias("y"), weight.cast("double").alias("w"), *[F.get(values, F.lit(i)).alias(f"f{i}") for i in range(size)])

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Loss, gradient, curvature and weight in all."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + len(b) + len(b) ** 2)
            for batch in batches:
                y, w, *f = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                x = np.vstack([np.ones(len(y)), *f])
                z = b @ x
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z
                total += np.concatenate([[w @ loss, w.sum()], x @ (w * (p - y)), ((x * (w * p * (1 - p))) @ x.T).ravel()])
            yield from learning.vectors({0: total})

        got = learning.summed(data.mapInArrow(task, learning.VECTORS)).get(0, np.zeros(2 + len(b) + len(b) ** 2))
        if not np.isfinite(got).all():
            raise ValueError("labels, weights and features must be finite numbers")
        if not got[1] > 0:
            raise ValueError("positive weights are needed")
        loss, _, *rest = got / got[1]
        return float(loss), np.array(rest[: len(b)]), np.array(rest[len(b) :]).reshape(len(b), -1), float(got[1])

    b = np.zeros(size + 1)
    loss, slope, curve, total = at(b)
    moments = 4 * curve  # of the features, since all probabilities are a half
    var = np.maximum(np.diag(moments) - moments[0] ** 2, 0)
    used = np.append(True, var[1:] > 1e-12 * np.maximum(np.diag(moments)[1:], 1e-300))  # a constant feature has no coefficient
    ridge = np.where(used, PENALTY * var, 0.0)
    ridge[0] = 0.0
    unit = np.where(used, np.sqrt(np.append(1.0, np.where(used[1:], var[1:], 1.0))), 1.0)  # solved in features of deviation 1
    loss += float(ridge @ b**2) / 2
    for _ in range(rounds):
        g = np.where(used, (slope + ridge * b) / unit, 0.0)
        h = np.where(np.outer(used, used), (curve + np.diag(ridge)) / np.outer(unit, unit), 0.0) + np.diag(np.where(used, 1e-14, 1.0))
        step = np.linalg.solve(h, g)
        gain = float(g @ step) / 2
        step = step / unit
        if gain < TOLERANCE:
            b = b - step
            break
        share = 1.0
        while True:
            new = b - share * step
            then, slope, curve, _ = at(new)
            then += float(ridge @ new**2) / 2
            if then <= loss or share < 1e-6:
                break
            share /= 2
        b, loss = new, then
    z = F.lit(float(b[0]))
    for i, c in enumerate(b[1:]):
        z = z + F.lit(float(c)) * F.get(values, F.lit(i))
    return 1 / (1 + F.exp(-z))


#: (data, label, weight, features column) to the probability of label 1: ``classify`` or a caller's own.
Classifier = Callable[[DataFrame, Column, Column, str], Column]


def density_ratio(df: DataFrame, columns: tuple[str, ...], degree: int = 2, classifier: Classifier = classify) -> DataFrame:
    """``df`` with ratio: observed over simulated density, from class-balanced weights, clipped, of mean 1 where y = 0."""
    (scale,), n = _scales(df, [{c: F.col(c) for c in columns}])
    data = df.withColumn("features", polynomial([F.col(c) for c in columns], scale, degree))
    balance = F.when(F.col("y") == 1, F.lit(sum(n.values()) / (2 * n[1]))).otherwise(F.lit(sum(n.values()) / (2 * n[0])))
    p = classifier(data, F.col("y"), balance, "features")
    both = data.withColumn("ratio", likelihood_ratio(p, 1e-6)).drop("features")
    mean = both.where("y = 0").agg(F.avg("ratio").alias("_m"))  # one row
    return both.crossJoin(F.broadcast(mean)).withColumn("ratio", F.col("ratio") / F.col("_m")).drop("_m")


def iterate(df: DataFrame, truth: tuple[str, ...], reco: tuple[str, ...], rounds: int = 3, degree: int = 2, classifier: Classifier = classify) -> DataFrame:
    """``df`` with w: simulated events reweighted at detector level (pull), then as a function of truth (push), in turn.

    Step 1 separates observed from weighted simulated events by their detector
    columns. Step 2 separates simulated events with step-1 weights from the same
    events without, by their truth columns. Truth of observed events isn't read.
    """
    push = F.lit(1.0)
    mc = F.col("y") == 0
    (on_reco, on_truth), n = _scales(df, [{c: F.col(c) for c in reco}, {c: F.when(mc, F.col(c)) for c in truth}])
    both = df.drop("w").withColumn("f_reco", polynomial([F.col(c) for c in reco], on_reco, degree))
    both = both.withColumn("f_truth", polynomial([F.when(mc, F.col(c)).otherwise(F.lit(0.0)) for c in truth], on_truth, degree))
    for _ in range(rounds):
        now = both.withColumn("push", F.when(mc, push).otherwise(1.0))
        p = classifier(now, F.col("y"), F.when(F.col("y") == 1, F.lit(n[0] / n[1])).otherwise(F.col("push")), "f_reco")
        pulled = now.where("y = 0").withColumn("pull", F.col("push") * likelihood_ratio(p, 1e-6))
        if classifier is classify:  # both sides of an event in one row
            pair = pulled.select("f_truth", (F.col("pull") / (1 + F.col("pull"))).alias("label"), (1 + F.col("pull")).alias("weight"))
        else:
            sides = F.array(F.struct(F.lit(1).alias("label"), F.col("pull").alias("weight")), F.struct(F.lit(0).alias("label"), F.lit(1.0).alias("weight")))
            pair = pulled.select("row_id", "f_truth", F.explode(sides).alias("s")).select("row_id", "f_truth", "s.label", "s.weight")
        push = likelihood_ratio(classifier(pair, F.col("label"), F.col("weight"), "f_truth"), 1e-6)
    out = both.withColumn("w", F.when(mc, push))
    mean = out.agg(F.avg("w").alias("_m")).first()["_m"]
    return out.withColumn("w", F.coalesce(F.col("w") / F.lit(mean), F.lit(1.0))).drop("f_reco", "f_truth")


def response_gain(df: DataFrame, p_without: Column, p_with: Column) -> DataFrame:
    """One row, nats, bits and se: how much a second set of columns lowers the classifier's loss, paired by event.

    The error is class-stratified: half the root of the summed variances of the class means.
    """
    y = F.col("y")

    def loss(p: Column) -> Column:
        q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
        return -(y * F.log(q) + (1 - y) * F.log(1 - q))

    by_class = df.withColumn("_d", loss(p_without) - loss(p_with)).groupBy("y").agg(F.avg("_d").alias("m"), F.var_samp("_d").alias("v"), F.count("*").alias("n"))
    return by_class.agg(F.avg("m").alias("nats"), (F.avg("m") / F.log(F.lit(2.0))).alias("bits"), (F.sqrt(F.sum(F.col("v") / F.col("n"))) / 2).alias("se"))
