"""Logistic fits in scans: they keep no rows, and reach the optimum."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import reweight


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    y = np.arange(2_000) % 2
    z = rng.normal(size=2_000) - 0.5 * y
    x = z + 0.3 * rng.normal(size=2_000)
    return spark.createDataFrame([(f"r{i}", int(a), float(b), float(c), 1.0) for i, a, b, c in zip(range(2_000), y, z, x)], "row_id string, y int, z1 double, x1 double, w double").repartition(3)


def test_iterated_fits_keep_no_rows(spark, rows, monkeypatch):
    kept = []
    java = spark.sparkContext._jsc.sc()
    summed = reweight.learning.summed
    monkeypatch.setattr(reweight.learning, "summed", lambda r: (summed(r), kept.append(java.getPersistentRDDs().size()))[0])
    before = java.getPersistentRDDs().size()
    out = reweight.iterate(rows, ("z1",), ("x1",), 2)
    assert len(kept) >= 8 and set(kept) == {before} and java.getPersistentRDDs().size() == before
    assert "InMemory" not in out._jdf.queryExecution().executedPlan().toString()


def test_coefficients_are_the_optimum(rows):
    data = rows.withColumn("features", F.array("x1", F.col("x1") * F.col("x1"), F.lit(2.0))).withColumn("weight", 1 + F.abs("z1"))
    p = reweight.classify(data, F.col("y"), F.col("weight"))
    at = data.select("y", "x1", "weight", p.alias("p")).toPandas().to_numpy()
    y, x, w, p = at.T
    f = np.vstack([np.ones(len(x)), x, x * x])
    slope = f @ (w * (p - y)) / w.sum()
    assert abs(slope[0]) < 1e-9 and np.abs(slope).max() < 1e-5  # all that is left is the penalty
    assert 0 < p.min() and p.max() < 1 and np.ptp(p) > 0.2


def test_parted_labels_equal_two_rows(rows):
    share = 1 / (1 + F.exp(F.col("z1")))
    one = rows.select(F.array("x1").alias("features"), share.alias("label"), F.lit(3.0).alias("weight"))
    two = one.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (3 * F.col("label")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (3 - 3 * F.col("label")).alias("weight")))).alias("s")).select("features", "s.*")
    a, b = (d.agg(F.sum(reweight.classify(d, F.col("label"), F.col("weight")) * F.get("features", F.lit(0)))).first()[0] for d in (one, two))
    assert a * 2 == pytest.approx(b, rel=1e-9)


def test_separable_rows_end_and_odd_numbers_are_refused(spark):
    df = spark.createDataFrame([(0, -1.0), (0, -2.0), (1, 1.0), (1, 2.0)], "y int, x double").withColumn("features", F.array("x"))
    got = {r["x"]: r["p"] for r in df.select("x", reweight.classify(df, F.col("y"), F.lit(1.0)).alias("p")).collect()}
    assert got[-1.0] < 0.01 and got[1.0] > 0.99 and all(math.isfinite(v) for v in got.values())
    for odd in (None, float("nan"), float("inf")):
        bad = df.unionByName(spark.createDataFrame([(1, odd)], "y int, x double").withColumn("features", F.array("x")))
        with pytest.raises(ValueError):
            reweight.classify(bad, F.col("y"), F.lit(1.0))
