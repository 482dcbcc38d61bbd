"""Diagnostics from shards: few reads of the table, the same subsample, no scale of weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import ceiling, distances, learning, sampling


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    y = np.arange(1_500) % 3 % 2
    z = rng.normal(size=1_500) + 0.8 * y
    x = z + 0.3 * rng.normal(size=1_500)
    w = np.exp(0.8 * z - 0.32)
    return spark.createDataFrame([(f"r{i}", int(a), float(b), float(c), float(d)) for i, a, b, c, d in zip(range(1_500), y, z, x, w)], "row_id string, y int, z1 double, x1 double, w double").repartition(3)


def run(df):
    got = ceiling.diagnostics(df, ("z1",), ("x1",), folds=3, settings=learning.Settings(hidden=(4,), epochs=2, batch=64), size=100, shard_rows=400)
    return {(r["diagnostic"], r["level"], r["quantity"]): r["value"] for r in got.collect()}


def test_the_table_is_read_three_times_and_the_scale_of_weights_is_no_matter(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = run(rows.mapInArrow(counted, rows.schema))
    assert read.value == 3 * 1_500
    scaled = run(rows.withColumn("w", F.col("w") * 8))
    assert got.keys() == scaled.keys()
    for k, v in got.items():
        assert v == pytest.approx(scaled[k], rel=1e-9, abs=1e-12)
    plain = {r["dim"]: r["unit"] for r in distances.wide_wasserstein(rows, ("z1", "x1"), {"unit": None}).collect()}
    assert got["oracle", "particle", "w1 z1 unit"] == pytest.approx(plain["z1"], rel=1e-9)
    assert got["oracle", "detector", "w1 x1 unit"] == pytest.approx(plain["x1"], rel=1e-9)
    w = np.array([r["w"] for r in rows.where("y = 0").select("w").collect()])
    assert got["audit", "particle", "share"] == pytest.approx(w.sum() ** 2 / (w * w).sum() / len(w), rel=1e-9)


@pytest.mark.parametrize("m", [1, 30, 400, 5_000])
def test_subsamples_of_known_classes_are_those_in_hash_order(spark, rows, m):
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    want = sorted(map(tuple, sampling.small_subsample(rows, m, 3).collect()))
    assert sorted(map(tuple, sampling.subsample_of_known(rows, m, 3, sizes).collect())) == want


def test_a_key_of_many_rows_is_left_to_the_tasks(spark, rows):
    same = rows.withColumn("row_id", F.when(F.col("y") == 1, F.lit("r1")).otherwise(F.col("row_id")))
    sizes = {r["y"]: r["n"] for r in same.groupBy("y").agg(F.count("*").alias("n")).collect()}
    got = sampling.subsample_of_known(same, 2, 0, sizes)
    assert got.groupBy("y").count().where("count <> 2").count() == 0 and got.count() == 4
    assert sorted(r["row_id"] for r in got.where("y = 0").collect()) == sorted(r["row_id"] for r in sampling.small_subsample(same, 2, 0).where("y = 0").collect())
