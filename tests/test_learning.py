"""The many-model trainer: batches, dealing, stopping, scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import learning, reweight


def moons(spark, n=4_000, parts=4):
    """Two correlated normal samples with equal means and spreads that only products tell apart."""
    rng = np.random.default_rng(5)
    y = np.arange(n) % 2
    a, e = rng.normal(size=(2, n))
    b = np.where(y == 1, 0.8, -0.8) * a + 0.6 * e
    return spark.createDataFrame([(int(i), int(k), float(u), float(v)) for i, k, u, v in zip(range(n), y, a, b)], "row_id long, y int, x1 double, x2 double").repartition(parts)


def plain(held=0.2):
    return lambda d: (d["y"], np.ones(len(d["y"])), learning.uniform(d["key"], "held") < held)


def test_batches_tile_the_rows_and_no_row_comes_twice_in_an_epoch():
    for n in (0, 1, 7, 256, 1000):
        got = learning.batches(n, 256, np.random.default_rng([3, n]))
        assert sorted(np.concatenate(got).tolist() if got else []) == list(range(n))
        assert all(len(b) == 256 for b in got[:-1])
    a, b = (np.concatenate(learning.batches(500, 64, np.random.default_rng([0, epoch]))) for epoch in (1, 2))
    assert not np.array_equal(a, b)


def test_counts_of_a_bootstrap_sample():
    key = np.arange(200_000).astype(np.int64)
    m = learning.multiplicities(key, "b", 1)
    assert abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.02 and abs((m == 0).mean() - math.exp(-1)) < 0.005
    assert not np.array_equal(m, learning.multiplicities(key, "b", 2))


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_results_do_not_depend_on_files_or_partitions(spark, parts):
    shards = learning.sharded(moons(spark, 3_000, parts), "row_id", ("y", "x1", "x2"), rows=700)
    assert shards.count() == 5
    tasks = {0: learning.Task(("x1", "x2"), plain(), 1), 1: learning.Task(("x1",), plain(), 2)}
    fits = learning.fit_all(shards, tasks, learning.Settings(epochs=6))
    want = test_results_do_not_depend_on_files_or_partitions.__dict__.setdefault("want", fits)
    for m, f in fits.items():
        assert np.allclose(f.losses, want[m].losses, atol=1e-9)
        assert all(np.allclose(a, b, atol=1e-7) for a, b in zip(f.parameters, want[m].parameters))


def test_early_stopping_and_a_sample_that_lines_cannot_part(spark):
    df = moons(spark)
    shards = learning.sharded(df, "row_id", ("y", "x1", "x2"), rows=1_000)
    fit = learning.fit_all(shards, {0: learning.Task(("x1", "x2"), plain(), 3)}, learning.Settings(epochs=200, patience=3))[0]
    assert len(fit.losses) < 200 and fit.losses[fit.best] < 0.55 < fit.losses[0]
    net = learning.network_classifier(learning.Settings(epochs=30))
    ratio = reweight.density_ratio(df, ("x1", "x2"), degree=1, classifier=net)
    lines = reweight.density_ratio(df, ("x1", "x2"), degree=1)

    def product(d):
        return d.where("y = 0").agg((F.sum(F.col("ratio") * F.col("x1") * F.col("x2")) / F.sum("ratio")).alias("m")).first()["m"]

    # observed products have mean 0.8, simulated ones -0.8
    assert product(ratio) > 0 and product(lines) < -0.6


def test_one_scan_an_epoch_whatever_the_number_of_models(spark):
    shards = learning.sharded(moons(spark, 1_000), "row_id", ("y", "x1", "x2"), rows=500).persist()
    calls = []
    original = learning.sums
    try:
        learning.sums = lambda *a: calls.append(1) or original(*a)
        for n in (1, 12):
            calls.clear()
            learning.fit_all(shards, {m: learning.Task(("x1", "x2"), plain(), m) for m in range(n)}, learning.Settings(epochs=2, patience=9))
            assert len(calls) == 4  # scales, two epochs, the last loss
    finally:
        learning.sums = original
        shards.unpersist()


def test_nulls_empty_tables_and_constant_columns(spark):
    df = spark.createDataFrame([(i, i % 2, None if i % 5 else 1.0, 2.0) for i in range(60)], "row_id long, y int, x1 double, x2 double")
    shards = learning.sharded(df, "row_id", ("y", "x1", "x2"))
    fit = learning.fit_all(shards, {0: learning.Task(("x1", "x2"), plain())}, learning.Settings(epochs=2))[0]
    assert all(np.isfinite(fit.losses)) and fit.scale["x2"] == (2.0, 1.0)
    p = df.select(learning.probabilities([fit, fit]).alias("p")).collect()
    assert all(0 <= v <= 1 for r in p for v in r["p"]) and len(p[0]["p"]) == 2
    none = learning.sharded(df.limit(0), "row_id", ("y", "x1", "x2"))
    assert none.count() == 0


def test_what_rows_mean_is_computed_once_for_all_classifiers_that_share_it(spark):
    shards = learning.sharded(moons(spark, 1_000), "row_id", ("y", "x1", "x2"), rows=500).persist()
    seen = spark.sparkContext.accumulator(0)
    means = plain()

    def weigh(d):
        seen.add(1)
        return means(d)

    tasks = {m: learning.Task(("x1", "x2")[: 1 + m % 2], weigh, m) for m in range(4)}
    fits = learning.fit_all(shards, tasks, learning.Settings(epochs=2, patience=9))
    assert seen.value == 2 * 3  # shards, passes
    alone = learning.fit_all(shards, {3: learning.Task(("x1", "x2"), means, 3)}, learning.Settings(epochs=2, patience=9))
    assert fits[3].losses == pytest.approx(alone[3].losses, abs=1e-12)
    shards.unpersist()


def test_steps_are_those_of_a_plain_loop(spark):
    from weftline.operators.training import Adam, backward, forward

    shards = learning.sharded(moons(spark, 700), "row_id", ("y", "x1", "x2")).persist()
    row = shards.first()
    data = {c: np.array(row[c]) for c in ("key", "y", "x1", "x2")}
    settings = learning.Settings(hidden=(5, 4), epochs=1, batch=128)

    def weigh(d):
        return d["y"], 1.0 + np.arange(len(d["y"])) % 3, learning.uniform(d["key"], "held") < 0.2

    fit = learning.fit_all(shards, {0: learning.Task(("x1", "x2"), weigh, 3)}, settings)[0]
    y, w, held = weigh(data)
    x = learning._inputs(data, ("x1", "x2"), learning.scales(shards, ("x1", "x2")))
    p = learning.network([2, 5, 4, 1], np.random.default_rng([3, 1]))
    losses = [np.average(learning.log_loss(y[held], forward(p, x[held])[1]), weights=w[held])]
    adam, mine = Adam(p, settings.rate, (0.9, 0.99)), np.flatnonzero(~held)
    for b in learning.batches(len(mine), 128, np.random.default_rng([3, 0, row["shard"], 2])):
        i = mine[b]
        inputs, out = forward(p, x[i])
        p = adam.step(p, learning.flat(backward(p, inputs, w[i] * (1 / (1 + np.exp(-out)) - y[i]) / w[i].sum())))
    losses.append(np.average(learning.log_loss(y[held], forward(p, x[held])[1]), weights=w[held]))
    assert fit.losses == pytest.approx(losses, abs=1e-12)
    shards.unpersist()


def test_rows_are_shuffled_together_and_all_of_them(spark, monkeypatch):
    df = moons(spark, 900, 5).withColumn("x2", F.when(F.col("row_id") % 7 > 0, F.col("x2")))
    monkeypatch.setattr(learning, "DEALT", 64)
    few = learning.sharded(df, "row_id", ("y", "x1", "x2"), rows=200)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan  # blocks of a shard, not its rows
    got = {r["key"][i]: (r["shard"], r["y"][i], r["x1"][i], r["x2"][i]) for r in few.collect() for i in range(len(r["key"]))}
    want = df.select(F.xxhash64("row_id").alias("key"), "y", "x1", "x2").collect()
    assert len(got) == len(want) == 900
    for r in want:
        shard, y, x1, x2 = got[r["key"]]
        assert (y, x1) == (r["y"], r["x1"]) and (math.isnan(x2) if r["x2"] is None else x2 == r["x2"])
    monkeypatch.undo()
    assert sorted(r["shard"] for r in few.collect()) == sorted(r["shard"] for r in learning.sharded(df, "row_id", ("y", "x1", "x2"), rows=200).collect())
