"""Batched training, the grid in one scan, selection, ceiling diagnostics and null calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import ceiling, distances, learning, training, uncertainty
from weftline.sources.populations import long


def shifted(spark, n=4_000, shift=0.8, smear=0.5, seed=3, parts=4):
    """Truth of N(shift, 1) against N(0, 1), smeared alike."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    z = rng.normal(size=n) + shift * y
    x = z + smear * rng.normal(size=n)
    return spark.createDataFrame([(f"r{i}", int(a), float(b), float(c)) for i, a, b, c in zip(range(n), y, z, x)], "row_id string, y int, z1 double, x1 double").repartition(parts)


def w1(df):
    return {r["dim"]: r["w1"] for r in distances.wasserstein(long(df, ("z1", "x1"))).collect()}


SETTINGS = training.Settings(generator=(12,), critic=(12,), epochs=6, critic_steps=2, rate=0.01)


def test_batches_need_fewer_passes_than_full_gradients(spark):
    df = shifted(spark)
    before = w1(df.withColumn("w", F.lit(1.0)))
    batched = training.train_batched(df, ("z1",), ("x1",), SETTINGS, held_out=0.2, batch=128)
    full = training.train(df, ("z1",), ("x1",), SETTINGS)  # 3 passes an epoch instead of 1
    a, b = (w1(training.weigh(df, t)) for t in (batched, full))
    assert a["z1"] < 0.4 * before["z1"] and a["z1"] < b["z1"]
    assert [h["epoch"] for h in batched.history] == list(range(1, 7)) and len(batched.generators) == 7
    assert all(np.isfinite(h["validation_loss"]) for h in batched.history)
    assert np.isnan(training.train_batched(df.limit(200), ("z1",), ("x1",), training.Settings(epochs=1)).history[0]["validation_loss"])


def test_batched_training_does_not_depend_on_partitions_or_observed_truth(spark):
    few, many = (shifted(spark, 1_500, parts=p) for p in (1, 7))
    poisoned = many.withColumn("z1", F.when(F.col("y") == 1, F.lit(-999.0)).otherwise(F.col("z1")))
    settings = training.Settings(generator=(4,), critic=(4,), epochs=2)
    a, b, c = (training.train_batched(d, ("z1",), ("x1",), settings, shard_rows=400) for d in (few, many, poisoned))
    for p, q, r in zip(a.generators[-1], b.generators[-1], c.generators[-1]):
        assert np.allclose(p, q, atol=1e-8) and np.allclose(q, r, atol=1e-8)


def test_wasserstein_batches_and_refusals(spark):
    df = shifted(spark, 2_000)
    got = training.train_batched(df, ("z1",), ("x1",), training.Settings("wasserstein", (8,), (8,), 3, 2, 0.01))
    assert all(np.isfinite(np.concatenate([np.ravel(t) for t in g])).all() for g in got.generators)
    for part in ("y = 0", "y = 1"):
        with pytest.raises(ValueError):
            training.train_batched(df.where(part), ("z1",), ("x1",), SETTINGS)


def test_splits_differ_by_cell_and_share_no_row():
    key = np.random.default_rng(1).integers(-(2**62), 2**62, 30_000)
    data = {"key": key, "y": np.arange(len(key)) % 2}
    a, b, c = (uncertainty.split_of(data, 7, *k) for k in ((0, 0), (0, 1), (1, 0)))
    for part in (a, b, c):
        assert np.allclose(np.bincount(part) / len(key), (0.7, 0.1, 0.2), atol=0.02)
    assert 0.3 < (a != b).mean() and 0.3 < (a != c).mean()
    again = uncertainty.split_of({"key": np.repeat(key, 3), "y": data["y"]}, 7, 0, 0)
    assert (again == np.repeat(a, 3)).all()  # copies of a row stay together
    both, only_data, only_mc = (uncertainty.drawn(data, 7, 0, r) for r in uncertainty.RESAMPLE)
    assert (only_data[data["y"] == 0] == 1).all() and (only_mc[data["y"] == 1] == 1).all()
    assert (only_data[data["y"] == 1] == both[data["y"] == 1]).all() and (uncertainty.drawn(data, 7, 1) != both).mean() > 0.3
    with pytest.raises(ValueError):
        uncertainty.drawn(data, 7, 0, "none")


def test_all_cells_train_in_the_scans_of_one(spark):
    df = shifted(spark, 1_200)
    settings = training.Settings(generator=(4,), critic=(4,), epochs=2)
    calls, original = [], learning.sums
    try:
        learning.sums = lambda *a: calls.append(1) or original(*a)
        for b, s in ((1, 1), (3, 2)):
            calls.clear()
            cells = uncertainty.train_grid(df, b, s, ("z1",), ("x1",), settings)
            assert len(calls) == 3 and set(cells) == {(i, j) for i in range(b) for j in range(s)}
    finally:
        learning.sums = original
    got = uncertainty.grid_weights(df, cells)
    means = got.groupBy("b", "s").agg(F.avg("w").alias("m"), F.count("*").alias("n")).collect()
    assert len(means) == 6 and all(abs(r["m"] - 1) < 1e-9 and r["n"] == 600 for r in means)
    one = training.weigh(df, cells[2, 1]).where("y = 0").join(got.where("b = 2 AND s = 1").withColumnRenamed("w", "v"), "row_id")
    assert one.agg(F.max(F.abs(F.col("w") - F.col("v")))).first()[0] < 1e-9
    g = [np.concatenate([np.ravel(t) for t in cells[k].generators[-1]]) for k in ((0, 0), (1, 0), (0, 1))]
    assert not np.allclose(g[0], g[1]) and not np.allclose(g[0], g[2])


def test_whole_summary_by_variable(spark):
    rng = np.random.default_rng(2)
    rows = [(v, b, s, float(rng.normal() + b), int(rng.integers(3)), float(rng.random() + 0.5)) for v in ("p", "q") for b in range(4) for s in range(3) for _ in range(60)]
    events = spark.createDataFrame(rows, "variable string, b int, s int, v double, bin int, w double")
    got = uncertainty.summary(events)
    assert {r["variable"] for r in got["components"].collect()} == {"p", "q"}
    for name in ("p", "q"):
        spectrum = got["spectra"].where(F.col("variable") == name).collect()
        assert abs(sum(r["f"] for r in spectrum) - 1) < 1e-9 and len(spectrum) == 3
        cov = {(r["bin_a"], r["bin_b"]): r for r in got["covariances"].where(F.col("variable") == name).collect()}
        corr = {(r["bin_a"], r["bin_b"]): r for r in got["correlations"].where(F.col("variable") == name).collect()}
        for (a, b), r in corr.items():
            for k in ("data", "initialization", "interaction", "total"):
                va, vb = cov[a, a][k], cov[b, b][k]
                assert np.isnan(r[k]) if va <= 0 or vb <= 0 else abs(r[k] - cov[a, b][k] / np.sqrt(va * vb)) < 1e-9
        # fractions add up to one, so every component's rows add up to zero
        assert all(abs(sum(cov[a, b]["interaction"] for b in range(3))) < 1e-12 for a in range(3))


def test_selection_is_scored_again_on_test_rows(spark):
    df = shifted(spark, 2_400)
    fold = F.pmod(F.xxhash64("row_id"), F.lit(3))
    trained = training.train_batched(df.where(fold == 0), ("z1",), ("x1",), SETTINGS, batch=64)
    got = training.select(df.where(fold == 1), df.where(fold == 2), trained, ("x1",), 300)
    values = [c["mmd2"] for c in got.curve]
    assert len(values) == 7 and values[got.epoch] == min(values)
    assert got.test["epoch"] == got.epoch and got.test["mmd2"] != values[got.epoch]
    assert got.test["mmd2"] < got.unweighted["mmd2"] and abs(got.unweighted["ess"] - 300) < 1e-6


def test_diagnostics_of_a_known_tilt(spark):
    """Truth is shifted by 0.8 and smeared by 0.5: the floor is that of two normals 0.8 / sqrt(1.25) apart."""
    df = shifted(spark, 6_000)
    exact = df.withColumn("w", F.when(F.col("y") == 0, F.exp(0.8 * F.col("z1") - 0.32)).otherwise(1.0))
    settings = learning.Settings(hidden=(8,), epochs=15, batch=128, patience=3)
    got = {(r["diagnostic"], r["level"], r["quantity"]): r["value"] for r in ceiling.diagnostics(exact, ("z1",), ("x1",), folds=4, settings=settings, size=800).collect()}

    def floor(d):
        u = np.random.default_rng(0).normal(size=400_000)
        return np.logaddexp(0, -(d * (u + d) - d * d / 2)).mean()

    assert abs(got["floor", "detector", "loss"] - floor(0.8 / np.sqrt(1.25))) < 0.02
    assert abs(got["oracle", "particle", "loss"] - floor(0.8)) < 0.02
    assert got["audit", "detector", "signal"] < 0.25 * got["floor", "detector", "signal"] and got["audit", "detector", "removed"] > 0.75
    for level, dim in (("particle", "z1"), ("detector", "x1")):
        assert got["oracle", level, f"w1 {dim} oracle"] < 0.35 * got["oracle", level, f"w1 {dim} unit"]
        assert got["criterion", level, "oracle"] < 0.3 * got["criterion", level, "unweighted"] > got["criterion", level, "candidate"]
    assert 0.3 < got["oracle", "particle", "share"] < 0.9
    with pytest.raises(ValueError):
        ceiling.diagnostics(exact.where("y = 1"), ("z1",), ("x1",))


def test_no_row_is_judged_by_a_classifier_that_saw_it():
    key = np.random.default_rng(1).integers(-(2**62), 2**62, 5_000)
    fold = ceiling.fold_of(key, 5, 0)
    assert set(fold.tolist()) == set(range(5)) and abs(np.bincount(fold) / len(key) - 0.2).max() < 0.03


def test_null_calibration_finds_nothing(spark):
    df = shifted(spark, 4_000)
    settings = learning.Settings(hidden=(6,), epochs=40, batch=32, patience=6)
    rows = ceiling.null_calibration(df, ("z1",), ("x1",), repeats=3, settings=settings).collect()
    assert {(r["source"], r["repeat"]) for r in rows} == {(s, k) for s in (0, 1) for k in range(3)}
    assert all(abs(r["nats"]) < 0.01 and 0 < r["se"] < 0.02 for r in rows)
