"""Trainer, reweighting, unfolding of all variables and uncertainty grids on samples of known shape."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import distances, ibu, reweight, sampling, tilt, training, uncertainty
from weftline.sources import gaussian, jets, populations, runs

SETTINGS = {"mu_nature": [0.4], "mu_mc": [0.0], "sigma_nature": 1.0, "sigma_mc": 1.0, "sigma_detector": 0.3}


@pytest.fixture(scope="module")
def shifted(spark):
    df = gaussian.generate(spark, 4000, gaussian.parse_settings(json.dumps(SETTINGS)), 3).withColumn("w", F.lit(1.0)).persist()
    yield df
    df.unpersist()


def w1(df, columns=("x1", "z1"), weight="w"):
    return {r["dim"]: r["w1"] for r in distances.wasserstein(populations.long(df, columns, weight)).collect()}


def test_gradients_equal_differences():
    g = np.random.Generator(np.random.PCG64(1))
    p = training.network([3, 5, 4, 1], g)
    p = [t + 0.1 * g.normal(size=t.shape) for t in p]
    x, c = g.normal(size=(20, 3)) * 2, g.normal(size=20)

    def values(q):
        inputs, out = training.forward(q, x)
        return (c * out).sum(), training.slope_penalty(q, inputs)[0]

    inputs, _ = training.forward(p, x)
    got = training._flat(training.backward(p, inputs, c)), training._flat(training.slope_penalty(p, inputs)[1])
    flat = training._flat(p)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (values(training._like(p, flat + s * step)) for s in (1, -1))
        for k in (0, 1):
            assert got[k][i] == pytest.approx((up[k] - down[k]) / 2e-6, abs=1e-4)
    slope, _ = training.slopes(p, inputs)
    up, down = (training.forward(p, x + s * np.array([1e-6, 0, 0]))[1] for s in (1, -1))
    assert slope[:, 0] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.mark.parametrize("objective", [training.CLASSIFIER, training.WASSERSTEIN])
def test_training_brings_the_samples_together(spark, shifted, objective):
    s = training.Settings(objective, generator=(8,), critic=(8,), epochs=20, rate=0.08, dispersion=0.01)
    trained = training.train(shifted, ("z1",), ("x1",), s, F.col("row_id").endswith("0"))
    out = training.weigh(shifted, trained)
    before, after = w1(shifted), w1(out)
    assert after["x1"] < 0.6 * before["x1"] and after["z1"] < 0.6 * before["z1"]
    assert out.where("y = 0").agg(F.avg("w")).first()[0] == pytest.approx(1.0)
    assert [h["epoch"] for h in trained.history] == list(range(1, 21)) and len(trained.generators) == 21
    back = training.restored(trained, training.parameter_table(spark, trained), 20)
    again = training.weigh(shifted, back).select("row_id", F.col("w").alias("again")).join(out, "row_id")
    assert again.where("abs(again - w) > 1e-12").count() == 0
    judged = training.judged(shifted, trained).limit(5).collect()
    assert all(np.isfinite(r["score"]) and np.isfinite(r["slope_x1"]) for r in judged)


def test_observed_truth_is_not_read_and_partitions_do_not_matter(shifted):
    s = training.Settings(generator=(4,), critic=(4,), epochs=3)
    a = training.train(shifted, ("z1",), ("x1",), s)
    poisoned = shifted.withColumn("z1", F.when(F.col("y") == 0, F.col("z1")).otherwise(F.lit(1e9))).repartition(13)
    b = training.train(poisoned, ("z1",), ("x1",), s)
    assert training._flat(a.generators[-1]) == pytest.approx(training._flat(b.generators[-1]), abs=1e-9)


def test_kernel_curve_selects_a_later_epoch(shifted):
    trained = training.train(shifted, ("z1",), ("x1",), training.Settings(generator=(8,), critic=(8,), epochs=8, rate=0.08))
    curve = training.kernel_curve(shifted, trained, ("x1",), 500)
    assert len(curve) == 9 and min(curve, key=lambda p: p["mmd2"])["epoch"] > 0


def test_training_refuses_what_it_cannot_use(shifted):
    with pytest.raises(ValueError):
        training.Settings("other")
    for cut in ("y = 1", "y = 0"):
        with pytest.raises(ValueError):
            training.train(shifted.where(cut), ("z1",), ("x1",), training.Settings(epochs=1))


def test_classifiers_bring_the_samples_together(shifted):
    before = w1(shifted)
    ratio = reweight.density_ratio(shifted, ("x1",)).withColumn("w", F.when(F.col("y") == 0, F.col("ratio")).otherwise(1.0))
    assert w1(ratio)["x1"] < 0.3 * before["x1"]
    assert w1(reweight.iterate(shifted, ("z1",), ("x1",), 3))["z1"] < 0.5 * before["z1"]


def test_a_callers_own_classifier_is_used(shifted):
    even = reweight.density_ratio(shifted, ("x1",), classifier=lambda data, label, weight, column: F.lit(0.5))
    assert even.where("y = 0 AND abs(ratio - 1) > 1e-12").count() == 0


def test_all_variables_are_unfolded(spark, shifted):
    df = shifted.withColumn("z2", F.col("z1") * 2).withColumn("x2", F.col("x1") * 2)
    pairs = {"a": ("z1", "x1"), "b": ("z2", "x2")}
    results = ibu.unfold_all(df, pairs, 4, 0.6, ~F.col("row_id").endswith("0"))
    assert {r["variable"]: r["status"] for r in ibu.outcomes(spark, results).collect()} == {"a": "ok", "b": "ok"}
    bins = ibu.bin_table(spark, results)
    assert bins.where("prior > 0 AND abs(weight - unfolded / prior) > 1e-9").count() == 0
    only = {"a": results["a"]}
    record = {(r["dim"], r["metric"]): r for r in distances.joint_record(ibu.reweighted(df, pairs, only), ("x1", "z1")).collect()}
    assert len(record) == 6 and record["z1", "wasserstein"]["improvement"] > 40
    with pytest.raises(ValueError):
        ibu.unfold_all(df.where("y = 0"), pairs)


def test_a_grid_run_goes_on_where_it_stopped(spark, shifted, tmp_path):
    calls = []

    def train(sample, seed):
        calls.append(seed)
        t = tilt.monomials(("z1",), 1)
        want = sample.where("y = 1").agg(F.avg("z1").alias("m")).first()["m"] + seed * 0.01
        fit = tilt.fit(sample.drop("w"), t, [want])
        return lambda rows: tilt.apply(rows.drop("w"), t, fit)

    evaluation = shifted.where("y = 0 AND row_id LIKE '%1'")
    first = uncertainty.run_grid(shifted, evaluation, 2, 2, train, str(tmp_path / "grid"))
    assert len(calls) == 4 and first.count() == 4 * evaluation.count()
    again = uncertainty.run_grid(shifted, evaluation, 3, 2, train, str(tmp_path / "grid"))
    assert len(calls) == 6
    events = again.join(evaluation.select("row_id", F.col("z1").alias("v")), "row_id").withColumn("variable", F.lit("z1"))
    got = uncertainty.collect(events).first()
    assert got["data"] > 0 and got["naive"] == pytest.approx(got["total"] + got["interaction"]) and got["sd_total"] >= 0
    for bad in ("b = 0", "NOT (b = 1 AND s = 1)"):
        with pytest.raises(ValueError):
            uncertainty.collect(events.where(bad))


def test_spread_over_direction_seeds(spark, shifted):
    got = distances.sliced_spread(spark, shifted, ("x1", "z1"), 4, (0, 1)).first()
    assert got["mean"] > 0 and got["sd"] >= 0


def test_ingested_jets_are_parted_by_class(spark, tmp_path):
    parts = [(10.0, 1), (5.0, 0), (1.0, -1)]
    jet = spark.createDataFrame([(i, i % 2, parts) for i in range(6)], "jet int, y int, parts array<struct<pt: double, charge: int>>")
    jets.ingest(jet, str(tmp_path / "jets"))
    back = jets.read_ingested(spark, str(tmp_path / "jets"), ("jet", "n_ch"))
    assert back.where("y = 1").count() == 3 and {r["n_ch"] for r in back.collect()} == {2}
    assert "PartitionFilters" in back.where("y = 1")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="class 0 or 1"):
        jets.ingest(jet.withColumn("y", F.lit(2)), str(tmp_path / "bad"))


def test_a_dataset_is_rebuilt_from_its_config(spark):
    config = json.dumps({**SETTINGS, "n": 50, "seed": 4, "split_seed": 9})
    a, b = (sorted(map(tuple, runs.rebuilt(spark, config).select("row_id", "z1", "x1", "split").collect())) for _ in range(2))
    assert a == b and len(a) == 100
    with pytest.raises(ValueError):
        runs.rebuilt(spark, json.dumps(SETTINGS))


def test_incomplete_runs_are_named(spark, tmp_path):
    for run, kinds in (("a", ("config", "metrics")), ("b", ("config",)), ("c", ("metrics",))):
        (tmp_path / run).mkdir()
        for k in kinds:
            (tmp_path / run / f"{k}.json").write_text("{}")
    assert {tuple(r) for r in runs.incomplete_runs(spark, str(tmp_path)).collect()} == {("b", "metrics"), ("c", "config")}
