"""Passes over packed rows, and steps that no longer join a table with itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import binning, blocks, distances, ibu, learning, reweight, sorted_areas, training, uncertainty
from weftline.plans.queries import QUERIES
from weftline.sources import populations

from .conftest import SF


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 4_000)
    z = rng.normal(size=4_000) + 0.4 * y
    x = z + 0.3 * rng.normal(size=4_000)
    return spark.createDataFrame([(f"r{i}", int(a), float(b), float(c), 1.0 + i % 3 * (1 - int(a))) for i, (a, b, c) in enumerate(zip(y, z, x))], "row_id string, y int, z1 double, x1 double, w double").repartition(3).persist()


def test_blocks_hold_all_numbers(spark, rows, monkeypatch):
    def listed(batches):
        import pyarrow as pa

        for a, b in blocks.unpack(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(b[:, 0].copy()), pa.array(b[:, 1].copy())], names=["y", "z", "x"])

    packed = blocks.pack(rows.select(F.array(F.col("y").cast("double")).alias("y"), F.array("z1", "x1").alias("v")), ordered=True)
    got = sorted(map(tuple, packed.mapInArrow(listed, "y double, z double, x double").collect()))
    assert got == sorted(map(tuple, rows.select(F.col("y").cast("double"), "z1", "x1").collect()))
    assert packed.count() == 3


def test_kept_rows_are_computed_once(spark, rows, monkeypatch):
    monkeypatch.setattr(sorted_areas, "FEW_VALUES", 50)
    monkeypatch.setattr(sorted_areas, "RANGE_ROWS", 500)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def dear(v):
        seen.add(1)
        return v

    own = [F.col("z1"), F.col("x1")], [F.lit(1.0), F.col("w")]
    want = {r[:2]: r["w1"] for r in sorted_areas.areas(rows, *own).collect()}
    got = {r[:2]: r["w1"] for r in sorted_areas.areas(rows.withColumn("w", dear("w")), *own, keep=True).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 4
    assert seen.value == 4_000
    assert sorted_areas.areas(rows.limit(0), *own, keep=True).count() == 0


def test_shards_are_not_listed_or_sorted_by_the_aggregate(rows):
    shards = learning.sharded(rows, "row_id", ("y", "z1"), rows=1_000)
    plan = shards._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort" not in plan
    found = shards.collect()
    assert len(found) == 4 and sum(len(r["key"]) for r in found) == 4_000 and all(r["key"] == sorted(r["key"]) for r in found)


def test_leakage_is_judged_line_by_line(spark, tmp_path):
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    line.unionByName(line.withColumn("l_quantity", F.col("l_quantity") * 3)).write.parquet(f"{tmp_path}/lineitem.parquet")  # keys repeat
    assert QUERIES["leakage_check"](spark, str(tmp_path)).first()[0] == 0


def test_iterated_weights_keep_every_row_once(rows):
    twice = rows.unionByName(rows)
    out = reweight.iterate(twice, ("z1",), ("x1",), 1)
    assert out.count() == 8_000 and out.columns == rows.columns
    got = out.where("y = 0").agg(F.avg("w"), F.min("w")).first()
    assert got[0] == pytest.approx(1) and got[1] > 0 and out.where("y = 1 AND w <> 1").count() == 0
    hidden = reweight.iterate(populations.poisoned(twice, ("z1",)), ("z1",), ("x1",), 1)
    assert hidden.agg(F.sum(F.col("w") * F.col("x1"))).first()[0] == pytest.approx(out.agg(F.sum(F.col("w") * F.col("x1"))).first()[0])


def test_grid_weights_bring_columns_along(rows):
    cells = uncertainty.train_grid(rows, 2, 1, ("z1",), ("x1",), training.Settings(generator=(2,), critic=(2,), epochs=1), shard_rows=2_000)
    twice = rows.unionByName(rows)
    got = uncertainty.grid_weights(twice, cells, keep=("z1",))
    assert got.count() == 2 * twice.where("y = 0").count()
    assert got.join(rows.select("row_id", F.col("z1").alias("z")), "row_id").where("z <> z1").count() == 0


def test_weights_by_halves_are_those_of_the_bins(spark):
    edges = [0.0, 1.0, 2.5, 4.0, 4.5]
    result = {"status": "ok", "edges": edges, "weights": [0.5, 1.5, 2.5, 3.5]}
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), -1.0, 0.0, 0.5, 1.0, 2.4, 2.5, 4.0, 4.4, 4.5, 9.0)], "v double")
    shown = F.array(*[F.lit(e) for e in edges])
    want = F.get(F.array(*[F.lit(w) for w in result["weights"]]), binning.saturated_bin(F.col("v"), shown))
    w = ibu.event_weights(df, "v", result)
    assert df.where(w != want).count() == 0 and df.where(w.isNull()).count() == 0
    assert "filter(" not in df.select(w)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_all_bins_are_counted_in_one_pass(rows):
    pairs = {"a": ("z1", "x1"), "b": ("x1", "z1"), "none": ("w", "x1")}
    edges = {"a": [-2.0, -0.5, 0.5, 2.0], "b": [-1.0, 0.0, 1.0], "none": [0.0]}
    got = ibu._unfolded(rows, pairs, edges, 3)
    assert got["none"]["status"] == "skipped"
    mc, data = rows.where("y = 0"), rows.where("y = 1")
    for name in "ab":
        truth, reco = pairs[name]
        prior = ibu.binned_counts(mc, truth, edges[name])
        steps = ibu.iterate(prior, ibu.binned_counts(data, reco, edges[name]), ibu.response(mc, truth, reco, edges[name]), 3)
        assert got[name]["prior"] == prior.tolist() and got[name]["unfolded"] == pytest.approx(steps[-1].tolist())


def test_joint_record_takes_distances_without_windows(rows):
    old = distances.compare(distances.metric_set(populations.long(rows, ("z1", "x1"), None)), distances.metric_set(populations.long(rows, ("z1", "x1"))))
    got = distances.joint_record(rows, ("z1", "x1"))
    assert "window" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {(r["dim"], r["metric"]): r for r in old.collect()}
    for r in got.collect():
        assert tuple(r)[2:] == pytest.approx(tuple(want.pop((r["dim"], r["metric"])))[2:], abs=1e-9)
    assert not want


@pytest.mark.parametrize("objective", [training.CLASSIFIER, training.WASSERSTEIN])
def test_training_computes_its_rows_once_and_compares_them_in_place(spark, rows, objective):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def dear(key):
        seen.add(1)
        return key.endswith("7")

    settings = training.Settings(objective, generator=(4,), critic=(4, 3), epochs=2)
    own = ("z1",), ("x1", "z1"), settings
    holes = rows.withColumn("z1", F.when(~F.col("row_id").endswith("3"), F.col("z1"))).unionByName(rows.limit(5).withColumn("y", F.lit(None).cast("int")))
    trained, got = training.train_and_compare(holes, *own, dear("row_id"))
    assert seen.value == 4_000  # neither for standardizing nor for the distances again
    again = training.train(holes, *own, F.col("row_id").endswith("7"))
    assert training._flat(again.generators[-1]) == pytest.approx(training._flat(trained.generators[-1]), abs=1e-9)
    want = distances.wide_wasserstein(training.weigh(holes, again), ("z1", "x1"), {"w1": F.col("w")}).collect()
    assert {r["dim"]: r["w1"] for r in got.collect()} == pytest.approx({r["dim"]: r["w1"] for r in want}, abs=1e-9)


@pytest.mark.parametrize("sizes", [[2, 1], [2, 5, 1], [3, 5, 4, 1]])
def test_steps_on_columns_are_those_on_rows(sizes):
    rng = np.random.default_rng(2)
    p = [t + 0.2 * rng.normal(size=t.shape) for t in training.network(sizes, rng)]
    x, g = rng.normal(size=(40, sizes[0])), rng.normal(size=40)
    inputs, out = training.forward(p, x)
    a = training._layers(p)
    entering, same = training._run(a, np.vstack([x.T, np.ones(40)]))
    leaving, on = training._leaving(a, entering)
    assert same == pytest.approx(out)
    assert training._flat(training._gradient(entering, leaving, g)) == pytest.approx(training._flat(training.backward(p, inputs, g)))
    assert training._flat(training._penalty(a, entering, leaving, on)) == pytest.approx(training._flat(training.slope_penalty(p, inputs)[1]))


def test_columns_are_scaled_by_simulated_training_rows(spark):
    df = spark.createDataFrame([(i % 2, float(i) if i % 3 else None, 0.1, i % 10 == 0) for i in range(3_000)], "y int, z1 double, x1 double, held boolean")
    trained = training.train(df, ("z1",), ("x1",), training.Settings(epochs=0), F.col("held"))
    want = df.where("y = 0 AND NOT held").agg(F.avg("z1"), F.stddev_pop("z1")).first()
    assert trained.scale["z1"] == pytest.approx(tuple(want)) and trained.scale["x1"] == (pytest.approx(0.1), 1.0)
