"""Stored tables, frozen designs, run folders and checks that ride on other passes."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from weftline.operators import sampling, weights
from weftline.sources import gaussian, populations, runs, store

SETTINGS = {"mu_nature": [0.4], "mu_mc": [0.0], "sigma_nature": 1.0, "sigma_mc": 1.0, "sigma_detector": 0.3}


def test_second_call_reads_only_and_other_settings_make_another_table(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    at = f"file://{tmp_path}/store"
    for _ in range(2):
        assert store.cached(spark, at, {"a": 1, "b": 0.1 + 0.2}, build).count() == 5
    assert store.cached(spark, at, {"b": 0.3, "a": 1}, build).count() == 5 and len(built) == 1
    store.cached(spark, at, {"a": 2, "b": 0.3}, build)
    assert len(built) == 2
    name = store.settings_name({"a": 1, "b": 0.3})
    (tmp_path / "store" / name / "table" / "_SUCCESS").unlink()  # a broken-off writer leaves no mark
    assert store.cached(spark, at, {"a": 1, "b": 0.3}, build).count() == 5 and len(built) == 3
    assert json.loads((tmp_path / "store" / name / "settings.json").read_text())["a"] == 1


def test_gaussian_datasets_are_kept(spark, tmp_path):
    settings = gaussian.parse_settings(json.dumps(SETTINGS))
    a = gaussian.dataset(spark, str(tmp_path), 20, settings, 1)
    b = gaussian.dataset(spark, str(tmp_path), 20, settings, 1)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) == sorted(map(str, gaussian.generate(spark, 20, settings, 1).collect()))
    gaussian.dataset(spark, str(tmp_path), 20, settings, 2)
    assert len(list(tmp_path.iterdir())) == 2


def test_of_several_creators_one_wins(spark, tmp_path):
    at = f"file://{tmp_path}/design"

    def freeze(i):
        try:
            runs.freeze_design(spark, at, {"n_bootstrap": 1, "n_seeds": 1, "by": i})
            return True
        except FileExistsError:
            return False

    with ThreadPoolExecutor(1) as pool:  # one after another: the second is refused, whoever it is
        won = list(pool.map(freeze, range(4)))
    assert won == [True, False, False, False] and runs.load_design(spark, at)["by"] == 0
    with pytest.raises(FileNotFoundError):
        runs.load_design(spark, f"file://{tmp_path}/none")


def test_cells_of_other_settings_are_refused(spark, tmp_path):
    at = f"file://{tmp_path}/grid"
    runs.freeze_design(spark, at, {"n_bootstrap": 1, "n_seeds": 2})
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "row_id string, w double")
    runs.write_cells(rows.select(F.lit(0).alias("b"), F.lit(0).alias("s"), "*"), at, {"rate": 0.1, "seed": 0})
    with pytest.raises(ValueError, match="missing"):
        runs.load_cells(spark, at)
    runs.write_cells(rows.select(F.lit(0).alias("b"), F.lit(1).alias("s"), "*"), at, {"rate": 0.1, "seed": 1})
    assert runs.load_cells(spark, at).count() == 4  # seeds are a cell's own
    other = f"file://{tmp_path}/other"
    runs.freeze_design(spark, other, {"n_bootstrap": 1, "n_seeds": 2})
    for s in (0, 1):
        runs.write_cells(rows.select(F.lit(0).alias("b"), F.lit(s).alias("s"), "*"), other, {"rate": 0.1 + s})
    with pytest.raises(ValueError, match="rate"):
        runs.load_cells(spark, other)


def test_a_broken_run_is_one_error_row(spark, tmp_path):
    for name, text in (("good", '{"n": 4}'), ("bad", "{"), ("zero", '{"n": 0}'), ("other", '{"n": 2}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.json").write_text(text)

    def evaluate(run, config):
        return {"inverse": 1 / config["n"], "twice": 2 * config["n"]}

    rows = runs.evaluate_runs(spark, str(tmp_path), evaluate).collect()
    good = {(r["run"], r["metric"]): r["value"] for r in rows if r["error"] is None}
    assert good == {("good", "inverse"): 0.25, ("good", "twice"): 8.0, ("other", "inverse"): 0.5, ("other", "twice"): 4.0}
    errors = {r["run"]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {"bad", "zero"} and "ZeroDivisionError" in errors["zero"] and len(rows) == 6


def test_readers_of_a_run(spark, tmp_path):
    run = f"file://{tmp_path}/run"
    history = spark.createDataFrame([(2, 0.5), (1, 0.7)], "epoch int, loss double")
    weights_of = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "epoch int, row_id string, w double")
    runs.write_run({"history": history, "weights": weights_of}, {"n": 1}, {}, run)
    assert [r["epoch"] for r in runs.read_history(spark, run).collect()] == [1, 2]
    assert runs.read_weights(spark, run, 2).first()["w"] == 2.0
    with pytest.raises(ValueError):
        runs.read_weights(spark, run)
    for read in (runs.read_history, runs.read_weights):
        with pytest.raises(FileNotFoundError):
            read(spark, f"{run}-none")
    assert runs.json_or_none(spark, f"{run}/none.json") is None
    store.create(spark, f"{run}/some.json", '{"a": 1}')
    assert runs.json_or_none(spark, f"{run}/some.json") == {"a": 1}


def test_clipped_values_are_counted_in_the_pass_that_is_made_anyway(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,), (1e-9,)], "p double")
    out, seen = weights.observed_ratio(df, "p")
    assert out.count() == 5 and seen.get == {"rows": 5, "clipped_low": 2, "clipped_high": 2}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and "Exchange" not in plan


def test_non_finite_values_are_counted_or_stop_the_job_itself(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), None), (float("inf"), 3.0)], "a double, b double")
    out, seen = populations.observed_finite(df, ("a", "b"))
    out.write.format("noop").mode("overwrite").save()
    assert seen.get == {"a": 2, "b": 1}
    assert populations.checked_finite(df.limit(1), ("a", "b")).count() == 1
    for bad in ("a", "b"):
        with pytest.raises(Exception, match=f"non-finite value in {bad}"):
            populations.checked_finite(df, (bad,)).agg(F.sum(bad)).collect()


def test_one_side_can_be_resampled(spark):
    df = spark.createDataFrame([(f"r{i}", i % 2) for i in range(400)], "row_id string, y int")
    both = {r["row_id"]: r["multiplicity"] for r in sampling.bootstrap_counts(df, 1).collect()}
    for side, y in (("data", 1), ("simulation", 0)):
        got = {(r["row_id"], r["y"]): r["multiplicity"] for r in sampling.bootstrap_counts(df, 1, resample=side).collect()}
        assert len(got) == 400 and all(m == 1 for (_, k), m in got.items() if k != y)
        assert all(m == both[i] for (i, k), m in got.items() if k == y) and sum(got.values()) == 400
    with pytest.raises(ValueError):
        sampling.bootstrap_counts(df, 1, resample="none")


def test_jet_populations_are_standardized_by_simulated_truth(spark):
    from weftline.sources import jets

    names = [f"{level}_{v}" for v in jets.VARIABLES for level in jets.LEVELS]
    rows = [(f"r{i:02d}", *[float((i * 7 + j * 3) % 11 + 0.5 * j) for j in range(24)]) for i in range(20)]
    table = spark.createDataFrame(rows, "row_id string, " + ", ".join(f"{n} double" for n in names))
    got, scale = jets.jet_population(table, table, 10, ("w", "q"))
    out = got.where("y = 0").agg(F.avg("z_w").alias("m"), F.stddev_pop("z_q").alias("s"), F.count("*").alias("n")).first()
    assert abs(out["m"]) < 1e-12 and abs(out["s"] - 1) < 1e-12 and out["n"] == 10 and set(scale) == {"w", "q"}
    assert got.columns == ["row_id", "y", "z_w", "z_q", "x_w", "x_q"]
    for bad in ({"w"}, ("w", "w"), ("none",), ()):
        with pytest.raises(ValueError):
            jets.jet_population(table, table, 10, bad)
    with pytest.raises(ValueError):
        jets.jet_population(table, table, 30, ("w",))
