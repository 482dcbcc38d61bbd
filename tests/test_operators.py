"""Operators on small made tables: edge cases that the driver's tables don't have."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import expressions
from weftline.operators import binning, distances, experiments, ibu, mmd, reweight, sampling, tilt, uncertainty, weights
from weftline.sources import gaussian, jets, populations, runs
from weftline.streaming import histograms


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_wasserstein_of_shifted_points(spark):
    long = rows(spark, [("d", 1, 1.0, float(v)) for v in range(5)] + [("d", 0, 3.0, v + 2.0) for v in range(5)], "dim string, y int, w double, v double")
    assert distances.wasserstein(long).first()["w1"] == pytest.approx(2.0)


def test_wasserstein_of_a_constant_column_is_zero(spark):
    long = rows(spark, [("d", 1, 1.0, 3.0), ("d", 0, 1.0, 3.0)], "dim string, y int, w double, v double")
    assert distances.wasserstein(long).first()["w1"] == 0


def test_js_without_weight_is_nan_and_disjoint_is_ln2(spark):
    long = rows(spark, [("a", 1, 1.0, 0.0), ("a", 0, 1.0, 9.0), ("b", 1, 1.0, 0.0), ("b", 0, 0.0, 9.0)], "dim string, y int, w double, v double")
    got = {r["dim"]: r for r in distances.js_and_triangular(long).collect()}
    assert got["a"]["js"] == pytest.approx(math.log(2)) and got["a"]["triangular"] == pytest.approx(2.0)
    assert math.isnan(got["b"]["js"])


def test_uniform_bins_agree_with_edges(spark):
    lo, hi, n = 0.1, 7.3, 37
    edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
    values = edges + [np.nextafter(e, 9) for e in edges] + [np.nextafter(e, -9) for e in edges[1:]]
    got = rows(spark, [(float(v),) for v in values], "v double").select("v", binning.uniform_bin(F.col("v"), F.lit(lo), F.lit(hi), n).alias("b")).collect()
    for r in got:
        assert r["b"] == min(n - 1, max(0, int(np.searchsorted(edges, r["v"], side="right")) - 1))


def test_four_binnings_differ_outside(spark):
    edges = F.array(*[F.lit(e) for e in (0.0, 1.0, 2.0)])
    got = rows(spark, [(-1.0,), (0.0,), (2.0,), (3.0,)], "v double").select(binning.saturated_bin(F.col("v"), edges).alias("s"), binning.dropping_bin(F.col("v"), edges).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0, None), (0, 0), (1, 1), (1, None)]
    with pytest.raises(ValueError):
        binning.nudged_edges([1.0, 1.0])


def test_fixed_histograms_and_ratio(spark):
    a = binning.fixed_histogram(rows(spark, [(0.5,), (1.5,), (9.0,)], "v double"), "v", 0.0, 2.0, 2)
    b = binning.fixed_histogram(rows(spark, [(0.5,)], "v double"), "v", 0.0, 2.0, 2)
    got = {r["bin"]: r["ratio"] for r in binning.bin_ratio(a, b).collect()}
    assert got[0] == 1.0 and math.isnan(got[1])


def test_quantile_edges_are_unique_and_nudged(spark):
    e = binning.quantile_edges(rows(spark, [(1.0,), (1.0,), (1.0,), (2.0,)], "v double"), "v", 4)
    assert e[0] < 1.0 and e[-1] > 2.0 and e == sorted(set(e))


def test_splits_are_disjoint_and_sized(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("row_id"), F.lit(0).alias("y"))
    n = {r["split"]: r["n"] for r in sampling.split(df, 1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"test": 200, "validation": 100, "train": 703}
    assert sampling.in_splits(sampling.split(df, 1), "test").count() == 200
    with pytest.raises(ValueError):
        sampling.in_splits(sampling.split(df, 1))


def test_rank_is_the_hash_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("row_id"))
    got = [r["row_id"] for r in sampling.hash_rank(df, 5).orderBy("rank").collect()]
    want = [r["row_id"] for r in df.orderBy(expressions.hash_key(5, F.col("row_id"))).collect()]
    assert got == want


def test_bootstrap_draws_as_many_as_there_are(spark):
    df = spark.range(777).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).alias("y"))
    counted = sampling.bootstrap_counts(df, 3)
    assert {r["y"]: r["n"] for r in counted.groupBy("y").agg(F.sum("multiplicity").alias("n")).collect()} == {0: 389, 1: 388}
    assert sampling.repeated(counted).count() == 777


def test_samplers_refuse_what_is_too_small(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("row_id"), F.lit(0).alias("y"))
    for bad in (lambda: sampling.reserve(df, 10, 1), lambda: sampling.disjoint_halves(df, 6, 1), lambda: sampling.head_of_class(df, 11)):
        with pytest.raises(ValueError):
            bad()
    halves = sampling.disjoint_halves(df, 5, 1)
    assert halves.select("row_id").distinct().count() == 10
    assert sampling.head_of_class(df, 3).count() == 3


def test_weights_keep_their_sums(spark):
    df = rows(spark, [("a", 0, 1.0), ("b", 0, 3.0), ("c", 1, 5.0)], "row_id string, y int, w double")
    mc = df.where("y = 0")
    assert [r["w"] for r in weights.mean_one(mc).orderBy("row_id").collect()] == [0.5, 1.5]
    assert sum(r["w"] for r in weights.sum_to_one(mc).collect()) == pytest.approx(1)
    assert [r["w"] for r in weights.class_preserving(df).orderBy("row_id").collect()] == [pytest.approx(0.5), pytest.approx(1.5), 1.0]
    for bad in (-1.0, float("nan"), 0.0):
        with pytest.raises(Exception, match="weights must be finite"):
            weights.mean_one(rows(spark, [(bad,)], "w double")).collect()
    d = weights.dispersion(df).first()
    assert d["share"] == pytest.approx(1 / (1 + d["dispersion"]))


def test_epoch_averages(spark):
    h = rows(spark, [(0, "a", 1.0), (0, "b", 3.0), (1, "a", 2.0), (1, "b", 2.0)], "epoch int, row_id string, w double")
    assert {r["row_id"]: r["w"] for r in weights.average_epochs(h).collect()} == {"a": 0.75, "b": 1.25}
    assert {r["row_id"]: r["w"] for r in weights.average_epochs(h, F.col("epoch") == 0).collect()} == {"a": 0.5, "b": 1.5}


def test_kernel_distance_against_direct_sums(spark):
    g = np.random.Generator(np.random.PCG64(0))
    a, b, w = g.normal(size=(40, 2)), g.normal(size=(50, 2)) + 0.5, g.random(50)
    data = rows(spark, [(f"a{i:03}", float(x), float(y), 1.0) for i, (x, y) in enumerate(a)], "row_id string, x double, z double, w double")
    mc = rows(spark, [(f"b{i:03}", float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(b, w))], "row_id string, x double, z double, w double")
    s = mmd.median_bandwidth(data, ("x", "z"))
    assert s == pytest.approx(np.sqrt(np.median(((a[:, None] - a[None]) ** 2).sum(-1)) / 2))
    got = mmd.weighted_mmd2(mmd.prepare(data, mc, ("x", "z"), s))
    k = lambda p, q: mmd.kernel(((p[:, None] - q[None]) ** 2).sum(-1), mmd.widths(s))
    u = w / w.sum()
    kaa, kbb = k(a, a), k(b, b)
    want = (kaa.sum() - np.trace(kaa)) / (40 * 39) + (u @ kbb @ u - (u * u) @ np.diag(kbb)) / (1 - u @ u) - 2 * (k(b, a).mean(axis=1) @ u)
    assert got["mmd2"] == pytest.approx(want) and got["ess"] == pytest.approx(1 / (u @ u))
    history = mc.select(F.lit(0).alias("epoch"), "row_id", "w").unionByName(mc.select(F.lit(1).alias("epoch"), "row_id", F.when(F.col("row_id") == "b000", 1.0).otherwise(0.0).alias("w")))
    points = mmd.curve(mmd.prepare(data, mc, ("x", "z"), s), history)
    assert points[0]["mmd2"] == pytest.approx(want) and points[1]["mmd2"] == float("inf") and mmd.select_epoch(points) == 0


def test_purity_edges_by_direct_search(spark):
    g = np.random.Generator(np.random.PCG64(3))
    t = g.normal(size=2000) * 3
    r = t + g.normal(size=2000) * 0.4
    df = rows(spark, [(float(a), float(b)) for a, b in zip(t, r)], "t double, r double")
    edges, lo = [t.min()], t.min()
    while len(edges) <= 50:
        for i in range(100):
            c = lo + 0.01 + (t.max() - lo - 0.01) / 99 * i
            inside = (t >= lo) & (t < c)
            if inside.any() and (inside & (r >= lo) & (r < c)).sum() / inside.sum() > ibu.PURITY:
                break
        else:
            break
        if c <= lo:
            break
        edges.append(c)
        lo = c
    assert ibu.purity_edges(df, "t", "r") == pytest.approx(edges)


def test_unfolding_recovers_a_known_truth():
    matrix = np.array([[0.8, 0.2, 0.0], [0.1, 0.8, 0.1], [0.0, 0.2, 0.8]])
    truth = np.array([100.0, 300.0, 50.0])
    steps = ibu.iterate(np.array([150.0, 150.0, 150.0]), matrix.T @ truth, matrix, 3000)
    assert steps[-1] == pytest.approx(truth, rel=1e-3)
    with pytest.raises(ValueError):
        ibu.iterate(np.zeros(3), truth, matrix, 1, strict=True)
    with pytest.raises(ValueError):
        ibu.bin_weights(np.ones(2), np.array([0.0, 1.0]))


def test_variables_of_one_bin_are_skipped(spark):
    df = rows(spark, [("a", 0, 1.0, 5.0), ("b", 1, 1.0, 1.0)], "row_id string, y int, z double, x double")
    r = ibu.unfold_variable(df, "z", "x")
    assert r["status"] == "skipped" and df.select(ibu.event_weights(df, "z", r).alias("w")).first()["w"] == 1.0


def test_tilt_of_a_shifted_normal(spark):
    g = np.random.Generator(np.random.PCG64(5))
    df = rows(spark, [(0, float(v), 1.0) for v in g.normal(size=4000)], "y int, z double, w double")
    t = tilt.monomials(("z",), 2)
    beta = tilt.fit(df, t, np.array([0.3, 1.2]))
    got = {r["statistic"]: r["mean"] for r in tilt.moments(tilt.apply(df.drop("w"), t, beta), t).collect()}
    assert got == {"z": pytest.approx(0.3, abs=1e-6), "z_z": pytest.approx(1.2, abs=1e-6)}


def test_anova_against_numpy(spark):
    g = np.random.Generator(np.random.PCG64(2))
    v = g.normal(size=(5, 4)) + g.normal(size=(5, 1)) * 2
    got = uncertainty.anova(rows(spark, [(b, s, float(v[b, s])) for b in range(5) for s in range(4)], "b int, s int, value double")).first()
    m = v.mean()
    r, c = v.mean(axis=1), v.mean(axis=0)
    e = ((v - r[:, None] - c[None] + m) ** 2).sum() / 12
    assert got["interaction"] == pytest.approx(e)
    assert got["data"] == pytest.approx((4 * ((r - m) ** 2).sum() / 4 - e) / 4)
    assert got["initialization"] == pytest.approx((5 * ((c - m) ** 2).sum() / 3 - e) / 5)


def test_correlation_of_a_flat_bin_is_nan(spark):
    cov = rows(spark, [(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0)], "bin_a int, bin_b int, cov double")
    got = {(r["bin_a"], r["bin_b"]): r["corr"] for r in uncertainty.correlation(cov).collect()}
    assert got[(0, 0)] == 1.0 and math.isnan(got[(0, 1)])
    assert uncertainty.closure_correlation(5) == -0.25 and uncertainty.rank_deficient(5, 5)


def test_arms(spark):
    r = rows(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0), ("b", 1, 2.0), ("b", 2, 4.0), ("b", 3, 4.5), ("c", 1, 1.0)], "arm string, seed int, value double")
    got = experiments.paired_delta(r, "a").collect()
    assert [x["arm"] for x in got] == ["b"]
    d = np.array([1.0, 2.0, 0.5])
    t = d.mean() / (d.std(ddof=1) / 3**0.5)
    assert got[0]["t"] == pytest.approx(t)
    # with two degrees of freedom the distribution is in closed form
    assert got[0]["p"] == pytest.approx(1 - t / math.sqrt(2 + t * t))
    with pytest.raises(ValueError):
        experiments.arm_summary(r.unionByName(r))


def test_ties(spark):
    a = rows(spark, [("a", 1e-4), ("b", 3e-4), ("c", 1e-2), ("d", float("nan"))], "arm string, mmd2 double")
    assert {r["arm"]: r["tied"] for r in experiments.tied_to_best(a).collect()} == {"a": True, "b": True, "c": False, "d": True}
    s = rows(spark, [("v", "m1", 1.0, "ok"), ("v", "m2", 1.0 + 1e-9, "ok"), ("u", "m1", 1.0, "ok"), ("u", "m2", 0.5, "skipped")], "variable string, method string, after double, status string")
    assert {(r["variable"], r["method"]) for r in experiments.best_methods(s, ("variable",)).collect()} == {("v", "m1"), ("v", "m2")}


def test_phases(spark):
    p = rows(spark, [(1, "fit.a", 1, 1.0), (2, "fit", 0, 3.0), (3, "plot", 0, 1.0)], "at int, name string, depth int, seconds double")
    got = {r["name"]: r for r in experiments.phase_totals(p).collect()}
    assert got["fit.a"]["top"] == got["fit"]["top"] != got["plot"]["top"] and got["fit"]["share"] == 0.75


def test_covariances_and_settings():
    assert gaussian.covariance(2.0, 2).tolist() == [[4.0, 0.0], [0.0, 4.0]]
    assert gaussian.covariance([1.0, 2.0], 2).tolist() == [[1.0, 0.0], [0.0, 4.0]]
    for bad in ([1.0, 2.0, 3.0], [[1.0, 2.0], [0.0, 1.0]], [[1.0, 2.0], [2.0, 1.0]]):
        with pytest.raises(ValueError):
            gaussian.covariance(bad, 2)
    with pytest.raises(ValueError):
        gaussian.parse_settings("{}")


def test_gaussian_samples_have_their_moments(spark):
    s = gaussian.parse_settings(json.dumps({"mu_nature": [1.0, 0.0], "mu_mc": [0.0, 0.0], "sigma_nature": [[1.0, 0.5], [0.5, 2.0]], "sigma_mc": 1.0, "sigma_detector": 0.5}))
    got = gaussian.generate(spark, 8000, s).where("y = 1").agg(F.avg("z1"), F.covar_samp("z1", "z2"), F.var_samp("x1")).first()
    assert got[0] == pytest.approx(1.0, abs=0.05) and got[1] == pytest.approx(0.5, abs=0.08) and got[2] == pytest.approx(1.25, abs=0.08)


def test_charges_and_degenerate_jets(spark):
    got = [r["c"] for r in spark.range(16).select(F.col("id").cast("int").alias("pid")).orderBy("pid").select(jets.charge_of("pid").alias("c")).collect()]
    assert got == [((0x5228849 >> (2 * p)) & 3) - 1 for p in range(16)]
    none = rows(spark, [(1, [])], "jet int, parts array<struct<pt:double,charge:int>>")
    assert tuple(jets.observables(none).select("q", "f_ch", "n_ch", "ptd").first()) == (0.0, 0.0, 0, 0.0)
    with pytest.raises(Exception, match="out of range"):
        rows(spark, [(16,)], "pid int").select(jets.charge_of("pid")).collect()
    one = rows(spark, [(1.0, 0.0, 0.0)], "a double, b double, c double").select(jets.tau21(F.col("a"), F.col("b")), jets.groomed_mass(F.col("b"), F.col("a"))).first()
    assert tuple(one) == (0.0, -14.0)


def test_guards(spark):
    df = rows(spark, [("a", 1, 1.0), ("b", 0, float("nan"))], "row_id string, y int, z1 double")
    with pytest.raises(ValueError):
        populations.require_finite(df, ("z1",))
    with pytest.raises(ValueError):
        populations.poisoned(df, ("z1",), -32768)
    with pytest.raises(ValueError):
        populations.select_columns(df, ("z1",), ("z2",))
    assert populations.truth_guarded(df, ("z1",)).where("y = 1").first()["z1"] is None
    assert rows(spark, [(float("inf"),)], "w double").select(expressions.finite_or_zero(F.col("w"))).first()[0] == 0.0


def test_runs(spark, tmp_path):
    for name, a, b in (("r1", 1, 5), ("r2", 2, 5)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.json").write_text(json.dumps({"a": a, "b": b}))
        (tmp_path / name / "metrics.json").write_text("{}")
    (tmp_path / "r3").mkdir()
    (tmp_path / "r3" / "config.json").write_text("{}")
    entries = runs.config_keys(runs.load_records(spark, str(tmp_path)))
    varying = runs.varying_keys(entries)
    assert [r["key"] for r in varying.collect()] == ["a"]
    assert {r["run"]: r["arm"] for r in runs.arm_labels(entries, varying).collect()} == {"r1": "a=1", "r2": "a=2"}


def test_designs_and_cells(spark, tmp_path):
    at = str(tmp_path / "grid")
    runs.freeze_design(spark, at, {"n_bootstrap": 2, "n_seeds": 2})
    with pytest.raises(FileExistsError):
        runs.freeze_design(spark, at, {})
    runs.freeze_design(spark, at, {"n_bootstrap": 2, "n_seeds": 2}, force=True)
    cells = sampling.cells(spark, 2, 2).withColumn("w", F.lit(1.0))
    runs.write_cells(cells.where("cell < 3"), at)
    with pytest.raises(ValueError):
        runs.load_cells(spark, at)
    runs.write_cells(cells.where("cell = 3"), at)
    assert runs.load_cells(spark, at).count() == 4
    with pytest.raises(FileExistsError):
        runs.freeze_design(spark, at, {}, force=True)
    assert experiments.missing_cells(spark, cells.where("cell <> 1"), 2, 2).first()["cell"] == 1


def test_summary_logs(spark, tmp_path):
    (tmp_path / "log").write_text("x\nSUMMARY seed=3 mean_improvement=81.5\n")
    assert tuple(runs.read_summary_log(spark, str(tmp_path / "log")).first()) == (3, 81.5)


def test_histograms_merge(spark):
    h = rows(spark, [("2024-01-01 00:00:00", "a", 1, 2, 5.0)], "window_start string, event_type string, bin int, n long, total double")
    assert tuple(histograms.merge(h, h).first())[3:] == (4, 10.0)


def test_response_gain_of_a_useful_column(spark):
    df = rows(spark, [(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.3)], "y int, p double")
    got = reweight.response_gain(df, F.lit(0.5), F.col("p")).first()
    assert got["nats"] > 0 and got["bits"] == pytest.approx(got["nats"] / math.log(2))


def test_equivalence_within_a_margin(spark):
    pairs = rows(spark, [(i, 1.0 + 0.01 * (-1) ** i, 1.0) for i in range(20)], "seed int, a double, b double")
    got = experiments.equivalence(pairs, 0.1).first()
    assert got["wins"] == 10 and got["p"] > 0.9 and got["p_equivalent"] < 1e-6
    assert experiments.equivalence(pairs, 1e-6).first()["p_equivalent"] > 0.4


def test_tables_of_arms(spark):
    r = rows(spark, [("a", "x", 1, 1.0), ("a", "x", 2, 2.0), ("b", "x", 1, 2.0), ("b", "x", 2, 4.0), ("b", "y", 1, 1.0), ("a", "y", 1, 1.0)], "arm string, observable string, seed int, value double")
    assert [tuple(x) for x in experiments.per_observable(r, "a").select("observable", "arm", "delta").collect()] == [("x", "b", 1.5)]
    table = {x["arm"]: x for x in experiments.arm_table(r.where("observable = 'x'"), "a").collect()}
    assert table["a"]["delta"] is None and table["b"]["delta_floors"] == pytest.approx(1.5 / experiments.FLOOR)
    assert [x["arm"] for x in experiments.presented(r.select("arm").distinct(), "arm", ("b",)).collect()] == ["b", "a"]


def test_settings_and_selection(spark):
    s = rows(spark, [(0, "n", "1"), (1, "n", "1"), (0, "k", "2"), (1, "k", "3")], "cell int, key string, value string")
    assert [x["key"] for x in experiments.disagreements(s).collect()] == ["k"]
    with pytest.raises(ValueError):
        experiments.require_same_sample({"data_seed": 1}, {"data_seed": 2})
    h = rows(spark, [("r", 0, 5.0), ("r", 1, 6.0)], "run string, epoch int, ess double")
    got = experiments.value_at_selection(h, rows(spark, [("r", 1), ("q", 0)], "run string, epoch int")).collect()
    assert {x["run"]: x["ess"] for x in got}["r"] == 6.0 and math.isnan({x["run"]: x["ess"] for x in got}["q"])
    assert experiments.ensemble(h.withColumnRenamed("ess", "value")).first()["most"] == 6.0


def test_distance_of_skewed_values_with_many_stretches(spark, monkeypatch):
    """One outlier and a heavy tail must not put nearly all rows in one stretch."""
    monkeypatch.setattr(binning, "STRETCH", 50)
    g = np.random.Generator(np.random.PCG64(3))
    a, b = np.append(g.pareto(0.7, 900), 1e9), np.round(g.pareto(0.9, 800), 1)
    w = g.random(800)
    long = rows(spark, [("d", 1, 1.0, float(v)) for v in a] + [("d", 0, float(u), float(v)) for u, v in zip(w, b)], "dim string, y int, w double, v double")
    v = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), v, side="right") / len(a)
    order = b.argsort()
    fb = np.append(0, w[order].cumsum())[np.searchsorted(b[order], v, side="right")] / w.sum()
    want = (np.abs(fa - fb)[:-1] * np.diff(v)).sum()
    for merge in (True, False):
        assert distances.wasserstein(long, merge=merge).first()["w1"] == pytest.approx(want)


def test_median_of_even_and_tied_distances(spark):
    for points in ([(0.0,), (1.0,)], [(0.0,), (0.0,), (5.0,)], [(float(i * i),) for i in range(60)], [(2.0,)]):
        u = np.asarray(points)
        df = rows(spark, [(str(i), p[0]) for i, p in enumerate(points)], "row_id string, x double")
        assert mmd.median_bandwidth(df, ("x",), block=7) == pytest.approx(np.sqrt(np.median((u - u.T) ** 2) / 2))


def test_observable_means_leave_exclusions_out(spark):
    s = rows(spark, [("a", 1, "u", 1.0), ("a", 1, "v", 3.0), ("b", 1, "u", 5.0)], "arm string, seed int, observable string, value double")
    assert {r["arm"]: r["value"] for r in experiments.mean_over_observables(s).collect()} == {"a": 2.0, "b": 5.0}
    with pytest.raises(ValueError, match="excluded"):
        experiments.mean_over_observables(s, ("u",))
    r = rows(spark, [("a", 1.0, None), ("a", float("nan"), 4.0)], "arm string, ess double, mmd2 double")
    assert experiments.arm_diagnostics(r).first()[1:] == (1.0, 4.0)
    k = rows(spark, [("particle_w1", 1.0), ("w1", 2.0)], "key string, value double")
    assert [tuple(x) for x in experiments.prefixed_metrics(k).collect()] == [("w1", 1.0)]


def test_tied_epochs_and_averaging_strategies(spark):
    h = rows(spark, [("r", 1, 0.5), ("r", 2, 0.50001), ("r", 3, 0.9), ("r", 4, float("nan"))], "run string, epoch int, val_mmd double")
    tied = sorted(r["epoch"] for r in experiments.tied_epochs(h).collect())
    assert tied == [1, 2]
    w = rows(spark, [(e, k, float(e * v)) for e in (1, 2, 3) for k, v in (("a", 1), ("b", 3 if e < 3 else 1))], "epoch int, row_id string, w double")
    got = {s: {r["row_id"]: r["w"] for r in weights.averaged(w, s, 3, tied).collect()} for s in ("selected", "tied-mean", "all-mean", "particle-best")}
    assert got["selected"] == got["particle-best"] == {"a": 1.0, "b": 1.0} and got["tied-mean"] == {"a": 0.5, "b": 1.5}
    assert got["all-mean"]["a"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        weights.averaged(w, "other")


def test_signed_ranks_with_ties_and_zeros(spark):
    a = [(1, 3.0, 1.0), (2, 1.0, 3.0), (3, 5.0, 4.0), (4, 2.0, 2.0), (5, 9.0, 4.0)]
    r = experiments.signed_rank(rows(spark, a, "seed int, a double, b double")).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (4, 7.5, 2.5)
    assert r["z"] == pytest.approx(2.5 / np.sqrt(4 * 5 * 9 / 24 - 6 / 48))


def test_small_expressions(spark):
    from pyspark.sql import functions as F

    from weftline.functions.expressions import fixed_point, merged

    r = spark.range(1).select(fixed_point(F.lit(1234.5), 2).alias("t"), merged(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3)")).alias("m")).first()
    assert r["t"] == "1234.50" and r["m"] == {"a": 1, "b": 3}
    with pytest.raises(ValueError, match="no cell"):
        sampling.cell(-1, 3)


def test_p_values_of_many_at_once(spark):
    t = [0.0, 0.5, -2.0, 12.0, None, 1e9]
    from pyspark.sql import functions as F

    df = rows(spark, [(i, x) for i, x in enumerate(t)], "i int, t double")
    got = {r["i"]: r["p"] for r in df.select("i", experiments.two_sided_p(F.col("t"), F.lit(2)).alias("p")).collect()}
    for i, x in enumerate(t):
        assert got[i] is None if x is None else got[i] == pytest.approx(1 - abs(x) / np.sqrt(2 + x * x), abs=1e-12)


@pytest.mark.parametrize("stretch", [7, 250_000])
def test_quantiles_by_counting_equal_those_of_all_values(spark, monkeypatch, stretch):
    monkeypatch.setattr(binning, "STRETCH", stretch)
    g = np.random.Generator(np.random.PCG64(5))
    values = np.concatenate([np.exp(3 * g.normal(size=150)), np.full(90, 2.5), [1e12]])
    df = rows(spark, [(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    assert binning.exact_quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    with pytest.raises(ValueError):
        binning.exact_quantiles(df.where("v IS NULL"), "v", shares)


def test_quantiles_are_counted_without_a_shuffle_of_rows_and_heavy_tails_or_infinities_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(binning, "with_stretch", None)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=2_000), np.repeat(0.25, 500), np.exp(rng.normal(size=500) * 40), -np.exp(rng.normal(size=500) * 40)])
    df = rows(spark, [(float(v),) for v in values], "v double")
    shares = [0.0, 0.001, 0.3, 0.5, 0.77, 0.999, 1.0]
    assert binning.exact_quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    odd = rows(spark, [(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    assert binning.exact_quantiles(odd, "v", [0.0, 0.25, 0.5, 0.75]) == [float("-inf"), 1.0, 2.0, float("inf")]
    assert math.isnan(binning.exact_quantiles(odd, "v", [1.0])[0])
