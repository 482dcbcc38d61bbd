"""Registered queries over the driver's tables, and the same in SQL.

Every query reads its whole tables. Values are rounded to six digits, since
sums differ in their last digits between engines and partitionings.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.expressions import hash_key, improvement, sigmoid
from weftline.operators import binning, ceiling, distances, experiments, ibu, learning, mmd, reweight, sampling, tilt, training, uncertainty, weights
from weftline.operators.sorted_areas import areas
from weftline.sources import gaussian, jets, populations
from weftline.streaming import histograms

DIGITS = 6
EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 60.0]
DIMS = ("x1", "x2", "z1", "z2")


def _round(*columns: str) -> dict[str, Column]:
    return {c: F.round(F.col(c), DIGITS) for c in columns}


def _pop(spark: SparkSession, sf: str) -> DataFrame:
    return populations.lines(spark, sf)


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    return populations.long(_pop(spark, sf), weight=None)


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return populations.long(_pop(spark, sf))


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as events of an 8 x 8 grid of (b, s)."""
    line = populations.read(spark, sf, "lineitem")
    return line.select(
        F.pmod("l_partkey", F.lit(8)).cast("int").alias("b"), F.pmod("l_suppkey", F.lit(8)).cast("int").alias("s"), (F.col("l_extendedprice") / 1000).alias("v"),
        (1 + F.col("l_discount")).alias("w"), F.least(F.lit(4), F.floor(F.col("l_quantity") / 10).cast("int")).alias("bin"),
    )


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value by event type and user."""
    return populations.read(spark, sf, "events").groupBy(F.col("event_type").alias("arm"), F.col("user_id").alias("seed")).agg(F.avg("value").alias("value"))


def w1_per_dim(spark, sf):
    return distances.wide_wasserstein(_pop(spark, sf), DIMS, {"w1": None}).withColumns(_round("w1"))


def w1_weighted(spark, sf):
    return distances.wide_wasserstein(_pop(spark, sf), DIMS, {"w1": F.col("w")}).withColumns(_round("w1"))


def jet_shard(spark, sf):
    """All 24 columns of orders as jets: their lines are particles, without and with discount and tax."""
    line = populations.read(spark, sf, "lineitem")
    factor = (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    code = F.pmod("l_partkey", F.lit(16)) / 10
    shards = line.groupBy("l_orderkey")
    out = []
    for level, f in (("gen", F.lit(1.0)), ("sim", factor)):
        pt = F.col("l_extendedprice") * f
        out += [
            F.array(F.sum(pt), F.lit(0.0), F.lit(0.0), F.sum(F.col("l_quantity") * f)).alias(f"{level}_jets"), F.count(F.lit(1)).alias(f"{level}_mults"), F.avg(F.sqrt(F.col("l_discount") * f)).alias(f"{level}_widths"),
            F.avg(F.sqrt(F.col("l_tax") * f)).alias(f"{level}_tau2s"), F.min(F.sqrt(F.col("l_discount") * f)).alias(f"{level}_zgs"), F.max(F.col("l_quantity") * f).alias(f"{level}_sdms"), F.max(F.sqrt(F.col("l_tax") * f)).alias(f"{level}_lhas"),
            F.sum(F.col("l_discount") * F.sqrt(F.col("l_discount") * f)).alias(f"{level}_ang2s"), F.collect_list(F.array(pt, F.lit(0.0), F.lit(0.0), code)).alias(f"{level}_particles"),
        ]
    got = jets.reduce_shard(shards.agg(*out), ("l_orderkey",))
    return got.select("l_orderkey", *[F.round(c, DIGITS).alias(c) for c in got.columns[1:]])


def improvement_pct(spark, sf):
    both = distances.wide_wasserstein(_pop(spark, sf), DIMS, {"before": None, "after": F.col("w")})
    return both.withColumn("improvement", improvement(F.col("before"), F.col("after"))).withColumns(_round("before", "after", "improvement"))


def hist_normalized(spark, sf):
    return binning.histogram(_weighted(spark, sf)).withColumns(_round("p", "q"))


def js_divergence(spark, sf):
    return distances.js_and_triangular(_weighted(spark, sf)).select("dim", F.round("js", DIGITS).alias("js"))


def triangular(spark, sf):
    return distances.js_and_triangular(_weighted(spark, sf)).select("dim", F.round("triangular", DIGITS).alias("triangular"))


def metric_set_long(spark, sf):
    return distances.metric_set(_weighted(spark, sf)).withColumns(_round("value"))


def metric_comparison(spark, sf):
    return distances.compare(distances.metric_set(_plain(spark, sf)), distances.metric_set(_weighted(spark, sf))).withColumns(_round("before", "after", "improvement"))


def sliced_w1(spark, sf):
    return distances.sliced_wasserstein(spark, _pop(spark, sf), ("x1", "x2"), distances.random_directions(128, 2), digits=9).withColumns(_round("sliced_w1"))


def distance_floors(spark, sf):
    """Sliced and axis distance of all lines, with what two equal samples of that size read."""
    return distances.distances_with_floors(_pop(spark, sf), ("x1", "x2"), n_directions=16, repeats=2).withColumns(_round("before", "after", "floor", "floor_sd"))


def axis_w1(spark, sf):
    return distances.axis_wasserstein(_pop(spark, sf), ("x1", "x2")).withColumns(_round("axis_w1"))


def ess(spark, sf):
    return _pop(spark, sf).groupBy("y").agg(F.round(weights.effective_size("w"), DIGITS).alias("ess"))


def weight_dispersion(spark, sf):
    return weights.dispersion(_pop(spark, sf)).withColumns(_round("ess", "share", "dispersion"))


def normalize_mean_one(spark, sf):
    return weights.mean_one(_pop(spark, sf).where("y = 0")).select("row_id", F.round("w", DIGITS).alias("w"))


def normalize_class_preserving(spark, sf):
    return weights.class_preserving(_pop(spark, sf)).select("row_id", F.round("w", DIGITS).alias("w"))


def normalize_sum_to_one(spark, sf):
    return weights.sum_to_one(_pop(spark, sf).where("y = 0")).select("row_id", F.round("w", 12).alias("w"))


def normalize_count_preserving(spark, sf):
    return weights.count_preserving(_pop(spark, sf).where("y = 0")).select("row_id", F.round("w", DIGITS).alias("w"))


def likelihood_ratio_weights(spark, sf):
    p = sigmoid((F.col("x1") - 25) / 5)
    return _pop(spark, sf).where("y = 0").select("row_id", F.round(weights.likelihood_ratio(p), DIGITS).alias("w"))


def bce_weighted(spark, sf):
    return weights.cross_entropy(_pop(spark, sf), sigmoid((F.col("x1") - 25) / 10)).withColumns(_round("loss"))


def critic_gap(spark, sf):
    return weights.critic_gap(_pop(spark, sf), F.col("x1") / 10 + F.col("x2") / 100).withColumns(_round("gap"))


def gradient_penalty(spark, sf):
    return _pop(spark, sf).agg(F.round(weights.gradient_penalty(F.sqrt(F.pow(F.col("x1") / 25, F.lit(2)) + F.pow(F.col("x2") / 50, F.lit(2)))), DIGITS).alias("penalty"))


def variance_split(spark, sf):
    p = _pop(spark, sf).where("y = 0")
    h = p.groupBy(F.floor(F.col("x1") / 5).alias("k")).agg(F.avg("w").alias("h"))
    both = p.withColumn("k", F.floor(F.col("x1") / 5)).join(F.broadcast(h), "k")  # a few dozen rows
    return weights.variance_split(both, "w", "h").withColumns(_round("total", "visible", "residual", "closure"))


def standardize(spark, sf):
    return tilt.standardized(_pop(spark, sf), ("z1", "z2")).select("row_id", *[F.round(c, DIGITS).alias(c) for c in ("z1", "z2")])


def population_counts(spark, sf):
    return _pop(spark, sf).groupBy("y").agg(F.count("*").alias("n"), F.round(F.min("z1"), DIGITS).alias("z1_min"), F.round(F.max("z2"), DIGITS).alias("z2_max"))


def interleave_partition(spark, sf):
    p = _pop(spark, sf)
    return populations.interleave(populations.nature(p), populations.simulated(p)).select("row_id", "y", F.round("x1", DIGITS).alias("x1"))


def truth_guard(spark, sf):
    return populations.truth_guarded(_pop(spark, sf)).groupBy("y").agg(F.count("z1").alias("known"), F.count("*").alias("n"))


def hash_split(spark, sf):
    return sampling.split(_pop(spark, sf), 42).select("row_id", "y", "split")


def hash_split_disjoint(spark, sf):
    return sampling.split(_pop(spark, sf), 42).groupBy("y", "split").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"))


def subsample_top_m(spark, sf):
    return sampling.subsample(_pop(spark, sf), 500, 7).select("row_id", "y", "rank")


def balanced_classes(spark, sf):
    return sampling.balanced(_pop(spark, sf), 3).select("row_id", "y")


def reserve_eval(spark, sf):
    return sampling.reserve(_pop(spark, sf), 200, 5).select("row_id", F.col("reserved").cast("int").alias("reserved"))


def disjoint_null_halves(spark, sf):
    return sampling.disjoint_halves(_pop(spark, sf).where("y = 0"), 300, 11).select("row_id", "half")


def bootstrap_multiplicity(spark, sf):
    return sampling.bootstrap_counts(_pop(spark, sf), 13).select("row_id", "y", F.col("multiplicity").cast("bigint").alias("multiplicity"))


def bootstrap_mean(spark, sf):
    counted = sampling.bootstrap_counts(_pop(spark, sf), 13)
    return counted.groupBy("y").agg(F.sum("multiplicity").cast("bigint").alias("n"), F.round(F.sum(F.col("multiplicity") * F.col("x1")) / F.sum("multiplicity"), DIGITS).alias("mean_x1"))


def pseudo_domains(spark, sf):
    return sampling.pseudo_domains(_pop(spark, sf).where("y = 0"), F.col("z2"), 1.5, 17).select("row_id", "domain")


def jet_features(spark, sf):
    line = populations.read(spark, sf, "lineitem")
    parts = jets.constituents(line, "l_orderkey", F.col("l_extendedprice"), F.pmod("l_partkey", F.lit(16)))
    return jets.observables(parts).select("l_orderkey", F.round("q", DIGITS).alias("q"), F.round("f_ch", DIGITS).alias("f_ch"), "n_ch", F.round("ptd", DIGITS).alias("ptd"))


def charge_decode(spark, sf):
    pid = populations.read(spark, sf, "lineitem").select(F.pmod("l_partkey", F.lit(16)).cast("int").alias("pid"))
    return pid.groupBy("pid").agg(F.count("*").alias("n")).select("pid", jets.charge_of("pid").cast("int").alias("charge"), "n")


def cubic_response(spark, sf):
    z = tilt.standardized(_pop(spark, sf), ("z2",))
    return z.groupBy("y").agg(*[F.round(F.avg(gaussian.cubic_response(F.col("z2"), s / 10)), DIGITS).alias(f"mean_{s}") for s in (0, 1, 5)])


def gaussian_smearing(spark, sf):
    keys = _pop(spark, sf)
    n = gaussian.normal(F.col("row_id"), "smear")
    return keys.groupBy("y").agg(F.round(F.avg(n), DIGITS).alias("mean"), F.round(F.stddev_pop(F.col("z1") + 2 * n), DIGITS).alias("sd"))


def _edges() -> Column:
    return F.array(*[F.lit(e) for e in EDGES])


def saturated_bins(spark, sf):
    return _pop(spark, sf).groupBy("y", binning.saturated_bin(F.col("x1"), _edges()).alias("bin")).agg(F.count("*").alias("n"))


def response_matrix(spark, sf):
    mc = _pop(spark, sf).where("y = 0").select(binning.saturated_bin(F.col("z1"), _edges()).alias("tb"), binning.saturated_bin(F.col("x1"), _edges()).alias("rb"))
    return binning.response_matrix(mc, "tb", "rb", len(EDGES) - 1).withColumns(_round("p"))


def purity_candidates(spark, sf):
    mc = _pop(spark, sf).where("y = 0")
    span = mc.agg(F.min("z1").alias("lo"), F.max("z1").alias("hi")).first()
    return ibu.candidate_purities(mc, "z1", "x1", span["lo"], span["hi"]).select("candidate", *[F.round(c, DIGITS).alias(c) for c in ("c", "purity")])


def ibu_iterations(spark, sf):
    p = _pop(spark, sf)
    mc = p.where("y = 0")
    prior = ibu.binned_counts(mc, "z1", EDGES)
    steps = ibu.iterate(prior, ibu.binned_counts(p.where("y = 1"), "x1", EDGES), ibu.response(mc, "z1", "x1", EDGES), 3)
    return spark.createDataFrame([(k, b, float(v)) for k, s in enumerate(steps) for b, v in enumerate(s)], "round int, bin int, content double").withColumns(_round("content"))


def ibu_weights(spark, sf):
    p = _pop(spark, sf)
    mc = p.where("y = 0")
    prior = ibu.binned_counts(mc, "z1", EDGES)
    steps = ibu.iterate(prior, ibu.binned_counts(p.where("y = 1"), "x1", EDGES), ibu.response(mc, "z1", "x1", EDGES), 3)
    result = {"status": "ok", "edges": EDGES, "weights": ibu.bin_weights(steps[-1], prior).tolist()}
    w = mc.withColumn("w", ibu.event_weights(mc, "z1", result))
    return weights.mean_one(w).select("row_id", F.round("w", DIGITS).alias("w"))


def joint_product_weights(spark, sf):
    p = _pop(spark, sf)
    out = ibu.joint_weights(p.drop("w"), {"a": 1 + F.col("z1") / 50, "b": F.when(F.col("z2") < 10, F.lit(0.0)).otherwise(F.lit(1.5))})
    return out.select("row_id", F.round("w", DIGITS).alias("w"))


PAIRS = {"first": ("z1", "x1"), "second": ("z2", "x2")}


def ibu_full(spark, sf):
    """Both variables unfolded; all metrics at both levels before and after the joint weights."""
    p = _pop(spark, sf)
    return distances.joint_record(ibu.reweighted(p, PAIRS, ibu.unfold_all(p, PAIRS)), ("x1", "x2", "z1", "z2"))


def _samples(spark, sf) -> tuple[DataFrame, DataFrame]:
    some = sampling.small_subsample(_pop(spark, sf), mmd.SUBSAMPLE, 23)
    return some.where("y = 1"), some.where("y = 0")


def median_bandwidth(spark, sf):
    data, _ = _samples(spark, sf)
    return spark.createDataFrame([(mmd.median_bandwidth(data, ("x1", "x2")),)], "bandwidth double").withColumns(_round("bandwidth"))


def mmd2_weighted(spark, sf):
    data, mc = _samples(spark, sf)
    got = mmd.weighted_mmd2(mmd.prepare(data, mc, ("x1", "x2"), 10.0))
    return spark.createDataFrame([(got["mmd2"], got["ess"], got["data"], got["cross"])], "mmd2 double, ess double, data double, cross_term double").withColumns(_round("mmd2", "ess", "data", "cross_term"))


def quantile_edges(spark, sf):
    got = binning.exact_quantiles(_pop(spark, sf), "z2", [i / 10 for i in range(11)])
    return spark.createDataFrame(list(enumerate(got)), "i int, edge double").withColumns(_round("edge"))


def binned_spectra(spark, sf):
    return uncertainty.spectra(_grid(spark, sf)).withColumns(_round("f"))


def weighted_means(spark, sf):
    return uncertainty.weighted_mean(_grid(spark, sf), "v").withColumns(_round("mean"))


def evaluation_variance(spark, sf):
    return uncertainty.mean_variance(_grid(spark, sf), "v").withColumns(_round("mean", "variance"))


def evaluation_covariance(spark, sf):
    return uncertainty.fraction_covariance(_grid(spark, sf)).select("bin_a", "bin_b", F.round(F.col("cov") * 1e6, DIGITS).alias("cov"))


def spectra_covariance(spark, sf):
    return uncertainty.covariance(uncertainty.spectra(_grid(spark, sf))).select("bin_a", "bin_b", F.round(F.col("cov") * 1e3, DIGITS).alias("cov"))


def correlation_guarded(spark, sf):
    return uncertainty.correlation(uncertainty.covariance(uncertainty.spectra(_grid(spark, sf)))).withColumns(_round("corr"))


def anova_components(spark, sf):
    cells = uncertainty.weighted_mean(_grid(spark, sf), "v").withColumnRenamed("mean", "value")
    return uncertainty.anova(cells).withColumns(_round("data", "initialization", "interaction", "total", "naive"))


def component_covariance(spark, sf):
    got = uncertainty.component_covariance(uncertainty.spectra(_grid(spark, sf)))
    return got.select("bin_a", "bin_b", *[F.round(F.col(c) * 1e3, DIGITS).alias(c) for c in ("data", "initialization", "interaction")])


def arm_summary(spark, sf):
    return experiments.arm_summary(_arms(spark, sf)).withColumns(_round("mean", "sd", "se"))


def paired_delta(spark, sf):
    return experiments.paired_delta(_arms(spark, sf), "click").select("arm", "n", *[F.round(c, DIGITS).alias(c) for c in ("delta", "se", "t")])


def paired_p_values(spark, sf):
    return experiments.paired_delta(_arms(spark, sf), "click").select("arm", F.round("p", 9).alias("p"))


def tied_to_best(spark, sf):
    arms = populations.read(spark, sf, "events").groupBy(F.col("user_id").alias("arm")).agg((F.avg("value") / 1e6).alias("mmd2"))
    return experiments.tied_to_best(arms).select("arm", F.col("tied").cast("int").alias("tied"))


def best_method_ties(spark, sf):
    scores = populations.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("variable"), F.col("l_returnflag").alias("method")).agg(F.round(F.avg("l_quantity"), 1).alias("after"))
    return experiments.best_methods(scores, ("variable",))


def missing_cells(spark, sf):
    """Users (b) and days (s) without an event, of all users and days between the first and the last."""
    events = populations.read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    first = events.agg(F.min("user_id").alias("u"), F.min("day").alias("d"), F.max("user_id").alias("last_u"), F.max("day").alias("last_d")).first()  # one row
    if first["u"] is None:
        return spark.createDataFrame([], "cell long, b int, s int")
    have = events.select((F.col("user_id") - first["u"]).cast("int").alias("b"), F.date_diff("day", F.lit(first["d"])).alias("s"))
    grid = (first["last_u"] - first["u"] + 1, (first["last_d"] - first["d"]).days + 1)
    return experiments.missing_cells(spark, have, *grid).select(F.col("cell").cast("bigint").alias("cell"), "b", "s")


def phase_upsert(spark, sf):
    orders = populations.read(spark, sf, "orders")
    old = orders.select("o_orderkey", F.col("o_totalprice").alias("seconds"))
    new = orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") / 2).alias("seconds"))
    return experiments.upsert(old, new, "o_orderkey").withColumns(_round("seconds"))


def rolling_median5(spark, sf):
    daily = populations.read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return experiments.rolling_median(daily, "v", "day", ("event_type",)).select("event_type", "day", F.round("v", DIGITS).alias("v"), F.round("smooth", DIGITS).alias("smooth"))


def ess_percent(spark, sf):
    daily = populations.read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return daily.select("event_type", "day", F.round(experiments.relative_to_first(daily, "v", "day", ("event_type",)), DIGITS).alias("percent"))


def floor_estimates(spark, sf):
    values = populations.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("value"))
    return experiments.floor_estimate(values, ("g",)).withColumns(_round("mean", "sd", "se", "sd_error"))


def log_log_slope(spark, sf):
    floors = populations.read(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("m")).agg(F.stddev_samp("l_extendedprice").alias("sd")).where("sd > 0")
    return experiments.scaling_exponent(floors).withColumns(_round("slope"))


def varying_config_keys(spark, sf):
    from weftline.sources import runs

    line = populations.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), "l_returnflag", "l_linestatus")
    pairs = F.array(F.struct(F.lit("flag").alias("key"), F.col("l_returnflag").alias("value")), F.struct(F.lit("status").alias("key"), F.col("l_linestatus").alias("value")))
    return runs.varying_keys(line.select("run", F.explode(pairs).alias("p")).select("run", "p.key", "p.value"))


def tilt_moments(spark, sf):
    mc = tilt.standardized(_pop(spark, sf), ("z1", "z2")).where("y = 0")
    return tilt.moments(mc, tilt.monomials(("z1", "z2"), 2)).withColumns(_round("mean"))


def tilt_fit(spark, sf):
    p = tilt.standardized(_pop(spark, sf), ("z1", "z2"))
    t = tilt.monomials(("z1", "z2"), 2)
    want = p.where("y = 1").agg(*[F.avg(c).alias(n) for n, c in t.items()]).first()
    out = tilt.apply(p.drop("w"), t, tilt.fit(p, t, [want[n] for n in t]))
    both = tilt.moments(out.where("y = 0"), t).withColumnRenamed("mean", "tilted")
    return both.join(tilt.moments(out.where("y = 1"), t), "statistic").withColumns(_round("tilted", "mean"))


def response_delta(spark, sf):
    got = reweight.response_gain(_pop(spark, sf), sigmoid((F.col("z1") - 25) / 40), sigmoid((F.col("z1") - 25) / 40 + (F.col("x2") - 50) / 400))
    return got.withColumns(_round("nats", "bits", "se"))


def density_ratio(spark, sf):
    out = reweight.density_ratio(_pop(spark, sf), ("x1", "x2"))
    return distances.wasserstein(populations.long(out.withColumn("w", F.when(F.col("y") == 0, F.col("ratio")).otherwise(1.0)), ("x1", "x2")))


def iter_reweight(spark, sf):
    out = reweight.iterate(_pop(spark, sf), ("z1", "z2"), ("x1", "x2"), 2)
    return distances.wide_wasserstein(out, DIMS, {"w1": F.col("w")})


def _training(objective: str, epochs: int) -> dict:
    held = hash_key("held", F.col("row_id")) < "2"  # an eighth of the rows
    return {"truth": ("z1", "z2"), "reco": ("x1", "x2"), "settings": training.Settings(objective, generator=(8,), critic=(8, 8), epochs=epochs), "held_out": held}


def adversarial_weights(spark, sf):
    return training.train_and_compare(_pop(spark, sf), **_training(training.CLASSIFIER, 6))[1]


def wasserstein_weights(spark, sf):
    return training.train_and_compare(_pop(spark, sf), **_training(training.WASSERSTEIN, 6))[1]


def training_history(spark, sf):
    return training.history_table(spark, training.train(_pop(spark, sf), **_training(training.CLASSIFIER, 3)))


#: A small generator of plain numbers: 2 inputs, 3 hidden, 1 output.
GENERATOR = [np.array([[0.5, -0.25, 0.125], [-0.75, 0.5, 0.25]]), np.array([0.1, 0.2, -0.1]), np.array([[0.3], [-0.2], [0.4]]), np.array([0.5])]


def generator_weights(spark, sf):
    """Weights of a given generator for all simulated lines."""
    given = training.Trained(training.Settings(), ("z1", "z2"), ("x1", "x2"), {"z1": (25.0, 15.0), "z2": (50.0, 30.0)}, generators=[GENERATOR])
    return training.weigh(_pop(spark, sf), given).where("y = 0").select("row_id", F.round("w", DIGITS).alias("w"))


def uncertainty_summary(spark, sf):
    """Components and deviations of mean price and quantity class over the grid of (b, s)."""
    line = _grid(spark, sf).withColumn("p", F.explode(F.array(F.struct(F.lit("price").alias("variable"), F.col("v")), F.struct(F.lit("bin").alias("variable"), F.col("bin").cast("double").alias("v")))))
    got = uncertainty.collect(line.select("p.variable", "b", "s", "p.v", "w"))
    return got.withColumns(_round("mean", "data", "initialization", "interaction", "total", "naive", "sd_total", "sd_naive"))


def leakage_check(spark, sf):
    """All variables' weights and distances from clean and from poisoned truth of nature: the largest difference, which must be 0."""
    p = _pop(spark, sf).drop("w")
    # a line has its truth of both arms beside each other, so that nothing is joined
    both = populations.poisoned(p.withColumns({"clean_z1": F.col("z1"), "clean_z2": F.col("z2")}))
    arms = {"clean": {"clean quantity": ("clean_z1", "x1"), "clean price": ("clean_z2", "x2")}, "poison": {"poison quantity": ("z1", "x1"), "poison price": ("z2", "x2")}}
    results = ibu.unfold_all(both, {k: pair for pairs in arms.values() for k, pair in pairs.items()}, rounds=3)
    for name, pairs in arms.items():
        both = ibu.joint_weights(both, {k: ibu.event_weights(both, truth, results[k]) for k, (truth, _) in pairs.items()}, name)
    level = distances.wide_wasserstein(both, ("x1", "x2", "clean_z1", "clean_z2"), {"a": F.col("clean"), "b": F.col("poison")}, keep=True)
    apart = both.where("y = 0").agg(F.max(F.abs(F.col("clean") - F.col("poison"))).alias("d")).unionByName(level.select(F.abs(F.col("a") - F.col("b")).alias("d")))
    return apart.agg(F.max("d").alias("largest_difference"))


def _tilted(spark, sf) -> DataFrame:
    """Lines of which the observed ones are kept with odds that grow with quantity, so that there is something to learn."""
    p = _pop(spark, sf)
    kept = hash_key("tilt", F.col("row_id")).substr(1, 4)
    share = F.conv(kept, 16, 10).cast("double") / 65536
    return p.where((F.col("y") == 0) | (share < sigmoid((F.col("z1") - 25) / 8))).drop("w")


NETWORK = learning.Settings(hidden=(8,), epochs=8, batch=512, patience=3)


def batched_weights(spark, sf):
    """W1 of every dimension of the tilted lines without weights and with those of a batched training."""
    p = _tilted(spark, sf)
    trained = training.train_batched(p, ("z1", "z2"), ("x1", "x2"), training.Settings(generator=(8,), critic=(8,), epochs=8, rate=0.01), held_out=0.125, shard_rows=16_384)
    return distances.wide_wasserstein(training.weigh(p, trained), DIMS, {"before": None, "after": F.col("w")}, keep=True)


def network_weights(spark, sf):
    """The same with weights of a network classifier between the samples' detector columns."""
    p = _tilted(spark, sf)
    out = reweight.density_ratio(p, ("x1", "x2"), degree=1, classifier=learning.network_classifier(NETWORK))
    return distances.wide_wasserstein(out, DIMS, {"before": None, "after": F.col("ratio")}, keep=True)


def ceiling_diagnostics(spark, sf):
    """Floor, oracle, audit and criterion of the tilted lines, the candidate being the exact tilt."""
    p = _tilted(spark, sf).withColumn("w", F.when(F.col("y") == 0, sigmoid((F.col("z1") - 25) / 8)).otherwise(1.0))  # on any scale
    return ceiling.diagnostics(p, ("z1", "z2"), ("x1", "x2"), folds=3, settings=NETWORK, size=2_000)


def null_responses(spark, sf):
    return ceiling.null_calibration(_pop(spark, sf), ("z1",), ("x1", "x2"), repeats=2, settings=NETWORK)


def grid_summary(spark, sf):
    """Variance components of weighted means over a 2 x 2 grid of trainings, all in the scans of one."""
    p = _tilted(spark, sf)
    cells = uncertainty.train_grid(p, 2, 2, ("z1", "z2"), ("x1", "x2"), training.Settings(generator=(4,), critic=(4,), epochs=4, rate=0.01))
    rows = uncertainty.grid_weights(p, cells, keep=("z1", "z2"))
    views = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in ("z1", "z2")])
    return uncertainty.collect(rows.select("b", "s", "w", F.explode(views).alias("p")).select("p.variable", "b", "s", "p.v", "w"))


def edge_search(spark, sf):
    """variable, bin, edge of both variables, from the simulated lines."""
    edges = ibu.purity_edges_all(_pop(spark, sf).where("y = 0"), {"quantity": ("z1", "x1"), "price": ("z2", "x2")}, 0.5)
    return spark.createDataFrame([(k, i, float(e)) for k, v in edges.items() for i, e in enumerate(v)], "variable string, bin int, edge double")


def _views(spark, sf) -> DataFrame:
    """The grid of lines with two binned variables."""
    line = _grid(spark, sf)
    views = F.array(F.struct(F.lit("quantity").alias("variable"), F.col("bin")), F.struct(F.lit("price").alias("variable"), F.least(F.lit(4), F.floor(F.col("v") / 20).cast("int")).alias("bin")))
    return line.select("b", "s", "v", "w", F.explode(views).alias("p")).select("p.variable", "b", "s", "v", "p.bin", "w")


def summary_spectra(spark, sf):
    return uncertainty.summary(_views(spark, sf))["spectra"].select("variable", "bin", F.round("f", DIGITS).alias("f"), *[F.round(F.col(f"sd_{k}"), DIGITS).alias(f"sd_{k}") for k in ("data", "initialization", "interaction", "total")])


def summary_covariances(spark, sf):
    got = uncertainty.summary(_views(spark, sf))["covariances"]
    return got.select("variable", "bin_a", "bin_b", *[F.round(1e3 * F.col(k), DIGITS).alias(k) for k in ("data", "initialization", "interaction", "total")])


def summary_correlations(spark, sf):
    """Correlations of the interaction component, the one that is never below zero on the diagonal."""
    return uncertainty.summary(_views(spark, sf))["correlations"].select("variable", "bin_a", "bin_b", F.round("interaction", 4).alias("interaction"))


def _shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "/tmp/weftline-checkpoints").rstrip("/")


def stream_histogram(spark, sf):
    """All events by type and bin, counted by a stream; its lateness covers the table."""
    at = f"{_shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = histograms.windowed_histogram(histograms.read_events(spark, sf), 0.0, 100.0, 10, "1 day", "36500 days")
    return histograms.run_available(stream, f"{at}/out", f"{at}/state").groupBy("event_type", "bin").agg(F.sum("n").alias("n"))


def window_histogram(spark, sf):
    """The stream's histogram over the table at rest."""
    got = histograms.windowed_histogram(populations.read(spark, sf, "events"), 0.0, 100.0, 10, "1 day")
    return got.withColumns(_round("total"))


def sweep_response(spark, sf):
    """Distance between the samples after a cubic response, over 25 strengths."""
    z = tilt.standardized(_pop(spark, sf), ("z2",)).select("y", F.col("z2").alias("z"))
    got = areas(z, [gaussian.cubic_response(F.col("z"), i / 24) for i in range(25)], [F.lit(1.0)])
    strength = F.get(F.array(*[F.lit(i / 24) for i in range(25)]), F.col("direction"))
    return got.select(F.round(strength, DIGITS).alias("s"), F.round("w1", DIGITS).alias("w1"))


def observable_means(spark, sf):
    """Mean event value of each user over event types but one."""
    scores = populations.read(spark, sf, "events").groupBy(F.col("user_id").alias("arm"), F.col("event_type").alias("observable")).agg(F.avg("value").alias("value")).withColumn("seed", F.lit(0))
    return experiments.mean_over_observables(scores.where("arm IS NOT NULL"), ("no such type",)).select("arm", F.round("value", DIGITS).alias("value"))


def tied_epoch_sets(spark, sf):
    """Days whose mean value is near the least of their event type."""
    daily = populations.read(spark, sf, "events").groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("epoch")).agg(F.avg("value").alias("val_mmd"))
    return experiments.tied_epochs(daily, floor=5.0).select("run", "epoch", F.round("val_mmd", DIGITS).alias("val_mmd"))


def signed_rank_test(spark, sf):
    """Quantity against scaled price of all lines, paired."""
    line = populations.read(spark, sf, "lineitem").select((F.col("l_quantity") + 0.0).alias("a"), (F.col("l_extendedprice") / 1500).alias("b"))
    got = experiments.signed_rank(line.select(F.round("a", 1).alias("a"), F.round("b", 1).alias("b")))
    return got.select("n", *[F.round(c, 3).alias(c) for c in ("w_plus", "w_minus", "z")])


def first_moment_transfer(spark, sf):
    return tilt.moment_transfer(_pop(spark, sf), "z1").withColumns(_round("observed", "simulated", "weighted", "closed"))


def mean_epoch_weights(spark, sf):
    """Line weights averaged over years as epochs, mean 1 in each."""
    line = populations.read(spark, sf, "lineitem")
    history = line.groupBy(F.year("l_shipdate").alias("epoch"), F.col("l_suppkey").cast("string").alias("row_id")).agg(F.sum("l_quantity").cast("double").alias("w"))
    return weights.averaged(history, "all-mean").withColumns(_round("w"))


def config_hash(spark, sf):
    text = F.to_json(F.struct("c_custkey", "c_mktsegment"))
    from weftline.functions.expressions import short_hash

    return populations.read(spark, sf, "customer").select("c_custkey", short_hash(text).alias("hash"))


def hash_order(spark, sf):
    """Customers in a seeded hash order, whole table."""
    c = populations.read(spark, sf, "customer")
    return sampling.hash_rank(c.select(F.col("c_custkey").cast("string").alias("row_id")), 99).select("row_id", "rank")


_NAMES = """
jet_shard distance_floors batched_weights network_weights ceiling_diagnostics null_responses grid_summary edge_search summary_spectra summary_covariances summary_correlations
wasserstein_weights training_history generator_weights uncertainty_summary
observable_means tied_epoch_sets signed_rank_test first_moment_transfer mean_epoch_weights
w1_per_dim w1_weighted improvement_pct hist_normalized js_divergence triangular metric_set_long metric_comparison sliced_w1 axis_w1 ess weight_dispersion
normalize_mean_one normalize_class_preserving normalize_sum_to_one normalize_count_preserving likelihood_ratio_weights bce_weighted critic_gap gradient_penalty
variance_split standardize population_counts interleave_partition truth_guard hash_split hash_split_disjoint subsample_top_m balanced_classes reserve_eval
disjoint_null_halves bootstrap_multiplicity bootstrap_mean pseudo_domains jet_features charge_decode cubic_response gaussian_smearing saturated_bins response_matrix
purity_candidates ibu_iterations ibu_weights joint_product_weights ibu_full median_bandwidth mmd2_weighted quantile_edges binned_spectra weighted_means
evaluation_variance evaluation_covariance spectra_covariance correlation_guarded anova_components component_covariance arm_summary paired_delta paired_p_values
tied_to_best best_method_ties missing_cells phase_upsert rolling_median5 ess_percent floor_estimates log_log_slope varying_config_keys tilt_moments tilt_fit
response_delta density_ratio iter_reweight adversarial_weights leakage_check stream_histogram window_histogram sweep_response config_hash hash_order
""".split()

QUERIES = {name: globals()[name] for name in _NAMES}
