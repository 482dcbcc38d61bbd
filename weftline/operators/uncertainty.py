"""Uncertainty over a grid of bootstrap samples (b) and seeds (s)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import learning, sampling, training

RESAMPLE = ("both", "data", "simulation")


def anova(cells: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """by, data, initialization, interaction, total, naive: random-effects variance components of (b, s, value).

    One value a cell; at least two of each. Components aren't clamped at 0.
    """
    keys = list(by)
    n = cells.groupBy(*keys).agg(F.countDistinct("b").alias("nb"), F.countDistinct("s").alias("ns"), F.avg(value).alias("grand"))
    rows = cells.groupBy(*keys, "b").agg(F.avg(value).alias("row_mean"))
    columns = cells.groupBy(*keys, "s").agg(F.avg(value).alias("col_mean"))
    on = keys or None

    def with_n(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(n), on) if on else df.crossJoin(F.broadcast(n))  # one row a group

    residual = with_n(cells.join(rows, [*keys, "b"]).join(columns, [*keys, "s"]))
    r = F.col(value) - F.col("row_mean") - F.col("col_mean") + F.col("grand")
    ms_e = residual.groupBy(*keys).agg((F.sum(r * r) / ((F.first("nb") - 1) * (F.first("ns") - 1))).alias("ms_e"), F.first("nb").alias("nb"), F.first("ns").alias("ns"))
    ms_d = with_n(rows).groupBy(*keys).agg((F.first("ns") * F.sum(F.pow(F.col("row_mean") - F.col("grand"), F.lit(2))) / (F.first("nb") - 1)).alias("ms_d"))
    ms_i = with_n(columns).groupBy(*keys).agg((F.first("nb") * F.sum(F.pow(F.col("col_mean") - F.col("grand"), F.lit(2))) / (F.first("ns") - 1)).alias("ms_i"))
    all_ms = ms_e.join(ms_d, on).join(ms_i, on) if on else ms_e.crossJoin(ms_d).crossJoin(ms_i)  # one row each
    out = all_ms.select(*keys, ((F.col("ms_d") - F.col("ms_e")) / F.col("ns")).alias("data"), ((F.col("ms_i") - F.col("ms_e")) / F.col("nb")).alias("initialization"), F.col("ms_e").alias("interaction"))
    return out.withColumn("total", F.col("data") + F.col("initialization") + F.col("interaction")).withColumn("naive", F.col("total") + F.col("interaction"))


def component_covariance(spectra: DataFrame) -> DataFrame:
    """bin_a, bin_b, data, initialization, interaction of spectra (b, s, bin, f): the same components for pairs of bins.

    Bins are few; pairs of bins are joined per cell.
    """
    n = spectra.agg(F.countDistinct("b").alias("nb"), F.countDistinct("s").alias("ns"))  # one row
    grand = spectra.groupBy("bin").agg(F.avg("f").alias("g"))
    rows, columns = (spectra.groupBy("bin", k).agg(F.avg("f").alias(f"m_{k}")) for k in "bs")
    dev = spectra.join(rows, ["bin", "b"]).join(columns, ["bin", "s"]).join(grand, "bin").select("b", "s", "bin", (F.col("f") - F.col("m_b") - F.col("m_s") + F.col("g")).alias("r"))

    def products(df: DataFrame, keys: list[str], v: str, name: str) -> DataFrame:
        other = df.select(*keys, F.col("bin").alias("bin_b"), F.col(v).alias("_o"))
        return df.select(*keys, F.col("bin").alias("bin_a"), v).join(other, keys).groupBy("bin_a", "bin_b").agg(F.sum(F.col(v) * F.col("_o")).alias(name))

    e = products(dev, ["b", "s"], "r", "e")
    d = products(rows.join(grand, "bin").select("b", "bin", (F.col("m_b") - F.col("g")).alias("r")), ["b"], "r", "d")
    i = products(columns.join(grand, "bin").select("s", "bin", (F.col("m_s") - F.col("g")).alias("r")), ["s"], "r", "i")
    out = e.join(d, ["bin_a", "bin_b"]).join(i, ["bin_a", "bin_b"]).crossJoin(F.broadcast(n))
    inter = F.col("e") / ((F.col("nb") - 1) * (F.col("ns") - 1))
    return out.select("bin_a", "bin_b", (F.col("d") / (F.col("nb") - 1) - inter / F.col("ns")).alias("data"), (F.col("i") / (F.col("ns") - 1) - inter / F.col("nb")).alias("initialization"), inter.alias("interaction"))


def spectra(events: DataFrame, by: tuple[str, ...] = ("b", "s")) -> DataFrame:
    """by, bin, f: unit-sum histograms of (by, bin, w)."""
    sums = events.groupBy(*by, "bin").agg(F.sum("w").alias("w"))
    return sums.withColumn("f", F.col("w") / F.sum("w").over(Window.partitionBy(*by))).drop("w")  # one row a bin


def weighted_mean(events: DataFrame, value: str, by: tuple[str, ...] = ("b", "s")) -> DataFrame:
    return events.groupBy(*by).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def mean_variance(events: DataFrame, value: str, by: tuple[str, ...] = ("b", "s")) -> DataFrame:
    """by, mean, variance of a weighted mean as a ratio estimator."""
    m = weighted_mean(events, value, by)
    return events.join(F.broadcast(m), [*by]).groupBy(*by).agg(  # one row a cell
        F.first("mean").alias("mean"), (F.sum(F.pow(F.col("w"), F.lit(2)) * F.pow(F.col(value) - F.col("mean"), F.lit(2))) / F.pow(F.sum("w"), F.lit(2))).alias("variance")
    )


def fraction_covariance(events: DataFrame) -> DataFrame:
    """bin_a, bin_b, cov of the bin fractions of (bin, w), by the delta method."""
    h = events.groupBy("bin").agg(F.sum("w").alias("h"), F.sum(F.col("w") * F.col("w")).alias("h2"))
    t = h.agg(F.sum("h").alias("t"), F.sum("h2").alias("w2"))  # one row
    f = h.crossJoin(F.broadcast(t)).select("bin", (F.col("h") / F.col("t")).alias("f"), "h2", "t", "w2")
    a = f.select(F.col("bin").alias("bin_a"), F.col("f").alias("fa"), F.col("h2").alias("ha"), "t", "w2")
    b = f.select(F.col("bin").alias("bin_b"), F.col("f").alias("fb"), F.col("h2").alias("hb"))
    same = F.when(F.col("bin_a") == F.col("bin_b"), F.col("ha")).otherwise(0.0)
    return a.crossJoin(F.broadcast(b)).select(  # bins by bins, both of a stated number
        "bin_a", "bin_b", ((same - F.col("fa") * F.col("hb") - F.col("ha") * F.col("fb") + F.col("fa") * F.col("fb") * F.col("w2")) / (F.col("t") * F.col("t"))).alias("cov")
    )


def covariance(spectra_rows: DataFrame, by: tuple[str, ...] = ("b", "s")) -> DataFrame:
    """bin_a, bin_b, cov over cells of (by, bin, f)."""
    other = spectra_rows.select(*by, F.col("bin").alias("bin_b"), F.col("f").alias("f_b"))
    return spectra_rows.select(*by, F.col("bin").alias("bin_a"), "f").join(other, [*by]).groupBy("bin_a", "bin_b").agg(F.covar_samp("f", "f_b").alias("cov"))


def correlation(cov: DataFrame) -> DataFrame:
    """bin_a, bin_b, corr; NaN where a diagonal isn't positive."""
    d = cov.where("bin_a = bin_b").select("bin_a", "cov")
    a, b = d.select("bin_a", F.col("cov").alias("va")), d.select(F.col("bin_a").alias("bin_b"), F.col("cov").alias("vb"))
    return cov.join(a, "bin_a").join(b, "bin_b").select(
        "bin_a", "bin_b", F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).otherwise(F.lit(float("nan"))).alias("corr")
    )


def cell_weights(population: DataFrame, evaluation: DataFrame, b: int, s: int, train: Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """b, s, row_id, w: one cell of the grid, its weights on the common ``evaluation`` rows.

    Trains with seed ``s`` on bootstrap sample ``b`` of ``population`` (row_id, y,
    ..). ``train(sample, seed)`` returns what weighs any rows, such as
    ``lambda d: training.weigh(d, trained)``.
    """
    sample = sampling.repeated(sampling.bootstrap_counts(population, f"sample:{b}"), "multiplicity")
    return train(sample, s)(evaluation).select(F.lit(b).alias("b"), F.lit(s).alias("s"), "row_id", "w")


def run_grid(population: DataFrame, evaluation: DataFrame, n_bootstrap: int, n_seeds: int, train: Callable, folder: str) -> DataFrame:
    """All cells, each written once under ``folder``; those that are there complete are kept, so a broken run goes on where it stopped."""
    spark = population.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for b in range(n_bootstrap):
        for s in range(n_seeds):
            at = f"{folder.rstrip('/')}/cell-{b}-{s}"
            done = hadoop(f"{at}/_SUCCESS")
            if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
                cell_weights(population, evaluation, b, s, train).write.mode("overwrite").parquet(at)
    return spark.read.parquet(*[f"{folder.rstrip('/')}/cell-{b}-{s}" for b in range(n_bootstrap) for s in range(n_seeds)])


def drawn(data: dict[str, np.ndarray], data_seed: int, b: int, resample: str = "both") -> np.ndarray:
    """How often each row of a shard (key, y) is in bootstrap sample ``b``; a side that isn't resampled counts once."""
    if resample not in RESAMPLE:
        raise ValueError(f"resample must be one of {RESAMPLE}")
    times = learning.multiplicities(data["key"], data_seed, "sample", b)
    once = {"both": np.zeros(len(times), bool), "data": data["y"] == 0, "simulation": data["y"] == 1}[resample]
    return np.where(once, 1, times)


def split_of(data: dict[str, np.ndarray], data_seed: int, b: int, s: int, test: float = 0.2, validation: float = 0.1) -> np.ndarray:
    """0 (train), 1 (validation) or 2 (test) for each row of a shard: another split in every cell, the same for all copies of a row."""
    u = learning.uniform(data["key"], data_seed, "split", b, s)
    return np.where(u < test, 2, np.where(u < test + validation, 1, 0))


def train_grid(
    population: DataFrame, n_bootstrap: int, n_seeds: int, truth: tuple[str, ...], reco: tuple[str, ...], settings: training.Settings = training.Settings(),
    data_seed: int = 0, resample: str = "both", batch: int = 512, shard_rows: int = learning.SHARD_ROWS,
) -> dict[tuple[int, int], training.Trained]:
    """All cells (b, s), each trained on its bootstrap sample's training part, in as many scans as one training takes.

    Rows are split first and repeated within their part: a row's multiplicity
    depends on b alone, its part on (b, s). Every row's count and part are computed
    where the row lies; no sample is written.
    """

    def member(b: int, s: int):
        def of(data: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            part = split_of(data, data_seed, b, s)
            return np.where(part == 2, 0, drawn(data, data_seed, b, resample)), part == 1

        return of

    keys = [(b, s) for s in range(n_seeds) for b in range(n_bootstrap)]
    cells = {i: training.Cell(member(b, s), s) for i, (b, s) in enumerate(keys)}
    got = training.train_cells(population, truth, reco, cells, settings, batch, shard_rows=shard_rows)
    return {k: got[i] for i, k in enumerate(keys)}


def grid_weights(evaluation: DataFrame, cells: dict[tuple[int, int], training.Trained], epoch: int = -1, keep: tuple[str, ...] = ()) -> DataFrame:
    """b, s, row_id, w: the weights of every cell on the simulated rows of ``evaluation``, of mean 1 a cell; one pass for all cells.

    Columns named in ``keep`` come along.
    """
    keys, fits = list(cells), list(cells.values())
    one = fits[0]

    @F.arrow_udf("array<double>")
    def score(v: pa.Array) -> pa.Array:
        z = v.flatten().to_numpy().reshape(len(v), len(one.truth))
        raw = np.logaddexp(0, np.column_stack([training.forward(t.generators[epoch], z)[1] for t in fits]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(fits), pa.int32()), pa.array(raw.ravel()))

    rows = evaluation.where("y = 0").select("row_id", *keep, F.posexplode(score(training._vector(one, one.truth))).alias("cell", "raw"))
    means = rows.groupBy("cell").agg(F.avg("raw").alias("mean"))  # one row a cell
    number = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(s).alias("s")) for b, s in keys])
    both = rows.join(F.broadcast(means), "cell").withColumn("k", F.get(number, F.col("cell")))
    return both.select("k.b", "k.s", "row_id", (F.col("raw") / F.col("mean")).alias("w"), *keep)


def summary(events: DataFrame) -> dict[str, DataFrame]:
    """The whole summary of a grid of (variable, b, s, v, bin, w), by variable.

    ``components``: means, variance components and deviations; ``spectra``: bin,
    f, and the deviations of its components over the grid; ``covariances`` and
    ``correlations``: bin_a, bin_b and every component.
    """
    names = [r["variable"] for r in events.select("variable").distinct().orderBy("variable").collect()]  # a few variables
    out = {"components": collect(events), "spectra": None, "covariances": None, "correlations": None}

    def put(kind: str, name: str, df: DataFrame) -> None:
        df = df.select(F.lit(name).alias("variable"), *df.columns)
        out[kind] = df if out[kind] is None else out[kind].unionByName(df)

    for name in names:
        rows = spectra(events.where(F.col("variable") == name))
        cov = component_covariance(rows).withColumn("total", F.col("data") + F.col("initialization") + F.col("interaction"))
        grand = rows.groupBy("bin").agg(F.avg("f").alias("f"))
        kinds = ("data", "initialization", "interaction", "total")
        deviations = cov.where("bin_a = bin_b").select(F.col("bin_a").alias("bin"), *[F.sqrt(F.greatest(F.col(k), F.lit(0.0))).alias(f"sd_{k}") for k in kinds])
        put("spectra", name, grand.join(deviations, "bin"))
        put("covariances", name, cov)
        diagonal = cov.where("bin_a = bin_b").select("bin_a", *[F.col(k).alias(f"a_{k}") for k in kinds])
        other = diagonal.select(F.col("bin_a").alias("bin_b"), *[F.col(f"a_{k}").alias(f"b_{k}") for k in kinds])
        ratio = [F.when((F.col(f"a_{k}") > 0) & (F.col(f"b_{k}") > 0), F.col(k) / F.sqrt(F.col(f"a_{k}") * F.col(f"b_{k}"))).otherwise(F.lit(float("nan"))).alias(k) for k in kinds]
        put("correlations", name, cov.join(diagonal, "bin_a").join(other, "bin_b").select("bin_a", "bin_b", *ratio))
    return out


def collect(events: DataFrame) -> DataFrame:
    """variable, mean, the variance components, sd_total and sd_naive of the weighted means of (variable, b, s, v, w).

    A deviation is the root of its component, 0 where that is below 0. A grid
    that lacks cells or has less than two of b or s is an error.
    """
    cells = weighted_mean(events, "v", ("variable", "b", "s")).withColumnRenamed("mean", "value").persist()
    try:
        for r in cells.groupBy("variable").agg(F.countDistinct("b").alias("nb"), F.countDistinct("s").alias("ns"), F.count("value").alias("n")).collect():  # one row a variable
            if r["nb"] < 2 or r["ns"] < 2 or r["n"] != r["nb"] * r["ns"]:
                raise ValueError(f"{r['variable']}: {r['n']} of {r['nb']} x {r['ns']} cells; a whole grid of at least 2 x 2 is needed")
        grand = cells.groupBy("variable").agg(F.avg("value").alias("mean"))
        out = grand.join(anova(cells, by=("variable",)), "variable")
    finally:
        cells.unpersist()
    return out.withColumns({f"sd_{c}": F.sqrt(F.greatest(F.col(c), F.lit(0.0))) for c in ("total", "naive")})


def closure_correlation(bins: int) -> float:
    """The correlation that the sum rule alone gives to K equal bins."""
    return -1.0 / (bins - 1)


def rank_deficient(n_bootstrap: int, bins: int) -> bool:
    return n_bootstrap <= bins
