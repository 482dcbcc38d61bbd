"""Comparison of experiment arms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.operators.binning import stretch_cuts, stretch_levels, with_stretch

# The resolution of the kernel distance, and the tolerances of a tie.
FLOOR = 1.159e-4
RELATIVE, ABSOLUTE = 1e-7, 1e-12


def arm_summary(runs: DataFrame) -> DataFrame:
    """arm, n, mean, sd, se of (arm, seed, value); two runs of one arm and seed are an error."""
    twice = runs.groupBy("arm", "seed").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("a seed occurs twice in an arm")
    return runs.groupBy("arm").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))


def mean_over_observables(scores: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """arm, seed, value: the mean of (arm, seed, observable, value) over observables, some left out.

    An error if an arm and seed have none of the others.
    """
    used = F.when(~F.col("observable").isin(*excluded), F.col("value")) if excluded else F.col("value")
    out = scores.groupBy("arm", "seed").agg(F.avg(used).alias("value"))
    if out.where("value IS NULL").limit(1).count():
        raise ValueError("every observable of a run is excluded")
    return out


def arm_diagnostics(runs: DataFrame, columns: tuple[str, ...] = ("ess", "mmd2")) -> DataFrame:
    """arm and the means of diagnostic columns over the runs that have them (no null, no NaN)."""
    return runs.groupBy("arm").agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns])


def prefixed_metrics(records: DataFrame, prefix: str = "particle_") -> DataFrame:
    """``records`` (.., key, value) whose key starts with a prefix, without it."""
    return records.where(F.col("key").startswith(prefix)).withColumn("key", F.substring("key", len(prefix) + 1, 1 << 30))


def tied_epochs(history: DataFrame, value: str = "val_mmd", floor: float = FLOOR, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The epochs whose value is within a floor of the least of their run; NaN is none."""
    some = history.where(~F.isnan(value) & F.col(value).isNotNull())
    least = some.groupBy(*by).agg(F.min(value).alias("_least"))
    return some.join(least, [*by]).where(F.col(value) <= F.col("_least") + floor).drop("_least")


def signed_rank(pairs: DataFrame) -> DataFrame:
    """n, w_plus, w_minus, z, p of Wilcoxon's signed-rank test on paired values (seed, a, b), zeros left out, ties at mean rank.

    Equal differences are counted first. Ranks are running sums in two levels:
    stretches of differences, cut at approximate quantiles, give each its start.
    p is two-sided: exact for at most ``EXACT_PAIRS`` pairs without ties, else normal.
    """
    d = F.round(F.col("a") - F.col("b"), 12)
    sizes = pairs.select(d.alias("d")).where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    levels = stretch_levels(sizes.count())
    dealt = with_stretch(sizes.crossJoin(F.broadcast(sizes.agg(stretch_cuts("size", levels).alias("_cuts")))), "size", levels).drop("_cuts")  # one row
    starts = dealt.groupBy("_stretch").agg(F.sum("t").alias("_n"))
    starts = starts.select("_stretch", F.coalesce(F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row a stretch
    inside = Window.partitionBy("_stretch").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("t").over(inside), F.lit(0))
    ranked = dealt.join(F.broadcast(starts), "_stretch").withColumn("rank", before + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    out = ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("plus"))).alias("w_minus"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = out.withColumn("z", F.when(spread > 0, (F.col("w_plus") - n * (n + 1) / 4) / spread))
    return out.withColumn("p", _signed_rank_p(F.col("n"), F.least("w_plus", "w_minus"), F.col("ties"), F.col("z"))).select("n", "w_plus", "w_minus", "z", "p")


#: Most pairs for which the distribution of the rank sum is counted out.
EXACT_PAIRS = 500


def rank_sum_distribution(n: int) -> np.ndarray:
    """Probability of every sum of signed ranks 1 to n, each rank counted with chance one half: by adding one rank after another."""
    p = np.ones(1)
    for rank in range(1, n + 1):
        p = (np.pad(p, (0, rank)) + np.pad(p, (rank, 0))) / 2
    return p


def _signed_rank_p(n: Column, least: Column, ties: Column, z: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def p(n: pd.Series, least: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
        out = []
        for k, w, t, x in zip(n, least, ties, z):
            if not k or pd.isna(x):
                out.append(None)
            elif k <= EXACT_PAIRS and t == 0:
                out.append(min(1.0, 2 * float(rank_sum_distribution(int(k))[: int(w) + 1].sum())))
            else:
                out.append(math.erfc(abs(x) / math.sqrt(2)))
        return pd.Series(out, dtype="float64")

    return p(n, least.cast("double"), ties.cast("double"), z.cast("double"))


def t_quantile(share: float, df: float) -> float:
    """The value that Student's t with ``df`` degrees of freedom stays below with probability ``share``, by halving."""
    if not 0 < share < 1 or df <= 0:
        raise ValueError("a share in (0, 1) and positive degrees of freedom are needed")
    if share < 0.5:
        return -t_quantile(1 - share, df)

    def beyond(t: float) -> float:
        return float(_incomplete_beta(np.array([df / 2]), np.array([0.5]), np.array([df / (df + t * t)]))[0]) / 2

    lo, hi = 0.0, 1.0
    while beyond(hi) > 1 - share:
        lo, hi = hi, 2 * hi
    for _ in range(200):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if beyond(middle) > 1 - share else (lo, middle)
    return (lo + hi) / 2


def with_interval(summary: DataFrame, mean: str = "mean", se: str = "se", n: str = "n", share: float = 0.95) -> DataFrame:
    """``summary`` with low and high, the interval of a mean from its standard error; null below two values."""
    sizes = sorted(r["n"] for r in summary.select(F.col(n).alias("n")).distinct().collect() if r["n"] and r["n"] > 1)  # group sizes
    width = F.lit(None).cast("double")
    for k in sizes:
        width = F.when(F.col(n) == k, F.lit(t_quantile((1 + share) / 2, k - 1))).otherwise(width)
    return summary.withColumns({"low": F.col(mean) - width * F.col(se), "high": F.col(mean) + width * F.col(se)})


def paired_delta(runs: DataFrame, baseline: str) -> DataFrame:
    """arm, n, delta, se, t, p of each arm against the baseline on shared seeds; arms with one shared seed are dropped."""
    base = runs.where(F.col("arm") == baseline).select("seed", F.col("value").alias("_base"))
    d = F.col("value") - F.col("_base")
    out = runs.where(F.col("arm") != baseline).join(base, "seed").groupBy("arm").agg(F.count("*").alias("n"), F.avg(d).alias("delta"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se")).where("n >= 2")
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("delta") / F.col("se")))
    return out.withColumn("p", two_sided_p(F.col("t"), F.col("n") - 1))


def two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, through the regularised incomplete beta function."""

    @F.pandas_udf(DoubleType())
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        x, n = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
        out = np.full(len(x), np.nan)
        some = ~np.isnan(x) & ~np.isnan(n)
        out[some] = _incomplete_beta(n[some] / 2, np.full(int(some.sum()), 0.5), n[some] / (n[some] + x[some] ** 2))
        return pd.Series(out).where(some, None)

    return p(t.cast("double"), df.cast("double"))


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by a continued fraction on the side where it converges."""
    far = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(far, b, a), np.where(far, a, b), np.where(far, 1 - x, x)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inside) + b * np.log1p(-inside)) if len(a) else x
    # modified Lentz evaluation of 1 / (1 + d1 / (1 + d2 / (1 + ...)))
    tiny = 1e-300
    f, c, d = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
    for i in range(1, 400):
        m = i // 2
        k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + k * d
        d = 1 / np.where(np.abs(d) > tiny, d, tiny)
        c = 1 + k / c
        c = np.where(np.abs(c) > tiny, c, tiny)
        f = f * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front / (a * f)))
    return np.where(far, 1 - out, out)


def tied_to_best(arms: DataFrame, value: str = "mmd2", factor: float = 2.0) -> DataFrame:
    """``arms`` with tied: within two resolutions of the least value; a NaN is tied."""
    v = F.col(value)
    best = arms.where(~F.isnan(v)).agg(F.min(v).alias("_best"))  # one row
    return arms.crossJoin(F.broadcast(best)).withColumn("tied", F.isnan(v) | F.coalesce(F.abs(v - F.col("_best")) <= factor * FLOOR, F.lit(True))).drop("_best")


def best_methods(scores: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, method of the least ``after``, ties included; groups of one candidate have none, skipped ones don't count."""
    some = scores.where("status <> 'skipped'") if "status" in scores.columns else scores
    group = Window.partitionBy(*by)  # one row a method
    least, n = F.min("after").over(group), F.count("*").over(group)
    return some.withColumn("_l", least).withColumn("_n", n).where((F.col("_n") >= 2) & (F.col("after") - F.col("_l") <= ABSOLUTE + RELATIVE * F.abs("_l"))).select(*by, "method", "after")


def skipped(records: DataFrame) -> Column:
    """Whether a variable was left out: by its status, else by an unchanged value."""
    return F.coalesce(F.col("status") == "skipped", F.col("before") == F.col("after"))


def missing_cells(spark: SparkSession, cells: DataFrame, n_bootstrap: int, n_seeds: int) -> DataFrame:
    """cell, b, s of the design that ``cells`` (b, s) lacks."""
    from weftline.operators.sampling import cells as every

    return every(spark, n_bootstrap, n_seeds).join(cells.select("b", "s").distinct(), ["b", "s"], "left_anti").select("cell", "b", "s")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key; the rest is kept."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def phase_totals(phases: DataFrame) -> DataFrame:
    """``phases`` (at, depth, seconds) with each row's top-level phase and its share of the total of those."""
    order = Window.orderBy("at")  # a few dozen phases of one run
    named = phases.withColumn("top", F.sum((F.col("depth") == 0).cast("int")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    total = phases.where("depth = 0").agg(F.sum("seconds").alias("_t"))
    return named.crossJoin(total).withColumn("share", F.col("seconds") / F.col("_t")).drop("_t")


def rolling_median(df: DataFrame, value: str, order: str, by: tuple[str, ...], width: int = 5, name: str = "smooth") -> DataFrame:
    """Median of ``width`` neighbours; the end values are repeated beyond the ends."""
    half = width // 2
    group = Window.partitionBy(*by).orderBy(order)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = [F.col(value)]
    for k in range(1, half + 1):
        values += [F.coalesce(F.lag(value, k).over(group), F.first(value).over(whole)), F.coalesce(F.lead(value, k).over(group), F.last(value).over(whole))]
    return df.withColumn(name, F.get(F.array_sort(F.array(*values)), F.lit(half)))


def relative_to_first(df: DataFrame, value: str, order: str, by: tuple[str, ...]) -> Column:
    return 100 * F.col(value) / F.first(value).over(Window.partitionBy(*by).orderBy(order))


def floor_estimate(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """mean, sd, se and the error of sd of repeated null distances."""
    sd, n = F.stddev_samp("value"), F.count("*")
    return values.groupBy(*by).agg(n.alias("n"), F.avg("value").alias("mean"), sd.alias("sd"), (sd / F.sqrt(n)).alias("se"), (sd / F.sqrt(2 * (n - 1))).alias("sd_error"))


def scaling_exponent(floors: DataFrame) -> DataFrame:
    """Slope of ln sd over ln m."""
    return floors.agg(F.regr_slope(F.log("sd"), F.log("m")).alias("slope"))


def ensemble(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, sd, least and most of the values of each group."""
    v = F.col("value")
    return values.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))


def equivalence(pairs: DataFrame, margin: float) -> DataFrame:
    """One row about paired values (seed, a, b): difference, error, t, p, wins of a, and the larger of two one-sided p-values.

    Both one-sided tests ask whether the difference is within ``margin``: a
    small ``p_equivalent`` says that it is.
    """
    d = F.col("a") - F.col("b")
    out = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("delta"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.count_if(d > 0).alias("wins"))
    out = out.withColumns({"t": F.when(F.col("se") > 0, F.col("delta") / F.col("se")), "t_low": (F.col("delta") + margin) / F.col("se"), "t_high": (margin - F.col("delta")) / F.col("se")})
    df = F.col("n") - 1

    def one_sided(t: str) -> Column:
        half = two_sided_p(F.col(t), df) / 2
        return F.when(F.col(t) > 0, half).otherwise(1 - half)

    return out.withColumns({"p": two_sided_p(F.col("t"), df), "p_equivalent": F.greatest(one_sided("t_low"), one_sided("t_high"))}).drop("t_low", "t_high")


def disagreements(settings: DataFrame) -> DataFrame:
    """Keys of (cell, key, value) that have several values among the cells that have them."""
    return settings.groupBy("key").agg(F.countDistinct("value").alias("values")).where("values > 1").select("key")


def require_same_sample(a: dict, b: dict, keys: tuple[str, ...] = ("variables", "n_samples", "data_seed")) -> None:
    """Two runs can be compared event by event only if these settings are equal."""
    differ = [k for k in keys if a.get(k) != b.get(k)]
    if differ:
        raise ValueError(f"different samples: {differ}")


def value_at_selection(history: DataFrame, selected: DataFrame, value: str = "ess") -> DataFrame:
    """run, value of each run at its selected epoch; NaN where the history lacks it."""
    at = history.select("run", "epoch", value)
    return selected.select("run", "epoch").join(at, ["run", "epoch"], "left").select("run", F.coalesce(value, F.lit(float("nan"))).alias(value))


def presented(df: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """``df`` in a stated order of a column's values; others follow by name."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def arm_table(runs: DataFrame, baseline: str) -> DataFrame:
    """arm, n, mean, sd, se, and the paired difference from the baseline in resolutions."""
    delta = paired_delta(runs, baseline).select("arm", "delta", F.col("se").alias("delta_se"), "p")
    return arm_summary(runs).join(delta, "arm", "left").withColumn("delta_floors", F.col("delta") / FLOOR)


def per_observable(runs: DataFrame, baseline: str) -> DataFrame:
    """observable, arm, n, delta, se: paired differences on shared (observable, seed); keys with one seed are dropped."""
    base = runs.where(F.col("arm") == baseline).select("observable", "seed", F.col("value").alias("_base"))
    d = F.col("value") - F.col("_base")
    both = runs.where(F.col("arm") != baseline).join(base, ["observable", "seed"])
    return both.groupBy("observable", "arm").agg(F.count("*").alias("n"), F.avg(d).alias("delta"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se")).where("n >= 2")
