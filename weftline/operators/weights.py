"""Event weights: five normalizations, dispersion and losses. They are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

EPSILON = 1e-7  # fixed value: the usual fuzz of the trainers this follows


def _with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))  # one row


def mean_one(df: DataFrame, w: str = "w", check: bool = True) -> DataFrame:
    """Weights of mean 1; negative, non-finite or all-zero weights are an error unless ``check`` is off.

    The check rides on the pass that takes the mean: it fails the job that uses
    the weights, without a scan of its own.
    """
    bad = F.count_if((F.col(w) < 0) | F.isnan(w) | (F.abs(F.col(w)) == float("inf")) | F.col(w).isNull())
    told = F.raise_error(F.lit("weights must be finite, not negative and not all zero")).cast("double")
    mean = F.when((bad > 0) | ~(F.coalesce(F.avg(w), F.lit(0.0)) > 0), told).otherwise(F.avg(w)) if check else F.avg(w)
    return _with_totals(df, _m=mean).withColumn(w, F.col(w) / F.col("_m")).drop("_m")


def class_preserving(df: DataFrame, w: str = "w") -> DataFrame:
    """Observed rows weigh 1, simulated ones w n / (sum w + epsilon)."""
    mc = F.col("y") == 0
    both = _with_totals(df, _n=F.count_if(mc), _s=F.sum(F.when(mc, F.col(w))))
    return both.withColumn(w, F.when(mc, F.col(w) * F.col("_n") / (F.col("_s") + EPSILON)).otherwise(1.0)).drop("_n", "_s")


def sum_to_one(df: DataFrame, w: str = "w") -> DataFrame:
    return _with_totals(df, _s=F.sum(w)).withColumn(w, F.col(w) / F.col("_s")).drop("_s")


def count_preserving(df: DataFrame, w: str = "w") -> DataFrame:
    return _with_totals(df, _s=F.sum(w), _n=F.count("*")).withColumn(w, F.col(w) * F.col("_n") / F.col("_s")).drop("_s", "_n")


def likelihood_ratio(p: Column, clip: float = 1e-7) -> Column:
    """p / (1 - p) with p kept away from 0 and 1."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return q / (1 - q)


def observed_ratio(df: DataFrame, p: str, clip: float = 1e-7, name: str = "w") -> tuple[DataFrame, Observation]:
    """``df`` with the likelihood ratio of a probability column, and what was clipped on the way.

    The observation (rows, clipped_low, clipped_high) is filled by the first action
    on the result; nothing is scanned for it.
    """
    seen = Observation()
    v = F.col(p)
    out = df.withColumn(name, likelihood_ratio(v, clip)).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(v < clip).alias("clipped_low"), F.count_if(v > 1 - clip).alias("clipped_high"))
    return out, seen


def effective_size(w: Column | str) -> Column:
    w = F.col(w) if isinstance(w, str) else w
    return F.pow(F.sum(w), F.lit(2)) / F.sum(w * w)


def dispersion(df: DataFrame, w: str = "w") -> DataFrame:
    """ess, share, dispersion of the simulated weights; share = 1 / (1 + dispersion) for weights of mean 1."""
    return df.where("y = 0").agg(
        effective_size(w).alias("ess"), (effective_size(w) / F.count("*")).alias("share"), (F.var_pop(w) / F.pow(F.avg(w), F.lit(2))).alias("dispersion")
    )


def cross_entropy(df: DataFrame, d: Column, w: str = "w") -> DataFrame:
    """One row, loss and rows: minus the mean of w y ln(d + e) + w (1 - y) ln(1 - d + e)."""
    y = F.col("y")
    return df.agg(
        (-F.sum(F.col(w) * (y * F.log(d + EPSILON) + (1 - y) * F.log(1 - d + EPSILON))) / F.count("*")).alias("loss"), F.count("*").alias("rows")
    )


def critic_gap(df: DataFrame, f: Column, w: str = "w") -> DataFrame:
    """One row, gap: the observed mean of f minus its weighted simulated mean."""
    y, mc = F.col("y"), F.when(F.col("y") == 0, F.col(w))
    return df.agg((F.avg(F.when(y == 1, f)) - F.sum(mc * f) / F.sum(mc)).alias("gap"))


def gradient_penalty(norm: Column) -> Column:
    """Aggregate: the mean squared excess of gradient norms over 1."""
    return F.avg(F.pow(F.greatest(F.lit(0.0), norm - 1), F.lit(2)))


def variance_split(df: DataFrame, w: str, h: str) -> DataFrame:
    """total = visible + residual + closure for a regression h of the weight w on what is visible."""
    return df.agg(F.var_pop(w).alias("total"), F.var_pop(h).alias("visible"), F.avg(F.pow(F.col(w) - F.col(h), F.lit(2))).alias("residual")).withColumn(
        "closure", F.col("total") - F.col("visible") - F.col("residual")
    )


def average_epochs(history: DataFrame, keep: Column | None = None) -> DataFrame:
    """row_id, w: the mean over epochs (those that ``keep`` selects) of weights brought to mean 1 in each epoch."""
    kept = history if keep is None else history.where(keep)
    means = kept.groupBy("epoch").agg(F.avg("w").alias("_m"))
    return kept.join(F.broadcast(means), "epoch").groupBy("row_id").agg(F.avg(F.col("w") / F.col("_m")).alias("w"))  # one row an epoch


def averaged(history: DataFrame, strategy: str, selected: int | None = None, tied: list[int] | None = None) -> DataFrame:
    """``average_epochs`` of (epoch, row_id, w) by a named strategy: selected, tied-mean, all-mean or particle-best.

    ``selected`` is the epoch of the first and the last of these, ``tied`` the epochs of the second.
    """
    if strategy == "all-mean":
        return average_epochs(history)
    if strategy == "tied-mean":
        if not tied:
            raise ValueError("no tied epochs")
        return average_epochs(history, F.col("epoch").isin(*tied))
    if strategy in ("selected", "particle-best"):
        if selected is None:
            raise ValueError("no selected epoch")
        return average_epochs(history, F.col("epoch") == selected)
    raise ValueError(f"unknown strategy {strategy}")
