"""Populations: labelled event tables with particle- and detector-level columns.

A population has one row per event with ``row_id`` (a stable key), ``y`` (1:
observed, "nature"; 0: simulated, "mc"), particle-level columns ``z1..``,
detector-level columns ``x1..`` and a candidate weight ``w`` (1 where y = 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_key() -> Column:
    """md5 of the five columns that identify a line."""
    return F.md5(F.concat_ws("|", *KEY, F.round(F.col("l_extendedprice") * 100).cast("bigint")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as events: quantity and price before (z) and after (x) discount and tax."""
    factor = (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    price = F.col("l_extendedprice") / 1000
    nature = F.col("l_linestatus") == "F"
    return read(spark, sf_dir, "lineitem").select(
        line_key().alias("row_id"),
        nature.cast("int").alias("y"),
        F.col("l_quantity").alias("z1"),
        price.alias("z2"),
        (F.col("l_quantity") * factor).alias("x1"),
        (price * factor).alias("x2"),
        F.when(nature, F.lit(1.0)).otherwise(1 + F.col("l_discount") * 10).alias("w"),
    )


def long(population: DataFrame, dims: tuple[str, ...] = ("x1", "x2", "z1", "z2"), weight: str | Column | None = "w", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event and dimension: dim, y, w, v. Without a weight every event weighs 1."""
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("v")) for d in dims])
    return population.select(*keep, "y", w.alias("w"), F.explode(pairs).alias("p")).select(*keep, "p.dim", "y", "w", "p.v")


def nature(population: DataFrame) -> DataFrame:
    return population.where("y = 1")


def simulated(population: DataFrame) -> DataFrame:
    return population.where("y = 0")


def truth_guarded(population: DataFrame, particle: tuple[str, ...] = ("z1", "z2")) -> DataFrame:
    """Particle-level columns only where they are known in an experiment: NULL where y = 1."""
    return population.withColumns({c: F.when(F.col("y") == 0, F.col(c)) for c in particle})


def poisoned(population: DataFrame, particle: tuple[str, ...] = ("z1", "z2"), sentinel: float = -999.0) -> DataFrame:
    """Particle-level truth of nature overwritten; nothing fitted may change. -32768 marks missing values and is refused."""
    if sentinel == -32768:
        raise ValueError("-32768 marks missing values")
    return population.withColumns({c: F.when(F.col("y") == 1, F.lit(sentinel)).otherwise(F.col(c)) for c in particle})


def require_finite(population: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``population``, or an error if a listed column holds a null or non-finite value."""
    found = {c: n for c, n in population.agg(*[_odd(c).alias(c) for c in columns]).first().asDict().items() if n}
    if found:
        raise ValueError(f"non-finite values: {found}")
    return population


def _odd(c: str) -> Column:
    return F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")))


def observed_finite(population: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """``population``, and the number of null or non-finite values of each column in the pass that the caller makes anyway."""
    seen = Observation()
    return population.observe(seen, *[_odd(c).alias(c) for c in columns]), seen


def checked_finite(population: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``population``; the job that reads it fails at a null or non-finite value, without a scan before."""

    def sound(c: str) -> Column:
        v = F.col(c)
        return F.when(v.isNull() | F.isnan(c) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"non-finite value in {c}")).cast("double")).otherwise(v.cast("double"))

    return population.withColumns({c: sound(c) for c in columns})


def interleave(nature_rows: DataFrame, simulated_rows: DataFrame) -> DataFrame:
    """Both samples under one label column, nature first."""
    return nature_rows.withColumn("y", F.lit(1)).unionByName(simulated_rows.withColumn("y", F.lit(0)))


def select_columns(population: DataFrame, known: tuple[str, ...], wanted: tuple[str, ...]) -> list[str]:
    """``wanted`` in canonical order; unknown names are an error that names the closest known ones."""
    unknown = [c for c in wanted if c not in population.columns]
    if unknown:
        import difflib

        hints = {c: difflib.get_close_matches(c, population.columns, 1) for c in unknown}
        raise ValueError(f"unknown columns: {hints}")
    return [c for c in known if c in wanted] + [c for c in wanted if c not in known]
