"""Jet observables from nested constituents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import sampling

# Fixed value: two bits for each particle code, charge + 1.
CHARGE_CODES = 0x5228849
# Fixed value: the log of the groomed mass where it vanishes.
SDM_FLOOR = -14.0


def _charge(pid: str) -> str:
    return f"CASE WHEN {pid} BETWEEN 0 AND 15 THEN (shiftright({CHARGE_CODES}, cast(2 * {pid} AS INT)) & 3) - 1 ELSE raise_error('particle code out of range') END"


def charge_of(pid: str) -> Column:
    """Charge by the name of a column or lambda variable path holding the code."""
    return F.expr(_charge(pid))


def constituents(rows: DataFrame, jet: str, pt: Column, code: Column) -> DataFrame:
    """jet, parts: array of (pt, charge) of each jet. A jet's constituents are few by nature."""
    named = rows.select(jet, pt.alias("pt"), code.cast("int").alias("pid"))
    return named.select(jet, F.struct("pt", charge_of("pid").alias("charge")).alias("part")).groupBy(jet).agg(F.collect_list("part").alias("parts"))


def observables(jets: DataFrame, parts: str = "parts") -> DataFrame:
    """Adds q, f_ch, n_ch and ptd; all are 0 where the jet has no momentum."""
    p = F.col(parts)

    def total(f) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda a, x: a + f(x))

    pt, root = total(lambda x: x["pt"]), total(lambda x: F.sqrt(x["pt"]))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return jets.withColumns(
        {
            "q": ratio(total(lambda x: x["charge"] * F.sqrt(x["pt"])), root),
            "f_ch": ratio(total(lambda x: F.abs(x["charge"]) * x["pt"]), pt),
            "n_ch": F.size(F.filter(p, lambda x: (x["charge"] != 0) & (x["pt"] > 0))).cast("long"),
            "ptd": ratio(F.sqrt(total(lambda x: x["pt"] * x["pt"])), pt),
        }
    )


def tau21(tau2: Column, width: Column) -> Column:
    return F.when(width > 0, tau2 / width).otherwise(F.lit(0.0))


def groomed_mass(sdm: Column, pt: Column) -> Column:
    """ln((sdm / pt)^2), and its floor where that isn't positive."""
    return F.when((sdm > 0) & (pt > 0), 2 * F.log(sdm / pt)).otherwise(F.lit(SDM_FLOOR))


#: The twelve observables in their order; mass and multiplicity by names that don't differ in case only.
VARIABLES = ("mass", "mult", "w", "tau21", "zg", "sdm", "q", "f_ch", "lha", "ang2", "ptd", "n_ch")
LEVELS = ("gen", "sim")


def reduce_shard(shard: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and 24 columns gen_mass, sim_mass, gen_mult, ..: every observable at both levels, from rows that are one jet each.

    For both levels a row has jets (pt, y, phi, m), mults, widths, tau2s, zgs, sdms,
    lhas, ang2s and particles, an array of (pt, y, phi, code / 10), padded with zeros
    or not. Arrays are reduced where they lie and not kept. An array of particles
    with less than four numbers or with a code beyond 15 is an error.
    """
    out = shard
    for level in LEVELS:
        jet, part = F.col(f"{level}_jets"), F.col(f"{level}_particles")
        code = F.transform(part, lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("pt"), F.round(F.get(p, F.lit(3)) * 10).cast("int").alias("pid"), F.size(p).alias("n")))
        out = out.withColumn("_codes", code).withColumn("_parts", F.expr(f"transform(_codes, x -> named_struct('pt', x.pt, 'charge', CASE WHEN x.n < 4 THEN raise_error('a particle needs four numbers') ELSE {_charge('x.pid')} END))"))
        out = observables(out, "_parts")
        pt, width = F.get(jet, F.lit(0)), F.col(f"{level}_widths").cast("double")
        stored = {
            "mass": F.get(jet, F.lit(3)), "mult": F.col(f"{level}_mults"), "w": width, "tau21": tau21(F.col(f"{level}_tau2s").cast("double"), width), "zg": F.col(f"{level}_zgs"),
            "sdm": groomed_mass(F.col(f"{level}_sdms").cast("double"), pt), "lha": F.col(f"{level}_lhas"), "ang2": F.col(f"{level}_ang2s"),
        }
        out = out.withColumns({f"{level}_{v}": stored.get(v, F.col(v)).cast("double") for v in VARIABLES}).drop("_codes", "_parts", "q", "f_ch", "n_ch", "ptd")
    return out.select(*keep, *[f"{level}_{v}" for v in VARIABLES for level in LEVELS])


def jet_population(nature: DataFrame, simulated: DataFrame, n: int, variables: tuple[str, ...] = VARIABLES, key: str = "row_id") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(row_id, y, z_<variable>, x_<variable>) of the first n jets of each sample, standardized; and each variable's mean and deviation.

    Both are those of simulated truth, for all four arrays. Variables come in the
    order asked for; duplicates, unknown names, a set, or fewer than n jets are errors.
    """
    if isinstance(variables, set | frozenset) or len(set(variables)) != len(variables) or not variables or set(variables) - set(VARIABLES):
        raise ValueError(f"variables must be some of {VARIABLES} in an order, each once")
    both = sampling.head_of_class(nature.withColumn("y", F.lit(1)).unionByName(simulated.withColumn("y", F.lit(0))), n, key)
    got = both.where("y = 0").agg(*[f(f"gen_{v}").alias(f"{k}_{v}") for v in variables for k, f in (("mu", F.avg), ("sigma", F.stddev_pop))]).first()
    scale = {v: (float(got[f"mu_{v}"]), float(got[f"sigma_{v}"])) for v in variables}
    columns = [((F.col(f"{level}_{v}") - scale[v][0]) / scale[v][1]).alias(f"{name}_{v}") for name, level in (("z", "gen"), ("x", "sim")) for v in variables]
    return both.select(key, "y", *columns), scale


def ingest(jets: DataFrame, path: str, label: str = "y") -> None:
    """Writes jets with their observables as Parquet, one folder a class; constituents aren't kept.

    Readers of one class then read its folder only. A jet without a class is an error.
    """
    checked = F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(F.raise_error(F.lit("a jet must be of class 0 or 1")).cast("int"))
    observables(jets).drop("parts").withColumn(label, checked).write.partitionBy(label).parquet(path)


def read_ingested(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The ingested table, all columns or those named and the class."""
    table = spark.read.parquet(path)
    return table.select("y", *columns) if columns else table
