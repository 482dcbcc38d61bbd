"""Reproducible splits and samples by hash order.

A rank in hash order is counted in two levels: rows fall into buckets by the
first three hex digits of their hash, the buckets' sizes give offsets, and each
bucket is ordered on its own. No window spans a whole table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.expressions import hash_integer, hash_key, hash_uniform, sigmoid

DIGITS = 3
#: Rows that are listed to find a rank among them.
FEW = 20_000


def hash_rank(df: DataFrame, seed: int | str, key: str = "row_id", by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``df`` with its rank (from 1) in hash order within ``by``, and the size ``n`` of its group."""
    h = df.withColumn("_h", hash_key(seed, F.col(key))).withColumn("_p", F.substring("_h", 1, DIGITS))
    sizes = h.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)  # at most 16 ** DIGITS rows a group
    sizes = sizes.select(
        *by, "_p",
        F.coalesce(F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key))
    return h.withColumn("_i", inside).join(sizes, [*by, "_p"]).withColumn(name, (F.col("_before") + F.col("_i")).cast("bigint")).drop("_h", "_p", "_i", "_before")


def hash_cuts(df: DataFrame, seeds: list[int | str], ranks: tuple[int, ...], key: str = "row_id") -> list[list[tuple[str, float]]]:
    """For each seed the hash at the given ranks (from 1) of its hash order, without ranking the table.

    Beside it stands the share of the rows of that hash that are up to the rank: 1
    unless keys repeat. The first hex digits are counted until few rows share those
    of a wanted rank; only these are listed. Fewer rows than a rank are an error.
    """
    hashes = F.array(*[F.struct(F.lit(i).alias("i"), hash_key(s, F.col(key)).alias("h")) for i, s in enumerate(seeds)])
    rows = df.select(F.explode(hashes).alias("p")).select("p.i", "p.h")
    wanted = {(i, r): ("", 0) for i in range(len(seeds)) for r in ranks}  # the digits so far, and the rows before them
    digits, most = 0, FEW + 1
    while most > FEW and digits < 32:
        prefixes = sorted({(i, p) for (i, _), (p, _) in wanted.items()})
        counts: dict[tuple[int, str], list[tuple[str, int]]] = {}
        chosen = rows if not digits else rows.where(F.concat(F.col("i").cast("string"), F.lit(":"), F.substring("h", 1, digits)).isin(*[f"{i}:{p}" for i, p in prefixes]))
        for r in chosen.groupBy("i", F.substring("h", 1, digits + DIGITS).alias("p")).agg(F.count("*").alias("n")).collect():  # 16 ** DIGITS rows a wanted rank
            counts.setdefault((r["i"], r["p"][:digits]), []).append((r["p"], r["n"]))
        most = 0
        for (i, rank), (p, ahead) in wanted.items():
            for q, n in sorted(counts.get((i, p), [])):
                if ahead + n >= rank:
                    wanted[i, rank], most = (q, ahead), max(most, n)
                    break
                ahead += n
            else:
                raise ValueError(f"fewer than {rank} rows")
        digits += DIGITS
    near = rows.where(F.concat(F.col("i").cast("string"), F.lit(":"), F.substring("h", 1, digits)).isin(*sorted({f"{i}:{p}" for (i, _), (p, _) in wanted.items()})))
    found = near.groupBy("i", "h").agg(F.count("*").alias("n")).orderBy("i", "h").collect()  # about FEW rows a wanted rank
    out: list[list[tuple[str, float]]] = [[] for _ in seeds]
    for i, cuts in enumerate(out):
        for rank in ranks:
            p, ahead = wanted[i, rank]
            for r in (r for r in found if r["i"] == i and r["h"].startswith(p)):
                if ahead + r["n"] >= rank:
                    cuts.append((r["h"], (rank - ahead) / r["n"]))
                    break
                ahead += r["n"]
    return out


def split(df: DataFrame, seed: int | str, key: str = "row_id", by: tuple[str, ...] = ("y",), test: float = 0.2, validation: float = 0.1) -> DataFrame:
    """``df`` with column split: a shuffled train | validation | test cut within each group.

    The last floor(n test) rows are the test part, the floor((n - that) validation / (1 - test)) before it validation.
    """
    ranked = hash_rank(df, seed, key, by)
    n_test = F.floor(F.col("n") * test)
    n_val = F.floor((F.col("n") - n_test) * (validation / (1 - test)))
    return ranked.withColumn(
        "split",
        F.when(F.col("rank") > F.col("n") - n_test, "test").when(F.col("rank") > F.col("n") - n_test - n_val, "validation").otherwise("train"),
    )


def in_splits(df: DataFrame, *splits: str) -> DataFrame:
    if not splits:
        raise ValueError("no split selected")
    return df.where(F.col("split").isin(*splits))


def subsample(df: DataFrame, m: int, seed: int | str, key: str = "row_id", by: tuple[str, ...] = ("y",)) -> DataFrame:
    """The first m rows of each group in hash order: without replacement, all if fewer."""
    return hash_rank(df, seed, key, by).where(F.col("rank") <= m)


def least_rows(df: DataFrame, m: int, order: list[Column], by: str) -> DataFrame:
    """The first m rows of each of few groups: every task keeps m at most, nothing is ranked as a whole."""
    groups = [r[by] for r in df.select(by).distinct().collect()]  # a few classes
    out = None
    for g in groups:
        part = df.where(F.col(by).eqNullSafe(F.lit(g))).orderBy(*order).limit(m)
        out = part if out is None else out.unionByName(part)
    return df.limit(0) if out is None else out


def small_subsample(df: DataFrame, m: int, seed: int | str, key: str = "row_id", by: str = "y") -> DataFrame:
    """``subsample`` of a size that one task can sort, without ranks."""
    return least_rows(df, m, [hash_key(seed, F.col(key)), F.col(key)], by)


def subsample_of_known(df: DataFrame, m: int, seed: int | str, sizes: dict[int, int], key: str = "row_id", by: str = "y") -> DataFrame:
    """``small_subsample`` in one scan, where ``sizes`` has every class with its rows; m rows a class cross the driver.

    Tasks give only rows whose hash is below a cut that leaves a few more than m
    of a class. Should they be fewer, the cut is raised; should keys repeat so
    that they are many more, the classes are sorted by tasks.
    """
    slack = m + 10 * math.isqrt(m) + 100
    while True:
        near = df.withColumn("_h", hash_key(seed, F.col(key)))
        below = {c: f"{int(slack / n * 16**12):012x}" if n > slack else None for c, n in sizes.items() if n}
        cut = reduce(lambda found, c: found.when(F.col(by) == c, F.lit(below[c] or "g")), below, F)  # of hex digits all are below g
        most = 4 * slack * len(below)
        got = near.where(F.substring("_h", 1, 12) < cut).limit(most + 1).toArrow()
        if got.num_rows > most:
            return small_subsample(df, m, seed, key, by)
        y, h, name = (got[c].to_pylist() for c in (by, "_h", key))
        order = sorted(range(got.num_rows), key=lambda i: (y[i], h[i], name[i] is not None, name[i] if name[i] is not None else 0))
        first = {c: [i for i in order if y[i] == c][:m] for c in below}
        if not any(below.values()) or all(len(first[c]) >= min(m, sizes[c]) for c in below):
            return df.sparkSession.createDataFrame(got.take([i for c in below for i in first[c]]).drop_columns(["_h"]), df.schema)
        slack *= 4


def head_of_class(df: DataFrame, n: int, key: str = "row_id", by: str = "y") -> DataFrame:
    """The n rows of least key in each class; an error if a class has fewer."""
    sizes = {r[by]: r["c"] for r in df.groupBy(by).agg(F.count("*").alias("c")).collect()}
    short = {k: c for k, c in sizes.items() if c < n}
    if short:
        raise ValueError(f"{n} rows asked for, available: {short}")
    return least_rows(df, n, [F.col(key)], by)


def balanced(df: DataFrame, seed: int | str, key: str = "row_id", by: str = "y") -> DataFrame:
    """Classes cut to the size of the smallest, in hash order."""
    ranked = hash_rank(df, seed, key, (by,))
    least = ranked.agg(F.min("n").alias("least"))  # one row
    return ranked.crossJoin(F.broadcast(least)).where(F.col("rank") <= F.col("least")).drop("least")


def reserve(df: DataFrame, n_eval: int, seed: int | str, key: str = "row_id") -> DataFrame:
    """Simulated rows with column reserved: n_eval of them held out for evaluation."""
    ranked = hash_rank(df.where("y = 0"), seed, key)
    n = ranked.select("n").first()
    if n is None or not 0 < n_eval < n["n"]:
        raise ValueError("the evaluation set must be a proper part of the simulated rows")
    return ranked.withColumn("reserved", F.col("rank") <= n_eval)


def disjoint_halves(df: DataFrame, m: int, seed: int | str, key: str = "row_id") -> DataFrame:
    """Two disjoint samples of m rows of one pool: half 0 and 1."""
    ranked = hash_rank(df, seed, key)
    n = ranked.select("n").first()
    if n is None or n["n"] < 2 * m:
        raise ValueError("the pool is smaller than two halves")
    return ranked.where(F.col("rank") <= 2 * m).withColumn("half", (F.col("rank") > m).cast("int"))


def bootstrap_counts(df: DataFrame, seed: int | str, key: str = "row_id", by: tuple[str, ...] = ("y",), resample: str = "both") -> DataFrame:
    """``df`` with multiplicity: n draws with replacement from each group's n rows, counted per row.

    ``resample`` names the side that is drawn, both, data (y = 1) or simulation
    (y = 0); rows of the other side count once.
    """
    if resample not in ("both", "data", "simulation"):
        raise ValueError("resample must be both, data or simulation")
    if resample != "both":
        drawn = F.col("y") == (1 if resample == "data" else 0)
        once = df.where(~drawn | F.col("y").isNull())
        ranked = hash_rank(once, f"{seed}:order", key, by)  # the same columns
        return bootstrap_counts(df.where(drawn), seed, key, by).unionByName(ranked.withColumn("multiplicity", F.lit(1).cast("long")))
    ranked = hash_rank(df, f"{seed}:order", key, by)
    draws = ranked.select(*by, hash_integer(F.col("n"), f"{seed}:draw", *[F.col(b) for b in by], F.col("rank")).alias("_d"))
    times = draws.groupBy(*by, "_d").agg(F.count("*").alias("multiplicity"))
    return ranked.withColumn("_d", F.col("rank") - 1).join(times, [*by, "_d"], "left").withColumn("multiplicity", F.coalesce("multiplicity", F.lit(0))).drop("_d")


def repeated(df: DataFrame, multiplicity: str = "multiplicity") -> DataFrame:
    """Each row as often as its multiplicity; 0 drops it. Carrying the multiplicity as a weight is cheaper."""
    return df.where(F.col(multiplicity) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(multiplicity).cast("int"))))


def pseudo_domains(df: DataFrame, score: Column, strength: float, seed: int | str, key: str = "row_id") -> DataFrame:
    """``df`` with column domain: Bernoulli with the sigmoid of a strength times a standardized score."""
    stats = df.agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))  # one row
    z = F.when(F.col("_s") > 0, (score - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn("domain", (hash_uniform(seed, F.col(key)) < sigmoid(strength * z)).cast("int")).drop("_m", "_s")


def cell(index: Column | int, n_seeds: int) -> tuple[Column, Column]:
    """(bootstrap, seed) of a cell number, seed-major; an error for a number below 0."""
    if isinstance(index, int) and index < 0:
        raise ValueError(f"no cell {index}")
    i = F.lit(index) if isinstance(index, int) else F.when(index >= 0, index).otherwise(F.raise_error(F.lit("no such cell")).cast("bigint"))
    return (i / n_seeds).cast("int"), (i % n_seeds).cast("int")


def split_seed(data_seed: int, b: Column, s: Column) -> Column:
    """A number of 60 bits for each (data seed, b, s)."""
    return F.conv(F.substring(hash_key(data_seed, b, s), 1, 15), 16, 10).cast("bigint")


def cells(spark: SparkSession, n_bootstrap: int, n_seeds: int) -> DataFrame:
    b, s = cell(F.col("id"), n_seeds)
    return spark.range(n_bootstrap * n_seeds).select(F.col("id").alias("cell"), b.alias("b"), s.alias("s"))
