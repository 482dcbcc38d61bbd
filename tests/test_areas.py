"""W1 under many weights and directions from one sorted order, and its floors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import distances, sorted_areas


def plain_w1(v, y, w):
    """The area between two weighted distribution functions, by a loop over the sorted values."""
    order = np.argsort(v, kind="stable")
    v, y, w = v[order], y[order], w[order]
    a, b = w * (y == 1), w * (y == 0)
    h = np.cumsum(a / a.sum() - b / b.sum())
    return float((np.abs(h[:-1]) * np.diff(v)).sum())


def sample(spark, n=3_000, parts=4):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, n)
    rows = [(f"r{i}", int(a), float(round(b, 1)), float(c), float(d)) for i, a, b, c, d in zip(range(n), y, rng.normal(size=n) + 0.3 * y, rng.normal(size=n) * (1 + y), rng.random(n) + 0.1)]
    return rows, spark.createDataFrame(rows, "row_id string, y int, x1 double, x2 double, w double").repartition(parts)


@pytest.mark.parametrize("size", [250_000, 200])
def test_all_weights_and_directions_equal_a_plain_loop(spark, monkeypatch, size):
    monkeypatch.setattr(sorted_areas, "RANGE_ROWS", size)
    rows, df = sample(spark)
    directions = np.array([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]])
    got = {(r["direction"], r["weight"]): r["w1"] for r in sorted_areas.areas(df, [F.col("x1"), F.col("x2")], [F.lit(1.0), F.col("w")], directions).collect()}
    y, x = np.array([r[1] for r in rows]), np.array([r[2:4] for r in rows])
    for d, u in enumerate(directions):
        for k, w in enumerate((np.ones(len(y)), np.array([r[4] for r in rows]))):
            assert got[d, k] == pytest.approx(plain_w1(x @ u, y, w), abs=1e-9)


def test_nulls_take_no_part_and_empty_classes_are_nan(spark):
    df = spark.createDataFrame([(1, 0.0), (1, None), (0, 2.0), (0, float("nan")), (0, float("inf"))], "y int, x double")
    got = {r["weight"]: r["w1"] for r in sorted_areas.areas(df, [F.col("x")], [F.lit(1.0), F.when(F.col("y") == 1, 1.0)]).collect()}
    assert got[0] == 2.0 and np.isnan(got[1])
    assert sorted_areas.areas(df.limit(0), [F.col("x")], [F.lit(1.0)]).count() == 0


def test_wide_distances_equal_long_ones(spark):
    _, df = sample(spark)
    from weftline.sources.populations import long

    wide = {r["dim"]: r for r in distances.wide_wasserstein(df, ("x1", "x2"), {"unit": None, "own": F.col("w")}).collect()}
    df = df.withColumn("w", F.when(F.col("y") == 0, F.col("w")).otherwise(1.0))
    for name, weight in (("unit", None), ("own", "w")):
        for r in distances.wasserstein(long(df, ("x1", "x2"), weight)).collect():
            assert wide[r["dim"]][name] == pytest.approx(r["w1"], abs=1e-9)


def test_floors_are_distances_of_disjoint_draws_of_the_size_compared(spark):
    from weftline.operators import sampling

    rows, df = sample(spark, 2_000)
    got = {r["metric"]: r for r in distances.distances_with_floors(df, ("x1", "x2"), n_directions=8, size=300, repeats=2).collect()}
    y, x, w = np.array([r[1] for r in rows]), np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])
    u = (x - x[y == 1].mean(axis=0)) / x[y == 1].std(axis=0)
    directions = {"sliced": np.array(distances.random_directions(8, 2, 0)), "axis": np.eye(2)}
    place = {r[0]: i for i, r in enumerate(rows)}
    draws = []
    for i in range(2):
        rank = {place[r["row_id"]]: r["rank"] for r in sampling.hash_rank(df, f"0:null:{i}", by=("y",)).where("y = 1").collect()}
        left, right = ([k for k, v in rank.items() if a < v <= b] for a, b in ((0, 300), (300, 600)))
        assert len(left) == len(right) == 300 and not set(left) & set(right)
        draws.append((left, right))
    for metric, turn in directions.items():
        mean = lambda v, side, weight: np.mean([plain_w1(v @ t, side, weight) for t in turn])
        assert got[metric]["before"] == pytest.approx(mean(u, y, np.ones(len(y))), abs=1e-9)
        assert got[metric]["after"] == pytest.approx(mean(u, y, np.where(y == 1, 1.0, w)), abs=1e-9)
        floors = [mean(u[a + b], np.array([1] * 300 + [0] * 300), np.ones(600)) for a, b in draws]
        assert got[metric]["floor"] == pytest.approx(np.mean(floors), abs=1e-9) and got[metric]["floor_sd"] == pytest.approx(np.std(floors, ddof=1), abs=1e-9)
    with pytest.raises(ValueError):
        distances.distances_with_floors(df, ("x1", "x2"), size=len(rows))


@pytest.mark.parametrize("tail", [False, True])
def test_of_many_directions_few_rows_are_sorted_and_areas_stay_exact(spark, monkeypatch, tail):
    for name, size in (("RANGE_ROWS", 200), ("FEW_VALUES", 0), ("CELLS", 8_192), ("BLOCK", 500)):
        monkeypatch.setattr(sorted_areas, name, size)
    dealt, sort = [], sorted_areas._sorted
    monkeypatch.setattr(sorted_areas, "_sorted", lambda *a: dealt.append(int(a[6].sum())) or sort(*a))
    rows, df = sample(spark)
    if tail:
        df = df.withColumn("x2", F.when(F.col("x2") > 1.5, F.exp(F.col("x2") * 20)).otherwise(F.col("x2")))
    directions = np.array(distances.random_directions(32, 2))
    weights = [F.lit(1.0), F.col("w"), (F.when(F.col("w") < 0.5, 1.0), F.when(F.col("w") >= 0.5, F.col("w")))]
    got = {(r["direction"], r["weight"]): r["w1"] for r in sorted_areas.areas(df, [F.col("x1"), F.col("x2")], weights, directions).collect()}
    at = df.select("y", "x1", "x2", "w").toPandas().to_numpy()
    y, x, w = at[:, 0], at[:, 1:3], at[:, 3]
    assert sum(dealt) <= len(rows)  # of 32 times as many values
    for d, u in enumerate(directions):
        low = w < 0.5
        for k, want in enumerate((plain_w1(x @ u, y, np.ones(len(y))), plain_w1(x @ u, y, w), plain_w1(x @ u, low.astype(int), np.where(low, 1.0, w)))):
            assert got[d, k] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_hash_cuts_are_the_hashes_at_ranks_and_floors_shuffle_no_table(spark, monkeypatch):
    from weftline.functions.expressions import hash_key
    from weftline.operators import sampling

    monkeypatch.setattr(sampling, "FEW", 1)
    _, df = sample(spark, 2_000)
    hashes = sorted(r[0] for r in df.select(hash_key("s", F.col("row_id"))).collect())
    assert sampling.hash_cuts(df, ["s"], (1, 700, 2_000)) == [[(hashes[i], 1.0) for i in (0, 699, 1_999)]]
    twice = df.unionByName(df)
    assert sampling.hash_cuts(twice, ["s", "s"], (1, 700)) == [[(hashes[0], 0.5), (hashes[349], 1.0)]] * 2
    with pytest.raises(ValueError):
        sampling.hash_cuts(df, ["s"], (2_001,))
    monkeypatch.setattr(sampling, "hash_rank", None)
    once, again = ({r["metric"]: r["floor"] for r in distances.distances_with_floors(d, ("x1", "x2"), n_directions=4, size=n, repeats=2).collect()} for d, n in ((df, 300), (twice, 600)))
    assert once == pytest.approx(again, abs=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_on_the_driver_are_bounded_whatever_stays_open(spark, monkeypatch, seed):
    for name, size in (("RANGE_ROWS", 200), ("FEW_VALUES", 0), ("CELLS", 256)):
        monkeypatch.setattr(sorted_areas, name, size)
    n, k = 6_000, 3
    rng = np.random.default_rng(seed)
    x, y, cut = rng.normal(size=(n, 2)), rng.integers(0, 2, n), rng.random((n, 2))
    df = spark.createDataFrame([(*map(float, a), int(b), *map(float, c)) for a, b, c in zip(x, y, cut)], "x1 double, x2 double, y int, c1 double, c2 double").repartition(3)
    halves = [(F.when(F.col(c) < 0.5, 1.0), F.when(F.col(c) >= 0.5, 1.0)) for c in ("c1", "c2")]  # nothing to find, so that most cells stay open
    seen, masses = [], sorted_areas._masses
    monkeypatch.setattr(sorted_areas, "_masses", lambda *a: seen.append(masses(*a)) or seen[-1])
    directions = np.array(distances.random_directions(4, 2, seed))
    got = {(r["direction"], r["weight"]): r["w1"] for r in sorted_areas.areas(df, [F.col("x1"), F.col("x2")], [F.lit(1.0), *halves], directions).collect()}
    assert max(t.num_rows * t.num_columns for t in seen) <= 1.5 * 16 * 256 and len(seen) > 4
    for d, u in enumerate(directions):
        for j, side in enumerate((y, (cut[:, 0] < 0.5).astype(int), (cut[:, 1] < 0.5).astype(int))):
            assert got[d, j] == pytest.approx(plain_w1(x @ u, side, np.ones(n)), rel=1e-9)


def test_floors_of_kept_rows_equal_those_of_ranked_ones_where_keys_repeat(spark, monkeypatch):
    from weftline.functions.expressions import hash_key
    from weftline.operators import blocks, sampling

    for few in (1, 20_000):
        monkeypatch.setattr(sampling, "FEW", few)
        _, df = sample(spark, 900)
        df = df.unionByName(df.where("x2 > 0"))
        packed = blocks.pack_typed(df.select(*[F.unhex(hash_key(s, F.col("row_id"))).alias(s) for s in "ab"]))
        want = sampling.hash_cuts(df, ["a", "b"], (1, 500, 1_200))
        got = distances._kept_cuts(packed, lambda b: blocks.unpack_typed(b, [np.uint64] * 2), 2, (1, 500, 1_200))
        assert [[(f"{h:016x}", s) for h, s in c] for c in got] == [[(h[:16], s) for h, s in c] for c in want]
        with pytest.raises(ValueError):
            distances._kept_cuts(packed, lambda b: blocks.unpack_typed(b, [np.uint64] * 2), 2, (df.count() + 1,))
