"""Exact signed ranks and intervals."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import binning, experiments


@pytest.mark.parametrize("n", [1, 2, 5, 9, 12])
def test_distribution_equals_enumeration(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    p = experiments.rank_sum_distribution(n)
    assert len(p) == n * (n + 1) // 2 + 1
    for w, v in enumerate(p):
        assert v == pytest.approx(sums.count(w) / 2**n)


def test_p_is_exact_for_few_pairs_and_normal_with_ties(spark):
    values = [0.5, -1.5, 2.5, 3.5, -0.25, 4.75, 6.0]
    got = experiments.signed_rank(spark.createDataFrame([(i, v, 0.0) for i, v in enumerate(values)], "seed int, a double, b double")).first()
    ranks = {v: r for r, v in enumerate(sorted(values, key=abs), 1)}
    least = min(sum(r for v, r in ranks.items() if v > 0), sum(r for v, r in ranks.items() if v < 0))
    sums = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    assert got["p"] == pytest.approx(2 * sum(s <= least for s in sums) / 2**7)
    tied = experiments.signed_rank(spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate((1, 1, -1, 2, 3))], "seed int, a double, b double")).first()
    assert tied["p"] == pytest.approx(math.erfc(abs(tied["z"]) / math.sqrt(2)))
    none = experiments.signed_rank(spark.createDataFrame([(1, 2.0, 2.0)], "seed int, a double, b double")).first()
    assert none["n"] == 0 and none["p"] is None


def test_ranks_of_many_differences_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(binning, "STRETCH", 50)
    rows = [(i, float((i * 7919) % 1009) / 7, 60.0) for i in range(1500)]
    got = experiments.signed_rank(spark.createDataFrame(rows, "seed int, a double, b double")).first()
    d = sorted((round(a - b, 12) for _, a, b in rows if a != b), key=abs)
    plus = minus = i = 0
    while i < len(d):
        j = i
        while j < len(d) and abs(d[j]) == abs(d[i]):
            j += 1
        rank = (i + 1 + j) / 2
        plus += rank * sum(v > 0 for v in d[i:j])
        minus += rank * sum(v < 0 for v in d[i:j])
        i = j
    assert (got["n"], got["w_plus"], got["w_minus"]) == (len(d), plus, minus)


def test_quantiles_of_one_and_two_degrees_of_freedom():
    for share in (0.6, 0.9, 0.975, 0.999):
        assert experiments.t_quantile(share, 1) == pytest.approx(math.tan(math.pi * (share - 0.5)), rel=1e-8)
        a = 4 * share * (1 - share)
        assert experiments.t_quantile(share, 2) == pytest.approx(2 * (share - 0.5) * math.sqrt(2 / a), rel=1e-8)
        assert experiments.t_quantile(1 - share, 2) == -experiments.t_quantile(share, 2)
    assert experiments.t_quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-4)
    with pytest.raises(ValueError):
        experiments.t_quantile(1.0, 3)


def test_interval_of_a_mean(spark):
    runs = spark.createDataFrame([("a", i, v) for i, v in enumerate((1.0, 2.0, 4.0))] + [("b", 0, 5.0)], "arm string, seed int, value double")
    got = {r["arm"]: r for r in experiments.with_interval(experiments.arm_summary(runs)).collect()}
    a = got["a"]
    assert a["high"] - a["mean"] == pytest.approx(4.302653 * a["se"], rel=1e-6) and a["mean"] - a["low"] == pytest.approx(a["high"] - a["mean"])
    assert got["b"]["low"] is None
    assert runs.where(F.lit(False)).count() == 0
