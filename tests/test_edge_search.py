"""Edges of all variables from an index of counts."""

import numpy as np
import pytest

from weftline.operators import ibu


def plain_edges(t, r, threshold):
    """The search by a loop over all events for every candidate."""
    lo, hi = t.min(), t.max()
    edges = [lo]
    while len(edges) <= ibu.MOST_BINS:
        lo = edges[-1]
        for c in ibu.candidates(lo, hi):
            below = ((t >= lo) & (t < c)).sum()
            both = ((t >= lo) & (r >= lo) & (np.maximum(t, r) < c)).sum()
            if below and both / below > threshold:
                break
        else:
            return edges
        if c <= lo:
            return edges
        edges.append(float(c))
    return edges


def table(spark, n=4_000, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.gamma(2.0, 2.0, n)
    b = np.round(rng.normal(size=n) * 10, 1)
    rows = [(float(x), float(x * (1 + 0.15 * e)), float(y), float(y + s)) for x, e, y, s in zip(a, rng.normal(size=n), b, rng.normal(size=n))]
    return rows, spark.createDataFrame(rows, "z1 double, x1 double, z2 double, x2 double").repartition(3)


@pytest.mark.parametrize("cells", [1024, 32])
def test_edges_equal_a_plain_search_in_few_scans(spark, monkeypatch, cells):
    monkeypatch.setattr(ibu, "CELLS", cells)
    rows, df = table(spark)
    scans, original = [], ibu.exact_purities
    monkeypatch.setattr(ibu, "exact_purities", lambda *a: scans.append(len(a[2])) or original(*a))
    pairs = {"a": ("z1", "x1"), "b": ("z2", "x2")}
    for threshold in (ibu.PURITY, 0.6):
        got = ibu.purity_edges_all(df, pairs, threshold)
        want = {"a": plain_edges(*np.array(rows)[:, :2].T, threshold), "b": plain_edges(*np.array(rows)[:, 2:].T, threshold)}
        assert got == want and all(len(x) > 4 for x in want.values())
        if cells == 1024:
            assert len(scans) <= 8 < sum(len(x) for x in want.values()) / 3
        scans.clear()


def test_no_values_constant_values_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 1.0), (1.0, None, None, 2.0)], "a double, b double, c double, d double")
    assert ibu.purity_edges_all(df, {"same": ("a", "b"), "none": ("c", "d")}) == {"same": [1.0], "none": []}
    rows, df = table(spark, 500)
    with_null = df.unionByName(spark.createDataFrame([(None, 2.0, 3.0, None)], "z1 double, x1 double, z2 double, x2 double"))
    t, r = (np.append(np.array(rows)[:, i], v) for i, v in ((2, 3.0), (3, np.nan)))
    assert ibu.purity_edges_all(with_null, {"b": ("z2", "x2")})["b"] == plain_edges(t, np.where(np.isnan(r), -1e9, r), ibu.PURITY)
