"""Every registered query against its SQL, on the smallest tables; the rest for their defined results."""

import duckdb
import pytest

from compare import TABLES, digest
from tests.conftest import SF
from weftline.plans.queries import QUERIES
from weftline.plans.sql import ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = digest(df.columns, [tuple(r) for r in df.collect()]), digest(columns, cur.fetchall())
    assert got[1] == want[1]


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_unfolding_runs_on_all_dimensions(spark):
    got = QUERIES["ibu_full"](spark, SF).collect()
    assert len({(r["dim"], r["metric"]) for r in got}) == len(got) == 12 and all(r["after"] >= 0 for r in got)


def test_poisoned_truth_changes_nothing(spark):
    assert QUERIES["leakage_check"](spark, SF).first()[0] == 0


def test_tilt_meets_its_targets(spark):
    for r in QUERIES["tilt_fit"](spark, SF).collect():
        assert abs(r["tilted"] - r["mean"]) < 1e-5


@pytest.mark.parametrize("name", ["density_ratio", "iter_reweight", "adversarial_weights", "wasserstein_weights"])
def test_reweighting_gives_finite_distances(spark, name):
    for r in QUERIES[name](spark, SF).collect():
        assert 0 <= r["w1"] < 2


@pytest.mark.parametrize("name, dims", [("batched_weights", ("z1", "x1")), ("network_weights", ("x1",))])
def test_learned_weights_bring_tilted_samples_together(spark, name, dims):
    got = {r["dim"]: r for r in QUERIES[name](spark, SF).collect()}
    assert set(got) == {"x1", "x2", "z1", "z2"}
    for d in dims:
        assert got[d]["after"] < 0.6 * got[d]["before"]


def test_diagnostics_of_the_exact_tilt(spark):
    got = {(r["diagnostic"], r["level"], r["quantity"]): r["value"] for r in QUERIES["ceiling_diagnostics"](spark, SF).collect()}
    assert got["floor", "detector", "signal"] > 0.05 and got["audit", "detector", "removed"] > 0.7
    assert got["oracle", "particle", "w1 z1 oracle"] < 0.5 * got["oracle", "particle", "w1 z1 unit"]
    assert got["criterion", "detector", "candidate"] < 0.3 * got["criterion", "detector", "unweighted"]


def test_nothing_is_found_where_nothing_is(spark):
    got = QUERIES["null_responses"](spark, SF).collect()
    assert len(got) == 4 and all(abs(r["nats"]) < 0.05 for r in got)


def test_the_grid_has_its_components(spark):
    got = {r["variable"]: r for r in QUERIES["grid_summary"](spark, SF).collect()}
    assert set(got) == {"z1", "z2"} and all(r["interaction"] >= 0 and r["sd_total"] >= 0 for r in got.values())


def test_edges_of_all_variables_ascend(spark):
    rows = QUERIES["edge_search"](spark, SF).collect()
    for name in ("quantity", "price"):
        edges = [r["edge"] for r in sorted((r for r in rows if r["variable"] == name), key=lambda r: r["bin"])]
        assert len(edges) > 3 and all(a < b for a, b in zip(edges, edges[1:]))


def test_floors_are_below_a_real_distance_and_above_zero(spark):
    for r in QUERIES["distance_floors"](spark, SF).collect():
        assert 0 < r["floor"] < 0.2 and r["before"] > 0 and r["after"] > 0


def test_training_records_every_epoch(spark):
    got = QUERIES["training_history"](spark, SF).orderBy("epoch").collect()
    assert [r["epoch"] for r in got] == [1, 2, 3]
    assert all(r["generator_loss"] == -r["critic_loss"] and 0 < r["validation_loss"] < 2 for r in got)


def test_stream_counts_every_event_of_one_file_or_many(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(100).write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for r in QUERIES["window_histogram"](spark, SF).collect():
        want[r["event_type"], r["bin"]] = want.get((r["event_type"], r["bin"]), 0) + r["n"]
    for folder in (SF, str(tmp_path)):
        got = {(r["event_type"], r["bin"]): r["n"] for r in QUERIES["stream_histogram"](spark, folder).collect()}
        assert got == want and sum(got.values()) == table.count()


def test_sweep_needs_no_row_for_each_strength(spark, monkeypatch):
    from weftline.operators import distances

    monkeypatch.setattr(distances, "wasserstein", None)  # it takes one row an event and strength
    got = {r["s"]: r["w1"] for r in QUERIES["sweep_response"](spark, SF).collect()}
    assert len(got) == 25 and got[0.0] >= 0 and got[1.0] > 0
