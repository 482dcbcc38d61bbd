"""Run directories as tables: JSON configs and metrics, logs, grids of cells."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import sampling
from weftline.sources import gaussian, store


def load_records(spark: SparkSession, root: str) -> DataFrame:
    """run, config, metrics (JSON strings) of every child of ``root`` that has both files.

    Children with one of the two are left out; ``incomplete_runs`` names them. None complete is an error.
    """
    files = spark.read.text([f"{root}/*/config.json", f"{root}/*/metrics.json"], wholetext=True).select(
        F.regexp_extract(F.input_file_name(), "([^/]+)/([^/]+)\\.json$", 1).alias("run"),
        F.regexp_extract(F.input_file_name(), "([^/]+)/([^/]+)\\.json$", 2).alias("kind"),
        "value",
    )
    config = files.where("kind = 'config'").select("run", F.col("value").alias("config"))
    metrics = files.where("kind = 'metrics'").select("run", F.col("value").alias("metrics"))
    out = config.join(metrics, "run")
    if not out.limit(1).count():
        raise FileNotFoundError(f"no complete run under {root}")
    return out


def incomplete_runs(spark: SparkSession, root: str) -> DataFrame:
    """run, missing: children of ``root`` with only one of config.json and metrics.json."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{config,metrics}.json").load(f"{root}/*").select("path")
    named = files.select(F.regexp_extract("path", "([^/]+)/([^/]+)\\.json$", 1).alias("run"), F.regexp_extract("path", "([^/]+)/([^/]+)\\.json$", 2).alias("kind"))
    kinds = named.groupBy("run").agg(F.collect_set("kind").alias("kinds"))  # at most two a run
    return kinds.where(F.size("kinds") == 1).select("run", F.when(F.array_contains("kinds", "config"), "metrics").otherwise("config").alias("missing"))


def rebuilt(spark: SparkSession, config: str) -> DataFrame:
    """The split population of a run from its config (JSON: n, seed, split_seed, gaussian settings): the rows it was trained on."""
    c = json.loads(config)
    missing = [k for k in ("n", "seed", "split_seed") if k not in c]
    if missing:
        raise ValueError(f"the config lacks {missing}")
    return sampling.split(gaussian.generate(spark, int(c["n"]), gaussian.parse_settings(config), int(c["seed"])), c["split_seed"])


def config_keys(records: DataFrame) -> DataFrame:
    """run, key, value (as JSON text) of the configs' top-level entries."""
    entries = F.from_json("config", "map<string,string>")
    return records.select("run", F.explode(entries).alias("key", "value"))


def varying_keys(entries: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Keys whose values differ across runs (a run without the key counts as a value)."""
    runs = entries.select("run").distinct()
    keys = entries.select("key").distinct().where(~F.col("key").isin(*ignored) if ignored else F.lit(True))
    n = runs.count()
    seen = entries.groupBy("key").agg(F.countDistinct("value").alias("values"), F.countDistinct("run").alias("runs"))
    return keys.join(seen, "key").where((F.col("values") > 1) | (F.col("runs") < n)).select("key")


def arm_labels(entries: DataFrame, varying: DataFrame) -> DataFrame:
    """run, arm: ``key=value`` of the varying keys in order, or ``baseline``."""
    runs = entries.select("run").distinct()
    named = entries.join(varying, "key").groupBy("run").agg(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))).alias("parts"))
    return runs.join(named, "run", "left").select("run", F.when(F.size("parts") > 0, F.array_join("parts", ",")).otherwise("baseline").alias("arm"))


def read_summary_log(spark: SparkSession, path: str) -> DataFrame:
    """seed, mean_improvement from lines ``SUMMARY seed=.. mean_improvement=..``."""
    lines = spark.read.text(path).where(F.col("value").startswith("SUMMARY"))
    pairs = F.str_to_map(F.regexp_replace("value", "^SUMMARY\\s+", ""), F.lit("\\s+"), F.lit("="))
    return lines.select(pairs["seed"].cast("long").alias("seed"), pairs["mean_improvement"].cast("double").alias("mean_improvement"))


def freeze_design(spark: SparkSession, path: str, design: dict, force: bool = False) -> None:
    """Write a design once; with ``force`` again, but never after cells have been run.

    Of several creators one wins, in any file system that Spark reaches.
    """
    if store.exists(spark, f"{path}/cells"):
        raise FileExistsError("cells exist: the design can't change")
    store.create(spark, f"{path}/design.json", json.dumps(design, indent=2, sort_keys=True), replace=force)


def load_design(spark: SparkSession, path: str) -> dict:
    return json.loads(store.read_text(spark, f"{path}/design.json"))


def write_cells(cells: DataFrame, path: str, settings: dict | None = None) -> None:
    """Append cells, one folder per (b, s), with the settings they were trained under."""
    text = F.lit(json.dumps(settings, sort_keys=True) if settings is not None else None).cast("string")
    cells.withColumn("settings", text).write.mode("append").partitionBy("b", "s").parquet(f"{path}/cells")


#: Settings that every cell has to itself.
OWN_SETTINGS = ("b", "s", "cell", "seed", "split_seed", "seconds")


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of a frozen design; gaps, sizes that disagree and settings that disagree are errors."""
    design = load_design(spark, path)
    cells = spark.read.parquet(f"{path}/cells")
    sizes = cells.groupBy("b", "s").agg(F.count("*").alias("n"), F.min("settings").alias("settings"), F.countDistinct("settings").alias("kinds"))
    found = sizes.collect()  # one row a cell
    have = {(r["b"], r["s"]) for r in found}
    missing = [(b, s) for b in range(design["n_bootstrap"]) for s in range(design["n_seeds"]) if (b, s) not in have]
    if missing:
        raise ValueError(f"missing cells: {missing}")
    if len({r["n"] for r in found}) != 1:
        raise ValueError("cells of different sizes")
    told = {(r["b"], r["s"]): json.loads(r["settings"]) for r in found if r["settings"]}
    for key in sorted({k for x in told.values() for k in x} - set(OWN_SETTINGS)):
        values = {json.dumps(x.get(key)) for x in told.values()}
        if len(values) > 1:
            raise ValueError(f"cells disagree on {key}: {sorted(values)}")
    if any(r["kinds"] > 1 for r in found) or 0 < len(told) < len(found):
        raise ValueError("cells disagree on their settings")
    return cells.drop("settings")


def read_history(spark: SparkSession, run: str) -> DataFrame:
    """The epochs of a run folder, in order; a run without any is an error that names it."""
    try:
        return spark.read.parquet(f"{run}/history").orderBy("epoch")
    except AnalysisException as e:
        raise FileNotFoundError(f"{run} has no history") from e


def read_weights(spark: SparkSession, run: str, epoch: int | None = None) -> DataFrame:
    """row_id, w of a run folder, of one epoch where the weights have several."""
    try:
        out = spark.read.parquet(f"{run}/weights")
    except AnalysisException as e:
        raise FileNotFoundError(f"{run} has no weights") from e
    if "epoch" in out.columns:
        if epoch is None:
            raise ValueError("the weights have several epochs: name one")
        out = out.where(F.col("epoch") == epoch)
    return out.select("row_id", "w")


def json_or_none(spark: SparkSession, path: str) -> dict | None:
    """A JSON file's content, None where there is none."""
    return json.loads(store.read_text(spark, path)) if store.exists(spark, path) else None


def evaluate_runs(spark: SparkSession, root: str, evaluate: Callable[[str, dict], dict[str, float]]) -> DataFrame:
    """run, metric, value, error: ``evaluate(run, config)`` of every run under ``root``, one task a run.

    ``evaluate`` runs in the tasks on a run's name and its parsed config. A run
    whose config can't be read or whose evaluation fails becomes one row with the
    error and no metric; the others aren't touched by it.
    """
    configs = spark.read.text(f"{root.rstrip('/')}/*/config.json", wholetext=True).select(
        F.regexp_extract(F.input_file_name(), "([^/]+)/config\\.json$", 1).alias("run"), F.col("value").alias("config")
    )

    def one(run: str, config: str) -> list[tuple]:
        try:
            return [(run, k, float(v), None) for k, v in sorted(evaluate(run, json.loads(config)).items())]
        except Exception as e:  # a broken run is a row of the result
            return [(run, None, None, f"{type(e).__name__}: {e}")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for run, config in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in one(run, config)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.float64(), pa.string()))], names=["run", "metric", "value", "error"])

    return configs.repartition("run").mapInArrow(each, "run string, metric string, value double, error string")


def write_run(tables: dict[str, DataFrame], config: dict, origins: dict, path: str) -> None:
    """One Parquet table per entry and the config with the origin of each value; an existing run is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        text = json.dumps({**config, "_origin": origins}, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/config")


def metrics_json(metrics: DataFrame, path: str) -> None:
    """Long metric rows as JSON lines."""
    metrics.write.mode("errorifexists").json(path)
