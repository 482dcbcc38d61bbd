"""Files and tables through Spark's own file systems: exclusive creation, and a store of tables named by their settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def create(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A file with ``text``; without ``replace`` only one of several creators succeeds, the others get FileExistsError."""
    fs, place = _at(spark, path)
    try:
        stream = fs.create(place, replace)
    except Py4JJavaError as e:
        if not replace and fs.exists(place):
            raise FileExistsError(path) from e
        raise
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()["value"]


def settings_name(settings: dict) -> str:
    """A digest of settings: key order and the last digits of floats don't matter."""

    def rounded(v):
        if isinstance(v, float):
            return float(f"{v:.12g}")
        if isinstance(v, dict):
            return {str(k): rounded(x) for k, x in v.items()}
        return [rounded(x) for x in v] if isinstance(v, list | tuple) else v

    return hashlib.sha256(json.dumps(rounded(settings), sort_keys=True).encode()).hexdigest()[:24]


def cached(spark: SparkSession, folder: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``settings`` describe: read back if a finished one is there, else built and written.

    The name of its folder is ``settings_name``. A table whose writing was broken
    off lacks its mark and is written again; ``settings.json`` beside it tells what
    it is.
    """
    at = f"{folder.rstrip('/')}/{settings_name(settings)}"
    if not exists(spark, f"{at}/table/_SUCCESS"):
        build().write.mode("overwrite").parquet(f"{at}/table")
        create(spark, f"{at}/settings.json", json.dumps(settings, sort_keys=True), replace=True)
    return spark.read.parquet(f"{at}/table")
