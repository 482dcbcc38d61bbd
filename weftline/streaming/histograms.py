"""Mergeable histograms of an event stream by time window and bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 64) -> DataFrame:
    """A stream of a Parquet table of a folder: one file, or a folder of part files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # as a glob, so that a single file may be streamed too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def windowed_histogram(events: DataFrame, lo: float, hi: float, bins: int, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """window_start, event_type, bin, n, total of value: partial sums that later rows of a window add to.

    Values outside [lo, hi) go to the end bins. Rows later than the watermark are dropped by the stream.
    """
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - lo) / (hi - lo) * bins).cast("int")))
    sums = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type", bin_.alias("bin"))
    return sums.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "bin", "n", "total")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Everything there is now, open windows included; restarts go on from the checkpoint.

    Each batch writes the windows that it changed in full, so a repeated batch
    overwrites itself; the latest batch of a window counts.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/part-{batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{out}/part-*")
    last = F.max(F.struct("batch", "n", "total")).alias("m")
    return rows.groupBy("window_start", "event_type", "bin").agg(last).select("window_start", "event_type", "bin", "m.n", "m.total")


def merge(*parts: DataFrame) -> DataFrame:
    """One histogram of several: counts and totals add."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("window_start", "event_type", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
