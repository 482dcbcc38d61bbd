"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id counts as ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine a default is set if none is."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/weftline-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage is cut by a table that outlives any executor, so later passes
    neither recompute it nor depend on one executor's disk.
    """
    path = f"{shared_dir(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way, deleted at the end of a ``with`` block; what leaves it must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/weftline/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back, as ``materialize`` does."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """``keep`` in buckets of ``key``, so that a later join or grouping by it doesn't shuffle the table."""
        self.tables.append(f"weftline_{uuid.uuid4().hex}")
        df.write.bucketBy(buckets, key).option("path", self.folder(name)).saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def folder(self, name: str) -> str:
        """A new path among them."""
        self.count += 1
        return f"{self.path}/{self.count}-{name}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_text(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list]], added: str) -> DataFrame:
    """``docs`` with the columns ``added`` (DDL), computed from its column ``text`` in Arrow batches.

    ``make`` runs once a task and returns a function from texts to one sequence
    per added column. The other columns pass through untouched, whatever their
    types and nulls; columns of ``docs`` named like added ones are replaced.
    """
    extra = T._parse_datatype_string(added)
    docs = docs.drop(*extra.names)
    at = docs.columns.index("text")
    names = [*docs.columns, *extra.names]
    kinds = [to_arrow_type(f.dataType) for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            got = compute(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, type=k) for x, k in zip(got, kinds))], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra.fields]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The fold of the numbers before each position (an exclusive scan from 0), for an associative ``op``.

    Growing an array by one element copies it, so arrays are folded in blocks of
    about the square root of their size.
    """
    zero = F.lit(0).cast(kind)

    def short(xs: Column, start: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    def blocks(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / w).cast("int"), F.lit(0))), lambda i: F.slice(v, i * w + 1, w)))

    def folded(bs: Column) -> Column:
        starts = short(F.transform(bs, lambda b: F.aggregate(b, zero, op)), zero)
        return F.flatten(F.zip_with(bs, starts, short))

    return let(let(values, blocks), folded)
