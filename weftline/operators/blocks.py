"""Rows packed into blocks of numbers, for operators that pass over the same rows many times.

A block holds many rows as a few byte strings, so that a pass moves and reads it
as a whole instead of value by value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task looks at together.
BLOCK = 1 << 16
#: Rows of a block of columns: a few hundred kilobytes, so that the JVM needn't give each a region of its own.
COLUMN_BLOCK = 1 << 13


def joined(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.Table]:
    """The rows in tables of about ``rows``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def matrices(table: pa.Table) -> list[np.ndarray]:
    """One matrix (row, place) for each column of arrays of numbers, all of one length in a column."""
    out = []
    for i in range(table.num_columns):
        c = table.column(i).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        out.append(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1))
    return out


def pack(df: DataFrame, ordered: bool = False) -> DataFrame:
    """rows, and each column of ``df`` (arrays of doubles, of one length in a column) as bytes: about ``BLOCK`` rows in one.

    With ``ordered`` the rows of a block are in order of the first column.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in joined(batches):
            found = matrices(table)
            if ordered:
                order = np.lexsort(found[0].T[::-1])
                found = [m[order] for m in found]
            parts = [pa.array([np.ascontiguousarray(m, float).tobytes()], pa.binary()) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64()), *parts], names=["rows", *table.column_names])

    return df.mapInArrow(task, ", ".join(["rows long", *[f"{c} binary" for c in df.columns]]))


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The matrices of every block of ``pack``."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column(0)[i].as_py()
            yield [np.frombuffer(batch.column(j)[i].as_buffer()).reshape(rows, -1) for j in range(1, batch.num_columns)]


def pack_columns(df: DataFrame) -> DataFrame:
    """rows, and v: the columns of ``df`` as bytes, one after the other, at most ``COLUMN_BLOCK`` rows in one; a null becomes NaN.

    The first column holds small whole numbers and no null; the rows of a block are in its order.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in joined(batches):
            for i in range(0, table.num_rows, COLUMN_BLOCK):
                found = np.vstack([c.to_numpy() for c in table.slice(i, COLUMN_BLOCK).columns])
                found = found[:, np.argsort(found[0].astype(np.int16), kind="stable")]
                yield pa.RecordBatch.from_arrays([pa.array([found.shape[1]], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["rows", "v"])

    return df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).mapInArrow(task, "rows long, v binary")


def unpack_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The matrix (column, row) of every block of ``pack_columns``."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield np.frombuffer(batch.column(1)[i].as_buffer()).reshape(-1, batch.column(0)[i].as_py())


def pack_typed(df: DataFrame) -> DataFrame:
    """rows, and each column of ``df`` as bytes in its own type, at most ``COLUMN_BLOCK`` rows in one; of a hash (bytes) the first 64 bits.

    No column holds a null.
    """

    def numbers(c: pa.Array) -> np.ndarray:
        return _leading(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in joined(batches):
            found = [numbers(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)) for c in table.columns]
            for i in range(0, table.num_rows, COLUMN_BLOCK):
                parts = [c[i : i + COLUMN_BLOCK] for c in found]
                yield pa.RecordBatch.from_arrays([pa.array([len(parts[0])], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in parts]], names=["rows", *table.column_names])

    return df.mapInArrow(task, ", ".join(["rows long", *[f"{c} binary" for c in df.columns]]))


def _leading(c: pa.Array) -> np.ndarray:
    """The first 64 bits of byte strings of one length."""
    size = len(c[0].as_buffer()) if len(c) else 8
    start = int(np.frombuffer(c.buffers()[1], np.int32)[c.offset]) if len(c) else 0
    data = np.frombuffer(c.buffers()[2], np.uint8)[start : start + size * len(c)].reshape(len(c), size)
    return np.ascontiguousarray(data[:, :8]).view(">u8").ravel().astype(np.uint64)


def unpack_typed(batches: Iterator[pa.RecordBatch], types: list[type], rows: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """The columns of ``pack_typed``, about ``rows`` rows at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        for i in range(batch.num_rows):
            held.append([np.frombuffer(batch.column(j + 1)[i].as_buffer(), t) for j, t in enumerate(types)])
            if sum(len(h[0]) for h in held) >= rows:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held)]
