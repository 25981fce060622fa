"""Helpers shared by the operators: tables, shared storage, byte views of Arrow text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that one vectorised step works on at most (a longer document is one step).
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of our own, but only without a cluster."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="factorloom-")
        atexit.register(shutil.rmtree, where, True)
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _stored(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that an operator can carry any of them without a clash of names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def schema_of(first: str, kind: DataType, rest: str) -> StructType:
    """A column of any type, and the columns of a DDL string."""
    return StructType([StructField(first, kind), *StructType.fromDDL(rest).fields])


def texts(docs: DataFrame, id_col: str, text_col: str, carry: Column | None, *more: Column) -> tuple[DataFrame, str]:
    """What an operator reads: the id as doc_id and the text, or only `carry` as row, which holds the text; and the name of the first.

    Spark bounds Arrow batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), and operators work on them in steps.
    """
    if carry is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more), "doc_id"
    return docs.select(carry.alias("row"), *more), "row"


def text_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The text column of a batch of `texts`."""
    return batch.column(1) if batch.schema.names[0] == "doc_id" else batch.column(0).field(text_col)


def merged(batches: Iterator[pa.RecordBatch], limit: int, at: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches joined until column `at` holds about limit bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of STEP_BYTES or one row at most, so that what is made of them stays small however many rows Spark sends at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * STEP_BYTES // max(1, batch.nbytes))
        for a in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(a, rows)


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """f over the (sliced) batches of a task, or one group; the worker then gives freed memory back to the system, as it may stay idle beside others."""

    def run(x):  # noqa: ANN001, ANN202
        try:
            yield from f(sliced(x))
        finally:
            release()

    def once(x):  # noqa: ANN001, ANN202
        try:
            return f(x)
        finally:
            release()

    return run if inspect.isgeneratorfunction(f) else once


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The files outlive a lost executor, so nothing upstream is computed again. They go with the driver, or by `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = _stored(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of `materialize` that nothing reads any more."""
    files, at = _stored(df.sparkSession, df.stored_at)
    files.delete(at, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, kind)
    at = at.astype(np.int64)
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each; a row beyond it stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
