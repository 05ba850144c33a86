"""Shared plumbing: Arrow text buffers, scratch tables on shared storage, column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that a Python worker takes at once; bounds its memory.
ARROW_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ARROW_ROWS rows at most.

    Spark reads the setting when a plan runs, so it can't be put back before the caller's action.  Its own bound, by
    bytes, lets an executor's buffers of whole texts grow too large beside a Parquet writer's.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ARROW_ROWS rows, whatever the session's setting: what is made of a part at once stays small."""
    for batch in batches:
        for i in range(0, max(batch.num_rows, 1), ARROW_ROWS):
            yield batch.slice(i, ARROW_ROWS)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir, or on a local master a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/weirflow-scratch"
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_open: list[list[Scratch]] = []


@contextmanager
def released() -> Iterator[None]:
    """Removes, at its end, the tables of every Scratch that began within it; what is still wanted must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.clear()


class Scratch:
    """Tables written to shared storage; a lost executor costs no recomputation beyond them.

    ``drop`` removes those that later steps no longer read; the rest go at the end of ``released``, or when the
    driver's Python ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []
        if _open:
            _open[-1].append(self)
        atexit.register(self.clear)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/weirflow/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weirflow_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = df._weirflow_path
        _delete(self.spark, path)
        self.paths.remove(path)

    def clear(self) -> None:
        atexit.unregister(self.clear)
        for path in self.paths:
            try:
                _delete(self.spark, path)
            except Exception:  # the session has ended before
                break
        self.paths = []


#: Ids of 64 bits that are broadcast at most.
BROADCAST_IDS = 1 << 20


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long ``column`` is one of ``ids`` (written, one column of that name); so many at most are broadcast."""
    return df.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, column, "left_semi")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of an Arrow string or binary column, or a slice of one; a null has length zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at -= at[0]
    start, end = at[:-1], at[1:].copy()
    if column.null_count:
        null = np.asarray(column.is_null())
        end[null] = start[null]
    return held, start, end


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of the frame's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
