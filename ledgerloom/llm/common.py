"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; longer texts make a pass of their own.
PASS_BYTES = 1 << 20
#: Bytes of input for which an intermediate table of narrow rows gets a file.
FILE_BYTES = 64 << 20
#: Bytes of an Arrow batch between Spark and Python; a longer row makes a batch of its own.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the session runs in one process (as
    in tests) is a temporary folder made for it; elsewhere its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return made.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    gone_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def gone_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the folder deleted when the driver ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)  # only what is there can be marked
    store.deleteOnExit(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what is needed until the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder, without its lineage."""
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        gone_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return frame.checkpoint(eager=True)


def few_files(source: DataFrame) -> int:
    """Files for a table with a narrow row for each row of ``source``: one for each core or each ``FILE_BYTES`` read, not more than a shuffle has partitions."""
    spark = source.sparkSession
    read = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(most, read // FILE_BYTES))


def cut_narrow(frame: DataFrame, files: int, heavy: bool = False) -> DataFrame:
    """``cut`` of narrow rows into ``files`` files at most.

    On a local file system without Hadoop's native library the JVM starts two ``chmod`` processes for each file that it makes, and
    each shares all of the JVM's memory until it runs: who then adds up the processes counts the executor twice.
    ``heavy``: what makes the rows keeps all of its tasks and a shuffle brings them together.
    """
    return cut(frame.repartition(files) if heavy else frame.coalesce(files))


def bounded(frame: DataFrame) -> DataFrame:
    """The frame; Arrow batches of its session are bounded by bytes, so that a batch of long texts stays small."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame


def doc_bucket(column: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``; null ids count as bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % buckets, F.lit(0))


def text_of(frame: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` and the text (null: empty), and no other column."""
    return bounded(frame).select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))


def packed(frame: DataFrame, *more, text: str = "text") -> DataFrame:
    """Each row as a struct ``row`` of all its columns, then ``more`` and the text (null: empty)."""
    return bounded(frame).select(F.struct("*").alias("row"), *more, F.coalesce(F.col(text), F.lit("")).alias("text"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows (nulls are empty)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch, parts of bounded text: the rows, their bytes and their offsets from 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = byte_view(batch.column(batch.schema.get_field_index(column)))
        for first, last in passes(offsets, limit):
            own = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[own[0] : own[-1]], own - own[0]
