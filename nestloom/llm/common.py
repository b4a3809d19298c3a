"""Shared folder, written intermediate tables and small column helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete, made, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder for files that workers write; it exists even if none of them writes any."""
    path = new_folder(spark, tag)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return path


@contextlib.contextmanager
def dropping(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """keep(df, tag) writes df; at the end of the block all other folders that were made in it are deleted. What leaves the
    block must have been kept."""
    first, kept = len(made), []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = written(df, tag)
        kept.append(made[-1])
        return out

    yield keep
    for one in made[first:]:
        if one not in kept:
            delete(*one)
    made[first:] = kept


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Rows and characters of texts that a join may broadcast; beyond them both sides are shuffled.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 32 << 20


def small_side(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcasting if it has at most BROADCAST_ROWS rows and its texts, byte strings and arrays
    at most BROADCAST_CHARS characters, bytes and 8-byte elements altogether."""
    wide = [F.coalesce(F.length(c) if kind in ("string", "binary") else F.size(c) * 8, F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith("array")]
    rows, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(reduce(lambda a, b: a + b, wide, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else df


#: Rows of an Arrow batch of whole texts; Spark's own number would hold tens of MB in the executor and again in its worker.
TEXT_BATCH, _OWN_BATCH, _BATCH_KEY = "1000", "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes after which a batch ends sooner, so that very long texts don't gather in one.
TEXT_BYTES, _OWN_BYTES, _BYTES_KEY = "4194304b", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to TEXT_BATCH rows and TEXT_BYTES unless they were set to others than Spark's own."""
    for key, own, new in ((_BATCH_KEY, _OWN_BATCH, TEXT_BATCH), (_BYTES_KEY, _OWN_BYTES, TEXT_BYTES)):
        if spark.conf.get(key) == own:
            spark.conf.set(key, new)


#: Bytes of texts after whose handling a worker gives freed memory back.
GIVE_BACK = 16 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_handled = 0


def give_back(handled: int = GIVE_BACK) -> None:
    """Called by a worker that has handled so many bytes: now and then its freed memory goes back to the system. Workers
    are used again by later stages, and what they kept would be missing there."""
    global _handled
    _handled += handled
    if _handled >= GIVE_BACK:
        _handled = 0
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


_held: dict[str, Callable[[], None]] = {}


def holds(owner: str, forget: Callable[[], None]) -> None:
    """Called by a module whose workers keep caches: forget empties them."""
    _held[owner] = forget


def make_room(owner: str) -> None:
    """Called by a worker at the start of a task: caches of other operators, whose stages this worker served before, go."""
    for other, forget in _held.items():
        if other != owner:
            forget()
    give_back()


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes a file of the shared folder from a worker: under a name of its own, then moved, so that a repeated or a
    lost task leaves whole files only. Works on any file system that pyarrow opens by its address."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    mine = f"{path}/_{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(mine) as out:
        out.write(data)
    try:
        system.move(mine, f"{path}/{name}")
    except OSError:
        if system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(mine)


def binary_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path, content of the files in a folder; none if there is none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds no: the place of each row in the order, from 0. Rows are sorted in ranges; a count for each range comes to
    the driver."""
    key = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key_", key), "sorted")
    rows = rows.withColumn("range_", F.shiftright("key_", 33))
    first, total = [], 0
    for r in sorted(rows.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).collect()):
        first.append((r.range_, total))
        total += r.n
    at = df.sparkSession.createDataFrame(first, "range_ bigint, before_ bigint")
    return rows.join(F.broadcast(at), "range_").withColumn("no", F.col("before_") + F.col("key_").bitwiseAND((1 << 33) - 1)).drop("range_", "before_", "key_")
