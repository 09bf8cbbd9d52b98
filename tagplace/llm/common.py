"""Shared plumbing of the text operators: shared-folder tables and Arrow passes that carry a row along."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes per Arrow batch: small, so that a batch of very long texts stays within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` and ``BATCH_BYTES`` where they are larger (never raise them)."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        told = spark.conf.get(key)
        if not told.isdigit() or not 0 < int(told) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only for a local master."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    told = tempfile.mkdtemp(prefix="tagplace-")
    spark.conf.set("spark.checkpoint.dir", told)
    return told


#: Paths made while a ``Scratch`` is open are also noted there.
_OPEN: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tagplace-{name}-{uuid.uuid4().hex}"
    there, fs = _on_disk(spark, path)
    fs.deleteOnExit(there)
    for paths in _OPEN:
        paths.append(path)
    return path


def _on_disk(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        there, fs = _on_disk(df.sparkSession, df._written_to)
        fs.delete(there, True)


class Scratch:
    """The tables that were written while it was open: ``with scratch: ...``; ``clear`` deletes them."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        _OPEN.append(self.paths)
        return self

    def __exit__(self, *what) -> None:
        _OPEN[:] = [paths for paths in _OPEN if paths is not self.paths]

    def clear(self, reader: DataFrame) -> None:
        """Delete these tables, but for those that ``reader`` still reads."""
        if not self.paths:
            return
        used = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in reader.inputFiles()}
        rest = [path for path in self.paths if path.rsplit("/", 1)[-1] in used]
        for path in self.paths:
            if path not in rest:
                there, fs = _on_disk(reader.sparkSession, path)
                fs.delete(there, True)
        self.paths[:] = rest


def trim() -> None:
    """Give freed memory back to the system: a worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def with_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict]]], new: str) -> DataFrame:
    """Append columns made by ``fn`` from Arrow batches; all other columns pass through untouched.

    ``new`` is a DDL string. An input column whose name (in any case) equals a new one is replaced.
    ``fn`` maps an iterator of batches to pairs (batch, {name: Arrow array}).
    """
    made = T.StructType.fromDDL(new)
    names = [f.name for f in made]
    taken = {x.lower() for x in names}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    schema = T.StructType(kept + list(made))
    keep = [f.name for f in kept]
    small_batches(df.sparkSession)

    def run(batches):
        for batch, more in fn(batches):
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in keep] + [more[x] for x in names], names=keep + names)
        trim()

    return df.mapInArrow(run, schema)


def sized(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of about ``limit`` bytes of ``column`` (a longer text is alone)."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= limit or at < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings; null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def held_out_crc(column, parts: int, at: int):
    """crc32 of an id's decimal text modulo ``parts`` equals ``at``; a null id is never held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(parts) == F.lit(at), F.lit(False))
