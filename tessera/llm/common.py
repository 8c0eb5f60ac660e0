"""What the corpus operators share: shared-folder tables, size-checked joins, samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when it has been counted and is not larger than this.
BROADCAST_BYTES = 48 << 20
#: Python workers take a batch of texts in slices of at most so many bytes and rows.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 4_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_folders: dict[str, str] = {}
_kept: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, with its file system named.

    Where that is unset, a session on this machine alone gets a temporary folder
    of its own; on a cluster there is none that all could read, which is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = _own_folders.setdefault(context.applicationId, "")
        path = _own_folders[context.applicationId] = path or "file://" + tempfile.mkdtemp(prefix="tessera-")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(name: str, make):
    """What ``make`` gave a worker under this name before, if nothing else was asked for since.

    A worker serves many tasks of many stages, one after the other; it remembers
    the tables of one operator at a time, so they do not add up.
    """
    if name not in _kept:
        if _kept:
            _kept.clear()
            returned()
        _kept[name] = make()
    return _kept[name]


def returned() -> None:
    """Gives freed memory of a worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def only(name: str) -> None:
    """From here on a worker serves this operator: what others have left in it goes."""
    kept(name, lambda: None)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts, and where in them each begins and the last ends; nothing is copied, and a null is empty."""
    _, at, data = column.buffers()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    at = np.frombuffer(at, np.int64 if wide else np.int32) if at is not None else np.zeros(1, np.int64)
    return np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8), at[column.offset : column.offset + len(column) + 1].astype(np.int64)


def rows_by_bytes(at: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``block`` bytes together, one at least: first row and row behind."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + block, "right")) - 1)
        yield first, last
        first = last


def sliced(batch: pa.RecordBatch, text: int, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """All of a batch in slices whose texts (column ``text``) have about ``most_bytes`` bytes, one text at least."""
    column, at, n = batch.column(text), 0, len(batch)
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    while at < n:
        end, size = at, 0
        while end < n and end - at < most_rows and (end == at or size + sizes[end] <= most_bytes):
            size += int(sizes[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there.

    A lost executor costs the tasks it ran, not the stages before the table.
    While it is written, batches for Python workers are bounded in bytes: texts
    and lists differ so much in size that a bound in rows alone bounds nothing.
    """
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(SLICE_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little
    to do may not do for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def cleared(spark: SparkSession) -> None:
    """``release``, then executors collect their garbage and give what their heaps have left over back to the system.

    A heap that grew for one operator stays as large for all after it, so over
    many operators each executor comes to hold all it may, nearly all of it
    garbage, beside its Python workers and native memory.  There is a task for
    each core, dealt out to the executors in turn; one that gets none only
    keeps its heap.
    """
    release(spark)
    cores = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def chosen(docs: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, also where others differ from them in case alone."""
    columns = docs.columns
    placed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    return placed.select([F.col(f"c{columns.index(n)}").alias(n) for n in names])


def joined(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` joined with a *stored* ``small``, which is broadcast only up to ``limit`` bytes.

    ``small`` is counted; beyond the limit the join shuffles both sides by key
    and adaptive execution splits its skewed partitions.
    """
    if small.count() * row_bytes <= limit:
        return big.join(F.broadcast(small), on, how)
    return big.hint("merge").join(small, on, how)


def id_hash(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text (0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0).cast("long"))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """All of ``df``, or about ``rows`` rows of it chosen by a hash of ``key``.

    The choice depends on the key and the row count alone, not on partitions.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < share)
