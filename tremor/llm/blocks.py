"""Columns of whole texts as numpy arrays, blocks of documents, and tables in the shared folder.

A *block* is a run of neighbouring input rows that holds about ``BLOCK_BYTES`` of text (a longer text is a
block of its own).  Operators that send something out per document and get an answer back address the
answer by (block, row in block), never by document id, so null and repeated ids need no special care.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 4 << 20
#: Bytes of a batch on its way to Python; Spark's own bound is a number of rows, which long texts make large.
BATCH, BATCH_KEY = "12m", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, the warehouse folder is used and set as checkpoint folder; only a session on one
    machine may do so, others get a ValueError.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        kept = sc.getCheckpointDir()
        if not kept and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = kept or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tremor-checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/tremor-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Let the folder go when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written once as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The table is there until the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", codec).parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound batches by BATCH bytes for the rest of the session; a lower bound that is set already stays."""
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY))) > int(BATCH[:-1]) << 20:
        spark.conf.set(BATCH_KEY, BATCH)


def trim() -> None:
    """Give freed memory back to the system: an idle worker stays for a while, beside those that run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other systems have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shards(spark: SparkSession, times: int = 4) -> int:
    """Groups to deal rows to: a few for each shuffle partition, so that a group stays small."""
    return max(1, times * int(spark.conf.get("spark.sql.shuffle.partitions")))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n, (_, offs, data) = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cuts(offsets: np.ndarray, most: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = hi
    return out


def numbered():
    """A function that gives a new block number at each call, unique in the running job."""
    first, seen = TaskContext.get().partitionId() << 32, [-1]

    def number() -> int:
        seen[0] += 1
        return first + seen[0]

    return number


def press(a: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unpress(b: bytes, kind=None) -> np.ndarray | bytes:
    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if kind is None else np.frombuffer(raw, kind)


def planes(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small ids and slow sequences shrink well."""
    a = np.ascontiguousarray(a)
    return press(a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else b"")


def unplanes(b: bytes, kind) -> np.ndarray:
    raw, size = unpress(b, np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1) if len(raw) else np.zeros(0, kind)
