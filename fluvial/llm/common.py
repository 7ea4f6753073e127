"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Odd multiplier of the polynomial hashes, and the finaliser's multiplier.
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9


def ship_by_value() -> None:
    """Pickle this package's functions by value, so executors need no copy of it."""
    import fluvial

    cloudpickle.register_pickle_by_value(fluvial)


ship_by_value()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, or the checkpoint folder set in the context; in local mode alone one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":  # one machine, one disk
            root = tempfile.mkdtemp(prefix="fluvial-")
            spark.sparkContext.setCheckpointDir(f"file://{root}")
            root = f"file://{root}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root}/fluvial-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    back = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    back._fluvial_folder = folder
    return back


def discard(*tables: DataFrame | None) -> None:
    """Removes what ``materialise`` wrote for tables that nothing reads any more."""
    for table in tables:
        folder = getattr(table, "_fluvial_folder", None)
        if folder:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batch_bytes(spark: SparkSession, size: str) -> None:
    """The most bytes of a batch that goes to a Python worker from now on in this session: long texts come in smaller batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Gives memory that this process no longer needs back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library has it
        trim(0)


def trimmed(run):
    """The batch function, which at a partition's end gives memory back: workers live on and serve later stages."""

    def wrapped(batches):
        import gc

        yield from run(batches)
        gc.collect()
        give_back()

    return wrapped


def relieved(function):
    """The function of a group, or of two groups, after which memory is given back. Spark tells them apart by the number of arguments."""

    def run(*tables):
        try:
            return function(*tables)
        finally:
            give_back()

    return (lambda a: run(a)) if function.__code__.co_argcount == 1 else (lambda a, b: run(a, b))


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with more columns behind it; a column of the same name gives way."""
    more = StructType.fromDDL(ddl)
    return StructType([f for f in schema.fields if f.name not in more.names] + more.fields)


def partitions(spark: SparkSession, factor: int = 1, least: int = 1) -> int:
    return max(least, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int | None:
    """The planner's estimate of a table's size, from its files; none where it has no idea."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0)) % n


def fraction_key(col: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends only on the id."""
    return F.pmod(F.xxhash64(col.cast("string"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def flat_utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the offset where each row starts (n + 1)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, most: int = 1 << 18):
    """(start, stop) row ranges of at most about ``most`` bytes (one row at least)."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        a = np.full(max(n, 1), base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    h ^= h >> np.uint64(29)
    h *= np.uint64(BASE)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """Hashes of byte ranges of one flat array, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        self.pw, self.inv = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.pw[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Unmixed hash of data[start:stop), equal for equal bytes wherever they lie."""
        return (self.sums[stop] - self.sums[start]) * self.inv[start]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time; each step is a bijection, so two words of up to eight bytes never clash."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    groups = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    size = end - begin
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = size.astype(np.uint64)
    left = np.arange(len(size))
    for at in range(0, int(size.max(initial=0)), 8):
        if at:
            left = left[size[left] > at]
        h[left] = mixed((h[left] * np.uint64(0xD6E8FEB86659FD93)) ^ (groups[begin[left] + at] & masks[np.minimum(size[left] - at, 8)]))
    return h


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def tallied(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each is there."""
    a = np.sort(a)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    return a[first], np.diff(np.append(first, len(a)))


def ragged_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive ranges off[i]:off[i+1]; 0 for empty ranges."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
