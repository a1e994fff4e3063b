"""What the operators of this subpackage share: tables, scratch tables, Arrow slices, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one for a master on one machine;
    on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_SCRATCH:
            _OWN_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="textloom-"))
        root = _OWN_SCRATCH[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """rows is a count that was taken of df; beyond `most` rows the join shuffles."""
    return F.broadcast(df) if rows <= most else df


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on and serves other stages' tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def slices(batches, column: str = "text", most: int = 1 << 20):
    """Cuts Arrow batches by rows so that a slice holds at most `most` bytes of the column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = offsets(col)
        start = 0
        while start < n:
            stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
            stop = min(n, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, from 0; nulls are empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    return raw - raw[0]


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array as one uint8 array, and the offsets of its rows in it."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    data = col.buffers()[2]
    if data is None or raw[-1] == raw[0]:
        return np.empty(0, np.uint8), raw - raw[0]
    return np.frombuffer(data, np.uint8, int(raw[-1] - raw[0]), int(raw[0])), raw - raw[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed a 64-bit hash of every span of one byte array: eight bytes a step, mixed after each, so that no algebra of
    the texts (as of polynomials modulo a power of two) makes two of them equal. Spans of over 64 bytes are hashed one by one."""
    size = stops - starts
    out = [mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) for seed in seeds]
    if not len(starts):
        return out
    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", whole, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= 64))
    step = 0
    while len(live):
        left = size[live] - step
        word = eight[starts[live] + step]
        word &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8))
        for h, seed in zip(out, seeds):
            h[live] = mix((h[live] ^ word) * np.uint64(seed | 1) + np.uint64(step + 1))
        step += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > 64):
        span = data[starts[i] : stops[i]].tobytes()
        for h, seed in zip(out, seeds):
            h[i] = xxhash.xxh3_64_intdigest(span, seed)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """64-bit hashes of any substrings of one byte array, from prefix sums of byte codes times powers of an odd base."""

    BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
    _powers: dict[int, np.ndarray] = {}
    _codes = [mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for k in range(len(BASES))]

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        have = cls._powers.get(base)
        if have is None or len(have) < n:
            size = max(n, 1 << 16)
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
            cls._powers[base] = have
        return have[:n]

    def __init__(self, data: np.ndarray, which: int = 0):
        self.base = self.BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._codes[which][data] * self.powers(self.base, len(data)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = self.powers(self.inverse, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of each substring of that width, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.powers(self.inverse, n) + np.uint64(width))
