"""Shared plumbing: tables, durable intermediate results, and byte views of Arrow text columns."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that ends a word: 0x20 and 0x09-0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, all in one machine's process) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        at = f"{tempfile.gettempdir()}/tracelake-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: For each thread the lists of tables that were written inside its calls of ``kept``, the innermost last.
_WRITTEN = threading.local()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    Cuts lineage: a lost executor costs only the tasks that ran on it, and an expensive Python
    stage runs once however often its result is used.
    """
    path = f"{shared_dir(df.sparkSession)}/tracelake/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if frames := getattr(_WRITTEN, "frames", None):
        frames[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a durable table; the tables that this call wrote on the way to it are deleted, and no others."""
    _WRITTEN.frames = [*getattr(_WRITTEN, "frames", []), []]
    try:
        result = durable(make())
    finally:
        *outer, mine = _WRITTEN.frames
        _WRITTEN.frames = outer
    *others, own = mine
    if outer:
        outer[-1].append(own)
    for path in others:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return result


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n+1 offsets of its rows; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's constants), in place on a copy."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice [start, end) of a byte array, whatever is around it.

    A slice is read in blocks of eight bytes; each block is mixed together with its number, and the sum of these
    with the slice's length. Slices of one length up to eight bytes never share a hash, and no pattern of
    bytes makes longer ones share it (prefix polynomials modulo 2**64 are equal for words of the Thue-Morse kind at any base).
    """
    n = ends - starts
    padded = np.r_[data, np.zeros(8, np.uint8)]
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    many = np.maximum((n + 7) >> 3, 1)
    first = np.cumsum(many) - many
    nth = np.arange(int(many.sum())) - np.repeat(first, many)
    value = blocks[np.repeat(starts, many) + 8 * nth]
    rest = np.minimum(np.repeat(n, many) - 8 * nth, 8)
    value &= MASKS[rest]
    mixed = mix(value + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    return mix(total + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: The lowest k bytes of a block.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


class PrefixHash:
    """Prefix polynomial hashes of a byte array: the hash of any slice in O(1), vectorised.

    ``hash(a, b)`` depends only on the bytes in [a, b) (not on a); modulo 2**64, finalised with
    ``mix`` over the slice's length.
    """

    def __init__(self, data: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


POWERS_A, POWERS_B = Powers(0x9E3779B97F4A7C15 | 1), Powers(0xD6E8FEB86659FD93)


def arrow_rows(batch: pa.RecordBatch, most_bytes: int, column: str = "text"):
    """Slices of a batch whose ``column`` holds about ``most_bytes`` at most (one longer row stays whole)."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
