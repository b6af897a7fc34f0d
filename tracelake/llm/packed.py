"""Packed exchange: numpy columns travel between tasks as a few binary rows per bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

BLOB = "bucket int, blob binary"
#: Squeezed columns of several kinds of entries.
MESSAGE = "bucket int, kind int, blob binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(", ")])


def blobs(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has entries: its part of the columns, one after the other."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    used = np.flatnonzero(np.diff(at))
    for some in np.array_split(used, max(1, len(used) // 64)):
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([b"".join(c[at[b] : at[b + 1]].tobytes() for c in columns) for b in some], pa.binary())], ["bucket", "blob"])


def columns(found, *kinds: str) -> list[np.ndarray]:
    """The columns of several blobs, end to end."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in found:
        raw, at = blob.as_py(), 0
        n = len(raw) // width
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def squeezed(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``blobs``, compressed: signed columns as differences, so that nearly sorted ids take little room."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in blobs(bucket, buckets, *columns):
        out = []
        for raw in batch.column(1):
            found = [np.diff(c, prepend=c.dtype.type(0)) if c.dtype.kind == "i" else c for c in _split(raw.as_py(), [c.dtype for c in columns])]
            out.append(pack.compress(b"".join(c.tobytes() for c in found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["bucket", "blob"])


def unsqueezed(found, *kinds: str) -> list[np.ndarray]:
    """The columns of several squeezed blobs, end to end."""
    unpack = zstandard.ZstdDecompressor()
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in found:
        for column, c in zip(out, _split(unpack.decompress(blob.as_py()), [np.dtype(k) for k in kinds]), strict=True):
            column.append(np.cumsum(c, dtype=c.dtype) if c.dtype.kind == "i" else c)
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def messages(kind: int, bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Squeezed entries of one kind, in rows of MESSAGE."""
    for b in squeezed(bucket.astype(np.int32), buckets, *columns):
        yield message_rows(kind, b.column(0), b.column(1))


def message_rows(kind: int, bucket: pa.Array, blob: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([bucket, pa.array(np.full(len(bucket), kind), pa.int32()), blob], ["bucket", "kind", "blob"])


def of_kind(table: pa.Table, kind: int) -> pa.ChunkedArray:
    """The blobs of one kind in a bucket's MESSAGE rows."""
    return table.filter(pc.equal(table["kind"], kind))["blob"]


def table_of(batches, schema: str) -> pa.Table:
    found = list(batches)
    return pa.Table.from_batches(found) if found else schema_of(schema).empty_table()


def _split(raw: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = len(raw) // sum(k.itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each entry of sorted columns differs from the one before."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def regroup(df: DataFrame, reduce: Callable, schema: str) -> DataFrame:
    """``reduce`` (bucket, blobs -> batches) over each bucket of packed rows."""

    def run(key, table):
        return table_of(reduce(key[0].as_py(), table["blob"]), schema)

    return df.groupBy("bucket").applyInArrow(run, schema)


def within(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x is in the sorted ``known`` (any place if it isn't), and whether it is."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x
