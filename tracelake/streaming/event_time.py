"""Streams by event time: watermarks, interval joins of two streams, sessions, and how many rows came too late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(left: DataFrame, right: DataFrame, key: str, time: str, id: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of each left row with the right rows of its key after it and not later than ``within``: key, id, time, result, result_ts.

    A join of two streams by event time: state holds a row only until the other side's watermark (``late`` behind the
    newest event) has passed the interval, and rows later than that are dropped. Tables join as well. Spark allows no further
    state behind such a join, so the first result of each left row is taken from the written pairs by ``first_of``.
    """
    a = left.select(F.col(key).alias("_k"), F.col(id).alias("_id"), F.col(time).alias("_t")).withWatermark("_t", late)
    b = right.select(key, F.col(id).alias("result"), F.col(time).alias("result_ts")).withWatermark("result_ts", late)
    met = (F.col("_k") == F.col(key)) & (F.col("result_ts") > F.col("_t")) & (F.col("result_ts") <= F.col("_t") + F.expr(f"INTERVAL {within}"))
    return a.join(b, met).select(key, F.col("_id").alias(id), F.col("_t").alias(time), "result", "result_ts")


def first_of(pairs: DataFrame, key: str, time: str, id: str) -> DataFrame:
    """Each left row's first result in a table of pairs."""
    return pairs.groupBy(key, id, time).agg(F.min(F.struct("result_ts", "result")).alias("_r")).select(key, id, time, "_r.result", "_r.result_ts")


def sessions(rows: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, start, end, n: runs of a key's rows with less than ``gap`` between two; of a stream each when its watermark has passed the end."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    found = rows.groupBy(key, F.session_window(time, gap).alias("_s")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "n")


def late_rows(query) -> int:
    """Rows that a streaming query's operators have dropped as too late, over all batches that it still remembers."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
