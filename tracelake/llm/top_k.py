"""Exact top-k inner products by MaxScore over dense integer vectors (operator 6).

Dimensions are the terms. Within a shard a term's contribution q_i * v_i lies between lo_i and
hi_i (from the shard's least and greatest v_i); shifted by lo_i it is at least 0 and at most its
bound hi_i - lo_i, as MaxScore needs. Terms are taken by falling bound; the trailing ones whose
bounds together can't lift a document over the threshold are non-essential. Essential postings
are traversed for a block of documents; the non-essential terms are probed one group after the
other for the documents that are still competitive. The threshold is the k-th best score so
far; it rises from block to block, and a task hands it on from shard to shard of its lane. The
lanes' results are merged by query, k rows of each lane.

Queries and shards are packed rows that meet by an equi-join on the number of the query block.
Where a shard's sums might pass 2^53 its arithmetic is that of unbounded integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import durable

SHARD, QUERIES, BLOCK, PROBE = 2048, 4096, 512, 8
#: Shards that one task searches one after the other, at most.
LANE = 16
LONG = 2**63 - 1
Best = tuple[np.ndarray, np.ndarray]


def quantised(x: float, scale: int) -> int:
    """floor(scale * x) as an unbounded integer; from 2^52 on a double is an integer itself."""
    return math.floor(scale * x) if abs(x) < 2.0**52 / scale else int(x) * scale


def first(ids: np.ndarray, score: np.ndarray, k: int) -> Best:
    """The k best by falling score, then id."""
    if score.dtype == object:
        top = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    else:
        top = np.lexsort((ids, -score))[:k]
    return ids[top], score[top]


def max_score(q: np.ndarray, v: np.ndarray, ids: np.ndarray, own: int, k: int, least: np.ndarray, most: np.ndarray, best: Best | None = None) -> Best:
    """The k best (id, score) of a shard and of ``best``, by falling score, then id; ``own`` is no candidate."""
    a, b = q * least, q * most
    low, bound = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(-bound, kind="stable")
    q, v, base = q[order], v[:, order], low.sum()
    after = np.r_[np.cumsum(bound[order][::-1])[::-1], 0]  # the most that the terms from i on can add
    lows = np.r_[0, np.cumsum(low[order])]
    best_ids, top = best if best is not None else (np.zeros(0, np.int64), np.zeros(0, v.dtype))
    for start in range(0, len(ids), BLOCK):
        at = start + np.flatnonzero(ids[start : start + BLOCK] != own)
        threshold = top[k - 1] if len(top) >= k else -np.inf
        if v.dtype != object and len(top) >= k:  # this shard's sums are below 2^53
            threshold = float(max(min(threshold, 1 << 60), -1 << 60))
        # Essential terms: those before the first i from which on the bounds stay under the threshold.
        under = base + after < threshold
        done = int(np.argmax(under)) if under.any() else len(q)
        part = v[at, :done] @ q[:done]
        while True:
            alive = part - lows[done] + base + after[done] >= threshold
            at, part = at[alive], part[alive]
            if done == len(q) or not len(at):
                break
            step = min(done + PROBE, len(q))
            part = part + v[at, done:step] @ q[done:step]
            done = step
        best_ids, top = first(np.r_[best_ids, ids[at]], np.r_[top, part], k)
    return best_ids, top


def _pack(width: int, scale: int, *names: str):
    """Rows of one key as packed ids and components: 32-bit integers where they fit, else text."""

    def run(key, table):
        table = table.sort_by("vec_id")
        rows = [[quantised(x, scale) for x in v] + [0] * (width - len(v)) for v in table["v"].to_pylist()]
        small = all(-(2**31) <= x < 2**31 for row in rows for x in row)
        raw = np.array(rows, "<i4").tobytes() if small else " ".join(str(x) for row in rows for x in row).encode()
        ids = table["vec_id"].to_numpy().astype("<i8").tobytes()
        return pa.table({**{n: pa.array([x.as_py()], pa.int64()) for n, x in zip(names, key, strict=True)}, "small": pa.array([small]), "ids": pa.array([ids], pa.binary()), "rows": pa.array([raw], pa.binary())})

    return run


def _unpack(raw: bytes, small: bool, width: int) -> np.ndarray:
    found = np.frombuffer(raw, "<i4").astype(np.float64) if small else np.array([int(x) for x in raw.split()], object)
    return found.reshape(-1, width)


def _searcher(k: int, width: int):
    """The search of a task's (shard, block) rows, ordered by block: a block's best go on from shard to shard."""

    def answers(block: int, own: np.ndarray, best: list[Best]) -> pa.RecordBatch:
        size = [len(ids) for ids, _ in best]
        whole = [int(x) for _, score in best for x in score]
        fits = [min(max(x, -LONG - 1), LONG) for x in whole]
        nth = np.repeat(np.arange(len(best)), size) + block * (1 << 32)
        ids = np.concatenate([ids for ids, _ in best])
        # Scores beyond a long keep their order by their digits.
        over = [None if x == y else f"{abs(x):0700d}" for x, y in zip(whole, fits, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size)), pa.array(nth), pa.array(ids), pa.array(fits, pa.int64()), pa.array(over, pa.string())], ["query_id", "nth", "vec_id", "score", "over"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    if now is not None:
                        yield answers(now, own, best)
                    now, own, best = row["block"], np.frombuffer(row["q_ids"], "<i8"), [None] * (len(row["q_ids"]) // 8)
                ids, v = np.frombuffer(row["ids"], "<i8"), _unpack(row["rows"], row["small"], width)
                queries = _unpack(row["q_rows"], row["q_small"], width)
                if row["small"] and row["q_small"] and width * int(np.abs(v).max()) * int(np.abs(queries).max()) >= 1 << 53 or v.dtype != queries.dtype:
                    v, queries = (np.array([[int(x) for x in r] for r in m], object).reshape(-1, width) for m in (v, queries))
                least, most = v.min(axis=0), v.max(axis=0)
                best = [max_score(q, v, ids, mine, k, least, most, b) for mine, q, b in zip(own, queries, best, strict=True)]
        if now is not None:
            yield answers(now, own, best)

    return search


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by integer inner product.

    Components are floor(scale * x), exact at any finite size; a score beyond a long is ranked
    by its true value and shown as the nearest long. Rows with a null id, a null vector, or a null
    or non-finite component take no part; a row is no candidate of queries with its own id; ties go
    to the smaller id, equal rows included. Vectors of different lengths are padded with 0. A query
    that is repeated is answered once for each different vector. Other columns are ignored. No rows
    or no queries: no rows.
    """
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = durable(rows.where(F.coalesce(usable, F.lit(False))).withColumn("v", F.transform("v", lambda x: x.cast("double"))))
    n, asked, width = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v"))).first()
    width = width or 1
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // QUERIES))
    lanes = max(min(shards, 32), -(-shards // LANE))
    packed = "small boolean, ids binary, rows binary"
    own = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards))
    shard = rows.withColumn("shard", own).withColumn("lane", F.col("shard") % lanes).groupBy("lane", "shard").applyInArrow(_pack(width, scale, "lane", "shard"), f"lane long, shard long, {packed}")
    block = rows.where("is_query").dropDuplicates(["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInArrow(_pack(width, scale, "block"), f"block long, {packed}")
    block = block.select("block", F.col("small").alias("q_small"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    meet = shard.withColumn("block", every).join(block.hint("shuffle_hash"), "block").repartition(lanes * blocks, "lane", "block").sortWithinPartitions("block", "lane", "shard")
    local = meet.mapInArrow(_searcher(k, width), "query_id long, nth long, vec_id long, score long, over string")
    # A score beyond a long: the larger its digits the better above, the worse below.
    up = F.when(F.col("score") > 0, F.col("over"))
    down = F.when(F.col("score") < 0, F.col("over"))
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), F.desc_nulls_last(up), F.asc_nulls_first(down), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
