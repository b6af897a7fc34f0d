"""Packing token sequences with a grouping genetic algorithm (operator 3).

1. **Pieces.** Each text becomes its token ids and one end id; longer sequences are cut at the
   capacity. Full pieces are sequences by themselves.
2. **Shards.** The others are dealt at random into shards of bounded size, so the packing work
   grows in proportion and no task holds more than one shard.
3. **Islands.** Each shard has several islands, each a row with its own population. An
   individual is a grouping: a list of bins. Crossover injects whole well-filled bins of one
   parent into the other, drops the bins that now hold duplicates, and places the displaced
   pieces by best fit, largest first. Between epochs each island receives the best individual
   of its neighbour (a join on shard and island).  A shard whose best individual reaches the
   lower bound ceil(tokens / capacity) leaves the search.
4. **Left-overs.** Bins under ``settle`` of the capacity go back, all shards' together, through
   steps 2 and 3 once more.
"""

from __future__ import annotations

import gc
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_rows, durable, parts
from tracelake.llm.tokens import ids

Bins = list[list[int]]


def best_fit(sizes: np.ndarray, items: list[int], bins: Bins, capacity: int) -> Bins:
    """Place ``items``, largest first, each into the open bin that it leaves the least room in."""
    bins = [list(b) for b in bins]
    by_room: dict[int, list[int]] = {}
    for i, full in enumerate(filled(sizes, bins) if bins else []):
        by_room.setdefault(capacity - full, []).append(i)
    sizes = sizes.tolist()
    rooms = sorted(by_room)
    for item in sorted(items, key=lambda i: -sizes[i]):
        size = sizes[item]
        at = bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([])
            where, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            where = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[where].append(item)
        if room - size not in by_room:
            by_room[room - size] = []
            insort(rooms, room - size)
        by_room[room - size].append(where)
    return bins


def filled(sizes: np.ndarray, bins: Bins) -> list[int]:
    """The tokens in each bin."""
    flat = np.fromiter((i for b in bins for i in b), np.int64)
    return np.add.reduceat(sizes[flat], np.cumsum([0, *map(len, bins[:-1])])).tolist()


def ranked(sizes: np.ndarray, bins: Bins) -> Bins:
    """Bins from the worst filled to the best."""
    return [bins[k] for k in np.argsort(filled(sizes, bins), kind="stable")]


def fitness(sizes: np.ndarray, bins: Bins, capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how unevenly they are filled (uneven is better)."""
    return len(bins), -sum((f / capacity) ** 2 for f in filled(sizes, bins))


def crossover(sizes: np.ndarray, giver: Bins, taker: Bins, capacity: int, rng: random.Random) -> Bins:
    """Inject a random share of the giver's best-filled half into the taker, then repair by best fit."""
    best = ranked(sizes, giver)[::-1]
    injected = [b for b in best[: max(1, len(best) // 2)] if rng.random() < 0.5] or best[:1]
    taken = {i for b in injected for i in b}
    kept = [b for b in taker if taken.isdisjoint(b)]
    displaced = [i for b in taker if not taken.isdisjoint(b) for i in b if i not in taken]
    return best_fit(sizes, displaced, injected + kept, capacity)


def mutate(sizes: np.ndarray, bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Empty the worst-filled bin and a few others, and place their pieces again."""
    order = ranked(sizes, bins)
    out = {0, *(rng.randrange(len(order)) for _ in range(3))}
    return best_fit(sizes, [i for k in out for i in order[k]], [b for k, b in enumerate(order) if k not in out], capacity)


def settled(sizes: np.ndarray, bins: Bins, capacity: int) -> bool:
    """Whether no packing is better: all bins are full but one."""
    return sum(f < capacity for f in filled(sizes, bins)) <= 1 if bins else True


def evolve(sizes: np.ndarray, people: list[Bins], capacity: int, rng: random.Random, size: int, generations: int) -> list[Bins]:
    """The population, best first, after some generations."""
    every = list(range(len(sizes)))
    if not people:
        people = [best_fit(sizes, every, [], capacity)]
    if not settled(sizes, people[0], capacity):
        while len(people) < size:
            some = rng.sample(every, len(every) // 2)
            bins = best_fit(sizes, some, [], capacity)
            rest = set(every).difference(some)
            people.append(best_fit(sizes, list(rest), bins, capacity))
    graded = sorted(((fitness(sizes, p, capacity), p) for p in people), key=lambda g: g[0])[:size]
    for _ in range(generations):
        if settled(sizes, graded[0][1], capacity):
            break
        giver, taker = rng.sample(graded, 2) if len(graded) > 1 else graded * 2
        child = mutate(sizes, crossover(sizes, giver[1], taker[1], capacity, rng), capacity, rng)
        graded = sorted([*graded, (fitness(sizes, child, capacity), child)], key=lambda g: g[0])[:size]
    return [p for _, p in graded]


def _packed(people: list[Bins], n: int) -> list[bytes]:
    out = []
    for bins in people:
        where = np.zeros(n, "<i4")
        for k, b in enumerate(bins):
            where[b] = k
        out.append(where.tobytes())
    return out


def _unpacked(people: list[bytes]) -> list[Bins]:
    out = []
    for raw in people:
        where = np.frombuffer(raw, "<i4")
        order = np.argsort(where, kind="stable")
        out.append([g.tolist() for g in np.split(order, np.flatnonzero(np.diff(where[order])) + 1)])
    return out


ISLANDS = "shard long, island int, sizes binary, people array<binary>"
_ISLANDS = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("people", pa.list_(pa.binary()))])


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<i4")
                rng = random.Random(f"{row['shard']}/{row['island']}/{epoch}")
                row["people"] = _packed(evolve(sizes, _unpacked(row["people"]), capacity, rng, population, generations), len(sizes))
                yield pa.RecordBatch.from_pylist([row], schema=_ISLANDS)

    return run


def search(dealt: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """Per shard of ``dealt`` (id, length, shard): best (each piece's bin, packed), its bins, and the bins and unevenness that best fit alone gives."""

    def gather(key, t):
        sizes = t.sort_by("id")["length"].to_numpy().astype("<i4")
        seed = _packed([best_fit(sizes, list(range(len(sizes))), [], capacity)], len(sizes))
        return pa.Table.from_pylist([{"shard": key[0].as_py(), "island": 0, "sizes": sizes.tobytes(), "people": seed}], schema=_ISLANDS)

    seeds = durable(dealt.groupBy("shard").applyInArrow(gather, ISLANDS))
    now = seeds.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    for epoch in range(epochs):
        if epoch:
            elite = now.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("people")[0].alias("elite"))
            now = now.join(elite, ["shard", "island"]).select("shard", "island", "sizes", F.concat(F.array("elite"), "people").alias("people"))
        spread = now.repartition(parts(now.sparkSession), "shard", "island")
        now = durable(spread.mapInArrow(_epoch(capacity, population, generations, epoch), ISLANDS))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, x = fitness(np.frombuffer(row["sizes"], "<i4"), _unpacked(row["people"][:1])[0], capacity)  # an island's best comes first
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]], "best": pa.array([row["people"][0]], pa.binary()), "bins": pa.array([n], pa.int64()), "uneven": pa.array([x])})

    graded = lambda df: df.mapInArrow(grade, "shard long, best binary, bins long, uneven double")
    least = F.min(F.struct("bins", "uneven", "best")).alias("x")
    best = graded(now).groupBy("shard").agg(least).select("shard", "x.best", "x.bins", "x.uneven")
    seed = graded(seeds).select("shard", F.col("bins").alias("seed_bins"), F.col("uneven").alias("seed_uneven"))
    return durable(best.join(seed, "shard"))


def deal(pieces: DataFrame, shard_items: int) -> DataFrame:
    """``pieces`` (id, length; ``id`` is unique) with a shard, by a hash of the id: about ``shard_items`` pieces each."""
    shards = max(1, -(-pieces.count() // shard_items))
    return durable(pieces.select("id", "length", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")))


def assign(pieces: DataFrame, capacity: int, shard_items: int, *effort: int) -> DataFrame:
    """``pieces`` (id, length) with shard and bin: each shard packed by itself, by ``search`` with ``effort``."""
    dealt = deal(pieces, shard_items)
    plans = search(dealt, capacity, *effort)

    def spread(key, t, plan):
        t = t.sort_by("id")
        return pa.table({"id": t["id"], "shard": t["shard"], "bin": pa.array(np.frombuffer(plan["best"][0].as_py(), "<i4").astype(np.int64))})

    return durable(dealt.groupBy("shard").cogroup(plans.select("shard", "best").groupBy("shard")).applyInArrow(spread, "id long, shard long, bin long"))


def improvement(plans: DataFrame) -> DataFrame:
    """One row: shards, how many ``search`` packed into fewer bins than best fit, and how many into fewer or more unevenly filled ones."""
    fewer, better = F.col("bins") < F.col("seed_bins"), F.struct("bins", "uneven") < F.struct("seed_bins", "seed_uneven")
    return plans.agg(F.count("*").alias("shards"), F.count_if(fewer).alias("fewer_bins"), F.count_if(better).alias("improved"))


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = ids(tokenizer)
        gc.disable()  # lists of words by the million, and no cycles
        for whole in batches:
            for batch in arrow_rows(whole, 2 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for i, found in enumerate(library.of([t.as_py() or "" for t in batch.column("text")])):
                    found = np.append(found, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(found), capacity)):
                        part = found[at : at + capacity]
                        row.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        library.forget()  # the worker goes on to other work
        gc.enable()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(cut, f"doc_id {kind}, {PIECE}")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, shard_items: int = 4096, islands: int = 3, epochs: int = 3, population: int = 3, generations: int = 6, settle: float = 0.97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0).

    A null or empty text is its end id alone; a text of any length is tokenised as a whole. Null keys
    and repeated rows are packed like any other, each row for itself. Of equally good packings the one
    of the smallest binary form counts. Other columns are ignored. No rows: no sequences.
    """
    all_pieces = durable(pieces_of(docs, tokenizer, capacity, end_id, key, text).withColumn("id", F.monotonically_increasing_id()))
    args = (capacity, shard_items, islands, epochs, population, generations)
    first = assign(all_pieces.where(F.col("length") < capacity).select("id", "length"), *args)
    loose = all_pieces.select("id", "length").join(first, "id")
    weak = loose.groupBy("shard", "bin").agg(F.sum("length").alias("filled")).where(F.col("filled") < int(settle * capacity))
    again = assign(loose.join(weak, ["shard", "bin"], "left_semi").select("id", "length"), *args)
    # A sequence's number is the round, then the shard, then the bin; a full piece has a round of its own.
    number = lambda nth: ((F.lit(nth) * (1 << 40) + F.col("shard")) * (1 << 20) + F.col("bin")).alias("sequence_id")
    placed = first.join(again.select("id"), "id", "left_anti").select("id", number(0)).unionByName(again.select("id", number(1)))
    placed = all_pieces.where(F.col("length") < capacity).join(placed, "id").unionByName(all_pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("id")))
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
