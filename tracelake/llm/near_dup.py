"""Exact n-gram Jaccard self-join by PartEnum signatures (operator 8).

**Signatures.** Sets of similar size share a band (band t holds the sizes [low(t), low(t+1)), so
that similar sets lie in the same band or in neighbouring ones), and each set takes part in the
instances of its own band and of the next. Within an instance two similar sets differ in at most
k features. The feature domain is dealt by a hash into n1 parts and each of these into n2 = 3
second-level parts. With n1 > k / 2 some part holds at most one of the differences, so in it two of
the three second-level parts agree as a whole: a set signs, in every part, each of the subsets of
two of its three second-level parts. The differences spoil at most n1 + k of the 3 n1 subsets (two for
a part's first one, one for its second), so similar sets agree on 2 n1 - k or more; a set that has
fewer empty subsets than that leaves those out, as an agreement on another is then certain.

**Frequent shingles.** What the bounds need of the domain is only that it is the same for all
sets, so shingles that ``FREQUENT`` documents or more hold (passages that pages share) are taken
out of it, whatever their number: else each would make groups of unlike documents. A set of
which that leaves too many empty parts (a large family of copies, or little but boilerplate)
signs its full set as well, empty parts included where it must; of two similar sets either one
has enough parts left, and they meet there, or both sign in full, and they meet there.

**Sketches.** How many members of a set fall into each of some buckets bounds what two sets can
share, so most documents that met by chance go before their sets travel.

**Links.** A group of sets with one signature is never turned into all its pairs. Its smallest
document is the hub and each member is compared exactly with one hub; the components of the
links so found are contracted. Groups that still hold several components are compared in
blocks: documents that met the same hub share blocks of about ``HUB_ROWS``, a cell is a pair of
blocks that some open group spans, and each cell counts all its intersections with one matrix
product and returns a spanning forest of its links. So two documents of a group are compared
unless they are already known to be connected, and no link that matters to a component is
lost. Documents with equal sets are one class throughout.

Signatures, groups and requests travel as packed arrays, a few rows per task, so that their
sorting and grouping is numpy's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracelake.llm.common import arrow_rows, durable, mix, parts, text_bytes
from tracelake.llm.components import components, hot_join, hot_limit
from tracelake.llm.packed import BLOB, blobs, columns, firsts, regroup, squeezed, unsqueezed, within
from tracelake.llm.shingles import folded, most_common, set_hashes, shingle_sets, sketches

#: Rows of ids that a broadcast may hold (about 60 MB in a JVM); beyond, Spark shuffles both sides.
BROADCAST_IDS = 1_000_000
#: Members that meet their hub in one group of rows, and documents in a block, on average at most.
HUB_ROWS = 256
#: Documents that must hold a shingle to take it out of the signatures' domain, and how many such may be broadcast (8 bytes each).
FREQUENT, FREQUENT_MOST = 32, 4_000_000
BATCH, LOT = 1 << 20, 4 << 20


def lows(percent: int, most: int) -> np.ndarray:
    """The smallest size of each band up to the size ``most``, and two more."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1, 2**62], np.int64)


def layout(percent: int, low: np.ndarray, instance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First-level parts of instances (sets of size up to u = low[instance + 1] - 1), and the subsets that similar sets agree on at least."""
    u = low[instance + 1] - 1
    k = 2 * u * (100 - percent) // (100 + percent)
    n1 = k // 2 + 1 + np.ceil(k * 0.15).astype(np.int64)
    return n1, 3 * n1 - 2 * np.minimum(k, n1) - np.maximum(0, k - n1)


def signatures(values: np.ndarray, bounds: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes of every non-empty set, and the set (its position) each is of.

    ``frequent``: whether each value is out of the domain.
    """
    size = np.diff(bounds)
    low = lows(percent, int(size.max(initial=1)))
    band = np.searchsorted(low, size, "right") - 1
    sums, owners = [], []
    own = np.repeat(np.arange(len(size)), size)
    scale = np.uint64(32)
    place, mixed = mix(values + np.uint64(7)) >> scale, mix(values)
    rare = np.ones(len(values), bool) if frequent is None else ~frequent
    for step in (0, 1):
        instance = np.where(size > 0, band + step, 0)
        n1, agreed = layout(percent, low, instance)
        cells = np.where(size > 0, 3 * n1, 0)  # one for each second-level part, and one for each subset of two
        base = np.r_[0, np.cumsum(cells)]
        cell = base[own] + ((place * cells[own].astype(np.uint64)) >> scale).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), cells)
        number = np.arange(base[-1]) - base[owner]
        # The subset of a cell is of its own second-level part and the next of the same first-level part.
        other = np.arange(base[-1]) + np.where(number % 3 == 2, -2, 1)
        short = size > 0  # sets with too many empty subsets so far
        for family, use in ((0, rare), (1, np.ones(len(values), bool))):
            if family:
                use &= short[own]
            total = np.zeros(base[-1], np.uint64)
            np.add.at(total, cell[use], mixed[use])
            count = np.bincount(cell[use], minlength=base[-1])
            total, count = total + total[other], count + count[other]
            empty = count == 0
            empties = np.bincount(owner[empty], minlength=len(size))
            sign = (~empty | ((empties >= agreed)[owner] & bool(family))) & short[owner]
            short = short & (empties >= agreed)
            who, nth = owner[sign], number[sign]
            tag = ((instance[who] * 2 + family) * 1_000_003 + nth).astype(np.uint64)
            sums.append(mix(total[sign] + mix(tag) + count[sign].astype(np.uint64)))
            owners.append(who)
    return np.concatenate(sums), np.concatenate(owners)


def spot(values: np.ndarray, n: np.uint64) -> np.ndarray:
    """The bucket of a shingle and 32 bits more of it: what frequencies are counted by."""
    return ((values % n) << np.uint64(32)) | ((values // n) & np.uint64(0xFFFFFFFF))


def frequent_shingles(docs: DataFrame, words: int, buckets: int) -> np.ndarray:
    """Sorted spots of the shingles that at least ``FREQUENT`` documents hold, counted over all documents.

    Where those are more than ``FREQUENT_MOST`` the threshold doubles until they aren't, so what
    is broadcast has a bound; any choice gives the same links.
    """
    n = np.uint64(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in (part for whole in batches for part in arrow_rows(whole, 2 * LOT)):
            spots, times = np.unique(np.concatenate([spot(shingle_sets(*text_bytes(batch.column(1)), words)[0], n) for batch in arrow_rows(lot, BATCH)]), return_counts=True)
            for low in range(0, 255 * (int(times.max(initial=0)) // 255 + 1), 255):  # a byte a count; large ones in pieces
                part = times > low
                yield from blobs((spots[part] >> np.uint64(32)).astype(np.int32), buckets, (spots[part] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(times[part] - low, 255).astype("u1"))

    def gather(bucket, found) -> Iterator[pa.RecordBatch]:
        spots, times = columns(found, "<u4", "u1")
        order = np.argsort(spots, kind="stable")
        spots, start = spots[order], np.flatnonzero(firsts(spots[order]))
        total = np.add.reduceat(times[order].astype("<i8"), start) if len(start) else np.zeros(0, "<i8")
        keep = total >= FREQUENT
        if keep.any():
            where = (spots[start][keep].astype("<u8") | (np.uint64(bucket) << np.uint64(32))).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[keep])], ["spot", "times"])

    found = durable(regroup(docs.mapInArrow(count, BLOB), gather, "spot long, times long"))
    least = FREQUENT
    while found.where(F.col("times") >= least).count() > FREQUENT_MOST:
        least *= 2
    rows = found.where(F.col("times") >= least).select("spot").toArrow()
    return np.sort(rows["spot"].to_numpy().astype(np.uint64))


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join on doc_id; ``ids`` is broadcast only where its counted rows are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two hashes and a sketch of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                values, bounds = shingle_sets(*text_bytes(batch.column(1)), words)
                hashes = [pa.array(set_hashes(values, bounds, salt).astype(np.int64)) for salt in (11, 12)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), *hashes, pa.array(sketches(values, bounds), pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def may_link(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets can be similar, by what their sketches (rows) leave possible."""
    most = np.minimum(most_common(a, b), np.minimum(size_a, size_b))
    return 100 * most >= percent * (size_a + size_b - most)


def plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows (doc_id, hub, task, size and sketch of either) whose sets can be similar; (doc_id, hub, task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("n_shingles", "hub_shingles")]
            raw = [batch.column(c).to_pylist() for c in ("sketch", "hub_sketch")]
            width = [np.array([len(x) for x in r]) for r in raw]
            keep = np.zeros(batch.num_rows, bool)
            for wide in np.unique(np.stack(width), axis=1).T.tolist():
                some = np.flatnonzero((width[0] == wide[0]) & (width[1] == wide[1]))
                a, b = (folded(np.frombuffer(b"".join(r[i] for i in some), "u1").reshape(len(some), w), min(wide)) for r, w in zip(raw, wide, strict=True))
                keep[some] = may_link(sizes[0][some], a, sizes[1][some], b, percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("doc_id", "hub", "task")], ["doc_id", "hub", "task"])

    return pairs.mapInArrow(run, "doc_id long, hub long, task long")


def promising(rows: DataFrame, percent: int) -> DataFrame:
    """Of the documents (cell, doc_id, root, n_shingles, sketch) of each cell those that can be similar to one of another root in it; (cell, doc_id)."""

    def run(key, table):
        doc, root, size = (table[c].to_numpy() for c in ("doc_id", "root", "n_shingles"))
        raw = table["sketch"].to_pylist()
        width, keep = np.array([len(x) for x in raw]), np.zeros(len(doc), bool)
        for w in np.unique(width).tolist():
            own, more = np.flatnonzero(width == w), np.flatnonzero((width == w) | (width == 2 * w))  # of similar sets one isn't twice as large
            sketch = np.zeros((len(more), w), "u1")
            for wide in (w, 2 * w):
                some = np.flatnonzero(width[more] == wide)
                if not len(some):
                    continue
                sketch[some] = folded(np.frombuffer(b"".join(raw[i] for i in more[some]), "u1").reshape(len(some), wide), w)
            for i in own.tolist():
                other = np.flatnonzero((root[more] != root[i]) & (100 * size[more] >= percent * size[i]) & (100 * size[i] >= percent * size[more]))
                mine = sketch[np.searchsorted(more, i)]
                hit = more[other[may_link(size[i], mine[None, :], size[more[other]], sketch[other], percent)]]
                keep[hit] = True
                keep[i] |= len(hit) > 0
        found = np.unique(doc[keep])
        return pa.table({"cell": pa.array([key[0].as_py()] * len(found), pa.int64()), "doc_id": pa.array(found)})

    return rows.groupBy("cell").applyInArrow(run, "cell long, doc_id long")


def groups(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Packed (group, hub, member) entries, by member: the groups of two or more documents that share a signature.

    A group is known by the hash of its members, so one that recurs under many signatures is one.
    """
    n = np.uint64(buckets)
    common = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words, buckets))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in (part for whole in batches for part in arrow_rows(whole, LOT)):
            found = []
            for batch in arrow_rows(lot, BATCH):
                values, bounds = shingle_sets(*text_bytes(batch.column(1)), words)
                sums, owner = signatures(values, bounds, percent, within(spot(values, n), common.value)[1])
                found.append((sums, batch.column(0).to_numpy()[owner]))
            if found:
                sums, doc = (np.concatenate(c) for c in zip(*found, strict=True))
                # 32 bits beside the bucket: a chance agreement costs a comparison, nothing else.
                yield from squeezed((sums % n).astype(np.int32), buckets, doc, ((sums // n) & np.uint64(0xFFFFFFFF)).astype("<u4"))

    def gather(_, found) -> Iterator[pa.RecordBatch]:
        doc, sig = unsqueezed(found, "<i8", "<u4")
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        start = firsts(sig)
        many = np.diff(np.flatnonzero(np.r_[start, True])) > 1
        keep = many[np.cumsum(start) - 1]
        sig, doc = sig[keep], doc[order[keep]]
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        new = firsts(sig, doc)
        sig, doc = sig[new], doc[new]
        start = np.flatnonzero(firsts(sig))
        size = np.diff(np.r_[start, len(sig)])
        total = np.add.reduceat(mix(doc.astype(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
        group = mix(total + size.astype(np.uint64))
        _, one = np.unique(group, return_index=True)
        one = one[size[one] > 1]
        yield from _spread(group[one], start[one], size[one], doc)

    def _spread(group, start, size, doc) -> Iterator[pa.RecordBatch]:
        at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        member, hub, g = doc[at], np.repeat(doc[start], size), np.repeat(group, size)
        yield from blobs((mix(g) % n).astype(np.int32), buckets, g, hub, member)

    def unique(_, found) -> Iterator[pa.RecordBatch]:
        g, hub, member = columns(found, "<u8", "<i8", "<i8")
        order = np.lexsort((member, g))
        g, hub, member = g[order], hub[order], member[order]
        new = firsts(g, member)
        g, hub, member = g[new], hub[new], member[new]
        yield from blobs((mix(member.astype(np.uint64)) % n).astype(np.int32), buckets, g, hub, member)

    signed = docs.mapInArrow(sign, BLOB)
    return durable(regroup(regroup(signed, gather, BLOB), unique, BLOB))


def homes(entries: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hub, task), and the hubs of very many: each document with the smallest hub of its groups (maybe itself), and which block of that hub's it is in."""

    def run(_, found) -> Iterator[pa.RecordBatch]:
        _, hub, member = columns(found, "<u8", "<i8", "<i8")
        order = np.lexsort((hub, member))
        order = order[firsts(member[order])]
        yield pa.RecordBatch.from_arrays([pa.array(member[order]), pa.array(hub[order])], ["doc_id", "hub"])

    found = durable(regroup(entries, run, "doc_id long, hub long"))
    deal = durable(found.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.count("*") / HUB_ROWS).alias("tasks")))
    hot = deal.where(F.col("n") > many)
    return durable(hot_join(found, deal.drop("n"), ["hub"], hot, "inner").select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), "tasks").alias("task"))), hot.select("hub")


def cells(entries: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """(cell, doc_id, root) of the groups that hold several components. ``places``: node, root, block."""
    n = np.uint64(buckets)

    def label(key, table, known):
        g, _, member = columns(table["blob"], "<u8", "<i8", "<i8")
        known = known.sort_by("node")
        at = np.searchsorted(known["node"].to_numpy(), member)  # every member has a place
        rows = list(blobs((mix(g) % n).astype(np.int32), buckets, g, member, *(known[c].to_numpy()[at] for c in ("root", "block"))))
        return pa.Table.from_batches(rows) if rows else pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]).empty_table()

    def pick(_, found) -> Iterator[pa.RecordBatch]:
        g, member, root, block = columns(found, "<u8", "<i8", "<i8", "<i8")
        order = np.lexsort((block, g))
        g, member, root, block = g[order], member[order], root[order], block[order]
        starts = np.flatnonzero(firsts(g))
        ends = np.r_[starts[1:], len(g)]
        if not len(starts):
            return
        open_ = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        one = block[starts] == block[ends - 1]
        inside = np.repeat(open_ & one, ends - starts)
        cell, doc, roots = [mix(block[inside].astype(np.uint64))], [member[inside]], [root[inside]]
        for a, b in zip(starts[open_ & ~one].tolist(), ends[open_ & ~one].tolist(), strict=True):
            cuts = [a, *(a + 1 + np.flatnonzero(block[a + 1 : b] != block[a : b - 1])).tolist(), b]
            pieces = list(zip(cuts, cuts[1:], strict=False))
            for i, (a1, b1) in enumerate(pieces):
                for a2, b2 in pieces[i + 1 :]:
                    both = np.r_[root[a1:b1], root[a2:b2]]
                    if both.min() != both.max():
                        name = mix(np.array([block[a1]]).astype(np.uint64)) + np.uint64(3) * block[a2 : a2 + 1].astype(np.uint64)
                        cell.append(np.repeat(mix(name), len(both)))
                        doc += [member[a1:b1], member[a2:b2]]
                        roots.append(both)
        cell, doc, root = (np.concatenate(c) for c in (cell, doc, roots))
        order = np.lexsort((doc, cell))
        order = order[firsts(cell[order], doc[order])]
        yield from blobs((mix(cell[order]) % n).astype(np.int32), buckets, cell[order], doc[order], root[order])

    def unique(_, found) -> Iterator[pa.RecordBatch]:
        cell, doc, root = columns(found, "<i8", "<i8", "<i8")
        order = np.lexsort((doc, cell))
        order = order[firsts(cell[order], doc[order])]
        yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (cell, doc, root)], ["cell", "doc_id", "root"])

    known = places.select("node", "root", "block", F.lit(None).cast("int").alias("bucket")).mapInArrow(lambda it: (_with_bucket(b, n) for b in it), "node long, root long, block long, bucket int")
    labelled = entries.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(label, BLOB)
    return regroup(regroup(labelled, pick, BLOB), unique, "cell long, doc_id long, root long")


def _with_bucket(batch: pa.RecordBatch, n: np.uint64) -> pa.RecordBatch:
    bucket = (mix(batch.column(0).to_numpy().astype(np.uint64)) % n).astype(np.int32)
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bucket)], ["node", "root", "block", "bucket"])


def compare(sets: list[np.ndarray], docs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of positions) of the similar pairs among some sets, by exact intersections."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a value of one set only is in no intersection
    number = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), sizes)[shared]
    column = number[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), 8192):
        part = (column >= low) & (column < low + 8192)
        table = np.zeros((len(sets), min(8192, int((times > 1).sum()) - low)), np.float32)
        table[row[part], column[part] - low] = 1
        both += table @ table.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked |= (docs[:, None] == docs[None, :])
    seen = sizes == 0
    a, b = [], []
    while not seen.all():
        front = np.array([np.flatnonzero(~seen)[0]])
        seen[front] = True
        while len(front):
            i = front[0]
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            a.append(np.full(len(new), i))
            b.append(new)
            front = np.r_[front[1:], new]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def verified(need: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among the documents of each cell of ``need`` (cell, task, doc_id, hub).

    With a hub: of it with the others only; without (null): a spanning forest of all links.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                values, bounds = shingle_sets(*text_bytes(batch.column("text")), words)
                raw = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "task", "doc_id", "hub")), pa.array(raw, pa.binary())], ["cell", "task", "doc_id", "hub", "raw"])

    def links(key, table):
        doc, hub = table["doc_id"].to_numpy(), table["hub"][0].as_py()
        found = [np.frombuffer(r.as_py(), "<u8") for r in table["raw"]]
        if hub is None:
            a, b = compare(found, doc, percent)
            a, b = doc[a], doc[b]
            a, b = np.minimum(a, b), np.maximum(a, b)
        else:
            b = []
            for own in (found[i] for i in np.flatnonzero(doc == hub)):
                for i in np.flatnonzero(doc != hub):
                    other = found[i]
                    if len(own) and len(other) and 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                        same = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                        if 100 * same >= percent * (len(own) + len(other) - same):
                            b.append(doc[i])
            a, b = np.full(len(b), hub), np.array(b, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = _by_id(docs, durable(need), "inner").select("cell", "task", "doc_id", "hub", "text").mapInArrow(sets, "cell long, task long, doc_id long, hub long, raw binary")
    return durable(rows.groupBy("cell", "task").applyInArrow(links, "a long, b long"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included).

    Two rows link if 100 * intersection >= percent * union of their shingle sets. Null or wordless
    texts have no shingles and link with nothing. A row with a null key takes no part: its
    component_id is null. Rows that repeat a key are one node. Texts of any length are taken whole.
    Other columns are ignored. No rows: no rows. Keys are integers (else a TypeError), since the
    smallest one names a component. Shingles are known by 64-bit hashes, equal sets by 128 bits:
    a collision would count two different shingles as one.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} isn't a column of integers")
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    table = durable(set_table(docs, words))
    many = hot_limit(table.count())
    linked, alone = table.where("n_shingles > 0 and doc_id is not null"), table.where("n_shingles = 0 or doc_id is null")
    classes = durable(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    large = classes.where(F.col("copies") > many)
    own = durable(hot_join(linked.select("doc_id", "n_shingles", "sketch", "h1", "h2"), classes, ["h1", "h2"], large, "inner").select("doc_id", "n_shingles", "sketch", "rep"))
    # Documents of which every row is a copy of an earlier one are left out; a repeated key ties its classes together.
    copies = durable(own.groupBy("doc_id").agg(F.max("rep").alias("most")).where("most < doc_id").select("doc_id"))
    usable = _by_id(docs.where("doc_id is not null"), copies, "left_anti")
    ties = own.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    repeated = table.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("b"))
    ties = ties.join(repeated, "b", "left_semi").select("a", "b")
    buckets = max(4, parts(spark))
    entries = groups(usable, words, percent, buckets)
    home, hot = homes(entries, many)
    sets = own.select("doc_id", "n_shingles", "sketch")
    hubs = sets.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("hub_shingles"), F.col("sketch").alias("hub_sketch"))
    pairs = hot_join(home.where("doc_id <> hub").join(sets, "doc_id"), hubs, ["hub"], hot, "inner")
    members = durable(plausible(pairs, percent).distinct().select(F.col("hub").alias("cell"), "task", "doc_id", "hub"))
    centres = members.select("cell", "task").distinct().select("cell", "task", F.col("cell").alias("doc_id"), F.col("cell").alias("hub"))
    links = durable(verified(members.unionByName(centres), docs, words, percent).unionByName(ties))
    roots = durable(components(links))
    places = home.join(roots, home.doc_id == roots.node, "left").select(F.col("doc_id").alias("node"), F.coalesce("root", "doc_id").alias("root"), F.xxhash64("hub", "task").alias("block"))
    left = durable(promising(cells(entries, places, buckets).join(sets, "doc_id"), percent))
    left = left.select("cell", F.lit(0).cast("long").alias("task"), "doc_id", F.lit(None).cast("long").alias("hub"))
    links = durable(links.unionByName(verified(left, docs, words, percent)))
    roots = durable(components(links).select(F.col("node").alias("rep"), "root"))
    out = hot_join(own.drop("sketch"), roots, ["rep"], large.select("rep"), "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
