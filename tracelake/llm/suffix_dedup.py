"""Removal of byte strings that an earlier document holds (operator 5): a distributed, hash-compared suffix sort.

**Anchors.** Sorting every suffix would move the corpus many times over. Each window of ``length``
bytes is filed under the least (by hash) of its ``gram``-byte strings, its anchor, so equal windows
share an anchor at the same place in the window; consecutive windows with one anchor are a run,
and a run's bytes are its segment. One run travels per 16 bytes of text or so.

**Whole runs.** Runs with equal anchor and equal segment, by prefix polynomial hashes of either base,
are taken for equal throughout: those of all but the smallest document are claims on its bytes. A
document's claims that go on in the same owner are joined, the owner's bytes are fetched, a
stretch once for each bucket, and every claim is compared byte by byte before anything is removed. If
a collision made a false claim, the whole is done again with other hashes.

**Suffix sort.** Where one anchor has different segments (the edges of copies), the segments'
bytes are fetched and their suffixes of ``length`` bytes sorted: a bottom-up mergesort, all runs of
all groups at once, whose comparisons find the common extension of two suffixes by binary search
over prefix polynomial hashes. Neighbours that the hashes call equal are compared byte by byte,
and each class of equal suffixes is owned by its smallest document.

A document is told from others with its id by its text's crc32, so repeated ids don't mix.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracelake.llm.common import POWERS_A, POWERS_B, PrefixHash, Powers, arrow_rows, durable, mix, parts, text_bytes
from tracelake.llm.packed import MESSAGE, firsts, message_rows, messages, of_kind, table_of, unsqueezed

GRAM, BATCH, PIECE = 20, 1 << 20, 4 << 20
#: Segments that are sorted at a time; a larger group of one anchor is sorted whole.
SORTED = 8192
#: Bytes of text that a bucket is for, about.
BUCKET = 64 << 20
#: The bases of the attempts' hashes, of anchors and of segments.
SALTED = [(POWERS_A, POWERS_B), (Powers(0xC2B2AE3D27D4EB4F), Powers(0x165667B19E3779F9)), (Powers(0x27D4EB2F165667C5), Powers(0x85EBCA77C2B2AE63))]
LOW32 = np.uint64(0xFFFFFFFF)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, salt: int = 0, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First window, last window, anchor's place, anchor's hash and segment's hash of every run."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchors, segments = SALTED[salt % len(SALTED)]
    prefix = PrefixHash(data, anchors)
    places = np.arange(len(data) - gram + 1)
    grams = prefix.hash(places, places + gram)
    bits = np.uint64(25)  # places within a piece of at most 32 MB
    least = (grams >> bits << bits) | places.astype(np.uint64)
    window, span = length - gram + 1, 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    valid = np.ones(len(least), bool)
    row = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    valid &= np.arange(len(least)) + length <= offsets[row + 1]
    first = np.flatnonzero(valid)
    if not len(first):
        return runs(data[:0], offsets[:1], length, salt, gram)
    anchor = (least[first] & np.uint64((1 << 25) - 1)).astype(np.int64)
    new = firsts(anchor)
    new[1:] |= first[1:] != first[:-1] + 1
    start = np.flatnonzero(new)
    a, b = first[start], first[np.r_[start[1:], len(first)] - 1]
    anchor = anchor[start]
    segment = mix(PrefixHash(data, segments).hash(a, b + length) + (anchor - a).astype(np.uint64))
    return a, b, anchor, grams[anchor], segment


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """The data in pieces of a bounded size that overlap by one window less a byte: (offset, data, offsets)."""
    for at in range(0, max(1, len(data)), PIECE):
        end = min(len(data), at + PIECE + length - 1)
        yield at, data[at:end], np.unique(np.clip(np.r_[0, offsets - at, end - at], 0, end - at))


def _owned(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by ``keys`` then doc, whether each entry in it is its key's first, and which entry that is."""
    order = np.lexsort((doc, *keys[::-1]))
    new = firsts(*(k[order] for k in keys))
    return order, new, order[np.flatnonzero(new)][np.cumsum(new) - 1]


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The suffixes of ``length`` bytes at ``starts`` in lexicographic order within each group (groups ascending, stable)."""
    prefix = PrefixHash(data, POWERS_A)

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = prefix.raw(a, a + mid) == prefix.raw(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """a < b, or (``ties``) a <= b."""
        n = extension(a, b)
        last = np.minimum(n, length - 1)
        return np.where(n == length, ties, data[a + last] < data[b + last])

    order = np.argsort(group, kind="stable")
    g = group[order]
    begin = np.flatnonzero(firsts(g))
    size = np.diff(np.r_[begin, len(g)])
    base, total = np.repeat(begin, size), np.repeat(size, size)
    index = np.arange(len(g)) - base
    width = 1
    while width < size.max(initial=0):
        active = np.flatnonzero(total > width)
        i, b0, t = index[active], base[active], total[active]
        mine = i // width
        other = mine ^ 1
        low = np.minimum(other * width, t)
        high = np.minimum(other * width + width, t)
        origin, right = low.copy(), mine % 2 == 1
        here = starts[order[active]]
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) // 2
            # The sibling's element goes first if it is smaller, or equal and from the left run.
            first = before(starts[order[b0[open_] + mid]], here[open_], right[open_])
            low[open_] = np.where(first, mid + 1, low[open_])
            high[open_] = np.where(first, high[open_], mid)
        to = b0 + (np.minimum(mine, other) * width) + (i - mine * width) + (low - origin)
        merged = order.copy()
        merged[to] = order[active]
        order, width = merged, width * 2
    return order


def shared_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes of ``length`` bytes equal one of their group that is of a smaller doc."""
    out = np.zeros(len(starts), bool)
    whole = PrefixHash(data, POWERS_B).hash(starts, starts + length)
    order = np.lexsort((whole, group))
    same = ~firsts(group[order], whole[order])
    some = np.zeros(len(starts), bool)
    some[order[same]] = True
    some[order[np.flatnonzero(same) - 1]] = True  # the others have no equal
    some = np.flatnonzero(some)
    order = some[suffix_order(data, starts[some], group[some], length)]
    new = firsts(group[order])
    # Neighbours that the hashes call equal are compared byte by byte.
    a, b = starts[order[1:]], starts[order[:-1]]
    close = np.flatnonzero(~new[1:] & (whole[order[1:]] == whole[order[:-1]]))
    equal = np.zeros(len(a), bool)
    for part in np.array_split(close, max(1, len(close) // 20_000)):
        offsets = np.arange(length)
        equal[part] = (data[a[part][:, None] + offsets] == data[b[part][:, None] + offsets]).all(axis=1)
    new[1:] |= ~equal
    begin = np.flatnonzero(new)
    if len(begin):
        owner = np.minimum.reduceat(doc[order], begin)[np.cumsum(new) - 1]
        out[order] = owner < doc[order]
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover; ranges that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.r_[at[1:], len(end)] - 1] if len(end) else end


#: What travels between the steps of a bucket, and its columns.
RUN, CLAIM, EDGE, REQUEST, BYTES, RANGE, SORT = range(7)
KINDS = {
    RUN: ("<u4", "<u4", "<u2", "<i8", "<u4", "<u4", "<u2"),  # anchor, segment (low, high), doc, crc of its text, start, shape
    CLAIM: ("<i8", "<u4", "<u4", "<u4", "<i8", "<u4", "<u4"),  # doc, crc, start, end; owner, its crc, its start
    EDGE: ("<i8", "<u4", "<u4", "<u2", "<u8"),  # doc, crc, start, shape, group
    REQUEST: ("<i8", "<u4", "<u4", "<u4", "<u4"),  # owner, its crc, start, length; the bucket that asks
    RANGE: ("<i8", "<u4", "<u4", "<u4"),  # doc, crc, start, end
}


def _windows(shape: np.ndarray) -> np.ndarray:
    return (shape >> 8).astype(np.int64) + 1


class Exchange:
    """What each step does with a bucket's entries. ``n`` buckets; ``salt``: which hashes, ``bits`` of a segment's count."""

    def __init__(self, n: int, length: int, salt: int, bits: int):
        self.n, self.un, self.length, self.salt, self.mask = n, np.uint64(n), length, salt, np.uint64((1 << bits) - 1)

    def of(self, doc: np.ndarray) -> np.ndarray:
        return (mix(doc.astype(np.uint64)) % self.un).astype(np.int64)

    def claims(self, mine: np.ndarray, owner: np.ndarray, doc, crc, start, shape) -> Iterator[pa.RecordBatch]:
        """Runs that equal an earlier document's by their hashes."""
        end = (start[mine] + (shape[mine] >> 8) + self.length).astype("<u4")
        yield from messages(CLAIM, self.of(doc[mine]), self.n, doc[mine], crc[mine], start[mine], end, doc[owner], crc[owner], start[owner])

    def file(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, un = self.length, self.un
        for lot in (part for whole in batches for part in arrow_rows(whole, 8 * BATCH)):
            found = []
            for batch in arrow_rows(lot, BATCH):
                data, offsets = text_bytes(batch.column(1))
                ids = batch.column(0).to_numpy()
                crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], "<u4")
                for at, piece, cuts in pieces(data, offsets, length):
                    a, b, anchor, gram, segment = runs(piece, cuts, length, self.salt)
                    row = np.searchsorted(offsets, a + at, "right") - 1
                    shape = ((b - a) << 8 | (anchor - a)).astype("<u2")
                    found.append((gram, segment & self.mask, ids[row], crc[row], (a + at - offsets[row]).astype("<u4"), shape))
            if not found:
                continue
            gram, segment, doc, crc, start, shape = (np.concatenate(c) for c in zip(*found, strict=True))
            order, _, first = _owned([gram, segment], doc)
            earlier = doc[first] < doc[order]
            yield from self.claims(order[earlier], first[earlier], doc, crc, start, shape)
            rest = np.sort(order[~earlier])
            gram, segment = gram[rest], segment[rest]
            low, high = (segment & LOW32).astype("<u4"), (segment >> np.uint64(32)).astype("<u2")
            yield from messages(RUN, gram % un, self.n, ((gram // un) & LOW32).astype("<u4"), low, high, doc[rest], crc[rest], start[rest], shape[rest])

    def settle(self, bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Claims of runs with equal hashes; and the edges: of anchors with several segments, each segment of its smallest document."""
        claimed = of_kind(table, CLAIM)
        if len(claimed):
            yield message_rows(CLAIM, pa.array(np.full(len(claimed), bucket), pa.int32()), claimed.combine_chunks())
        gram, low, high, doc, crc, start, shape = unsqueezed(of_kind(table, RUN), *KINDS[RUN])
        order, new, first = _owned([gram, low, high], doc)
        earlier = doc[first] < doc[order]
        yield from self.claims(order[earlier], first[earlier], doc, crc, start, shape)
        g = gram[order]
        begin = np.flatnonzero(firsts(g))
        kinds = np.add.reduceat(new.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        mixed = np.repeat(kinds > 1, np.diff(np.r_[begin, len(g)]))
        ask = order[mixed & ~earlier]
        yield from messages(EDGE, self.of(doc[ask]), self.n, doc[ask], crc[ask], start[ask], shape[ask], gram[ask].astype("<u8") * self.un + np.uint64(bucket))

    def join(self, bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """A document's claims that go on in the same owner are one; each different stretch of an owner is asked for once by a bucket."""
        doc, crc, start, end, owner, owner_crc, at = unsqueezed(of_kind(table, CLAIM), *KINDS[CLAIM])
        shift = at.astype(np.int64) - start
        order = np.lexsort((start, shift, owner_crc, owner, crc, doc))
        doc, crc, start, end, owner, owner_crc, shift = (c[order] for c in (doc, crc, start, end, owner, owner_crc, shift))
        new = firsts(doc, crc, owner, owner_crc, shift)
        if len(new):
            new[1:] |= start[1:] > end[:-1]  # of one shift, ends rise with starts
        head = np.flatnonzero(new)
        last = np.maximum.reduceat(end, head) if len(head) else end
        doc, crc, start, owner, owner_crc, shift = (c[head] for c in (doc, crc, start, owner, owner_crc, shift))
        at = (start + shift).astype("<u4")
        yield from messages(CLAIM, np.full(len(doc), bucket), self.n, doc, crc, start, last, owner, owner_crc, at)
        size = (last - start).astype("<u4")
        order = np.lexsort((size, at, owner_crc, owner))
        one = order[firsts(*(c[order] for c in (owner, owner_crc, at, size)))]
        yield from messages(REQUEST, self.of(owner[one]), self.n, owner[one], owner_crc[one], at[one], size[one], np.full(len(one), bucket, "<u4"))

    def fetch(self, packed: pa.Table, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The bytes of a bucket's documents: of edges, for the sort, and of requested stretches, for who asks."""
        width = 2 * self.length
        doc, crc, start, shape, group = _by_doc(unsqueezed(of_kind(table, EDGE), *KINDS[EDGE]))
        owner, owner_crc, at, size, asker = _by_doc(unsqueezed(of_kind(table, REQUEST), *KINDS[REQUEST]))
        edges, answers = [], defaultdict(list)
        for id_, data in _texts(packed):
            own = zlib.crc32(data)
            a, b = np.searchsorted(doc, [id_, id_ + 1])
            mine = a + np.flatnonzero(crc[a:b] == own)
            if len(mine):
                bytes_ = np.frombuffer(data, np.uint8)
                place = start[mine].astype(np.int64)[:, None] + np.arange(width)
                edges.append((mine, np.where(place < len(bytes_), bytes_[np.minimum(place, len(bytes_) - 1)], 0).astype("u1")))
            a, b = np.searchsorted(owner, [id_, id_ + 1])
            for i in (a + np.flatnonzero(owner_crc[a:b] == own)).tolist():
                answers[int(asker[i])].append((id_, own, int(at[i]), data[at[i] : at[i] + size[i]]))
        if edges:
            mine, bytes_ = (np.concatenate(c) for c in zip(*edges, strict=True))
            raw = np.ascontiguousarray(bytes_).view(f"V{width}").ravel()
            yield from messages(SORT, mix(group[mine]) % self.un, self.n, group[mine], doc[mine], crc[mine], start[mine], shape[mine], raw)
        pack = zstandard.ZstdCompressor(level=1)
        for to, found in answers.items():
            heads = np.array([(d, c, s, len(x)) for d, c, s, x in found], "<i8").tobytes()
            raw = pack.compress(len(found).to_bytes(8, "little") + heads + b"".join(x for *_, x in found))
            yield message_rows(BYTES, pa.array([to], pa.int32()), pa.array([raw], pa.binary()))

    def sort(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, doc, crc, start, shape, raw = unsqueezed(of_kind(table, SORT), "<u8", "<i8", "<u4", "<u4", "<u2", f"V{2 * self.length}")
        order = np.argsort(group, kind="stable")
        ends = np.r_[np.flatnonzero(np.diff(group[order])) + 1, len(order)]
        cut = 0
        while cut < len(order):  # some whole groups at a time
            end = int(ends[np.searchsorted(ends, min(cut + SORTED, len(order)))])
            yield from self.sort_part(*(c[order[cut:end]] for c in (group, doc, crc, start, shape, raw)))
            cut = end

    def sort_part(self, group, doc, crc, start, shape, raw) -> Iterator[pa.RecordBatch]:
        data, width = np.frombuffer(raw.tobytes(), np.uint8), 2 * self.length
        windows = _windows(shape)
        of = np.repeat(np.arange(len(doc)), windows)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = (shape[of] & 255).astype(np.int64) - nth  # of the anchor in the window
        _, pre = np.unique(group[of] * np.uint64(256) + place.astype(np.uint64), return_inverse=True)
        gone = shared_windows(data, of * width + nth, pre, doc[of], self.length)
        of, at = of[gone], (start[of] + nth)[gone].astype("<u4")
        # Consecutive windows are one range.
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        of, begin, end = of[head], at[head], at[np.r_[head[1:], len(at)] - 1] + self.length if len(at) else at
        yield from messages(RANGE, self.of(doc[of]), self.n, doc[of], crc[of], begin, end.astype("<u4"))

    def cut(self, packed: pa.Table, table: pa.Table, return_text: bool) -> pa.Table:
        """The rows of the result; a claim counts if its owner's bytes are the same, else the row's n_false says so."""
        doc, crc, start, end, owner, owner_crc, at = _by_doc(unsqueezed(of_kind(table, CLAIM), *KINDS[CLAIM]))
        ranges = _by_doc(unsqueezed(of_kind(table, RANGE), *KINDS[RANGE]))
        held, unpack = {}, zstandard.ZstdDecompressor()
        for raw in of_kind(table, BYTES):
            raw = unpack.decompress(raw.as_py())
            n = int.from_bytes(raw[:8], "little")
            place = 8 + 32 * n
            for d, c, s, size in np.frombuffer(raw, "<i8", 4 * n, 8).reshape(-1, 4).tolist():
                held[d, c, s, size] = raw[place : place + size]
                place += size
        out = []
        for id_, raw in _texts(packed, nulls=True):
            own, spans, false = zlib.crc32(raw), [], 0
            if id_ is not None:
                a, b = np.searchsorted(doc, [id_, id_ + 1])
                for i in (a + np.flatnonzero(crc[a:b] == own)).tolist():
                    x, y = int(start[i]), int(end[i])
                    if held.get((int(owner[i]), int(owner_crc[i]), int(at[i]), y - x)) == raw[x:y]:
                        spans.append((x, y))
                    else:
                        false += 1
                a, b = np.searchsorted(ranges[0], [id_, id_ + 1])
                some = a + np.flatnonzero(ranges[1][a:b] == own)
                spans += zip(ranges[2][some].tolist(), ranges[3][some].tolist(), strict=True)
            s, e = merged(*np.array(spans, np.int64).reshape(-1, 2).T)
            kept = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
            out.append((id_, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept if return_text else None, false))
        rows = list(zip(*out, strict=True)) or [[]] * 7
        return pa.table({c: pa.array(r, t) for (c, t), r in zip(RESULT.items(), rows, strict=True)})


RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "n_false": pa.int64()}


def _by_doc(columns_: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns_[0], kind="stable")
    return [c[order] for c in columns_]


def _texts(packed: pa.Table, nulls: bool = False) -> Iterator[tuple]:
    unpack = zstandard.ZstdDecompressor()
    for id_, raw in zip(packed["doc_id"].to_pylist(), packed["packed"], strict=True):
        if nulls or id_ is not None:
            yield id_, unpack.decompress(raw.as_py())


def remove_repeats(
    docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", return_text: bool = False, segment_bits: tuple[int, ...] = (48, 48, 48)
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary) per row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts in a row with a smaller
    id, judged on the input. Null and empty texts: 0 bytes, none removed. Texts of any length are
    taken whole. Rows with a null key lose nothing and take nothing; rows that share a key take
    nothing from each other. Other columns are ignored. No rows: no rows. Keys are integers (else
    a TypeError) and ``length`` from GRAM + 1 to GRAM + 255. ``segment_bits``: of the hashes of whole
    runs, in each attempt; an attempt that a collision spoils is followed by the next, with other hashes.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} isn't a column of integers")
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length {length} isn't between {GRAM + 1} and {GRAM + 255}")
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, parts(docs.sparkSession), -(-size // BUCKET))
    for salt, bits in enumerate(segment_bits):
        found = durable(_attempt(docs, Exchange(n, length, salt, bits), return_text))
        if found.where("n_false > 0").isEmpty():
            return found.drop("n_false") if return_text else found.drop("n_false", "kept")
    raise RuntimeError("every attempt met a collision")


def _attempt(docs: DataFrame, x: Exchange, return_text: bool) -> DataFrame:
    def grouped(df: DataFrame, reduce) -> DataFrame:
        return df.groupBy("bucket").applyInArrow(lambda key, table: table_of(reduce(key[0].as_py(), table), MESSAGE), MESSAGE)

    kinds = lambda df, *some: df.where(F.col("kind").isin(*some))
    first = durable(grouped(docs.where("doc_id is not null").mapInArrow(x.file, MESSAGE), x.settle))
    claims = durable(grouped(kinds(first, CLAIM), x.join))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                texts = [pack.compress((t.as_py() or "").encode()) for t in batch.column(1)]
                bucket = x.of(batch.column(0).fill_null(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), batch.column(0), pa.array(texts, pa.binary())], ["bucket", "doc_id", "packed"])

    texts = docs.mapInArrow(squeeze, "bucket int, doc_id long, packed binary").groupBy("bucket")
    asked = kinds(first, EDGE).unionByName(kinds(claims, REQUEST)).groupBy("bucket")
    fetched = durable(texts.cogroup(asked).applyInArrow(lambda _, packed, table: table_of(x.fetch(packed, table), MESSAGE), MESSAGE))
    sorted_ = durable(grouped(kinds(fetched, SORT), lambda _, table: x.sort(table)))
    known = kinds(claims, CLAIM).unionByName(kinds(fetched, BYTES)).unionByName(sorted_).groupBy("bucket")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_false long"
    return texts.cogroup(known).applyInArrow(lambda _, packed, table: x.cut(packed, table, return_text), schema)
