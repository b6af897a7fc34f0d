"""Benchmark decontamination by latent semantic retrieval (operator 9).

1. **Passages.** Texts are cut into passages of ``2 * STEP`` words, a new one every ``STEP`` words.
   Words are hashed to ``TERMS`` terms; a passage's vector is its TF-IDF sum, with document
   frequencies counted over all texts.
2. **Randomised SVD.** With A the matrix of all steps of passages, Y = (A'A) G is gathered in one
   distributed pass for a random G, together with the document frequencies; with Q an orthonormal basis of Y, B = Q'(A'A)Q follows from
   B (Q'G) = Q'Y, and its eigenvectors give the leading right singular vectors. The first
   ``COMMON`` of them tell languages and function words apart and are left out. What is gathered
   has a fixed size, TERMS x RANK.
3. **Candidates.** Passages and benchmark items are compared by the cosine of their latent vectors;
   a passage goes on with its items above ``COSINE`` if it shares enough of their rarer terms.
4. **Exact candidates.** The latent search can miss, so a second path adds every document that can pass
   the checks. Who holds k of an item's m words in order holds t of any m - k + t of them: the
   rarest are looked up, and t within a window are asked for. Documents with the item's answer
   (its last words) in place are candidates too.
5. **Checks.** The longest common subsequence of words of the item and of a window of the document, a
   quarter longer than the item, and the answer within the same window decide: coverage of
   at least ``STRICT``, or of ``LOOSE`` with the answer found in place. Every window that
   starts at one of the item's words counts, so the result depends on no candidate's place.

The benchmark is broadcast in blocks of about ``ITEMS`` items, each searched by a pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_rows, durable, mix, text_bytes
from tracelake.llm.packed import within
from tracelake.llm.shingles import words

TERMS, RANK, COMMON, STEP = 1 << 13, 44, 14, 16
COSINE, STRICT, LOOSE, ANSWER = 0.4, 0.6, 0.5, 3
#: Terms in a larger share of the texts don't count for the quick test of a candidate.
RARE = 0.08
#: Hits asked for among an item's rarest words, as a share of its words; any share finds the same.
HITS = 0.15
#: Bits of the bitmaps that settle most lookups of words.
BITMAP = 20
#: Items in a block: about 8 KB each in a worker.
ITEMS = 4_000
BATCH = 1 << 20


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word hash and term of every word, case and stops at its end aside."""
    starts, ends, rows, hashes = words(data, offsets)
    return rows, hashes, (mix(hashes + np.uint64(5)) >> np.uint64(40)).astype(np.int64) % TERMS


def steps_of(rows: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of every step of STEP words, the step's row, and whether a passage starts there (a text's last step ends the one before)."""
    count = np.bincount(rows, minlength=texts)
    begin = np.cumsum(count) - count
    steps = -(-count // STEP)
    row = np.repeat(np.arange(texts), steps)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
    starts = (nth == 0) | (nth < (steps - 1)[row])
    return begin[row] + nth * STEP, row, starts


def summed(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of ``table[rows]`` over the runs of rows that begin at ``first``, the nth row of all runs at once; long runs in pieces of STEP."""
    n = np.diff(np.r_[first, len(rows)])
    if n.max(initial=0) > STEP:
        pieces = -(-n // STEP)
        begin = np.cumsum(pieces) - pieces
        part = summed(table, rows, np.repeat(first, pieces) + STEP * (np.arange(pieces.sum()) - np.repeat(begin, pieces)))
        return summed(part, np.arange(len(part)), begin)
    order = np.argsort(-n, kind="stable")  # the longest first, so that those with an nth row come first
    start, longer = first[order], len(n) - np.cumsum(np.bincount(n, minlength=STEP + 1))
    sums = table[rows[start]]
    for j in range(1, n.max(initial=0)):
        sums[: longer[j]] += table[rows[start[: longer[j]] + j]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def vectors(term: np.ndarray, first: np.ndarray, starts: np.ndarray, row: np.ndarray, weighed: np.ndarray) -> np.ndarray:
    """Each passage's sum of ``weighed`` (TERMS x k) over its words."""
    if not len(first):
        return np.zeros((0, weighed.shape[1]), np.float32)
    sums = summed(weighed, term, first)
    both = sums.copy()
    both[:-1] += np.where((row[1:] == row[:-1])[:, None], sums[1:], 0)
    return both[starts]


def longest(full: int, masks: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time (Python's integers): of a sequence, ``full``'s bits, and another, the bits at which each of its words is in the first."""
    v = full
    for x in masks:
        u = v & x
        v = ((v + u) | (v - u)) & full
    return full.bit_length() - v.bit_count()


def bits(words: list) -> dict:
    """The bits of each word's places."""
    places: dict = {}
    for i, x in enumerate(words):
        places[x] = places.get(x, 0) | (1 << i)
    return places


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    places = bits(a)
    return longest((1 << len(a)) - 1, [places[x] for x in b if x in places])


def leaked(item: list, text: list, strict: float = STRICT, loose: float = LOOSE) -> bool:
    """The rule: whether ``text`` (a window's words) holds the item, by coverage, or by less of it with its answer. ``cover`` applies it to all windows."""
    n = common(item, text)
    answer = item[-ANSWER:]
    return n >= strict * len(item) or n >= loose * len(item) and any(text[i : i + len(answer)] == answer for i in range(len(text) - len(answer) + 1))


def answers_in(answer: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The places of ``text`` at which ``answer`` begins."""
    n = max(0, len(text) - len(answer) + 1)
    return np.flatnonzero(np.logical_and.reduce([text[j : j + n] == x for j, x in enumerate(answer)]))


def cover(item: list, text: np.ndarray, strict: float = STRICT, loose: float = LOOSE) -> float:
    """The best coverage among the windows of ``text`` that hold the item, by enough of it or by less of it with its answer; 0 if none does."""
    m = len(item)
    if not m:
        return 0.0
    whole = np.array(item, np.uint64)
    known, many = np.unique(whole, return_counts=True)
    at, found = within(text, known)
    places, word = np.flatnonzero(found), at[found]
    n, nth = len(places), np.arange(len(places))
    if not n:
        return 0.0
    end = np.searchsorted(places, places + m + m // 4)
    # As many words as can be common: in the window from each of them on a word counts as often as the item has it, so one
    # counts only for windows that begin after the place so many of its like before it.
    order = np.argsort(word, kind="stable")
    back = np.arange(n) - many[word[order]]
    same = (back >= 0) & (word[order[np.maximum(back, 0)]] == word[order])
    after = np.zeros(n, np.int64)
    after[order[same]] = order[back[same]] + 1
    counts = np.zeros(n + 1, np.int64)
    np.add.at(counts, np.maximum(after, np.searchsorted(end, nth, "right")), 1)
    most = np.cumsum(counts[:n]) - nth
    hits = answers_in(whole[-ANSWER:], text) + min(ANSWER, m)
    last = np.minimum(places + m + m // 4, len(text))
    holds = np.searchsorted(hits, last, "right") > np.searchsorted(hits, places + min(ANSWER, m))
    able = (most >= strict * m) | (holds & (most >= loose * m))
    able = np.flatnonzero(able)
    if not len(able):
        return 0.0
    of = bits(item)
    full, best, masks = (1 << m) - 1, 0, [of[x] for x in known[word].tolist()]
    for i in able[np.argsort(-most[able], kind="stable")].tolist():
        if most[i] <= best or best == m:
            break
        got = longest(full, masks[i : end[i]])
        if got > best and (got >= strict * m or (holds[i] and got >= loose * m)):
            best = got
    return best / m


class Exact:
    """The documents that can pass the checks, by an item's rarest words or its answer."""

    def __init__(self, items: list[list], rarity: list[np.ndarray], strict: float):
        word, owner, need, span, answers, answered = [], [], [], [], [], []
        for i, (item, rare) in enumerate(zip(items, rarity, strict=True)):
            m = len(item)
            k = max(1, int(np.ceil(strict * m - 1e-9)))
            t = min(k, max(1, int(HITS * m)))
            rarest = {item[j] for j in np.argsort(rare, kind="stable")[: max(0, m - k + t)].tolist()}
            word += rarest
            owner += [i] * len(rarest)
            need.append(t)
            span.append(m + m // 4)
            if m >= ANSWER:
                answers.append(self.joined(np.array(item[-ANSWER:], np.uint64))[0])
                answered.append(i)
        self.need, self.span = np.array(need, np.int64), np.array(span, np.int64)
        self.words, self.answers = self.index(word, owner), self.index(answers, answered)

    @staticmethod
    def joined(hashes: np.ndarray) -> np.ndarray:
        """A hash of the ANSWER words from each place on."""
        n = max(0, len(hashes) - ANSWER + 1)
        out = np.zeros(n, np.uint64)
        for j in range(ANSWER):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        return out

    @staticmethod
    def index(keys: list, owner: list) -> tuple[np.ndarray, ...]:
        keys, owner = np.array(keys, np.uint64), np.array(owner, np.int64)
        order = np.argsort(keys, kind="stable")
        known, start = np.unique(keys[order], return_index=True)
        maybe = np.zeros(1 << BITMAP, bool)
        maybe[known >> np.uint64(64 - BITMAP)] = True
        return maybe, known, np.r_[start, len(keys)], owner[order]

    @staticmethod
    def hits(keys: np.ndarray, index: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Place and owner of every key that the index holds, by place."""
        maybe, known, start, owner = index
        place = np.flatnonzero(maybe[keys >> np.uint64(64 - BITMAP)])
        at, found = within(keys[place], known)
        place, at = place[found], at[found]
        many = start[at + 1] - start[at] if len(at) else at
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(place, many), owner[np.repeat(start[at], many) + nth]

    def pairs(self, rows: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of every candidate."""
        place, item = self.hits(hashes, self.words)
        order = np.argsort(item, kind="stable")
        place, item = place[order], item[order]
        last = np.arange(len(place)) + self.need[item] - 1
        fits = last < len(place)
        at, last = np.flatnonzero(fits), last[fits]
        near = (item[last] == item[at]) & (rows[place[last]] == rows[place[at]]) & (place[last] - place[at] < self.span[item[at]])
        found = set(zip(rows[place[at[near]]].tolist(), item[at[near]].tolist(), strict=True))
        place, item = self.hits(self.joined(hashes), self.answers)
        whole = rows[place] == rows[np.minimum(place + ANSWER - 1, len(rows) - 1)]
        return found | set(zip(rows[place[whole]].tolist(), item[whole].tolist(), strict=True))


def _gather(docs: DataFrame, per_batch, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``per_batch(data, offsets)`` over all texts: one row of a fixed size per partition, added up in rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                part = per_batch(*text_bytes(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel().astype(np.float32)
            for i, x in enumerate(np.array_split(flat, 16)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in table["sums"])
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(run, "piece int, sums binary").groupBy("piece").applyInArrow(add, "piece int, sums binary").toArrow().sort_by("piece")
    return np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in rows["sums"]]).reshape(shape) if rows.num_rows else np.zeros(shape)


def latent_terms(docs: DataFrame, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The idf-weighted right singular vectors (TERMS x RANK - COMMON, float32), which terms are rare, and in how many texts each is."""

    drawn = np.random.default_rng(seed).standard_normal((TERMS, RANK))
    weighed = drawn.astype(np.float32)

    def run(data, offsets):
        """Counts of steps' terms multiplied by their own product with the drawn matrix, and in a last column the texts that hold each term."""
        rows, _, term = terms_of(data, offsets)
        first, row, _ = steps_of(rows, len(offsets) - 1)
        out = np.zeros((TERMS, RANK + 1), np.float32)
        # Steps stand for the passages here: each word counts once.
        if not len(first):
            return out
        held = np.zeros((len(offsets) - 1, TERMS), bool)
        held[rows, term] = True
        out[:, RANK] = held.sum(axis=0)
        x = summed(weighed, term, first)
        step = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(term)]))
        order = np.argsort(term.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(term[order]) > 0])
        out[term[order[heads]], :RANK] = summed(x, step[order], heads)
        return out

    # A is the counts C times the idf D, so A'A G = D C'C D G. G is taken as what D makes the drawn matrix, so one pass gives both
    # C'C (D G) and the frequencies that D needs.
    total = _gather(docs, run, (TERMS, RANK + 1))
    df = total[:, RANK]
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    draw, y = drawn / idf[:, None], total[:, :RANK] * idf[:, None]
    q, _ = np.linalg.qr(y)
    b = (q.T @ y) @ np.linalg.pinv(q.T @ draw)
    _, turn = np.linalg.eigh((b + b.T) / 2)
    return (q @ turn[:, ::-1][:, COMMON:] * idf[:, None]).astype(np.float32), df < RARE * max(1, docs.count()), df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, strict: float = STRICT, loose: float = LOOSE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, coverage) of every document that holds a benchmark item, also reworded.

    ``coverage`` is the best of the windows that hold it. Null and empty texts and items hold nothing; texts
    of any length are searched as a whole. Rows with null ids match with a null id; ids are of any type.
    Items of fewer than 8 words are matched like any other. Repeated rows give repeated results. Other
    columns are ignored. Without documents or without items: no rows.
    """
    docs = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    fitted = latent_terms(docs)
    items, blocks = benchmark.select(benchmark[item_key].alias("item_id"), benchmark[item_text].alias("text")), -(-benchmark.count() // ITEMS)
    item_kind = items.schema["item_id"].dataType.simpleString()
    if blocks <= 1:
        return _search(docs, items.toArrow(), item_kind, *fitted, cosine, strict, loose)
    dealt = durable(items.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
    found = (_search(docs, dealt.where(F.col("_block") == b).select("item_id", "text").toArrow(), item_kind, *fitted, cosine, strict, loose) for b in range(blocks))
    return reduce(DataFrame.unionByName, found)


def _search(docs: DataFrame, items: pa.Table, item_kind: str, latent: np.ndarray, rare: np.ndarray, df: np.ndarray, cosine: float, strict: float, loose: float) -> DataFrame:
    """``contaminated`` for one block of items."""
    kind, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema.field("item_id").type
    data, offsets = text_bytes(items["text"])
    rows, hashes, term = terms_of(data, offsets)
    item_words = [hashes[rows == i].tolist() for i in range(items.num_rows)]
    # An item is searched by its own passages, so that long items are found by any part.
    first, row, starts = steps_of(rows, items.num_rows)
    probe, owner = vectors(term, first, starts, row, latent), row[starts]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    probe = unit(probe)
    telling = np.zeros((items.num_rows, TERMS), bool)
    telling[rows, term] = True
    telling &= rare
    needed = np.ceil(0.3 * np.minimum(telling.sum(axis=1), 12))
    exact = Exact(item_words, [df[term[rows == i]] for i in range(items.num_rows)], strict)
    held = docs.sparkSession.sparkContext.broadcast((latent, probe, owner, item_words, items["item_id"].to_pylist(), telling, needed, exact))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, probe, owner, item_words, names, telling, needed, exact = held.value
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                rows, hashes, term = terms_of(*text_bytes(batch.column("text")))
                first, row, starts = steps_of(rows, batch.num_rows)
                found = exact.pairs(rows, hashes)
                if len(first) and len(probe):
                    x = unit(vectors(term, first, starts, row, latent))
                    at, of = first[starts], row[starts]
                    for low in range(0, len(x), 4096):
                        i, j = np.nonzero(x[low : low + 4096] @ probe.T >= cosine)
                        word = np.minimum(at[low + i][:, None] + np.arange(2 * STEP), len(term) - 1)
                        enough = telling[owner[j][:, None], term[word]].sum(axis=1) >= needed[owner[j]]
                        i, j = i[enough], j[enough]
                        found.update(zip(of[low + i].tolist(), owner[j].tolist(), strict=True))
                begin = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                out = []
                for r, item in sorted(found):
                    if best := cover(item_words[item], hashes[begin[r] : begin[r + 1]], strict, loose):
                        out.append((r, names[item], best))
                if out:
                    r, item, covered = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r, pa.int64())), pa.array(item, item_type), pa.array(covered, pa.float64())], ["doc_id", "item_id", "coverage"])

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, coverage double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """The rows without any benchmark item; ``key`` (a column of longs without nulls) says which row holds what."""
    found = durable(contaminated(docs.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct())
    few = found.count() <= 1_000_000
    return docs.join(F.broadcast(found) if few else found, key, "left_anti").select(docs.columns)
