"""Phrase collocation mining by pivot partitioning (operator 12), after MG-FSM.

**Words.** One pass counts the words of each language (``counts``). The frequent ones, by falling
frequency, are numbered: the smaller its rank, the more frequent a word. Ranks run over all languages
together, so a rank tells its language.

**Fragments.** A phrase belongs to its rarest word, the pivot, and an occurrence to the pivot's first place in it.
A second pass rewrites each place's surroundings for the word there as pivot: up to two words to the left
that are more frequent than it, up to two to the right that aren't rarer; rarer ones, and the ends of the
piece, cut. Equal fragments of a batch become one with a count. Fragments travel, packed, to the bucket of their
pivot, where every phrase that the pivot owns is counted and no other: no phrase is counted in two
buckets. A pivot with very many occurrences is dealt over several buckets by its fragments, and the
counts of its phrases are added up once more, by phrase.

**Broadcast, of bounded size.** The numbered words: ``HEAD`` and ``HEAD_BYTES`` at most. Where more words
are frequent, those beyond (all rarer than the numbered ones) aren't numbered: phrases that hold one of
them are counted as rows of their words, by a plain grouping. Such words are rare, so no group of it is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, arrow_rows, durable, mix, parts, text_bytes
from tracelake.llm.packed import firsts, regroup, squeezed, unsqueezed

HEAD, HEAD_BYTES = 2_000_000, 64 << 20
#: Bytes of text of a lot, bytes of text that a bucket is for, fragments that are looked at together, occurrences of a pivot in one bucket.
LOT, BUCKET, SLICE, SPLIT = 4 << 20, 64 << 20, 1 << 20, 1 << 20
#: Parts of a language that are ranked each before all.
DEALS = 32
NONE = np.uint32(0xFFFFFFFF)
#: 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
FRAGMENT = ("<i4", "<u4", "<u4", "<u4", "<u4", "<u4")  # pivot, second and first to the left, first and second to the right, times
PHRASE = ("<i4", "<u4", "<u4", "<i8")  # its words (the third NONE: there are two), times
ROWS = "lang string, w1 string, w2 string, w3 string, a long, f1 long, f2 long, f3 long"
ROW_TYPES = [pa.string()] * 4 + [pa.int64()] * 4


class Lot:
    """The words of some texts: ``which`` distinct (language, word) each is, and its piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("text"))
        kind = KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        row = np.searchsorted(offsets, starts, "right") - 1
        # Neither number falls from word to word, so their sum is the same for words of one piece only.
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[starts] + row
        bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
        letters = LOWER[data[kind == 0]]
        text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
        langs = batch.column("lang").dictionary_encode()
        code, lang = (np.asarray(x.indices, np.int64) for x in (text, langs))
        distinct, self.which, self.times = np.unique(code * max(1, len(langs.dictionary)) + lang[row], return_inverse=True, return_counts=True)
        self.lang = langs.dictionary.take(distinct % max(1, len(langs.dictionary))).cast(pa.string())
        self.word = text.dictionary.take(distinct // max(1, len(langs.dictionary))).cast(pa.string())
        self.langs, self.tokens = langs.dictionary, np.bincount(lang[row], minlength=len(langs.dictionary))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[Lot]:
    for whole in batches:
        for batch in arrow_rows(whole, LOT):
            yield Lot(batch)


def _counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, f of the words that occur ``least`` times or more, and a row without word with the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            yield pa.RecordBatch.from_arrays([lot.lang, lot.word, pa.array(lot.times.astype(np.int64))], ["lang", "word", "f"])
            yield pa.RecordBatch.from_arrays([lot.langs, pa.nulls(len(lot.langs), pa.string()), pa.array(lot.tokens.astype(np.int64))], ["lang", "word", "f"])

    found = docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return durable(found.where(F.col("word").isNull() | (F.col("f") >= least)))


class Head:
    """The numbered words. ``whole``: all other words are infrequent."""

    def __init__(self, words: pa.Table, whole: bool):
        words = words.take(pc.sort_indices(words, [("f", "descending"), ("lang", "ascending"), ("word", "ascending")]))
        self.lang, self.word = (words[c].combine_chunks().cast(pa.string()) for c in ("lang", "word"))
        self.f, self.whole = words["f"].to_numpy().astype(np.int64), whole
        self.salts = 1 + self.f // SPLIT

    def ranks(self, lot: Lot) -> np.ndarray:
        """Each distinct word's rank, or -1."""
        out = np.full(len(lot.word), -1, np.int64)
        for lang in lot.langs.to_pylist():
            mine, theirs = (np.flatnonzero(np.asarray(pc.equal(x, lang))) for x in (lot.lang, self.lang))
            at = pc.index_in(lot.word.take(mine), value_set=self.word.take(theirs)).fill_null(-1).to_numpy()
            out[mine] = np.where(at >= 0, theirs[np.maximum(at, 0)], -1) if len(theirs) else -1
        return out

    def rows(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, times: np.ndarray) -> list[pa.Array]:
        """Columns of ROWS for phrases of numbered words."""
        third = pa.array(z.astype(np.int64), mask=z == NONE)
        f3 = pa.array(self.f[np.where(z == NONE, 0, z)] if len(self.f) else z.astype(np.int64), mask=z == NONE)
        return [self.lang.take(x), *(self.word.take(c) for c in (x, y, third)), pa.array(times.astype(np.int64)), pa.array(self.f[x]), pa.array(self.f[y]), f3]


def fragments(rank: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """The columns of FRAGMENT for each word as pivot, equal ones together, by pivot; ``rank`` -1: no word of a phrase."""
    n = len(rank)
    padded, at = np.r_[-1, -1, rank, -1, -1], np.r_[-1, -1, piece, -1, -1]
    near = lambda d: np.where(at[2 + d : 2 + d + n] == piece, padded[2 + d : 2 + d + n], -1)
    left, right, right2, left2 = near(-1), near(1), near(2), near(-2)
    left = np.where(left < rank, left, -1)
    left2 = np.where((left >= 0) & (left2 < rank), left2, -1)
    right = np.where(right <= rank, right, -1)
    right2 = np.where((right >= 0) & (right2 <= rank), right2, -1)
    some = (rank >= 0) & ((left >= 0) | (right >= 0))
    found = [c[some].astype(np.int32).view(np.uint32) for c in (rank, left2, left, right, right2)]
    h = np.zeros(len(found[0]), np.uint64)
    for c in found[1:]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    order = np.lexsort((h, found[0]))  # equal ones side by side; only truly equal ones become one
    found = [c[order] for c in found]
    first = np.flatnonzero(firsts(*found))
    times = np.diff(np.r_[first, len(order)])
    return [found[0][first].view(np.int32), *(c[first] for c in found[1:]), times.astype("<u4")], h[order][first]


def phrases(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Words and number of all phrases that the pivots of some fragments own: those of two words, then of three."""
    pivot, left2, left, right, right2, times = columns
    pivot = pivot.view(np.uint32)
    for kinds in (((left, pivot), (pivot, right)), ((left2, left, pivot), (left, pivot, right), (pivot, right, right2))):
        found = []
        for kind in kinds:
            some = np.logical_and.reduce([c != NONE for c in kind])
            found.append([*(c[some] for c in kind), times[some]])
        *words, n = (np.concatenate(c) for c in zip(*found, strict=True))
        yield summed(*words, *([np.full(len(n), NONE)] if len(words) == 2 else []), n)


def summed(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct phrases and their numbers."""
    pair = x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)
    order = np.lexsort((z, pair))
    x, y, z = x[order], y[order], z[order]
    first = np.flatnonzero(firsts(x, y, z))
    total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return x[first], y[first], z[first], total


def _tail(lot: Lot, rank: np.ndarray) -> list[pa.Array]:
    """Columns of ROWS for the lot's phrases that hold a word without number."""
    which, piece, unknown = lot.which, lot.piece, rank[lot.which] < 0
    found = []
    for size in (2, 3):
        at = np.arange(max(0, len(which) - size + 1))
        at = at[(piece[at] == piece[at + size - 1]) & np.logical_or.reduce([unknown[at + i] for i in range(size)])]
        found.append([*(which[at + i] for i in range(size)), *([np.full(len(at), NONE, np.int64)] if size == 2 else []), np.ones(len(at), np.int64)])
    x, y, z, n = summed(*(np.concatenate(c) for c in zip(*found, strict=True)))
    third = pa.array(z, mask=z == NONE)
    nulls = [pa.nulls(len(x), pa.int64())] * 3
    return [lot.lang.take(x), lot.word.take(x), lot.word.take(y), lot.word.take(third), pa.array(n), *nulls]


def candidates(docs: DataFrame, words: DataFrame, least: int, head_words: int, head_bytes: int, buckets: int) -> DataFrame:
    """Rows of ROWS: phrases of two or three words that occur ``least`` times or more, and how often each of their words does."""
    spark = docs.sparkSession
    words = words.where("word is not null")
    size = F.octet_length("word") + F.octet_length("lang") + 16
    levels = words.groupBy(F.floor(F.log2("f")).alias("level")).agg(F.count("*"), F.sum(size)).collect()
    start, many, held = max((r[0] + 1 for r in levels), default=0), 0, 0
    for level, n, size_ in sorted(levels, reverse=True):
        if many + n > head_words or held + size_ > head_bytes:
            break
        start, many, held = level, many + n, held + size_
    whole = many == sum(r[1] for r in levels)
    head = Head(words.where(F.col("f") >= 1 << start).toArrow(), whole)
    given, n_buckets = spark.sparkContext.broadcast(head), np.uint64(buckets)
    split = bool((head.salts > 1).any())
    names = ["bucket", "blob", *(c.split()[0] for c in ROWS.split(", "))]
    empty = lambda n: [pa.nulls(n, t) for t in ROW_TYPES]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = given.value
        for lot in _lots(batches):
            rank = head.ranks(lot)
            columns, h = fragments(rank[lot.which], lot.piece)
            salt = h % head.salts[columns[0]].astype(np.uint64) if len(h) else h
            bucket = mix(columns[0].astype(np.uint64) + salt * np.uint64(0x9E3779B97F4A7C15)) % n_buckets
            for b in squeezed(bucket.astype(np.int32), buckets, *columns):
                yield pa.RecordBatch.from_arrays([*b.columns, *empty(b.num_rows)], names)
            if not head.whole:
                tail = _tail(lot, rank)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(tail[0]), pa.int32()), pa.nulls(len(tail[0]), pa.binary()), *tail], names)

    def mine(_, blobs) -> Iterator[pa.RecordBatch]:
        head = given.value
        columns = unsqueezed(blobs, *FRAGMENT)
        lots = -(-len(columns[0]) // SLICE)
        lot = mix(columns[0].astype(np.uint64) + np.uint64(1)) % np.uint64(max(1, lots))
        for k in range(lots):
            mine_ = lot == k
            for x, y, z, times in phrases([c[mine_] for c in columns]):
                owner = np.maximum(np.maximum(x, y), np.where(z == NONE, 0, z))
                hot = head.salts[owner] > 1
                some = ~hot & (times >= least)
                rows = head.rows(x[some], y[some], z[some], times[some])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows[0]), pa.int32()), pa.nulls(len(rows[0]), pa.binary()), *rows], names)
                if hot.any():
                    x, y, z, times = (c[hot] for c in (x, y, z, times))
                    h = mix(mix(mix(x.astype(np.uint64)) + y) + z)
                    for b in squeezed((h % n_buckets).astype(np.int32), buckets, x.view(np.int32), y, z, times.astype("<i8")):
                        yield pa.RecordBatch.from_arrays([*b.columns, *empty(b.num_rows)], names)

    def add(_, blobs) -> Iterator[pa.RecordBatch]:
        x, y, z, times = unsqueezed(blobs, *PHRASE)
        x, y, z, times = summed(x.view(np.uint32), y, z, times)
        some = times >= least
        yield pa.RecordBatch.from_arrays(given.value.rows(x[some], y[some], z[some], times[some]), names[2:])

    schema = f"bucket int, blob binary, {ROWS}"
    sent = docs.mapInArrow(spread, schema)
    sent = sent if whole else durable(sent)
    is_row = F.col("bucket").isNull()
    mined = regroup(sent.where(~is_row).select("bucket", "blob"), mine, schema)
    mined = durable(mined) if split else mined
    found = mined.where(is_row).select(*names[2:])
    if split:
        found = found.unionByName(regroup(mined.where(~is_row).select("bucket", "blob"), add, ROWS))
    if not whole:
        rare = sent.where(is_row).groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
        for i in (1, 2, 3):
            rare = rare.join(words.select("lang", F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}")), ["lang", f"w{i}"], "left")
        found = found.unionByName(rare.select(*names[2:]))
    return durable(found)


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)), exactly."""
    number = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {number(a)} * {number(a)}) div ({number(left)} * {number(right)})")


def collocations(
    docs: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, lang: str = "lang", text: str = "text",
    head_words: int = HEAD, head_bytes: int = HEAD_BYTES, buckets: int | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three words.

    Phrases occur ``least`` times or more; one that a longer candidate of at least ``cover`` percent of its occurrences holds is left
    out. A null text is empty, a null language ``und`` (together with rows of that very language). Texts of any length are
    taken whole; repeated rows count each. Ties are by the phrase's bytes. No rows: no rows. Other
    columns are ignored. ``head_words``, ``head_bytes`` and ``buckets`` bound what is broadcast and what a task holds; they change no result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(4, parts(spark), -(-size // BUCKET))
    words = _counts(docs, least)
    found = candidates(docs, words, least, head_words, head_bytes, buckets)
    pairs, triples = found.where("w3 is null").drop("w3", "f3"), found.where("w3 is not null")
    inside = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    covered = triples.select("lang", "a", inside.alias("p")).groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    kept = pairs.join(covered, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    two = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    three = triples.join(pairs.select("lang", "w1", "w2", F.col("a").alias("l2")), ["lang", "w1", "w2"])
    three = three.join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["lang", "w2", "w3"])
    three = three.withColumn("s1", _score("a", "f1", "r1")).withColumn("s2", _score("a", "l2", "f3"))
    first = F.col("s1") <= F.col("s2")
    cut = F.when(first, F.col("f1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("f3")).alias("r")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", *cut, F.least("s1", "s2").alias("score"))
    # The best of each of some parts of a language, then of these, so that no task gets all phrases of a language.
    best, deal = two.unionByName(three), F.pmod(F.xxhash64("phrase"), F.lit(DEALS))
    for part in (["lang", deal], ["lang"]):
        order = Window.partitionBy(*part).orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = words.where("word is null").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), one AS (
  SELECT lang, w[i] AS p, count(*) AS f FROM starts GROUP BY ALL
), two AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM starts WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10
), three AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM starts WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10
), covered AS (
  SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM two t JOIN one l ON l.lang = t.lang AND l.p = t.x JOIN one r ON r.lang = t.lang AND r.p = t.y
    LEFT JOIN covered c ON c.lang = t.lang AND c.x = t.x AND c.y = t.y
  WHERE c.longer IS NULL OR 100 * c.longer < 50 * t.f
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f
  FROM three t JOIN one l ON l.lang = t.lang AND l.p = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f
  FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.p = t.z
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen
)
SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(f) AS BIGINT) FROM one WHERE one.lang = ranked.lang) AS n, score FROM ranked WHERE rank <= 2000
"""
