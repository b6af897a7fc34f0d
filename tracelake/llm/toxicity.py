"""Toxicity by a convolutional text classifier, trained in numpy (operator 11).

**Network.** A word (a run of ASCII letters, digits and other than ASCII bytes, A-Z lowered) has three hashed embeddings, end
to end: by the whole word, by its first six bytes and by its first four, so that forms of one stem resemble each other
and words which share one row by chance still differ. Filters of one, two and three words run over the text,
each keeps its largest response (max pooling), and a logistic unit adds these up. Only the places of the
largest responses have a gradient, so a step costs little more than the forward pass.

**Training** uses a bounded sample of the labelled rows (``sample``, by a hash of the key, in its expected number). One half of it gives each
embedding row its first component: the smoothed log odds of toxic texts among those that hold its words.
The other half is dealt over shards of about ``SHARD`` / 2 texts; in each round every shard goes through its texts from the
same weights (Adagrad, lots of 32 texts, ``STEPS`` lots at least), and the weights are averaged, piece by piece in tasks: the
driver gets their mean alone. A shard is read in one order, so the result doesn't depend on the cluster.

**Scores** are taken with the learned weights rounded to a grid on which every sum is exact, so that texts with the same words have the
same score wherever they lie.

**Thresholds** by language are set on labelled rows outside the sample: of each language the score from which on the F1 of toxic
is largest, and the one of all languages together where a language has too few toxic rows there. They decide
``flagged`` alone; score and ``predicted`` never see a language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, arrow_rows, durable, slice_hashes, text_bytes

#: Rows and width of an embedding, words of the filters, filters of each width.
ROWS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 16
#: Bytes of a word that each of its embeddings is for.
STEMS = (1 << 40, 6, 4)
GAP = max(WIDTHS) - 1
NOTHING = len(STEMS) * ROWS  # the embedding row of no word: zero
ROUNDS, LOT, RATE = 5, 32, 0.05
#: Labelled rows of the sample for a shard: fewer would learn too little between two averages.
SHARD = 5000
#: Steps of a shard in a round, at least: fewer texts are gone through more often.
STEPS = 30
#: Texts that all have a word's odds before any is seen; bounds of the log odds.
SMOOTH, ODDS = 20.0, (-2.0, 5.0)
#: Words that are looked at together, bytes of text of a batch, cells of the score and toxic rows for a language's own threshold.
PIECE, BATCH, CELLS, FEWEST = 1 << 16, 1 << 20, 1000, 20
#: Pieces in which arrays of the shards are added up: one of the weights is below half a MB.
PIECES = 32

BREAKS = np.ones(256, bool)
BREAKS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = False


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of every word, a row of numbers each, and the texts' bounds."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~BREAKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    lower = LOWER[data]
    return np.column_stack([slice_hashes(lower, starts, np.minimum(ends, starts + stem)).astype("<u2") for stem in STEMS]), np.searchsorted(starts, offsets)


def own_rows(ids: np.ndarray) -> np.ndarray:
    """Rows of the one table of embeddings, in which each stem's rows follow the last one's."""
    return ids + ROWS * np.arange(len(STEMS))


class Net:
    """The weights: embeddings, filters by width and place, their biases, the last unit's weights and bias."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights
        self.words, self.filters, self.bias, self.out, self.base = weights

    @staticmethod
    def start(odds: np.ndarray, share: float, seed: int = 0) -> Net:
        r, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        words = r.normal(0, 0.1, (NOTHING + 1, DIM))
        words[:NOTHING, 0], words[NOTHING] = odds, 0
        filters = r.normal(0, 0.3, (sum(WIDTHS), len(STEMS) * DIM, FILTERS))
        base = np.log(share) - np.log1p(-share)
        return Net([x.astype("f4") for x in (words, filters, np.zeros(n), r.normal(0, 0.1, n), np.array([base]))])

    def exact(self) -> Net:
        """These weights with words and filters rounded to multiples of powers of two, the finest for which no response needs more than float32's 24 bits.

        Then no sum of a response is rounded, in whatever order a matrix product takes it and whatever texts lie around.
        """
        for bits in range(40, 1, -1):
            w, f = 2.0 ** (bits // 2), 2.0 ** (bits - bits // 2)
            words, filters = np.round(self.words * w), np.round(self.filters * f)
            largest = np.abs(words[:NOTHING]).reshape(len(STEMS), ROWS, DIM).max(axis=1).ravel()
            each = np.einsum("i,kif->kf", largest.astype(float), np.abs(filters).astype(float))
            ends = np.cumsum(WIDTHS)
            if max(each[b - n : b].sum(axis=0).max() for n, b in zip(WIDTHS, ends, strict=True)) <= 1 << 24:
                break
        return Net([(words / w).astype("f4"), (filters / f).astype("f4"), *self.weights[2:]])

    @staticmethod
    def laid(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embedding rows of each place, with ``GAP`` places of no word after each text, and the texts' first places."""
        n = np.diff(bounds)
        size = np.maximum(n, 1) + GAP
        start = np.cumsum(size) - size
        place = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], n)
        rows = np.full((size.sum(), len(STEMS)), NOTHING)
        rows[place] = own_rows(ids)
        return rows, start

    def responses(self, rows: np.ndarray, start: np.ndarray, places: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places' vectors, each filter's response at each place, and its largest one in each text (of its first ``places``)."""
        x, found, k = self.words[rows].reshape(len(rows), -1), [], 0
        for width in WIDTHS:
            z = x @ self.filters[k]
            for j in range(1, width):
                z[: max(0, len(z) - j)] += x[j:] @ self.filters[k + j]
            found.append(z)
            k += width
        z = np.hstack(found)
        gap = rows[:, 0] == NOTHING
        gap[start] = False  # a text without words has one place
        z[gap] = -np.inf
        if places is not None:
            z[places:] = -np.inf
        return x, z, np.maximum.reduceat(z, start, axis=0)

    def logits(self, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        active = np.maximum(largest + self.bias, 0)
        return active, active @ self.out + self.base[0]

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The texts' probabilities; a long text is taken in overlapping pieces, of which the largest responses count."""
        largest = np.full((len(bounds) - 1, len(self.bias)), -np.inf, "f4")
        start = 0
        while start < len(largest):
            end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + PIECE, "right")) - 1)
            first, last = bounds[start], bounds[end]
            if last - first <= PIECE:
                largest[start:end] = self.responses(*self.laid(ids[first:last], bounds[start : end + 1] - first))[2]
            else:
                for a in range(first, last, PIECE):
                    b = min(last, a + PIECE + GAP)
                    places = None if b == last else PIECE
                    largest[start] = np.maximum(largest[start], self.responses(*self.laid(ids[a:b], np.array([0, b - a])), places)[2][0])
            start = end
        active = np.maximum(largest + self.bias, 0).astype(float)
        logit = np.full(len(active), float(self.base[0]))
        for k, weight in enumerate(self.out.astype(float)):  # one after the other: a product's order would depend on the number of texts
            logit += active[:, k] * weight
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def learn(self, past: list[np.ndarray], ids: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> None:
        """One step of Adagrad on some texts; ``past``: the sums of squared gradients."""
        rows, start = self.laid(ids, bounds)
        x, z, largest = self.responses(rows, start)
        active, logit = self.logits(largest)
        slope = ((1 / (1 + np.exp(-logit)) - toxic) / len(toxic)).astype("f4")
        inner = np.outer(slope, self.out) * (active > 0)
        text = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(rows)]))
        at, filter_ = np.nonzero(z == largest[text])
        _, first = np.unique(text[at] * z.shape[1] + filter_, return_index=True)  # of equal responses the first
        at, filter_ = at[first], filter_[first]
        back = inner[text[at], filter_]
        at, filter_, back = at[back != 0], filter_[back != 0], back[back != 0]
        by_filter, touched, by_row, k = np.zeros_like(self.filters), [], [], 0
        for nth, width in enumerate(WIDTHS):
            mine = filter_ // FILTERS == nth
            for j in range(width):
                some = mine & (at + j < len(rows))
                place, f, g = at[some] + j, filter_[some] % FILTERS, back[some, None]
                np.add.at(by_filter[k + j].T, f, x[place] * g)
                touched.append(rows[place].ravel())
                by_row.append((self.filters[k + j].T[f] * g).reshape(-1, DIM))
            k += width
        row, which = np.unique(np.concatenate(touched), return_inverse=True)
        to_rows = np.zeros((len(row), DIM), "f4")
        np.add.at(to_rows, which, np.concatenate(by_row))
        to_rows[row == NOTHING] = 0
        past[0][row] += to_rows**2
        self.words[row] -= RATE * to_rows / np.sqrt(past[0][row])
        found = by_filter, inner.sum(0), active.T @ slope, slope.sum(keepdims=True)
        for weight, squares, g in zip(self.weights[1:], past[1:], found, strict=True):
            squares += g**2
            weight -= RATE * g / np.sqrt(squares)


def _unpacked(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    at, out = 0, []
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape).astype("f4"))
        at += w.size
    return out


def _summed(texts: DataFrame, make: Callable[[pa.Table], np.ndarray]) -> np.ndarray:
    """The sum over all shards of the flat array that ``make`` gives for a shard's rows, and last the number of shards.

    Tasks add up a piece of all shards each, in the shards' order; only the sums come to the driver.
    """

    def cut(key, table):
        pieces = np.array_split(np.append(make(table), 1).astype("<f4"), PIECES)
        return pa.table({"shard": pa.array([key[0].as_py()] * PIECES, pa.int32()), "piece": pa.array(range(PIECES), pa.int32()), "x": pa.array([x.tobytes() for x in pieces], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(x.as_py(), "<f4").astype("<f8") for x in table.sort_by("shard")["x"])
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})

    cuts = texts.groupBy("shard").applyInArrow(cut, "shard int, piece int, x binary")
    found = cuts.groupBy("piece").applyInArrow(add, "piece int, x binary").toArrow().sort_by("piece")
    return np.concatenate([np.frombuffer(x.as_py(), "<f8") for x in found["x"]]) if found.num_rows else np.zeros(1)


def _ids(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts, end to end, and the texts' bounds."""
    ids = np.frombuffer(b"".join(found), "<u2").reshape(-1, len(STEMS))
    return ids, np.r_[0, np.cumsum([len(x) // (2 * len(STEMS)) for x in found])].astype(np.int64)


def _odds(texts: DataFrame) -> tuple[np.ndarray, float]:
    """The log odds of toxic texts for each embedding row, and the share of toxic texts; ``texts``: columns ids, toxic."""

    def count(table):
        many = np.zeros((2, NOTHING + 1), "<i4")
        for raw, toxic in zip(table["ids"], table["toxic"], strict=True):
            many[int(toxic.as_py()), np.unique(own_rows(_ids([raw.as_py()])[0]))] += 1
            many[int(toxic.as_py()), NOTHING] += 1
        return many.ravel()

    total = _summed(texts, count)
    many = total[:-1].reshape(2, -1) if total[-1] else np.zeros((2, NOTHING + 1))
    share = float(np.clip((many[1, -1] + 0.1) / (many[:, -1].sum() + 1), 1e-4, 1 - 1e-4))
    odds = np.log((many[1, :-1] + SMOOTH * share) / (many[0, :-1] + SMOOTH * (1 - share))) - np.log(share / (1 - share))
    return np.clip(odds, *ODDS), share


def train(texts: DataFrame, odds: np.ndarray, share: float) -> Net:
    """The weights, from ``texts``: shard, by, ids, toxic."""
    net, spark = Net.start(odds, share), texts.sparkSession

    def learner(given):
        def go(table):
            mine = Net([w.copy() for w in given.value])
            past = [np.full(w.shape, 1e-4, "f4") for w in mine.weights]
            table = table.sort_by([("by", "ascending"), ("ids", "ascending")])
            lots = [table.slice(i, LOT) for i in range(0, table.num_rows, LOT)]
            for _ in range(-(-STEPS // len(lots))):
                for lot in lots:
                    mine.learn(past, *_ids(lot["ids"].to_pylist()), np.asarray(lot["toxic"], float))
            return np.concatenate([w.ravel() for w in mine.weights])

        return go

    for _ in range(ROUNDS):
        given = spark.sparkContext.broadcast(net.weights)
        total = _summed(texts, learner(given))
        given.destroy()
        if not total[-1]:
            net.out[:] = 0  # nothing was learned: the share of toxic texts for all
            break
        net = Net(_unpacked(total[:-1] / total[-1], net.weights))
    return net


def thresholds(scored: DataFrame) -> DataFrame:
    """lang, threshold of each language with ``FEWEST`` toxic rows or more, and a row without language for all together; ``scored``: lang, score, toxic."""
    cells = scored.select("lang", F.floor(F.col("score") * CELLS).alias("cell"), F.col("toxic").cast("long").alias("toxic"))
    by_lang = cells.where("lang is not null").groupBy("lang", "cell").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    for_all = cells.groupBy("cell").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    found = by_lang.unionByName(for_all.select(F.lit(None).cast("string").alias("lang"), "cell", "t", "n"))
    above, whole = Window.partitionBy("lang").orderBy(F.desc("cell")), Window.partitionBy("lang")
    hit, all_ = F.sum("t").over(above), F.sum("t").over(whole)
    found = found.select("lang", "cell", (2 * hit / (F.sum("n").over(above) + all_)).alias("f1"), all_.alias("all"))
    best = found.groupBy("lang").agg(F.max(F.struct("f1", "cell")).alias("best"), F.first("all").alias("all"))
    return best.where(F.col("all") >= FEWEST).select("lang", (F.col("best.cell") / CELLS).alias("threshold"))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = 0.3, sample: int = 20_000,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged per row of ``docs``.

    Only labels of rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_fold`` are learned from, of these about ``sample`` rows
    at most in the network and all others in the thresholds. Null and empty texts have no words and are scored like any other; texts
    of any length are scored as a whole; repeated rows are scored each. A null key is never held out and matches no label.
    Contradicting labels of one document count by their mean; null labels don't. Without labels every score is the same.
    A null language, or one with few toxic rows outside the sample, has the threshold of all; where all have few of them
    that is ``threshold``. No rows: no rows. Other columns are ignored.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                ids, bounds = word_ids(*text_bytes(batch.column("text")))
                found = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = {c: batch.column(c) for c in ("shard", "half", "by", "toxic")} | {"ids": pa.array(found, pa.binary())}
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in ("shard", "half", "by", "ids", "toxic")})

    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic")).where(~held)
    by = F.xxhash64("doc_id")
    fit_part = F.pmod(by, F.lit(5)) != 0
    known = durable(known.withColumn("by", by).withColumn("fit", fit_part))
    many = known.where("fit").count()
    chosen = F.pmod(F.shiftright("by", 20), F.lit(1 << 20)) < int(min(1.0, sample / max(many, 1)) * (1 << 20))
    picked = known.where("fit").where(chosen).select("doc_id", "toxic", "by")
    picked = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(  # broadcast: about ``sample`` keys at most
        (F.pmod(F.shiftright("by", 3), F.lit(-(-min(sample, max(many, 1)) // SHARD)))).cast("int").alias("shard"), (F.pmod(F.shiftright("by", 10), F.lit(2))).cast("int").alias("half"), "by", "text", "toxic"
    )
    texts = picked.mapInArrow(featurise, "shard int, half int, by long, ids binary, toxic boolean")
    texts = durable(texts)
    half = lambda k: texts.where(F.col("half") == k).select("shard", "by", "ids", "toxic")
    net = train(half(1), *_odds(half(0))).exact()
    given = docs.sparkSession.sparkContext.broadcast(net.weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(given.value)
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                score = net.scores(*word_ids(*text_bytes(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(score)], ["doc_id", "lang", "score"])

    scored = durable(docs.mapInArrow(apply, f"doc_id {kind}, lang string, score double"))
    rest = known.where(~F.col("fit") | ~chosen).select("doc_id", "toxic")
    limits = durable(thresholds(scored.join(rest, "doc_id").select("lang", "score", "toxic")))
    for_all = limits.where("lang is null").select("threshold").first()
    limit = F.coalesce(F.col("threshold"), F.lit(for_all[0] if for_all else threshold).cast("double"))
    out = scored.join(limits.where("lang is not null"), "lang", "left")
    decided = (F.col("score") >= threshold).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("score") >= limit).alias("flagged")
    return out.select("doc_id", held.alias("held_out"), "score", *decided)
