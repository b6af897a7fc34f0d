"""Quality classifier by positive-unlabelled learning (operator 4).

A linear score over style features of whole texts, fitted to trusted positives P and all
documents as the unlabelled U, with the class prior pi estimated from these two. For logistic
loss the unbiased risk pi E_P[l(z)] + (E_U[l(-z)] - pi E_P[l(-z)]) is convex,
-pi E_P[z] + E_U[softplus(z)], and is minimised by Newton steps whose sums run over every
document. The part in brackets estimates the negatives' risk and can't truly be below 0: a step
that would take it there is halved until it doesn't (the non-negative estimator). Negative
labels are used for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_rows, durable, text_bytes
from tracelake.llm.shingles import rolled, words

BASIC = 17


def style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text: shares of byte classes, word lengths, and how much repeats."""
    n = np.diff(offsets)
    sums = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
    classes = np.zeros(256, np.uint8)
    for code, some in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\n", b" \t\r\x0b\x0c", b".,;:'\"?()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
        classes[list(some)] = code
    classes[128:] = 9
    kind = classes[data]
    share = [sums(kind == c) / np.maximum(n, 1) for c in range(1, 10)]
    starts, ends, rows, hashes = words(data, offsets, lower=False)
    count = np.bincount(rows, minlength=len(n))
    some = np.maximum(count, 1)
    size = (ends - starts).astype(float)
    mean = np.bincount(rows, size, len(n)) / some
    long_ = np.bincount(rows, size > 18, len(n)) / some
    again = np.zeros(len(rows))
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    same = np.bincount(rows, again, len(n)) / some

    def distinct(values, of):
        total = np.bincount(of, minlength=len(n))
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.where(total > 0, np.bincount(o[new], minlength=len(n)) / np.maximum(total, 1), 1.0)

    third = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, int)
    upper = share[0] / np.maximum(share[0] + share[1], 1e-9)
    return np.column_stack([*share, np.log1p(n), np.log1p(count), mean, long_, same, distinct(hashes, rows), distinct(rolled(hashes, third, 3), rows[third]), upper]).astype(np.float32)


def expand(x: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Each feature, and how far it is below and above what is usual among the positives; and 1."""
    x = x.astype(np.float64)
    below, above = np.clip((low - x) / scale, 0, 5), np.clip((x - high) / scale, 0, 5)
    return np.column_stack([np.ones(len(x)), np.clip((x - low) / scale, -5, 5), below, above, below > 0.5, above > 0.5])


def _softplus(z):
    return np.logaddexp(0, z)


def _summed(df: DataFrame, per_batch, size: int) -> np.ndarray:
    """The sum of ``per_batch`` (features of some rows -> ``size`` numbers) over all rows of ``df`` (a column x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += per_batch(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f4").reshape(-1, BASIC))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def add(_, table):
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table["s"])
        return pa.table({"s": pa.array([total.tobytes()], pa.binary())})

    found = df.select("x").mapInArrow(run, "s binary")
    if found.rdd.getNumPartitions() > 256:  # added up in two steps, so that the driver gets few rows
        found = found.groupBy(F.spark_partition_id() % 64).applyInArrow(add, "s binary")
    return sum((np.frombuffer(r.as_py(), np.float64) for r in found.toArrow()["s"]), np.zeros(size))


def fit(features: DataFrame, positives: DataFrame, prior: float, usual: tuple, steps: int = 15, ridge: float = 1e-4) -> np.ndarray:
    """The weights. ``features`` and ``positives``: a column x (binary, float32); ``usual``: what ``expand`` needs.

    Every step that is taken lowers the risk and leaves the negatives' part of it at 0 or above; a Newton step
    is halved until it does, and where no part of it does the fit has ended.
    """
    d = 1 + 5 * BASIC

    def parts(w: np.ndarray, second: bool):
        def run(x: np.ndarray) -> np.ndarray:
            x = expand(x, *usual)
            z = x @ w
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            out = [np.array([len(x), _softplus(z).sum()]), x.sum(0)]
            return np.concatenate([*out, p @ x, ((x.T * (p * (1 - p))) @ x).ravel()] if second else out)

        return run, 2 + d + (d + d * d if second else 0)

    w = np.zeros(d)
    of_p = _summed(positives, *parts(w, False))
    n_p = of_p[0]
    if not n_p:
        w[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return w
    mean_p = of_p[2 : 2 + d] / n_p

    def measured(w: np.ndarray, of_p: np.ndarray) -> tuple[float, float, np.ndarray]:
        """The risk, the negatives' part of it, and the sums over the unlabelled."""
        of_u = _summed(features, *parts(w, True))
        mean_u = of_u[1] / of_u[0]
        return -prior * mean_p @ w + mean_u + ridge / 2 * w @ w, mean_u - prior * of_p[1] / n_p, of_u

    value, _, of_u = measured(w, of_p)
    for _ in range(steps):
        slope, curve = of_u[2 + d : 2 + 2 * d] / of_u[0], of_u[2 + 2 * d :].reshape(d, d) / of_u[0]
        step = -np.linalg.solve(curve + (ridge + 1e-9) * np.eye(d), -prior * mean_p + slope + ridge * w)
        for _ in range(6):
            now, negative, sums = measured(w + step, _summed(positives, *parts(w + step, False)))
            if negative >= 0 and now <= value:
                break
            step = step / 2
        else:
            return w
        w, gain, value, of_u = w + step, value - now, now, sums
        if gain < 1e-7:
            break
    return w


#: Cells of z between -LIMIT and LIMIT, and the chance that the estimate's margins for sampling are too small.
CELLS, LIMIT, CHANCE = 4096, 30.0, 0.1


def class_prior(features: DataFrame, positives: DataFrame, w: np.ndarray, usual: tuple) -> float:
    """The share of positives among the unlabelled, from a score and positives that it wasn't fitted to.

    Of any region of the score the unlabelled hold at least the prior times what the positives hold, and
    no more than that where there are no negatives: the least ratio over the regions above a
    threshold, each with its margin for sampling, is the estimate. Only positives and unlabelled rows are used.
    """

    def cells(x: np.ndarray) -> np.ndarray:
        z = np.clip(expand(x, *usual) @ w, -LIMIT, LIMIT - 1e-9)
        return np.bincount(((z + LIMIT) / (2 * LIMIT) * CELLS).astype(np.int64), minlength=CELLS).astype(float)

    above = [np.cumsum(_summed(df, cells, CELLS)[::-1]) for df in (features, positives)]
    n_u, n_p = (a[-1] for a in above)
    if not n_p or not n_u:
        return 0.5
    share_u, share_p = above[0] / n_u, above[1] / n_p
    margin = sum(np.sqrt(np.log(4 / CHANCE) / (2 * n)) for n in (n_u, n_p))
    some = np.flatnonzero(share_p > 0)
    best = some[np.argmin((share_u[some] + margin) / share_p[some])]
    return float(min(max(share_u[best] / share_p[best], 0.01), 0.99))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = 20_000, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``, and its ``row`` (a column of longs) where that is asked for.

    Only labels of rows whose crc32(doc_id as text) mod ``folds`` isn't 0 are learned from; of
    the labelled rows at most ``sample`` (those of least hash) give the features' usual ranges,
    while the risk's sums run over all of them. Null and empty texts are scored like any other,
    texts of any length as a whole; repeated rows are scored each, and count each. A null key is
    never held out and matches no label. Contradicting labels of one document count by their mean;
    null labels don't. Without positives the score is 0.5. No rows: no rows. Other columns are
    ignored.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole, 1 << 20):
                x = style(*text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[2:]], ["doc_id", "x", *asked])

    kind, asked, more = docs.schema[key].dataType.simpleString(), [row] if row else [], f", {row} long" if row else ""
    features = durable(docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), *asked).mapInArrow(featurise, f"doc_id {kind}, x binary{more}"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good")).where(~held)
    train = durable(features.join(known, "doc_id"))
    positives = train.where("good").select("x", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("first"))
    usual = train.where("good").orderBy(F.xxhash64("doc_id")).select("x").limit(sample).toArrow()["x"].to_pylist()
    x = np.frombuffer(b"".join(usual), "<f4").reshape(-1, BASIC).astype(float) if usual else np.zeros((1, BASIC))
    low, high = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    usual = low, high, np.maximum(high - low, np.maximum(0.02 * np.abs(high), 0.005))
    # A first score is fitted to half of the positives; the others and the unlabelled give the prior.
    draft = fit(features, positives.where("first"), 0.5, usual, steps=6)
    prior = class_prior(features, positives.where("not first"), draft, usual)
    w = fit(features, positives, prior, usual)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, BASIC)
            p = 1 / (1 + np.exp(-np.clip(expand(x, *usual) @ w, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *batch.columns[2:]], ["doc_id", "score", "predicted", *asked])

    return features.mapInArrow(apply, f"doc_id {kind}, score double, predicted int{more}").select("doc_id", held.alias("held_out"), "score", "predicted", *asked)
