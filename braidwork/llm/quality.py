"""Quality classifier: a linear support-vector machine on Naive Bayes features.

A text becomes the indicators of its hashed n-grams: byte 4-grams, case kept,
and single words; one more indicator tells the class of its number of words.  Each indicator is scaled by its class log-count ratio, which
is counted over *all* labelled training rows.  A linear hinge-loss model is
then fitted to these scaled, length-normalised indicators by dual coordinate
descent, on at most ``sample`` labelled rows of each class (those whose
``doc_id`` hashes lowest); part of that sample is held back to turn margins
into probabilities at the class balance of all labelled rows.

Ratios and weights are two vectors of ``features`` numbers: their size is
fixed, so scoring is one map over the texts with a small broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._counts import KIND, pack, total

FEATURES = 1 << 17
WIDTH = 4
#: Hashed with a text's size class.
_SIZE = 1 << 40
#: Added to the squared length of a text's features: a few n-grams alone say little.
DAMP = 20.0


def indicators(array: pa.Array, features: int = FEATURES) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text."""
    shift = np.uint64(64 - (int(features).bit_length() - 1))
    mark = np.zeros(features, np.int64)
    data, offsets = tx.buffers(array)

    def distinct(ids: np.ndarray) -> np.ndarray:
        at = np.arange(len(ids))
        mark[ids] = at
        return ids[mark[ids] == at]

    for i, j in tx.slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        hashes, _, owner = tx.words(part, own)
        words = (tx.mix(hashes) >> shift).astype(np.int64)
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        grams = (tx.rolling(part, WIDTH) >> shift).astype(np.int64) if len(part) <= 4 * tx.PIECE else None
        for k in range(j - i):
            a, b = int(own[k]), int(own[k + 1])
            if grams is not None:
                own_grams = grams[a : max(b - WIDTH + 1, a)]
            else:
                steps = range(a, b, tx.PIECE)
                own_grams = np.concatenate([distinct((tx.rolling(part[x : min(x + tx.PIECE + WIDTH - 1, b)], WIDTH) >> shift).astype(np.int64)) for x in steps])
            size = np.array([int(bounds[k + 1] - bounds[k]).bit_length() + _SIZE], np.uint64)
            yield distinct(np.concatenate([own_grams, words[bounds[k] : bounds[k + 1]], (tx.mix(size) >> shift).astype(np.int64)]))


def class_counts(rows: DataFrame, features: int = FEATURES) -> np.ndarray:
    """For each label, the rows of ``(label, text)`` that have each feature, and in the last place all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, features + 1), np.int64)
        for batch in batches:
            for y, ids in zip(batch.column(0).to_pylist(), indicators(batch.column(1), features), strict=True):
                count[y][ids] += 1
                count[y][features] += 1
        yield from pack("both", count.ravel())

    size = 2 * (features + 1)
    return total(rows.mapInArrow(run, KIND), size).get("both", np.zeros(size, np.int64)).reshape(2, -1)


def descend(sets: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, *, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; the weights of the unscaled indicators.

    ``y`` is -1 or 1.  Rows are normalised to about unit length, with a bias
    feature in the last place.
    """
    w = np.zeros(len(ratio) + 1)
    rows = [(np.append(ids, len(ratio)), scaled(ids, ratio)) for ids in sets]
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([float(x @ x) for _, x in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            slope = y[i] * float(w[ids] @ x) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[ids] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w


def scaled(ids: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[ids]
    return np.append(x / np.sqrt(float(x @ x) + DAMP), 0.1)


def calibrate(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - good), weight * p * (1 - p) + 1e-9
        ga, gb = float(g @ margin) + 1e-3 * (a - 1), float(g.sum()) + 1e-3 * b
        haa, hab, hbb = float(h @ margin**2) + 1e-3, float(h @ margin), float(h.sum()) + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, features: int = FEATURES, sample: int = 6000) -> Model:
    """Learn from ``labels(doc_id, label)`` joined to ``docs(doc_id, text)``.

    Labels other than 0 and 1, null labels and labels without a document teach
    nothing.  With one class only, or none, every score is that class's share
    (one half without labels).
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("label in (0, 1) and doc_id is not null")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined = texts.join(rows.hint("merge"), "doc_id").select("label", "text")
    count = class_counts(joined, features).astype(float)
    count, rows_of = count[:, :-1], count[:, -1]
    p, q = ((count[k] + 1) / (rows_of[k] + 2) for k in (1, 0))
    ratio = np.log(p / q) if rows_of.min() > 0 else np.zeros(features)
    share = (rows_of[1] + 1) / (rows_of.sum() + 2)
    if rows_of.min() == 0:
        return Model(ratio, np.zeros(features + 1), 0.0, float(np.log(share / (1 - share))))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    few = [rows.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    picked = texts.join(F.broadcast(few[0].unionAll(few[1])), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.astype(np.int32).tobytes() for x in indicators(batch.column(2), features)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "label", "ids"])

    seen = picked.mapInArrow(run, "doc_id long, label int, ids binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    sets = [np.frombuffer(x.as_buffer(), np.int32) for chunk in seen["ids"].chunks for x in chunk]
    y = seen["label"].to_numpy()
    keep = np.random.default_rng(11).random(len(y)) < 0.75
    sides = np.where(y == 1, 1.0, -1.0)
    balance = np.where(y == 1, rows_of[1] / max((y == 1).sum(), 1), rows_of[0] / max((y == 0).sum(), 1)) / rows_of.sum() * len(y)
    chosen = np.flatnonzero(keep)
    weights = descend([sets[i] for i in chosen], sides[chosen], ratio, cost=np.sqrt(balance[chosen]))
    rest = np.flatnonzero(~keep) if (~keep).any() else chosen
    margin = np.array([weights[np.append(sets[i], features)] @ scaled(sets[i], ratio) for i in rest])
    slope, intercept = calibrate(margin, (y[rest] == 1).astype(float), balance[rest])
    return Model(ratio, weights, slope, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for each row; only the text is read.

    Null and empty texts have no n-grams and get the score of their size class.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float32), (model.ratio * model.weights[:-1]).astype(np.float32), float(model.weights[-1]) * 0.1, model.slope, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, product, bias, slope, intercept = shared.value
        square = ratio * ratio
        for batch in batches:
            margin = [float(product[ids].sum(dtype=float)) / np.sqrt(float(square[ids].sum(dtype=float)) + DAMP) + bias for ids in indicators(batch.column(1), len(ratio))]
            p = 1 / (1 + np.exp(-np.clip(slope * np.array(margin) + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.7).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
