"""Language proportions of each document by expectation-maximisation.

Byte 4-grams of the lower-cased letters (everything else in ASCII is a word
border) are hashed to ``features`` buckets.  Each language's n-gram
distribution is learnt from labelled rows and smoothed towards the languages'
mean, so an n-gram that was never seen favours none of them.  A document is a
mixture of languages: EM estimates the proportions from its n-gram
likelihoods.  The set of languages is the one with the highest likelihood less
a penalty for each language (BIC, times the n-gram order because n-grams
overlap): languages are added greedily while the penalised likelihood rises.

The model holds ``languages * features`` numbers and is broadcast; it does not
grow with the rows.  Training counts are summed over all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._counts import KIND, pack, total
from ._work import bounded_batches

FEATURES = 1 << 16
ORDER = 4
_LETTER = re.compile(r"[^\W\d_]")
_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_PIECE = 1 << 20


def ngrams(text: str, features: int = FEATURES) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, with repeats, in bounded pieces."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    for at in range(0, max(len(raw), 1), _PIECE):
        data = _MAP[np.frombuffer(b" " + raw[at : at + _PIECE + (ORDER - 2 if at + _PIECE < len(raw) else 0)] + b" ", np.uint8)]
        gap = (data[1:] == 32) & (data[:-1] == 32)
        if len(data) < ORDER:
            yield np.zeros(0, np.int64)
            continue
        d = data.astype(np.uint32)
        key = d[:-3] | (d[1:-2] << 8) | (d[2:-1] << 16) | (d[3:] << 24)
        key = key[~(gap[:-2] | gap[1:-1] | gap[2:])]
        key = (key ^ (key >> 15)) * np.uint32(0x9E3779B1)
        yield (key >> np.uint32(32 - int(features).bit_length() + 1)).astype(np.int64)


def train_counts(rows: DataFrame, features: int = FEATURES) -> dict[str, np.ndarray]:
    """Each language's n-gram counts over all rows of ``(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = held.setdefault(lang, np.zeros(features, np.int64))
                for ids in ngrams(text, features):
                    np.add.at(count, ids, 1)
        for lang, count in held.items():
            yield from pack(lang, count)

    return total(rows.mapInArrow(run, KIND), features)


def fit(rows: DataFrame, *, features: int = FEATURES, prior: float = 5000.0) -> tuple[list[str], np.ndarray, int]:
    """Languages in code-point order, their ``features x languages`` probabilities, and the commonest one.

    ``rows`` has ``lang`` and ``text``; rows with a null in either teach nothing.
    """
    bounded_batches(rows.sparkSession)
    found = train_counts(rows.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string")), features)
    langs = sorted(found)
    counts = np.stack([found[x] for x in langs], axis=1).astype(float) if langs else np.zeros((features, 1))
    whole = np.maximum(counts.sum(axis=0), 1)
    mean = 0.9 * (counts / whole).mean(axis=1) + 0.1 / features
    return langs, (counts + prior * mean[:, None]) / (whole + prior), int(counts.sum(axis=0).argmax())


def proportions(table: np.ndarray, counts: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """EM estimate of the mixture proportions, and its log-likelihood."""
    theta, total = np.full(table.shape[1], 1 / table.shape[1]), counts.sum()
    for _ in range(steps):
        before, theta = theta, theta * ((counts / (table @ theta)) @ table) / total
        if np.abs(theta - before).max() < 1e-4:
            break
    return theta, float(counts @ np.log(table @ theta))


def infer(table: np.ndarray, logs: np.ndarray, ids: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Selected languages, largest share first, and their proportions."""
    ids, counts = np.unique(ids, return_counts=True)
    counts = counts.astype(float)
    own, single = table[ids], counts @ logs[ids]
    best = int(single.argmax())
    chosen, theta, level = [best], np.ones(1), float(single[best])
    penalty = ORDER * 0.5 * math.log(counts.sum() + 1)
    if table.shape[1] > 1 and proportions(own, counts)[1] - level > penalty:
        while len(chosen) < table.shape[1]:
            tried = [(proportions(own[:, [*chosen, k]], counts), k) for k in range(table.shape[1]) if k not in chosen]
            (share, likelihood), k = max(tried, key=lambda x: x[0][1])
            if likelihood - level <= penalty:
                break
            chosen, theta, level = [*chosen, k], share, likelihood
    order = np.argsort(-theta, kind="stable")
    return [chosen[i] for i in order], theta[order]


def predict(text: str | None, table: np.ndarray, logs: np.ndarray, langs: list[str], common: int, features: int) -> tuple[list[int], np.ndarray]:
    """As :func:`infer`, from a text; nothing for a text without a letter."""
    if not (text and langs and _LETTER.search(text)):
        return [], np.zeros(0)
    ids = np.concatenate(list(ngrams(text, features)))
    return infer(table, logs, ids) if len(ids) else ([common], np.array([1 / len(langs)]))


def held_out(doc_id: Column, fold: int = 0, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, common: int = 0) -> DataFrame:
    """``doc_id, lang_pred, score, languages, shares`` for each row of ``docs``.

    ``lang_pred`` is the language with the largest share and ``score`` that
    share.  Null texts and texts without a letter give ``und`` with score 0 and
    no languages, and so do all texts when no language was learnt.  A text with
    letters but too short for an n-gram gets the commonest language, with score
    1 / languages.  Only the text is read; other columns are ignored.  An empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    features = table.shape[0]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        logs = np.log(own)
        for batch in batches:
            pred, score, names, shares = [], [], [], []
            for text in batch.column(1).to_pylist():
                pick, theta = predict(text, own, logs, langs, common, features)
                pred.append(langs[pick[0]] if pick else "und")
                score.append(float(min(max(theta[0], 0.0), 1.0)) if pick else 0.0)
                names.append([langs[k] for k in pick])
                shares.append(theta.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def keep_identified(docs: DataFrame, langs: list[str], table: np.ndarray, common: int = 0, *, min_share: float = 0.25) -> DataFrame:
    """The rows of ``docs`` in some language, all columns kept; no shuffle.

    Rejected are null texts, texts without a letter, and texts of which no
    language makes up ``min_share``.
    """
    bounded_batches(docs.sparkSession)
    features, at = table.shape[0], docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log(shared.value)
        for batch in batches:
            found = [predict(text, shared.value, logs, langs, common, features) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([len(pick) > 0 and float(theta[0]) >= min_share for pick, theta in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
