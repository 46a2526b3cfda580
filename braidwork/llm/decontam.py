"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item is the multiset of its five-word shingles, with a 256-bit
SimHash in which every occurrence of a shingle votes.  In a document, windows
of as many words as an item has get the same fingerprint from running sums of
the votes; a document shorter than an item is one window.  Only windows that
hold a shingle of some item of that size need a fingerprint: the similarity of
all others is 0.

Fingerprints are cut into ``blocks`` parts.  Two fingerprints within
``radius`` bits agree within ``radius // blocks`` bits in one part at least, so
an index on each part finds every item within the radius.  What it finds is
verified exactly: the weighted Jaccard similarity of the two multisets of
shingles (sum of smaller over sum of larger multiplicities) must reach
``percent``.

The items of one pass are bounded by ``pass_bytes`` and held as flat arrays; a
larger benchmark takes several passes over the documents, so the broadcast
never grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

#: Bits of a fingerprint, and windows that get theirs at once.
BITS, CHUNK = 256, 2048
_SEEDS = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(BITS // 64)]


def votes(shingles: np.ndarray) -> np.ndarray:
    """The bits of each shingle's hash, one for a vote for and zero for a vote against."""
    spread = np.stack([tx.mix(shingles ^ s) for s in _SEEDS], axis=1) if len(shingles) else np.zeros((0, len(_SEEDS)), np.uint64)
    return np.unpackbits(spread.view(np.uint8), axis=1)


def fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of ``size`` shingles, as rows of 64-bit numbers."""
    total = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(votes(shingles), axis=0, dtype=np.int32, out=total[1:])
    return np.packbits(2 * (total[size:] - total[:-size]) > size, axis=1).view(np.uint64)


@dataclass
class Items:
    """The items of one pass: shingles and counts of item ``k`` lie between ``bounds[k]`` and ``bounds[k + 1]``."""

    ids: list[int | None]
    words: np.ndarray
    prints: np.ndarray
    bounds: np.ndarray
    shingles: np.ndarray
    counts: np.ndarray
    by_words: dict[int, np.ndarray] = field(default_factory=dict)
    #: For each shingle width: the sorted shingles, where the item sizes of each begin, the sizes, and a filter on 20 bits.
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """The shingles at each word: of five words, or of a short item's whole length."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * tx._STEP[j]
    return tx.mix(total + np.uint64(0 if width == 5 else width))


def build(ids: list[int | None], texts: list[str]) -> Items:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    hashes, _, owner = tx.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    borders = np.searchsorted(owner, np.arange(len(raw) + 1))
    sizes = np.diff(borders)
    kept = np.flatnonzero(sizes > 0)
    bags, prints = [], np.zeros((len(kept), BITS // 64), np.uint64)
    for row, k in enumerate(kept.tolist()):
        shingles = _rolled(hashes[borders[k] : borders[k + 1]], min(int(sizes[k]), 5))
        prints[row] = _whole(shingles)
        bags.append(np.unique(shingles, return_counts=True))
    none = np.zeros(0, np.uint64)
    bounds = np.cumsum([0, *(len(b[0]) for b in bags)])
    flat = np.concatenate([none, *(b[0] for b in bags)])
    counts = np.concatenate([np.zeros(0, np.int64), *(b[1] for b in bags)])
    words = sizes[kept]
    out = Items([ids[k] for k in kept.tolist()], words, prints, bounds, flat, counts)
    out.by_words = {n: np.flatnonzero(words == n) for n in np.unique(words).tolist()}
    each = np.repeat(words, np.diff(bounds))
    for width in np.unique(np.minimum(words, 5)).tolist():
        own = np.minimum(each, 5) == width
        order = np.lexsort((each[own], flat[own]))
        values, of = flat[own][order], each[own][order]
        fresh = np.r_[True, (values[1:] != values[:-1]) | (of[1:] != of[:-1])][: len(values)]
        values, of = values[fresh], of[fresh]
        known, starts = np.unique(values, return_index=True)
        quick = np.zeros(1 << 20, bool)
        quick[known >> np.uint64(44)] = True
        out.known[width] = known, np.append(starts, len(values)), of, quick
    return out


def _whole(shingles: np.ndarray) -> np.ndarray:
    """SimHash of all shingles together, in memory that does not grow with their number."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), CHUNK):
        total += votes(shingles[k : k + CHUNK]).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(shingles)).view(np.uint64)


def _windows(rolled: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of windows of ``size`` shingles, a bounded number at once, and their fingerprints."""
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = int(np.searchsorted(starts, low + CHUNK))
        some = starts[at:end]
        if size > CHUNK:
            yield some, np.stack([_whole(rolled[s : s + size]) for s in some.tolist()])
        else:
            yield some, fingerprints(rolled[low : int(some[-1]) + size], size)[some - low]
        at = end


def candidates(prints: np.ndarray, items: np.ndarray, radius: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree within ``radius // blocks`` bits in one of the blocks.

    Holds all pairs within ``radius`` bits: were each block more than
    ``radius // blocks`` apart, the whole would be more than ``radius`` apart.
    """
    part = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}[BITS // blocks]
    mine, theirs = np.ascontiguousarray(prints).view(part), np.ascontiguousarray(items).view(part)
    found = np.zeros((len(mine), len(theirs)), bool)
    for b in range(blocks):
        buckets, which = np.unique(theirs[:, b], return_inverse=True)
        asked, whose = np.unique(mine[:, b], return_inverse=True)
        close = np.bitwise_count(asked[:, None] ^ buckets[None, :]) <= radius // blocks
        found |= close[whose][:, which]
    return np.nonzero(found)


def _similar(shingles: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """Sums of the smaller and of the larger multiplicities."""
    own, times = np.unique(shingles, return_counts=True)
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    least = int(np.minimum(times, counts[at])[values[at] == own].sum())
    return least, int(times.sum() + counts.sum()) - least


def _hits(hashes: np.ndarray, owner: np.ndarray, items: Items) -> dict[int, dict[int, np.ndarray]]:
    """For each text with a known shingle, and each size of an item that has it, the words where it begins."""
    texts, sizes, places = [], [], []
    for width, (known, starts, of, quick) in items.known.items():
        rolled = _rolled(hashes, width)
        maybe = np.flatnonzero(quick[rolled >> np.uint64(44)])
        maybe = maybe[owner[maybe] == owner[maybe + width - 1]]
        at = np.minimum(np.searchsorted(known, rolled[maybe]), len(known) - 1)
        same = known[at] == rolled[maybe]
        maybe, at = maybe[same], at[same]
        many = starts[at + 1] - starts[at]
        first = np.cumsum(many) - many
        sizes.append(of[np.arange(many.sum()) + np.repeat(starts[at] - first, many)])
        places.append(np.repeat(maybe, many))
        texts.append(owner[places[-1]])
    out: dict[int, dict[int, np.ndarray]] = {}
    if texts:
        text, size, place = (np.concatenate(x) for x in (texts, sizes, places))
        order = np.lexsort((place, size, text))
        text, size, place = text[order], size[order], place[order]
        cuts = np.flatnonzero((text[1:] != text[:-1]) | (size[1:] != size[:-1])) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(text)].tolist(), strict=True):
            if b > a:
                out.setdefault(int(text[a]), {})[int(size[a])] = place[a:b]
    return out


def _starts(places: np.ndarray, size: int, last: int) -> np.ndarray:
    """Starts, up to ``last``, of the windows of ``size`` shingles that hold one of ``places``, sorted."""
    change = np.zeros(last + 2, np.int32)
    near = places[places - size < last]
    np.add.at(change, np.maximum(near - size + 1, 0), 1)
    np.add.at(change, np.minimum(near, last) + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def leaks(hashes: np.ndarray, hits: dict[int, np.ndarray], items: Items, *, percent: int, radius: int, blocks: int) -> list[tuple[int, float, int, int, int]]:
    """``(item, similarity, first word, words, windows)``: each item's best window, the first on ties.

    ``hits`` has the words at which a shingle of an item of each size begins.
    """
    out: dict[int, list] = {}
    every = {width: _rolled(hashes, width) for width in {min(words, 5) for words in hits}}
    for words, places in sorted(hits.items()):
        members, rolled = items.by_words[words], every[min(words, 5)]
        full = words - min(words, 5) + 1
        size = min(full, len(rolled))
        if 100 * size < percent * full:
            continue
        for some, prints in _windows(rolled, _starts(places, size, len(rolled) - size), size):
            rows, cols = candidates(prints, items.prints[members], radius, blocks)
            near = np.bitwise_count(prints[rows] ^ items.prints[members[cols]]).sum(axis=1, dtype=np.int64) <= radius
            for r, c in zip(rows[near].tolist(), cols[near].tolist(), strict=True):
                item, start = int(members[c]), int(some[r])
                a, b = items.bounds[item], items.bounds[item + 1]
                least, most = _similar(rolled[start : start + size], items.shingles[a:b], items.counts[a:b])
                if 100 * least >= percent * most:
                    held = out.setdefault(item, [0.0, start, 0, min(words, len(hashes))])
                    held[2] += 1
                    if least / most > held[0]:
                        held[:2] = [least / most, start]
    return [(k, s, at, words, n) for k, (s, at, n, words) in sorted(out.items())]


def _each(array: pa.Array, items: Items, how: dict) -> Iterator[list]:
    data, offsets = tx.buffers(array)
    for i, j in tx.slices(offsets):
        hashes, _, owner = tx.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        bounds = np.searchsorted(owner, np.arange(j - i + 1)).tolist()
        found = _hits(hashes, owner, items)
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            yield leaks(hashes[a:b], {words: at - a for words, at in found[k].items()}, items, **how) if k in found else []


def _passes(benchmark: DataFrame, pass_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(math.ceil(size / pass_bytes), 1)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()
        yield build([r["item_id"] for r in own], [r["text"] for r in own])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, percent: int = 75, radius: int = 75, blocks: int = 8, pass_bytes: int = 32 << 20) -> DataFrame:
    """Benchmark items found in documents.

    Takes ``docs(doc_id, text)`` and ``benchmark(item_id, text)``; other columns
    are ignored.  Returns ``doc_id, item_id, similarity, start_word, n_words,
    n_windows`` with one row for each document and item that it leaks: the best
    window (the first on ties) and how many windows reach the threshold.  Null
    and blank texts on either side match nothing; an item of fewer than five
    words is one shingle and matches exactly.  A document shorter than an item
    is one window (``n_words`` is then its own number of words).  Items that
    repeat an ``item_id`` are searched for each by itself, and so are items with
    a null one, which stays null.  Repeated documents each give their rows.  An
    empty table on either side gives an empty result, and texts of any length
    are searched whole.
    """
    how = {"percent": percent, "radius": radius, "blocks": blocks}
    spark, out = docs.sparkSession, None
    for items in _passes(benchmark, pass_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = [(k, *x) for k, found in enumerate(_each(batch.column(1), own, how)) for x in found]
                k, item, sim, start, words, n = zip(*rows, strict=True) if rows else ((),) * 6
                cols = [batch.column(0).take(pa.array(k, pa.int64())), pa.array([own.ids[x] for x in item], pa.int64()), pa.array(sim, pa.float64()), *(pa.array(v, pa.int64()) for v in (start, words, n))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "similarity", "start_word", "n_words", "n_windows"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long, n_windows long")
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, percent: int = 75, radius: int = 75, blocks: int = 8, pass_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns kept; no shuffle.

    Each row is judged by its text alone: ids, repeats and columns named as in
    ``benchmark`` play no part.  Null and blank texts stay, and so does every
    row if the benchmark is empty.
    """
    how = {"percent": percent, "radius": radius, "blocks": blocks}
    spark, at = docs.sparkSession, docs.columns.index("text")
    for items in _passes(benchmark, pass_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in _each(batch.column(at), shared.value, how)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), i AS (
  SELECT item, item_id, w, least(len(w), 5) AS width, len(w) - least(len(w), 5) + 1 AS size FROM t WHERE len(w) > 0
), bag AS (
  SELECT item, width, shingle, COUNT(*) AS n FROM (SELECT item, width, unnest(list_transform(range(1, size + 1), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS shingle FROM i) GROUP BY ALL
), known AS (
  SELECT DISTINCT width, shingle FROM bag
), one AS (
  SELECT doc_id, len(w) AS n_doc, width, unnest(range(0, len(w) - width + 1)) AS pos, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS shingle
  FROM d, (SELECT DISTINCT width FROM i) WHERE len(w) >= width
), seen AS (
  SELECT one.* FROM one SEMI JOIN known USING (width, shingle)
), hits AS (
  SELECT doc_id, item, pos, shingle, n, width, n_doc, i.size AS full_size, least(i.size, n_doc - width + 1) AS size FROM seen JOIN bag USING (width, shingle) JOIN i USING (item, width)
), starts AS (
  SELECT DISTINCT doc_id, item, full_size, size, unnest(range(greatest(pos - size + 1, 0), least(pos, n_doc - width + 1 - size) + 1)) AS start FROM hits WHERE 100 * size >= 75 * full_size
), shared AS (
  SELECT s.doc_id, s.item, s.start, s.size, s.full_size, least(COUNT(*), any_value(h.n)) AS n
  FROM starts s JOIN hits h ON h.doc_id = s.doc_id AND h.item = s.item AND h.pos BETWEEN s.start AND s.start + s.size - 1 GROUP BY s.doc_id, s.item, s.start, s.size, s.full_size, h.shingle
), alike AS (
  SELECT doc_id, item, start, size, CAST(SUM(n) AS BIGINT) AS low, CAST(size + full_size - SUM(n) AS BIGINT) AS high FROM shared GROUP BY doc_id, item, start, size, full_size
)
SELECT doc_id, item_id, MAX(CAST(low AS DOUBLE) / high) AS similarity, CAST(arg_min(start, (-(CAST(low AS DOUBLE) / high), start)) AS BIGINT) AS start_word,
  CAST(any_value(alike.size) + any_value(width) - 1 AS BIGINT) AS n_words, COUNT(*) AS n_windows
FROM alike JOIN i USING (item) WHERE 100 * low >= 75 * high GROUP BY doc_id, item, item_id
"""
