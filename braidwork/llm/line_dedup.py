"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  A later line is removed if an earlier one has
a Jaccard similarity of ``percent`` or more; whether the earlier one stays does
not matter, so the result does not depend on any order of work.  Lines are in
order of ``doc_id`` and line number; where different texts share a ``doc_id``
(or have none), lines of equal number are in order of their hashes.

1. Words are counted in a table of ``buckets`` hash buckets: a broadcast of
   fixed size that gives one total order of words, rarest first.  The order
   need not be exact for the join to be, only the same everywhere.
2. Each line gives its size, a 128-bit key of its set, its prefix (the words of
   which two similar lines must share one) and a parity bitmap.  Equal sets are
   one class with its first line; equal lines of a block of texts are one row
   before they are dealt out, so thousands of equal lines cost few rows.
3. Classes meet by word.  A word that more than ``often`` prefixes hold is
   joined with a second word of the line: similar lines share two words of
   prefixes that are one word longer, so their lists stay short where single
   words' lists would grow with the corpus.
4. In a list, the length filter, the positions of the common word and the
   bitmaps rule out most pairs.  Each later line keeps only its best candidate,
   or a few where the best is close to the limit, so a family of variants costs
   a few pairs a line, not all pairs.  They are verified on the whole lines.
5. Lines whose candidates fail, and that have more, meet their lists again, and
   all their candidates are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._counts import KIND, pack, total
from ._work import Workspace

_LOW = np.uint64((1 << 24) - 1)
_WORDS = 2  # 64-bit words of a bitmap
_SHORT = 48  # sets up to this size have one word: theirs, folded
#: A line whose best candidate is within this share of the limit, in thousandths, is verified with it alone at first.
_SURE = 600
_BITS = [f"b{k}" for k in range(_WORDS)]
_KEY = ["doc", "line", "k1"]
_LINE = "doc long, line int, h long, k1 long, k2 long, n int, prefix binary, " + ", ".join(f"{b} long" for b in _BITS) + ", m int"
_PAIR = "doc long, line int, k1 long, doc2 long, line2 int, k12 long, ratio int, more boolean"
#: The fields of an entry of a list, packed one after the other.
_ENTRY = {"word": np.uint32, "doc": np.int64, "line": np.int32, "k1": np.int64, "n": np.int32, "at": np.int32, "open": np.uint8, **{b: np.int64 for b in _BITS}}
#: Comparisons that are held at once.
_BLOCK = 1 << 18
_FILTER_BITS = 26


def _tokens(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``i`` to ``j``, each word's hash, its row less ``i`` and its line's number in the text."""
    data, offsets = tx.buffers(array)
    for i, j in tx.slices(offsets, 1 << 18):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, starts, owner = tx.words(part, own)
        breaks = np.flatnonzero(part == 10)
        line = tx.places(starts, breaks) - np.searchsorted(breaks, own[:-1])[owner]
        yield i, j, hashes, owner, line


def _hashes(array: pa.Array) -> Iterator[np.ndarray]:
    """The words' hashes alone."""
    data, offsets = tx.buffers(array)
    for i, j in tx.slices(offsets, 1 << 17):  # temporary arrays stay in the cache
        yield tx.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]


def _counted(parts: Iterator[np.ndarray], buckets: int) -> np.ndarray:
    """How often each bucket is in ``parts``; the table is only passed over once for every so many numbers."""
    seen, held, n = np.zeros(buckets, np.int64), [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n > 2 * buckets:
            seen += np.bincount(np.concatenate(held), minlength=buckets)
            held, n = [], 0
    return seen + np.bincount(np.concatenate(held), minlength=buckets) if held else seen


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of short rows put together, up to ``rows`` rows or ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def word_order(docs: DataFrame, buckets: int) -> np.ndarray:
    """Place of each hash bucket when buckets are in order of their words' count."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack("words", _counted(((hashes >> shift).astype(np.int32) for batch in batches for hashes in _hashes(batch.column(0))), buckets))

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, KIND)
    seen = total(rows, buckets).get("words", np.zeros(buckets, np.int64))
    place = np.empty(buckets, np.uint64)
    place[np.argsort(seen, kind="stable")] = np.arange(buckets, dtype=np.uint64)
    return place


def _sets(hashes: np.ndarray, group: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups, bounds and the groups' distinct words, rarest first.  ``group`` does not fall."""
    shift = np.uint64(64 - (len(place).bit_length() - 1))
    words = (place[(hashes >> shift).astype(np.int64)] << np.uint64(24)) | ((hashes >> np.uint64(20)) & _LOW)
    most = 1 << (63 - 44)
    at = 0
    while at < len(group):
        base = int(group[at])
        end = int(np.searchsorted(group, base + most))
        keys = tx.distinct(((group[at:end] - base).astype(np.uint64) << np.uint64(44)) | words[at:end])
        of = (keys >> np.uint64(44)).astype(np.int64)
        bounds = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(keys)]
        yield of[bounds[:-1]] + base, bounds, keys & np.uint64((1 << 44) - 1)
        at = end


def _set_keys(words: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spread words, and the two keys of each set that begins at ``low``."""
    spread = tx.mix(words)
    return spread, np.add.reduceat(spread, low), np.bitwise_xor.reduceat(tx.mix(spread + np.uint64(1)), low)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Words that a set of ``n`` shares with any similar one, at least."""
    return (percent * n + 99) // 100


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of slices of ``flat``, ``size`` items each."""
    offsets = np.r_[0, np.cumsum(size)] * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _copies(k1: np.ndarray, k2: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """The number of rows of each set, at its first row in order of ``place``; 0 at the others."""
    by = np.lexsort((*place[::-1], k2, k1))
    at = np.flatnonzero(np.r_[True, (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])])
    out = np.zeros(len(by), np.int32)
    out[by[at]] = np.diff(np.r_[at, len(by)])
    return out


def _lines(docs: DataFrame, place, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, hashes, owner, line in _tokens(batch.column(2)):
                top = int(line.max(initial=0)) + 1
                for group, bounds, words in _sets(hashes, owner * top + line, place.value):
                    n, low = np.diff(bounds), bounds[:-1]
                    spread, k1, k2 = _set_keys(words, low)
                    bit, where = np.uint64(1) << (spread & np.uint64(63)), (spread >> np.uint64(6)) % np.uint64(_WORDS)
                    maps = [np.bitwise_xor.reduceat(np.where(where == k, bit, np.uint64(0)), low) for k in range(_WORDS)]
                    maps = [np.where(n <= _SHORT, maps[0] ^ maps[1], maps[0]), np.where(n <= _SHORT, np.uint64(0), maps[1])]
                    row = i + group // top
                    number = (group % top).astype(np.int32)
                    copies = _copies(k1, k2, ids[row], number, marks[row])
                    size = np.where(copies > 0, np.minimum(n - _needed(n, percent) + 2, n), 0)  # one word more, for pairs of words
                    place_in = np.arange(len(words)) - np.repeat(low, n)
                    kept = (spread[place_in < np.repeat(size, n)] >> np.uint64(32)).astype(np.uint32)  # equal words stay equal; the rest is for the verification
                    cols = [pa.array(ids[row]), pa.array(number), pa.array(marks[row]), *(pa.array(k.view(np.int64)) for k in (k1, k2)), pa.array(n.astype(np.int32)), _binary(kept, size), *(pa.array(m.view(np.int64)) for m in maps), pa.array(copies)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "line", "h", "k1", "k2", "n", "prefix", *_BITS, "m"])

    return docs.select("doc", "h", "text").mapInArrow(run, _LINE)


def _prefixes(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and word of each prefix entry; the rows' stored prefixes as starts and words."""
    k = batch.schema.get_field_index("prefix")
    data, offsets = tx.buffers(batch.column(k))
    flat, start = data[offsets[0] : offsets[-1]].view(np.uint32), (offsets - offsets[0]) // 4
    n = batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.int64)
    size = n - _needed(n, percent) + 1
    row = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, at, flat[start[row] + at], start, flat


def frequent_words(classes: DataFrame, work: Workspace, percent: int, often: int, buckets: int, most: int = 1 << 20) -> tuple[int, np.ndarray]:
    """Number of prefix entries, and the words that more than ``often`` prefixes hold, sorted.

    Exact: only words in buckets with so many entries are counted one by one.
    Where more than ``most`` words are, the limit rises by powers of two, which
    bounds the broadcast; words left out keep longer lists and lose no pair.
    """
    shift = np.uint32(32 - (buckets.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack("words", _counted((_prefixes(batch, percent)[2] >> shift for batch in batches), buckets))

    seen = total(classes.select("n", "prefix").mapInArrow(count, KIND), buckets).get("words", np.zeros(buckets, np.int64))
    full = classes.sparkSession.sparkContext.broadcast(seen > often)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _prefixes(batch, percent)[2]
            words = np.sort(words[full.value[words >> shift]])
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]][: len(words)])
            yield pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int32)), pa.array(np.diff(np.r_[first, len(words)]))], names=["word", "m"])

    if not (seen > often).any():
        return int(seen.sum()), np.zeros(0, np.uint32)
    counts = classes.select("n", "prefix").mapInArrow(single, "word int, m long").groupBy("word").agg(F.sum("m").alias("m"))
    counts = work.save(counts.where(F.col("m") > often), "frequent")
    sizes = {r["e"]: r["c"] for r in counts.groupBy(F.floor(F.log2("m")).cast("int").alias("e")).agg(F.count("*").alias("c")).collect()}
    least = 0
    while sum(c for e, c in sizes.items() if e >= least) > most:
        least += 1
    words = counts.where(F.floor(F.log2("m")) >= least).select("word").toArrow()["word"].to_numpy()
    return int(seen.sum()), np.sort(words.astype(np.int32).view(np.uint32))


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``held``."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _keys(batch: pa.RecordBatch, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and list of each entry: a word, or a frequent word and a later one."""
    row, at, word, start, flat = _prefixes(batch, percent)
    many = _among(word, frequent)
    r, a, w = row[many], at[many], word[many].astype(np.uint64)
    left = (start[r + 1] - start[r]) - a - 1
    which = np.repeat(np.arange(len(r)), left)
    second = a[which] + 1 + np.arange(len(which)) - np.repeat(np.cumsum(left) - left, left)
    both = (tx.mix((w[which] << np.uint64(32)) | flat[start[r[which]] + second].astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return np.r_[row[~many], r[which]], np.r_[at[~many], second - 1], np.r_[word[~many], both]


def _spread(classes: DataFrame, percent: int, parts: int, frequent, wanted=None, held=None) -> DataFrame:
    """Entries packed by the partition of their list; with ``wanted``, of the lists and sizes in this filter only; ``held`` has the keys of open lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in _gathered(batches):
            batch = _marked(batch, held)
            row, at, word = _keys(batch, percent, frequent.value)
            if wanted is not None:
                n = batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.int64)
                some = _held(wanted.value, _list_place(word, _size_class(n[row])))
                row, at, word = row[some], at[some], word[some]
            to = word.astype(np.int64) % parts
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(parts + 1))
            row, own = row[order], {"word": word[order], "at": at[order].astype(np.int32)}
            fields = [own[f] if f in own else np.ascontiguousarray(batch.column(batch.schema.get_field_index(f)).to_numpy()[row].astype(kind)) for f, kind in _ENTRY.items()]
            some = np.flatnonzero(np.diff(bounds)).tolist()
            packed = [codec.compress(b"".join(f[bounds[p] : bounds[p + 1]].tobytes() for f in fields)).to_pybytes() for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(bounds)[some], pa.int32()), pa.array(packed, pa.binary())], names=["part", "m", "z"])

    fixed = ["doc", "line", "k1", "n", "prefix", *_BITS]
    return classes.select(*fixed, *(c for c in ["open"] if c in classes.columns)).mapInArrow(run, "part int, m int, z binary")


def _marked(batch: pa.RecordBatch, held) -> pa.RecordBatch:
    """The batch with a column ``open``: its own, or whether the line's key is in ``held``."""
    if "open" in batch.schema.names:
        return batch
    keys = batch.column(batch.schema.get_field_index("k1")).to_numpy()
    some = _among(keys, held.value) if held is not None else np.zeros(len(keys), bool)
    return batch.append_column("open", pa.array(some.astype(np.int32)))


def _size_class(n: np.ndarray) -> np.ndarray:
    return (8 * np.log2(n)).astype(np.int64)


def _list_place(word: np.ndarray, size_class: np.ndarray) -> np.ndarray:
    """Bit of a list's lines of one size class in the filter of wanted lists."""
    return (tx.mix((word.astype(np.uint64) << np.uint64(16)) + size_class.astype(np.uint64)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _entries(table: pa.Table) -> dict[str, np.ndarray]:
    codec, width = pa.Codec("zstd"), sum(np.dtype(k).itemsize for k in _ENTRY.values())
    parts: dict[str, list[np.ndarray]] = {f: [] for f in _ENTRY}
    for m, z in zip(table["m"].to_pylist(), (x for c in table["z"].chunks for x in c), strict=True):
        raw, at = codec.decompress(z.as_buffer(), m * width), 0
        for f, kind in _ENTRY.items():
            parts[f].append(np.frombuffer(raw, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return {f: np.concatenate(x) for f, x in parts.items()}


def _line_order(doc: np.ndarray, line: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """Entries in order of their lines; far faster than ``lexsort`` where ids are not shared."""
    by = np.argsort(doc)
    rank = np.empty(len(doc), np.uint64)
    rank[by] = np.cumsum(np.r_[False, doc[by][1:] != doc[by][:-1]])
    place = (rank << np.uint64(32)) | line.astype(np.uint64)
    by = np.argsort(place)
    same = place[by][1:] == place[by][:-1]
    if (k1[by][1:][same] != k1[by][:-1][same]).any():
        by = np.lexsort((k1, place))
    return by


def _blocks(low: np.ndarray, high: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each ``x`` with the places from its ``low`` to its ``high``, in blocks of bounded size."""
    count = np.maximum(high - low, 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(x):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, side="right")), at + 1)
        c = count[at:upto]
        which = np.repeat(np.arange(at, upto), c)
        yield x[which], low[which] + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        at = upto


def _candidates(table: pa.Table, percent: int, long: int, few: int, again: bool) -> pa.Table:
    """For each later line its best earlier candidates and whether it has more; if ``again``, all candidates of open lines."""
    f = _entries(table)
    order = np.argsort((f["word"].astype(np.uint64) << np.uint64(32)) | f["n"].astype(np.uint64))
    f = {k: v[order] for k, v in f.items()}
    n, left = f["n"], f["n"] - f["at"]  # words of the set, and those from the common one on
    maps = [f[b].view(np.uint64) for b in _BITS]
    folded = maps[0] ^ maps[1]
    # ``who`` numbers the lines of this partition in their order
    by = _line_order(*(f[c] for c in _KEY))
    fresh = np.r_[True, np.any([f[c][by][1:] != f[c][by][:-1] for c in _KEY], axis=0)]
    who = np.empty(len(by), np.int64)
    who[by] = np.cumsum(fresh) - 1
    line = by[fresh]
    starts = np.flatnonzero(np.r_[True, f["word"][1:] != f["word"][:-1]])
    size = np.diff(np.r_[starts, len(by)])
    of = np.repeat(np.arange(len(starts)), size)
    width = int(n.max()) + 2
    sorted_key = of * width + n  # rises
    n64 = n.astype(np.int64)
    best, many = np.zeros(0, np.uint64), np.zeros(len(line), bool)
    wide = np.uint64(26)
    if len(line) >> 26:
        raise ValueError("more lines in a part than their numbers can hold")

    def able(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may be similar, and their distance by the bitmaps in thousandths of the limit."""
        both = n[x] + n[y]
        some = np.flatnonzero((100 + percent) * np.minimum(left[x], left[y]).astype(np.int64) >= percent * both.astype(np.int64))
        x, y, both = x[some], y[some], both[some].astype(np.int64)
        some = who[x] != who[y]
        x, y, both = x[some], y[some], both[some]
        apart = np.bitwise_count(folded[x] ^ folded[y]).astype(np.int64)
        wide = np.minimum(n[x], n[y]) > _SHORT
        a, b = x[wide], y[wide]
        apart[wide] = sum(np.bitwise_count(m[a] ^ m[b]).astype(np.int64) for m in maps)
        limit = (100 - percent) * both
        some = (100 + percent) * apart <= limit
        return x[some], y[some], 1000 * (100 + percent) * apart[some] // np.maximum(limit[some], 1)

    def keep(x: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> None:
        """Holds the best candidates of each later line, as later line, distance and earlier line in one number."""
        nonlocal best
        a, b = np.maximum(who[x], who[y]).astype(np.uint64), np.minimum(who[x], who[y]).astype(np.uint64)
        best = tx.distinct(np.concatenate([best, (a << np.uint64(36)) | (ratio.astype(np.uint64) << wide) | b]))
        a = (best >> np.uint64(36)).astype(np.int64)
        over = np.r_[np.zeros(few, bool), a[few:] == a[:-few]][: len(a)]
        many[a[over]] = True
        best = best[~over]

    def leaders(x: np.ndarray) -> None:
        """Lines are compared with those that are like no earlier one, these with all."""
        heads, rest = [], x[np.argsort(who[x], kind="stable")]
        whole = rest
        while len(rest):
            head, rest = rest[0], rest[1:]
            fit = 100 * np.minimum(n64[rest], n64[head]) >= percent * np.maximum(n64[rest], n64[head])
            a, b, ratio = able(rest[fit], np.full(int(fit.sum()), head))
            keep(a, b, ratio)
            many[who[a]] = True
            heads.append(head)
            rest = rest[~np.isin(who[rest], who[a]) & (who[rest] != who[head])]
        for head in heads:
            x = whole[who[whole] < who[head]]
            x = x[100 * np.minimum(n64[x], n64[head]) >= percent * np.maximum(n64[x], n64[head])]
            keep(*able(x, np.full(len(x), head)))

    if again:
        found = [np.zeros(0, np.int64)]
        x = np.flatnonzero(f["open"] > 0)
        low = np.searchsorted(sorted_key, of[x] * width + _needed(n64[x], percent))
        high = np.searchsorted(sorted_key, of[x] * width + np.minimum(100 * n64[x] // percent, width - 1), side="right")
        for a, b in _blocks(low, high, x):
            a, b, _ = able(a, b)
            a, b = who[a], who[b]
            found.append(tx.distinct((a << 32 | b)[b < a].view(np.uint64)).view(np.int64))
        pair = tx.distinct(np.concatenate(found).view(np.uint64)).view(np.int64)
        later, earlier = pair >> 32, pair & 0xFFFFFFFF
        ratio, more = np.zeros(len(pair), np.int32), np.zeros(len(pair), bool)
    else:
        for k in np.flatnonzero(size > long).tolist():
            leaders(np.arange(starts[k], starts[k] + size[k]))
        # In order of size, each line is compared with the longer ones up to its limit; as the shorter
        # line it can only match by a word in its first places.
        x = np.flatnonzero((size[of] > 1) & (size[of] <= long) & ((100 + percent) * left.astype(np.int64) >= 2 * percent * n64))
        high = np.searchsorted(sorted_key, of[x] * width + np.minimum(100 * n64[x] // percent, width - 1), side="right")
        for a, b in _blocks(x + 1, high, x):
            keep(*able(a, b))
        later, ratio, earlier = (best >> np.uint64(36)).astype(np.int64), ((best >> wide) & np.uint64(1023)).astype(np.int32), (best & np.uint64((1 << 26) - 1)).astype(np.int64)
        fresh = np.r_[True, later[1:] != later[:-1]][: len(later)]
        sure = (ratio[fresh] <= _SURE)[np.cumsum(fresh) - 1]
        many[later[sure & ~fresh]] = True
        some = fresh | ~sure
        later, ratio, earlier = later[some], ratio[some], earlier[some]
        more = many[later]
    a, b = line[later], line[earlier]
    cols = {c: f[c][a] for c in _KEY} | {f"{c}2": f[c][b] for c in _KEY} | {"ratio": ratio, "more": more}
    return pa.table(cols)


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Bit of a line in the filter of wanted lines."""
    return (tx.mix(tx.mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _marks(at: np.ndarray) -> pa.RecordBatch:
    at = tx.distinct(at.astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array((at >> 16).astype(np.int32)), pa.array((at & 0xFFFF).astype(np.int32))], names=["chunk", "bit"])


def _filter(marks: DataFrame) -> np.ndarray:
    """A bit table of fixed size from the distinct ``chunk, bit`` of ``marks``."""

    def gather(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[table["bit"].to_numpy()] = 1
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((1 << _FILTER_BITS) // 8, np.uint8)
    found = marks.distinct().groupBy("chunk").applyInArrow(gather, "chunk int, bits binary").toArrow()  # no more than ``out``
    for chunk, bits in zip(found["chunk"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[chunk << 13 : (chunk + 1) << 13] = np.frombuffer(bits, np.uint8)
    return out


def _held(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _wanted(lines: DataFrame) -> np.ndarray:
    """A filter that holds all of ``lines`` (and, the more there are, others)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _marks(_place(batch.column(0).to_numpy(), batch.column(1).to_numpy()))

    return _filter(lines.mapInArrow(mark, "chunk int, bit int"))


def _cuts(part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, start and end of each line of texts laid end to end."""
    breaks = np.flatnonzero(part == 10)
    owner = np.r_[np.arange(len(own) - 1), np.searchsorted(own, breaks, side="right") - 1]
    start = np.r_[own[:-1], breaks + 1]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    same = np.r_[owner[1:] == owner[:-1], False]
    end = np.where(same, np.r_[start[1:], 0] - 1, own[owner + 1])
    return owner, np.arange(len(owner)) - np.searchsorted(owner, owner), start, end


def _whole(texts: DataFrame, held, place) -> DataFrame:
    """``doc, line, k1, words`` of the lines that the filter ``held`` lets through: their distinct words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = tx.buffers(batch.column(1))
            for i, j in tx.slices(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                owner, number, start, end = _cuts(part, own)
                at = _place(ids[i + owner], number)
                hit = np.flatnonzero(_held(held.value, at))
                if not len(hit):
                    continue
                bounds = np.r_[0, np.cumsum(end[hit] - start[hit])]
                rows = np.concatenate([part[a:b] for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)])
                hashes, _, of = tx.words(rows, bounds)
                for group, cuts, words in _sets(hashes, of, place.value):
                    _, k1, _ = _set_keys(words, cuts[:-1])
                    which = hit[group]
                    cols = [pa.array(ids[i + owner[which]]), pa.array(number[which].astype(np.int32)), pa.array(k1.view(np.int64)), _binary(words, np.diff(cuts))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*_KEY, "words"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, line int, k1 long, words binary")


def _verify(pairs: DataFrame, texts: DataFrame, place, percent: int, work: Workspace) -> DataFrame:
    """The later lines of the pairs that reach the threshold on whole lines."""
    lines = pairs.select("doc", "line").unionByName(pairs.selectExpr("doc2 as doc", "line2 as line"))
    held = texts.sparkSession.sparkContext.broadcast(_wanted(lines))
    whole = work.save(_whole(texts, held, place), "whole")
    sets = whole.dropDuplicates(_KEY)
    other = sets.select(*(F.col(c).alias(f"{c}2") for c in _KEY), F.col("words").alias("words2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(3)], names=_KEY)

    rows = pairs.join(sets, _KEY).join(other, [f"{c}2" for c in _KEY])
    gone = work.save(rows.select(*_KEY, "words", "words2").mapInArrow(run, "doc long, line int, k1 long").distinct(), "gone")
    work.drop(whole)
    return gone


def repeated_lines(docs: DataFrame, work: Workspace, *, percent: int = 75, buckets: int = 1 << 20, often: int = 1024, long: int = 4096, few: int = 8, part_entries: int = 1 << 18) -> DataFrame:
    """``doc, h, line`` of each line that is similar to an earlier one; ``docs`` has ``doc``, ``h`` (a hash of the text) and ``text``.

    Each line has its best candidate verified first, or its ``few`` best ones
    if that one is close to the limit.  Lists above ``long`` entries are compared by leaders, which costs less in
    families of variants; the candidates differ, the result does not.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50: similar lines then share two words at least")
    context = docs.sparkSession.sparkContext
    place = context.broadcast(word_order(docs, buckets))
    lines = work.save(_lines(docs, place, percent), "lines", hashes=True)
    first = [F.min(F.struct("doc", "line", "h")).alias("first"), (F.sum("m") > 1).alias("many"), *(F.first(c).alias(c) for c in ("n", "prefix", *_BITS))]
    classes = work.save(lines.where("m > 0").repartition("k1", "k2").groupBy("k1", "k2").agg(*first).select("k1", "k2", "first.*", "many", "n", "prefix", *_BITS), "classes", hashes=True)
    entries, words = frequent_words(classes, work, percent, often, buckets)
    parts, frequent = max(math.ceil(entries / part_entries), 1), context.broadcast(words)
    lists = _spread(classes, percent, parts, frequent)
    found = work.save(lists.groupBy("part").applyInArrow(lambda t: _candidates(t, percent, long, few, False), _PAIR), "candidates")
    tried = F.sort_array(F.collect_set(F.struct("ratio", *(f"{c}2" for c in _KEY)))).alias("tried")  # at most ``few`` from each of the line's lists
    pairs = found.groupBy(*_KEY).agg(tried, F.max("more").alias("more")).withColumn("few", F.when(F.expr(f"tried[0].ratio <= {_SURE}"), 1).otherwise(few))
    pairs = pairs.select(*_KEY, (F.col("more") | (F.size("tried") > F.col("few"))).alias("more"), F.explode(F.slice("tried", F.lit(1), F.col("few"))).alias("pair"))
    pairs = work.save(pairs.select(*_KEY, "pair.*", "more"), "pairs")
    work.drop(found)
    gone = _verify(pairs, docs, place, percent, work)
    open_ = work.save(pairs.where("more").select(*_KEY).distinct().join(gone, _KEY, "left_anti"), "open")
    if open_.first() is not None:
        rest = work.save(_again(classes, open_, percent, parts, frequent), "rest")
        gone = gone.unionByName(_verify(rest, docs, place, percent, work))
    of_class = classes.select("k1", "k2", "doc", "line", "h", "many").join(gone.withColumn("gone", F.lit(True)), _KEY, "left")
    marked = of_class.where("many or gone").select("k1", "k2", *(F.col(c).alias(f"{c}1") for c in ("doc", "line", "h")), "gone")
    mine = lines.select("k1", "k2", "doc", "line", "h").join(marked, ["k1", "k2"])
    out = work.save(mine.where("gone or doc != doc1 or line != line1 or h != h1").select("doc", "h", "line"), "removed")
    work.keep_only(out)
    return out


def _again(classes: DataFrame, open_: DataFrame, percent: int, parts: int, frequent, most: int = 1 << 20) -> DataFrame:
    """All candidates of the open lines; only lists and sizes that they can match in are dealt out.

    Open lines are marked by a broadcast of their keys if there are at most
    ``most``, else by a join.
    """
    context = classes.sparkSession.sparkContext
    keys = open_.select("k1").limit(most + 1).toArrow()["k1"].to_numpy()  # the limit is the check of the size
    held = context.broadcast(np.sort(keys)) if len(keys) <= most else None
    if held is None:
        classes = classes.join(open_.withColumn("open", F.lit(1)), _KEY, "left").withColumn("open", F.coalesce("open", F.lit(0)))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _marked(batch, held)
            batch = batch.filter(pc.equal(batch.column(batch.schema.get_field_index("open")), 1))
            n = batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.int64)
            row, _, word = _keys(batch, percent, frequent.value)
            low, high = _size_class(_needed(n, percent))[row], _size_class(100 * n // percent)[row]
            which = np.repeat(np.arange(len(row)), high - low + 1)
            size = low[which] + np.arange(len(which)) - np.searchsorted(which, which)
            yield _marks(_list_place(word[which], size))

    marks = classes.select("k1", "n", "prefix", *(c for c in ["open"] if c in classes.columns)).mapInArrow(lists, "chunk int, bit int")
    wanted = context.broadcast(_filter(marks))
    dealt = _spread(classes, percent, parts, frequent, wanted, held).groupBy("part")
    return dealt.applyInArrow(lambda t: _candidates(t, percent, 0, 0, True), _PAIR).select(*_KEY, *(f"{c}2" for c in _KEY)).distinct()


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without repeated lines, all columns kept, with the line counts.

    Takes any frame with ``doc_id`` and ``text``.  Returns its columns, ``text``
    without the removed lines, and ``n_lines`` and ``removed`` (the numbers of
    the removed lines, from 0).  Lines without words are never removed; null
    and empty texts stay.  Rows that repeat a ``doc_id`` and its text are one
    document: a line is not removed for the same line of the same document.
    Different texts of one ``doc_id`` are documents of their own; their lines
    of equal number are in order of their hashes.  Documents with a null
    ``doc_id`` come last.  Columns named like the added ones are replaced.  An
    empty table gives an empty result.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    text = F.col("text").cast("string")
    work = Workspace(docs.sparkSession, "lines")
    gone = repeated_lines(docs.select(doc.alias("doc"), F.xxhash64(text).alias("h"), text.alias("text")), work, **how)
    lists = gone.groupBy(F.col("doc").alias("__doc"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_set("line")).alias("removed"))
    kept = [c for c in docs.columns if c not in ("n_lines", "removed", "text")]
    rows = docs.select(*kept, text.alias("text"), doc.alias("__doc"), F.xxhash64(text).alias("__h"))
    out = tx.packed(rows, [*kept, "__doc", "__h"]).join(lists, ["__doc", "__h"], "left").drop("__doc", "__h")
    return out.mapInArrow(_cut(len(kept)), _cut_schema(docs, kept))


def _cut_schema(docs: DataFrame, kept: list[str]) -> T.StructType:
    return T.StructType([*(docs.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])


def _cut(n: int):
    """Takes ``n`` columns, then size, compressed text and the removed lines' numbers; gives the columns and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count = [], []
            null = batch.column(n).is_null().to_pylist()
            asked = batch.column(n + 2).to_pylist()
            for x, none, gone in zip(tx.unpacked(batch.column(n).fill_null(0), batch.column(n + 1)), null, asked, strict=True):
                lines = x.as_py().split(b"\n")
                count.append(0 if none else len(lines))
                drop = set(gone or ())
                texts.append(None if none else b"\n".join(y for k, y in enumerate(lines) if k not in drop) if drop else x.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array([x or [] for x in asked], pa.list_(pa.int32()))], names=[*batch.schema.names[:n], "text", "n_lines", "removed"])

    return run
