"""Vectorised word and byte hashing over Arrow string buffers.

Words are runs of bytes outside 0x20 and 0x09-0x0D, with A-Z folded to lower
case.  All functions work on whole batches of texts with numpy; nothing loops
over words in Python.  Texts longer than ``PIECE`` bytes are hashed in pieces
that end at white space, so temporary arrays stay bounded whatever the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE = 1 << 20
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_rng = np.random.default_rng(20240611)
#: One random odd-ish 64-bit value for each byte; upper and lower case share it.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_FOLD] * U64(2) + U64(1)
_RAW = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Multipliers of the words in a shingle.
_STEP = [U64(pow(0xD6E8FEB86659FD93, j, 2**64)) for j in range(64)]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null texts are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def slices(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses a text's border."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = (data != 0x20) & (data - np.uint8(0x09) > 4)
    turn = np.empty(len(data) + 1, bool)
    turn[0], turn[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=turn[1:-1])
    at = np.flatnonzero(turn)  # starts and ends by turns
    edge = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    edge = edge[word[edge] & word[edge - 1]]
    at = np.insert(at, np.repeat(np.searchsorted(at, edge), 2), np.repeat(edge, 2))
    return at[::2], at[1::2]


def _piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = _spans(data, offsets)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = total[ends]
    hashes -= total[starts]
    hashes *= down[starts]
    hashes += (ends - starts).view(np.uint64)
    return mix(hashes), starts, ends


def places(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of the ``bounds`` at or before each of the rising ``starts``."""
    upto = np.searchsorted(starts, bounds)
    return np.repeat(np.arange(len(bounds) + 1), np.diff(np.r_[0, upto, len(starts)]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and text number of each word of texts laid end to end.

    ``offsets`` are relative to ``data`` and begin with 0.
    """
    n = len(data)
    if n <= PIECE + 4096 or len(offsets) > 2:
        hashes, starts, _ = _piece(data, offsets)
    else:
        parts, at = [], 0
        while at < n:
            cut = at + PIECE
            while cut < n and not SPACE[data[cut]]:
                step = SPACE[data[cut : cut + 4096]]
                cut += int(step.argmax()) if step.any() else len(step)
            cut = min(cut, n)
            h, s, _ = _piece(data[at:cut], np.array([0, cut - at]))
            parts.append((h, s + at))
            at = cut
        hashes = np.concatenate([p[0] for p in parts])
        starts = np.concatenate([p[1] for p in parts])
    return hashes, starts, places(starts, offsets) - 1


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, in order, with repeats.

    ``bounds`` delimit the texts' words.  A text of fewer words has one
    shingle, its whole sequence; a text without words has none.
    """
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        if len(rolled):
            rolled += hashes[j : n - width + 1 + j] * _STEP[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(rolled[a : b - width + 1])
        elif b > a:
            short = (hashes[a:b] * np.array(_STEP[: b - a], np.uint64)).sum(dtype=np.uint64) + U64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on, case kept."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RAW[data] * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is many times faster than the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def long_lists(lists: list[np.ndarray]) -> pa.Array:
    """A list<int64> column from uint64 arrays."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.ascontiguousarray(flat))))


def packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and, for ``text``, its length ``__size`` (null for null) and compressed bytes ``__z``: for texts that are about to be shuffled."""
    fields = [rows.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            data, offsets = buffers(batch.column(len(names)))
            raw = memoryview(data)
            z = [codec.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            size = pa.array(np.diff(offsets), mask=batch.column(len(names)).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], size, pa.array([x.to_pybytes() for x in z], pa.binary())], names=[*names, "__size", "__z"])

    return rows.select(*names, "text").mapInArrow(run, T.StructType([*fields, T.StructField("__size", T.LongType()), T.StructField("__z", T.BinaryType())]))


def unpacked(size: pa.Array, z: pa.Array) -> pa.Array:
    """The texts that :func:`packed` compressed, as bytes; null texts are empty."""
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(x.as_buffer(), n, asbytes=True) if n else b"" for x, n in zip(z, size.to_pylist(), strict=True)], pa.large_binary())
