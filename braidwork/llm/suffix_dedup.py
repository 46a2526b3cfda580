"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else in the corpus.  Sorting all suffixes of a corpus is not possible
in one place, so suffixes meet only where they can be equal:

1. Anchors.  Of every run of ``length`` bytes the 64-byte gram with the least
   hash (leftmost on ties) is an anchor.  Equal strings have equal anchors at
   equal offsets, so a repeated string always shares an anchor with its twin.
   Anchors that occur once are done with.
2. Each anchor's window is all the bytes that a string around it can have.
   Equal windows are counted, not gathered: where a window occurs twice, all
   its bytes are repeated.  Thousands of copies cost one row here.
3. Anchors with different windows go on with one row for each window.  The
   windows of a bucket are dealt to shards; each shard has its Burrows-Wheeler
   transform over the suffixes that are aligned at the anchor, column by
   column.  The transforms are merged by refining their interleave one symbol
   at a time: the interleave of column ``j`` follows from that of ``j + 1`` by
   one stable counting pass over the shards' symbols, and the lengths of the
   common prefixes follow from range minima.  No suffix is sorted again.
   Neighbours whose common prefix reaches ``length`` are repeated strings.
4. An anchor with more than ``group_rows`` different windows (a passage that a
   large part of all documents has in different surroundings) would not fit
   one task.  Its strings are hashed and counted instead, which is exact too.
5. Repeated strings become byte ranges; a document's ranges are united and cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._work import Workspace

GRAM = 64
_POS = np.uint64((1 << 21) - 1)
_ANCHOR = "uid int, id long, anchor long, window long, pos long, lead int, tail int"
_WINDOW = "anchor long, window long, n long, uid int, id long, pos long, lead int, content binary"
_RANGE = "uid int, id long, a long, b long"


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return keys if span == width else np.minimum(keys[: len(keys) - (width - span)], keys[width - span :])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in texts laid end to end, and the grams' hashes there."""
    gram = tx.rolling(data, GRAM)
    starts = len(data) - length + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keys = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    least = _least(keys, length - GRAM + 1)[:starts]
    inside = np.ones(starts + 1, bool)
    for edge in offsets[1:-1].tolist():
        inside[max(edge - length + 1, 0) : min(edge, starts)] = False
    at = (least[inside[:starts]] & _POS).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return at, gram[at]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows ``i`` to ``j`` and bytes ``a`` to ``b``: many short texts, or a part of a long one with overlap."""
    for i, j in tx.slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= tx.PIECE:
            yield i, j, a, b
        else:
            for x in range(a, b, tx.PIECE):
                yield i, j, x, min(x + tx.PIECE + length - 1, b)


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column(2))
            uid, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = -1
            for i, j, a, b in _pieces(offsets, length):
                part = data[a:b]
                own = np.clip(offsets[i : j + 1] - a, 0, b - a)
                at, gram = anchors(part, own, length)
                if len(at) and at[0] + a == done:  # the last anchor of a long text's piece can be the first of the next
                    at, gram = at[1:], gram[1:]
                done = int(at[-1]) + a if len(at) else done
                row = i + np.searchsorted(own, at, side="right") - 1 if j - i > 1 else np.full(len(at), i)
                pos = at + a - offsets[row]
                lead = np.minimum(pos, reach)
                tail = np.minimum(offsets[row + 1] - offsets[row] - pos, length)
                window = _range_hash(data, pos + offsets[row] - lead, pos + offsets[row] + tail)
                window = tx.mix(window + (lead * 1009 + tail).astype(np.uint64))
                cols = [uid[row], ident[row], gram.view(np.int64), window.view(np.int64), pos, lead.astype(np.int32), tail.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["uid", "id", "anchor", "window", "pos", "lead", "tail"])

    return texts.mapInArrow(run, _ANCHOR)


def _range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for each pair; the ranges lie near each other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low, high = int(starts.min()), int(ends.max())
    up, down = tx.powers(high - low + 1)
    total = np.zeros(high - low + 1, np.uint64)
    np.cumsum(tx.mix(tx._RAW)[data[low:high]] * up[: high - low], out=total[1:])
    return tx.mix((total[ends - low] - total[starts - low]) * down[starts - low])


def _contents(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted windows with their bytes."""
    of_text = wanted.groupBy("uid", "id").agg(F.collect_list(F.struct("anchor", "window", "n", "pos", "lead", "tail")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(tx.unpacked(batch.column(2), batch.column(3)))
            lists = batch.column(4)
            w = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            field = lambda k: w.field(k).to_numpy()
            start = offsets[row] + field("pos") - field("lead")
            stop = offsets[row] + field("pos") + field("tail")
            raw = data.tobytes() if len(w) else b""
            for k in range(0, len(w), 4096):
                own = slice(k, k + 4096)
                content = [raw[a:b] for a, b in zip(start[own].tolist(), stop[own].tolist(), strict=True)]
                ids = [batch.column(c).take(pa.array(row[own])) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(w.field(f)[own] for f in ("anchor", "window", "n")), *ids, w.field("pos")[own], w.field("lead")[own], pa.array(content, pa.binary())], names=["anchor", "window", "n", "uid", "id", "pos", "lead", "content"])

    return tx.packed(texts, ["uid", "id"]).join(of_text, ["uid", "id"]).select("uid", "id", "__size", "__z", "w").mapInArrow(run, _WINDOW)


def aligned_bwt(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform of one shard, column by column.

    ``columns[j]`` has the rows' symbols at column ``j``.  Returns ``bwt``, where
    ``bwt[j]`` lists these symbols in the order of the suffixes at ``j + 1``, and
    ``rank``, where ``rank[j]`` lists the rows in the order of the suffixes at ``j``.
    """
    width, rows = columns.shape
    bwt, rank = np.empty_like(columns), np.empty((width, rows), np.int32)
    order = np.arange(rows, dtype=np.int32)
    for j in range(width - 1, -1, -1):
        bwt[j] = columns[j][order]
        order = order[np.argsort(bwt[j], kind="stable")]
        rank[j] = order
    return bwt, rank


def merged_repeats(shards: list[tuple[np.ndarray, np.ndarray]], length: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column from which each row has ``length`` symbols in common with another row.

    Merges the shards' transforms by refining their interleave from the last
    column to the first.  ``none`` is the symbol of a place outside a text; it
    equals nothing.  Rows are numbered through the shards; without a repeat
    the first column is the number of columns and the last is -1.
    """
    width = shards[0][0].shape[0]
    sizes = [s[0].shape[1] for s in shards]
    base = np.concatenate([[0], np.cumsum(sizes)])
    rows = int(base[-1])
    interleave = np.repeat(np.arange(len(shards)), sizes)
    ends = np.full(rows, width, np.int64)  # where the common prefix with the suffix before ends
    ends[:1] = width
    first, last = np.full(rows, width), np.full(rows, -1)
    symbol, of_row = np.empty(rows, np.uint16), np.empty(rows, np.int64)
    places = np.argsort(interleave, kind="stable")
    for j in range(width - 1, -1, -1):
        for s, (bwt, _) in enumerate(shards):
            symbol[places[base[s] : base[s + 1]]] = bwt[j]
        order = np.argsort(symbol, kind="stable")
        new = symbol[order]
        same = np.flatnonzero((new[1:] == new[:-1]) & (new[1:] != none)) + 1
        fresh = np.full(rows, j, np.int64)
        if len(same):
            pairs = np.stack([order[same - 1] + 1, order[same] + 1], axis=1).ravel()
            fresh[same] = np.minimum.reduceat(np.append(ends, j), pairs)[::2]
        ends, interleave = fresh, interleave[order]
        places = np.argsort(interleave, kind="stable")
        if j + length <= width:
            for s, (_, rank) in enumerate(shards):
                of_row[places[base[s] : base[s + 1]]] = rank[j] + base[s]
            long = ends - j >= length
            hit = long.copy()
            hit[:-1] |= long[1:]
            found = of_row[hit]
            first[found] = j
            last[found] = np.maximum(last[found], j)
    return first, last


def _merge_bucket(table: pa.Table, length: int, shard_rows: int) -> pa.Table:
    reach, none = length - GRAM, 256
    width, rows = reach + length, table.num_rows
    columns = np.full((rows, width), none, np.uint16)
    lead = table["lead"].to_numpy()
    for k, x in enumerate(table["content"].combine_chunks()):
        own = np.frombuffer(x.as_buffer(), np.uint8)
        columns[k, reach - lead[k] : reach - lead[k] + len(own)] = own
    columns = np.ascontiguousarray(columns.T)
    shards = [aligned_bwt(columns[:, k : k + shard_rows]) for k in range(0, rows, shard_rows)]
    first, last = merged_repeats(shards, length, none)
    own = np.flatnonzero((last >= 0) & (table["n"].to_numpy() == 1))
    start = table["pos"].to_numpy()[own] - reach
    out = table.select(["uid", "id"]).take(pa.array(own))
    return pa.table({"uid": out["uid"], "id": out["id"], "a": start + first[own], "b": start + last[own] + length})


def _counted(windows: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated strings in anchors with very many windows, by counting hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(7)[k].as_buffer(), np.uint8)
                h = tx.rolling(x, length)
                start = batch.column(5)[k].as_py() - batch.column(6)[k].as_py() + np.arange(len(h))
                same = [pa.array(np.full(len(h), batch.column(c)[k].as_py()), batch.schema.field(c).type) for c in (0, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(h.view(np.int64)), pa.array(start)], names=["anchor", "n", "uid", "id", "pos", "h", "a"])

    rows = windows.mapInArrow(run, "anchor long, n long, uid int, id long, pos long, h long, a long")
    rows = rows.withColumn("offset", F.col("a") - F.col("pos"))  # a string near two equal anchors is one string
    keys = ["anchor", "h", "offset"]
    twice = rows.groupBy(*keys).agg(F.sum("n").alias("total")).where("total > 1").select(*keys)
    found = rows.where("n = 1").join(twice, keys)
    return found.groupBy("anchor", "uid", "id", "pos").agg(F.min("a").alias("a"), (F.max("a") + length).alias("b")).select("uid", "id", "a", "b")


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = tx.buffers(tx.unpacked(batch.column(1), batch.column(2)))
            raw, size, kept, spans = data.tobytes(), np.diff(offsets), [], []
            lists = batch.column(3)
            flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            for k in range(batch.num_rows):
                base, stop = int(offsets[k]), int(offsets[k + 1])
                own, text = [], []
                if at[k + 1] > at[k]:
                    x, y = a[at[k] : at[k + 1]], b[at[k] : at[k + 1]]
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], np.maximum.accumulate(y[order])
                    head = np.flatnonzero(np.r_[True, x[1:] > y[:-1]])
                    own = list(zip(x[head].tolist(), y[np.r_[head[1:], len(x)] - 1].tolist(), strict=True))
                done = base
                for s, e in own:
                    text.append(raw[done : base + s])
                    done = base + e
                kept.append(b"".join([*text, raw[done:stop]]))
                spans.append([{"start": s, "end": e} for s, e in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, *, length: int = 200, bucket_rows: int = 2000, shard_rows: int = 500, group_rows: int = 20000) -> DataFrame:
    """Texts without the bytes that lie in a repeated ``length``-byte string.

    Takes any frame with ``doc_id`` and ``text``; other columns are ignored.
    Returns ``doc_id, n_bytes, spans, kept``, one row for each input row:
    ``spans`` are the maximal removed byte ranges and ``kept`` is what is left,
    as bytes (a cut may fall within a character).  A null or empty text has no
    bytes and no spans.  A repeated row counts as another place.  An empty
    table gives an empty result.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    work = Workspace(spark, "suffix")
    text = F.col("text").cast("string")
    texts = docs.select(F.hash(text).alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    plain = texts.select("uid", "id", "text")
    every = work.save(_anchor_rows(plain.where(F.octet_length("text") >= length), length), "anchors")
    again = work.save(every.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor"), "again")
    shared = work.save(every.join(again, "anchor", "left_semi"), "shared")
    work.drop(every, again)
    keys = ["anchor", "window"]
    one = F.min(F.struct("uid", "id", "pos", "lead", "tail")).alias("one")
    windows = work.save(shared.groupBy(*keys).agg(F.count("*").alias("n"), one).select(*keys, "n", "one.*"), "windows")
    whole = shared.join(windows.where("n > 1").select(*keys), keys, "left_semi").select("uid", "id", (F.col("pos") - F.col("lead")).alias("a"), (F.col("pos") + F.col("tail")).alias("b"))
    groups = windows.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").drop("least")
    open_ = windows.join(groups, "anchor")
    wanted = work.save(open_, "open")
    ranges = work.save(whole, "whole")
    work.drop(shared)
    work.drop(windows)
    sizes = wanted.agg(F.count("*").alias("n"), F.max("m").alias("m")).first()
    content = work.save(_contents(plain, wanted.select(*keys, "n", "uid", "id", "pos", "lead", "tail")), "contents")
    large = wanted.where(F.col("m") > group_rows).select("anchor").distinct()
    buckets = max(sizes["n"] // bucket_rows, 1)
    small = content.join(large, "anchor", "left_anti") if (sizes["m"] or 0) > group_rows else content
    small = small.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    merged = small.groupBy("bucket").applyInArrow(lambda t: _merge_bucket(t, length, shard_rows), _RANGE)
    if (sizes["m"] or 0) > group_rows:
        merged = merged.unionByName(_counted(content.join(large, "anchor", "left_semi").select(*content.columns), length))
    ranges = ranges.unionByName(work.save(merged, "merged"))
    work.drop(content, wanted)
    lists = ranges.groupBy("uid", "id").agg(F.collect_set(F.struct("a", "b")).alias("r"))
    rows = tx.packed(texts, ["uid", "id", "doc_id"])
    return _cut(rows.join(lists, ["uid", "id"], "left").select("doc_id", "__size", "__z", "r"))
