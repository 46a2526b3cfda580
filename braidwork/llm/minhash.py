"""Near-duplicate documents by min-max hashing.

1. One pass over the texts hashes each document's distinct five-word shingles
   and takes, under each of ``permutations`` random permutations, both the
   smallest and the largest value: two signature values for one evaluation,
   unbiased for Jaccard and of lower variance than as many independent minima.
2. Documents with equal shingle sets form one class; only its smallest
   ``doc_id`` goes on, so thousands of copies cost one row.
3. Signatures are cut into ``bands`` of ``rows`` values.  Each band bucket draws
   one member and compares the others with it (a star, never all pairs); the
   buckets of a document draw differently, so a large group of near copies
   grows together.  Links are confirmed on the full shingle sets, components
   are found, and buckets that still hold several components draw again.
4. The documents of buckets that hold several components after ``stars`` turns
   are compared across these components, so that no link between different
   texts is lost.  An exact prefix filter on their rarest shingles keeps this
   from growing with the square of a family of copies just below the threshold.

With 40 bands of 5 values a pair at the threshold of 0.75 misses every bucket
with probability (1 - 0.75^5)^40 = 2e-5, and far less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._graph import components
from ._work import Workspace

#: 64-bit words of the parity bitmap of a set.
_BITMAP = 8
_BITS = [f"b{k}" for k in range(_BITMAP)]
SIGNATURE = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _draw(permutations: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    mult = rng.integers(0, 2**31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, permutations, dtype=np.uint32)
    weights = rng.integers(0, 2**63, bands * rows, dtype=np.uint64).reshape(bands, rows) * np.uint64(2) + np.uint64(1)
    return mult, add, weights


def minmax(values: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set's hashes under each permutation, minima first."""
    folded = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(mult), 2**32 - 1, np.uint32)
    high = np.zeros(len(mult), np.uint32)
    for at in range(0, len(folded), 2048):
        block = folded[None, at : at + 2048] * mult[:, None] + add[:, None]
        np.minimum(low, block.min(axis=1), out=low)
        np.maximum(high, block.max(axis=1), out=high)
    return np.concatenate([low, high])


def _band_keys(signature: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bands, rows = weights.shape
    table = signature[: bands * rows].astype(np.uint64).reshape(bands, rows)
    return tx.mix((table * weights).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def text_sets(array: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = tx.buffers(array)
    for i, j in tx.slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        hashes, _, owner = tx.words(data[offsets[i] : offsets[j]], own)
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        for x in tx.shingles(hashes, bounds, width):
            yield tx.distinct(x)


def signatures(docs: DataFrame, *, width: int, permutations: int, bands: int, rows: int) -> DataFrame:
    """``SIGNATURE`` rows, one for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add, weights = _draw(permutations, bands, rows)
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            for values in text_sets(batch.column(1), width):
                n.append(len(values))
                k1.append(values.sum(dtype=np.uint64))
                k2.append(np.bitwise_xor.reduce(tx.mix(values)) if len(values) else np.uint64(0))
                keys.append(_band_keys(minmax(values, mult, add), weights) if len(values) else np.zeros(0, np.uint64))
            cols = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)), tx.long_lists(keys)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNATURE)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``id``, the packed shingles and the parity bitmap of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, maps = [], []
            for x in text_sets(batch.column(1), width):
                out.append(x.tobytes())
                place = (x >> np.uint64(20)).astype(np.int64) % (64 * _BITMAP)
                maps.append(np.packbits((np.bincount(place, minlength=64 * _BITMAP) & 1).astype(np.uint8)).view(np.int64))
            bits = np.array(maps, np.int64).reshape(len(maps), _BITMAP)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *(pa.array(bits[:, k]) for k in range(_BITMAP))], names=["id", "shingles", *_BITS])

    return texts.mapInArrow(run, "id long, shingles binary, " + ", ".join(f"{b} long" for b in _BITS))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    rows = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "su", "sv")
    return rows.mapInArrow(run, "u long, v long")


def _star(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each bucket's members with one of them, drawn by hash, so that buckets draw differently."""
    draw = F.xxhash64(F.lit(turn), "key", "rep")
    head = members.groupBy("key").agg(*(F.min_by(c, draw).alias(f"head_{c}") for c in ("rep", "n_shingles", "component_id")))
    both = members.join(head, "key").where("component_id != head_component_id").where(_alike("n_shingles", "head_n_shingles", percent))
    return both.select(F.greatest("rep", "head_rep").alias("u"), F.least("rep", "head_rep").alias("v"))


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components among the members' documents, by their rarest shingles.

    Sets with Jaccard of ``percent`` or more have a shingle in common among the
    first ``n - ceil(percent * n / 100) + 1`` of each, in any one order; rarest
    first, few documents share one.  A pair is left out where the places of the
    common shingle, or the parity bitmaps of the sets (which differ in no more
    bits than the sets in shingles), prove it below the threshold.
    """
    owner = members.groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n"), F.max("component_id").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column(3))
            size = np.diff(offsets) // 8
            for i, j in tx.slices(offsets):  # bounds the rows of a batch
                of = pa.array(np.repeat(np.arange(i, j), size[i:j]))
                own = data[offsets[i] : offsets[j]].view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(3)), pa.array(own)], names=["id", "n", "c", "shingle"])

    rows = sets.join(owner, "id").select("id", "n", "c", "shingles").mapInArrow(run, "id long, n long, c long, shingle long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    of_id = Window.partitionBy("id")
    ranked = rows.join(often, "shingle").withColumn("at", F.row_number().over(of_id.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(of_id))
    prefix = ranked.where(f"at <= n - floor(({percent} * n + 99) / 100) + 1").select("shingle", "id", "n", "c", "at").join(sets.select("id", *_BITS), "id")
    a, b = prefix.alias("a"), prefix.alias("b")
    need = f"{percent} * (a.n + b.n)"
    placed = F.expr(f"{100 + percent} * (1 + least(a.n - a.at, b.n - b.at)) >= {need}")
    apart = " + ".join(f"bit_count(a.{x} ^ b.{x})" for x in _BITS)
    near = F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * (a.n + b.n)")
    both = a.join(b, F.expr("a.shingle = b.shingle and a.id > b.id and a.c != b.c") & _alike("a.n", "b.n", percent) & placed & near)
    return both.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))


def _alike(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _still_open(members: DataFrame, near: DataFrame) -> DataFrame:
    """The buckets that have members of several components, with these components."""
    placed = members.drop("component_id").join(near.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    split = placed.groupBy("key").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b").select("key")
    return placed.join(split, "key", "left_semi").select("rep", "n_shingles", "key", "component_id")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 75, permutations: int = 100, bands: int = 40, rows: int = 5, stars: int = 2
) -> DataFrame:
    """Component of near-duplicates of each document.

    Takes any frame with ``doc_id`` and ``text``; other columns are ignored.
    Returns ``doc_id, n_shingles, component_id, kept``, one row for each input
    row.  Null, empty and blank texts have no shingles and link with nothing.
    A null ``doc_id`` links with nothing and has a null component; it is kept.
    Rows that repeat a ``doc_id`` stand for one document and get one component.
    An empty table gives an empty result.
    """
    if bands * rows > 2 * permutations:
        raise ValueError("bands * rows exceeds the two values of each permutation")
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    sig = work.save(signatures(docs, width=width, permutations=permutations, bands=bands, rows=rows), "signatures")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    classes = work.save(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    exploded = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    open_ = work.save(exploded.join(shared, "key", "left_semi").withColumn("component_id", F.col("rep")), "members")
    wanted = open_.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = work.save(_sets(texts.join(wanted, "doc_id", "left_semi"), width), "sets")
    near = tried = None
    for turn in range(stars + 1):
        pairs = (_star(open_, percent, turn) if turn < stars else _rest(open_, sets, percent)).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = work.save(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = work.save(_confirm(pairs, sets, percent), "confirmed")
        if near is not None:
            links = links.unionByName(near.select(F.col("id").alias("u"), F.col("component_id").alias("v")))
        near = components(links, work)
        if turn < stars:
            before, open_ = open_, work.save(_still_open(open_, near), "open")
            work.drop(before)
    final = near
    of_class = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    keys = ["k1", "k2", "n_shingles"]
    out = sig.select("doc_id", *keys).join(of_class, keys, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = work.save(out.select("doc_id", "n_shingles", component.alias("component_id")), "result")
    work.keep_only(out)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), one AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, COUNT(*) AS n_both FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common WHERE 100 * n_both >= 75 * (nx + ny - n_both)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(any_value(s.shingles)) AS BIGINT) AS n_shingles, MIN(r.y) AS component_id, MIN(r.y) = s.doc_id AS kept
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id
"""
