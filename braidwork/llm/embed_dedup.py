"""Exact near-duplicate vectors by a metric range join over pivot cells.

Unit vectors with cosine ``>= threshold`` are exactly those within chord
distance ``eps = sqrt(2 - 2 * threshold)``.  A bounded number of pivots, drawn
by hash, divides each label's vectors into cells: a vector's home is the cell
of its nearest pivot.  By the triangle inequality a vector ``x`` can be within
``eps`` of a member of cell ``p`` only if its distance to ``p`` is at most the
cell's radius plus ``eps``, and at most its distance to its own pivot plus
``2 * eps``; only then is it copied to cell ``p``, and only to cells that come
before its home, so that each pair meets once.  Cells are joined independently,
as a grid of blocks of bounded size, and every pair is confirmed by its cosine
in double precision.

Equal vectors are one class with a multiplicity and a number of its own, so
different vectors that share a ``vec_id`` stay apart.  A block returns link counts
and one edge for each linked member (a forest), never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._work import Workspace

_MEMBER = "label string, dim int, cell int, home boolean, number long, m long, vector array<double>"
_KEYS = ["label", "dim", "cell"]


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, padded with zeros to ``dim``."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), max(int(lengths.max(initial=0)), dim)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    top = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(top > 0, top, 1)  # else squares may overflow or vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if units.shape[1] > pivots.shape[1]:
        pivots = np.pad(pivots, ((0, 0), (0, units.shape[1] - pivots.shape[1])))
    return np.sqrt(np.maximum(2 - 2 * (units @ pivots.T), 0))


def _join_block(table: pa.Table, threshold: float) -> pa.Table:
    home = table["role"].to_numpy() == 0
    vectors = _units(table["vector"].combine_chunks(), 0)
    number, m, own = table["number"].to_numpy(), table["m"].to_numpy(), table["home"].to_numpy(zero_copy_only=False)
    a, b = np.flatnonzero(home), np.flatnonzero(~home)
    linked = (vectors[a] @ vectors[b].T) >= threshold
    linked &= number[a][:, None] != number[b][None, :]
    counts = np.concatenate([linked @ m[b], np.where(own[b], 0, m[a] @ linked)])
    ids = np.concatenate([number[a], number[b]])
    x, y = np.nonzero(linked)
    least = ids.copy()
    while len(x):
        before = least.copy()
        np.minimum.at(least, x, before[len(a) + y])
        np.minimum.at(least, len(a) + y, before[x])
        if (least == before).all():
            break
    keep = (counts > 0) | (least < ids)
    return pa.table({"number": pa.array(ids[keep]), "links": pa.array(counts[keep].astype(np.int64)), "other": pa.array(least[keep])})


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, cell_rows: int = 4096, block_rows: int = 1024, most_pivots: int = 128) -> DataFrame:
    """Links and component of each vector.

    Takes any frame with ``vec_id``, ``embedding`` (an array of numbers) and
    ``label``; other columns are ignored.  Returns ``vec_id, n_links,
    component_id, kept``, one row for each input row.  Vectors link only within
    a label and a length.  A null label or vector, an empty or zero vector and
    one with null or non-finite components link with nothing.  Each row is
    a vector of its own, also where rows share a ``vec_id``.  A null ``vec_id`` links with nothing, has a null
    component and is kept.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "vectors")
    eps = math.sqrt(2 - 2 * threshold) + 1e-9
    value = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), value.alias("vector"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0)
    sound &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(1), "vector", "label")})
    keys = ["k1", "k2"]
    classes = work.save(rows.where("sound").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("vector").alias("vector")).withColumn("number", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    wanted = min(max(n // cell_rows, 1), most_pivots)
    drawn = [np.array(r[0]) for r in classes.orderBy(F.xxhash64(*keys), *keys).limit(wanted).select("vector").collect()]
    dim = max((len(p) for p in drawn), default=1)
    pivots = np.stack([np.pad(p / np.abs(p).max(), (0, dim - len(p))) for p in drawn]) if drawn else np.ones((1, 1))
    pivots /= np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))
    held = spark.sparkContext.broadcast(pivots)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _chords(_units(batch.column(0), dim), held.value)
                yield pa.RecordBatch.from_arrays([pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))], names=["cell", "far"])

    found = classes.select("vector").mapInArrow(homes, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect()
    radius = np.full(len(pivots), -1.0)
    for r in found:
        radius[r["cell"]] = r["far"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _chords(_units(batch.column(3), dim), held.value)
            home, least = far.argmin(axis=1), far.min(axis=1)
            visit = (far <= radius[None, :] + eps) & (far <= least[:, None] + 2 * eps) & (np.arange(len(radius))[None, :] < home[:, None]) & (radius >= 0)[None, :]
            for own in (True, False):
                x, cell = (np.arange(len(home)), home) if own else np.nonzero(visit)
                for k in range(0, len(x), 2048):
                    i = pa.array(x[k : k + 2048])
                    some = batch.take(i)
                    cols = [some.column(0), some.column(3).value_lengths().cast(pa.int32()), pa.array(cell[k : k + 2048].astype(np.int32)), pa.array(np.full(len(i), own)), some.column(1), some.column(2), some.column(3)]
                    yield pa.RecordBatch.from_arrays(cols, names=["label", "dim", "cell", "home", "number", "m", "vector"])

    members = work.save(classes.select("label", "number", "m", "vector").mapInArrow(deal, _MEMBER), "members")
    sizes = members.groupBy(*_KEYS).agg(F.ceil(F.sum(F.col("home").cast("long")) / block_rows).alias("nh"), F.ceil(F.count("*") / block_rows).alias("na"))
    sized = members.join(sizes, _KEYS).withColumns({"h": F.pmod(F.xxhash64("number"), "nh"), "a": F.pmod(F.xxhash64("number"), "na")})
    first = sized.where("home").withColumns({"role": F.lit(0), "a": F.explode(F.expr("sequence(0L, na - 1)"))})
    second = sized.where("nh > 0").withColumns({"role": F.lit(1), "h": F.explode(F.expr("sequence(0L, nh - 1)"))})
    blocks = first.unionByName(second).select(*_KEYS, "h", "a", "role", "home", "number", "m", "vector")
    joined = work.save(blocks.groupBy(*_KEYS, "h", "a").applyInArrow(lambda t: _join_block(t, threshold), "number long, links long, other long"), "links")
    near = components(joined.where("other < number").select(F.col("number").alias("u"), F.col("other").alias("v")), work)
    links = joined.groupBy("number").agg(F.sum("links").alias("links"))
    of_class = classes.select(*keys, "rep", "m", "number").join(links, "number", "left").join(near.select(F.col("id").alias("number"), F.col("component_id").alias("of")), "number", "left")
    of_class = of_class.withColumn("of", F.coalesce("of", "number"))
    least = of_class.groupBy("of").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "of").select(*keys, (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("sound"))
    out = rows.select("vec_id", "sound", *keys).join(of_class, [*keys, "sound"], "left")
    out = work.save(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "result")
    work.keep_only(out)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT v.vec_id, (SELECT COUNT(*) FROM links WHERE x = v.vec_id) AS n_links, MIN(r.y) AS component_id, MIN(r.y) = v.vec_id AS kept
FROM v JOIN reach r ON r.x = v.vec_id GROUP BY v.vec_id
"""
