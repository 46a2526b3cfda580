"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should appear ``target / source size`` times.  The
whole part is certain; the fractional parts are rounded dependently: two
documents trade probability mass so that the expected number of *words* of the
pair stays the same, until one of them is 0 or 1, and the other meets the next
document.  Words taken from a source therefore miss its target by less than
one document; long documents go first, so that a short one tends to be last.

Rounding runs as a reduction tree.  Leaves are hash buckets of one source with
a bounded number of documents, so a source with a third of all rows is many
leaves; each leaf settles all its documents but one, and the survivors of many
leaves meet one level up, until one is left and is rounded by itself.  Draws
and buckets are hashes of ``doc_id``, text and a number among equal rows: reruns
agree whatever the partitioning, and rows with a null or repeated id spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Workspace

WORDS = r"[^\x20\x09-\x0D]+"
_ROW = "doc_id long, text_hash long, source string, source_size long, target double, size long, copies long, mass double, draw long, leaf long, leaves long"
_EPS = 1e-12


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Words to take from each source.

    Sources in code-point order, null last, get the weights in turn and share
    the total; what exceeds ``cap`` times a source is shared out again by
    weight among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _settle(size: list[int], mass: list[float], draw: list[float]) -> tuple[list[int], int]:
    """Rounds ``mass`` pair by pair; returns 0 or 1 for each, and the index of the one left open or -1."""
    bits, held = [0] * len(size), -1
    p = 0.0
    for i, (t, q) in enumerate(zip(size, mass, strict=True)):
        if q <= _EPS or t == 0:
            continue
        if q >= 1 - _EPS:
            bits[i] = 1
            continue
        if held < 0:
            held, p = i, q
            continue
        s = size[held]
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        move = up if draw[i] * (up + down) < down else -down
        p, q = p + move / s, q - move / t
        for k, x in ((held, p), (i, q)):
            if x >= 1 - _EPS:
                bits[k] = 1
        if _EPS < q < 1 - _EPS:
            held, p = i, q
        elif not _EPS < p < 1 - _EPS:
            held = -1
    mass[:] = [p if k == held else float(b) for k, b in enumerate(bits)]
    return bits, held


def _leaf(table: pa.Table) -> pa.Table:
    order = table.sort_by([("size", "descending"), ("draw", "ascending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
    draw = (np.asarray(order["draw"]).view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
    mass = order["mass"].to_pylist()
    bits, held = _settle(order["size"].to_pylist(), mass, draw.tolist())
    copies = np.asarray(order["copies"]) + np.array(bits, np.int64)
    left = np.zeros(len(bits))
    if held >= 0:
        left[held] = mass[held]
    out = order.set_column(order.schema.get_field_index("copies"), "copies", pa.array(copies))
    return out.set_column(order.schema.get_field_index("mass"), "mass", pa.array(left))


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, leaf_rows: int = 4096, most_sources: int = 1_000_000) -> DataFrame:
    """How often each document enters the mix.

    Takes any frame with ``doc_id``, ``text`` and ``source``; other columns are
    ignored.  Returns ``doc_id, text_hash, source, size, source_size, target,
    copies, taken``, one row for each input row; ``text_hash`` is Spark's
    ``xxhash64`` of the text and ``taken = copies * size``.  A null text has
    size 0 and takes nothing; null sources are one source, the last.  Repeated
    rows are rounded each by itself.  An empty table gives an empty result.
    One number for each source reaches the driver, as the shares of all sources
    depend on each other; more than ``most_sources`` are an error.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    keys = ["doc_id", "text_hash", "source", "size"]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.col("source").cast("string"), size.alias("size"))
    rows = work.save(rows.groupBy(*keys).agg(F.count("*").alias("rows")), "sizes")
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.sum("rows").alias("n")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    aim = targets({r["source"]: r["words"] for r in found}, weights, cap)
    plan = [(r["source"], r["words"], aim[r["source"]], math.ceil(r["n"] / leaf_rows)) for r in found]
    table = spark.createDataFrame(plan, "source string, source_size long, target double, leaves long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    block = F.lit(4096)  # equal rows are numbered in two steps, so no list grows with their number
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / block))))
    each = each.withColumn("row", F.explode(F.sequence(F.col("block") * block, F.least((F.col("block") + 1) * block, F.col("rows")) - 1)))
    joined = each.alias("r").join(table.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("doc_id", "text_hash", "row", "r.source", "source_size", "target", "size", rate.alias("rate"), "leaves")
    ident = ["doc_id", "text_hash", "row"]
    level = joined.select(
        "doc_id", "text_hash", "source", "source_size", "target", "size", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("mass"),
        F.xxhash64(F.lit("draw"), *ident).alias("draw"), F.pmod(F.xxhash64(F.lit("leaf"), *ident), "leaves").alias("leaf"), "leaves",
    )
    done, most = [], max((p[3] for p in plan), default=1)
    while True:
        out = work.save(level.groupBy("source", "leaf").applyInArrow(_leaf, _ROW), "level")
        if most == 1:
            break
        done.append(out.where("mass = 0"))
        level = out.where("mass > 0").withColumns({"leaf": F.floor(F.col("leaf") / leaf_rows), "draw": F.xxhash64(F.lit("again"), "draw")})
        most = math.ceil(most / leaf_rows)
    lone = (F.shiftrightunsigned(F.xxhash64(F.lit("last"), "draw"), 11) / F.lit(2.0**53)) < F.col("mass")
    whole = out.withColumn("copies", F.col("copies") + F.when(lone & (F.col("mass") > 0), 1).otherwise(0))
    for x in done:
        whole = whole.unionByName(x)
    out = work.save(whole.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), "result")
    work.keep_only(out)
    return out
