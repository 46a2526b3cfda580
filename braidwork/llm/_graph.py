"""Connected components of an edge table, distributed.

Alternates large-star and small-star steps (each vertex hands its neighbours
to its smallest neighbour) until the edges are a forest of stars.  The number
of rounds is logarithmic in the longest chain.  A vertex with very many
neighbours is never gathered: its minimum is a partially aggregated ``min``,
and its edges are joined with that minimum, which adaptive execution can
split.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Workspace


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionAll(moved)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``(id, component_id)`` for each vertex that is not the smallest of its component.

    ``edges`` has the columns ``u`` and ``v``, two longs.  Loops and nulls are
    ignored; without edges the result is empty.
    """
    seen = None
    now = work.save(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        seen = mark
        step = work.save(_small(_large(now).where("u != v").distinct()).where("u != v").distinct(), "stars")
        work.drop(now)
        now = step
