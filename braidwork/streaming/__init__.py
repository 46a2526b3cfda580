"""Micro-batches of a stream through a graph."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.merge import delete_path, path_exists
from ..plans.node import Node


def for_each_batch(target: Node, source: Node, *, sink: Callable[[DataFrame, int], None] | None = None, done: str | None = None, **settings: Any) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch``: ``target`` runs with the batch as ``source``.

    Spark may deliver a batch again after a failure.  Merging caches absorb
    that; for other sinks, ``done`` is a folder in which finished batches leave
    a mark, and a marked batch is passed over.
    """
    inputs = settings.pop("inputs", {})

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = f"{done}/batch-{batch_id}" if done else None
        if mark and path_exists(spark, mark):
            return
        result = target.run(spark, inputs={**inputs, source: batch}, **settings)
        if sink is not None:
            sink(result, batch_id)
        if mark:
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(mark), spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(mark))

    return run


def file_stream(spark: SparkSession, path: str, schema: Any, format: str = "json", **options: Any) -> DataFrame:
    """A streaming frame of the files that arrive in a folder."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def run_stream(stream: DataFrame, target: Node, source: Node, checkpoint: str, *, trigger: dict[str, Any] | None = None, **settings: Any) -> StreamingQuery:
    """Start the stream; without ``trigger`` it takes what is there and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(for_each_batch(target, source, **settings))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["delete_path", "file_stream", "for_each_batch", "run_stream"]
