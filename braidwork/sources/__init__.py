"""Nodes that read data.

Each is a pyspark node with a key of its own, so that all consumers of one
source share one frame and Spark prunes its columns and partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.node import Node, NodeKind
from ..plans.schema import Schema


def source(name: str, read: Callable[[SparkSession], DataFrame], *, output: Schema | None = None, description: str = "", tags: list[str] | None = None) -> Node:
    """A source from any function of a session."""

    def load(spark: SparkSession) -> DataFrame:
        return read(spark)

    load.__name__ = name
    load.__doc__ = description or f"Reads {name}."
    key = "source_" + re.sub(r"[^A-Za-z0-9]", "_", name)
    return Node(load, "pyspark", spark_context=True, output=output, tags=["datasource", *(tags or [])], kind=NodeKind.DATASOURCE, key=key, name=name)


def table(name: str, **how: Any) -> Node:
    """A table or view of the session's catalog."""
    return source(name, lambda spark: spark.table(name), **how)


def files(path: str, format: str = "parquet", *, name: str | None = None, options: dict[str, Any] | None = None, schema: Any = None, **how: Any) -> Node:
    """Files that ``spark.read`` knows: parquet, csv, json, orc, text."""

    def read(spark: SparkSession) -> DataFrame:
        reader = spark.read.format(format).options(**(options or {}))
        return (reader.schema(schema) if schema is not None else reader).load(path)

    return source(name or path, read, **how)


def jdbc(url: str, name: str, *, options: dict[str, Any] | None = None, **how: Any) -> Node:
    """A table of a database; give ``partitionColumn`` and bounds in ``options`` to read it in parallel."""
    return source(name, lambda spark: spark.read.format("jdbc").options(url=url, dbtable=name, **(options or {})).load(), **how)


def frame(name: str, value: Any, **how: Any) -> Node:
    """A frame that exists already: Spark, pandas, or rows and a schema."""
    from ..operators.frames import FrameKind, convert

    return source(name, lambda spark: convert(value, FrameKind.PYSPARK, spark), **how)


Spark = table
