"""Frames of the three kinds: detection, conversion, selection, schema enforcement."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from enum import Enum
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..errors import FrameKindError, MissingColumnsError, NoSelectedColumnsError
from ..functions.casts import conform_column, conform_series
from ..plans.schema import Schema

log = logging.getLogger("braidwork")


class FrameKind(Enum):
    PANDAS = "pandas"
    PANDAS_ON_SPARK = "pandas_on_spark"
    PYSPARK = "pyspark"


def frame_kind(frame: Any) -> FrameKind:
    if isinstance(frame, DataFrame):
        return FrameKind.PYSPARK
    if isinstance(frame, pd.DataFrame):
        return FrameKind.PANDAS
    if type(frame).__module__.startswith("pyspark.pandas"):
        return FrameKind.PANDAS_ON_SPARK
    raise FrameKindError(f"{type(frame)} is not a dataframe of a supported kind")


def _created(frame: pd.DataFrame, spark: SparkSession) -> DataFrame:
    """A Spark frame in which missing values are null, whether the session converts by Arrow or row by row.

    Row by row, Spark finds no type for a column of nulls, refuses ``pd.NA`` and
    keeps NaN; so columns of nulls get the type that Arrow has for them, and
    others hold None.
    """
    by_arrow = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled", "false").lower() == "true"
    held, columns = {}, []
    for k, (name, values) in enumerate(frame.items()):
        there = values.notna()
        if not there.any():
            kind = pa.Array.from_pandas(values).type
            null = F.lit(None).cast(from_arrow_type(kind.value_type if pa.types.is_dictionary(kind) else kind))
            held[f"c{k}"] = pd.Series(0, index=frame.index)
        elif not (by_arrow or there.all() or values.dtype.kind == "M"):  # rows of times have None for NaT
            plain = pd.Series(values.dt.to_pytimedelta(), frame.index, object) if values.dtype.kind == "m" else values.astype(object)
            held[f"c{k}"] = plain.where(there, None)
        else:
            held[f"c{k}"] = values
        columns.append((F.col(f"c{k}") if there.any() else null).alias(str(name)))
    return spark.createDataFrame(pd.DataFrame(held)).select(*columns)


def from_pandas(frame: pd.DataFrame, spark: SparkSession, schema: Schema | None = None) -> DataFrame:
    """A Spark frame with the declared types of its columns; an empty one without a schema has strings."""
    declared = {c.name: c.type for c in schema.columns} if schema is not None and schema.typed() else {}
    if not frame.empty:
        out = _created(frame, spark)
        quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
        return out.select(*(conform_column(quoted(f.name), f.dataType, declared[f.name]).alias(f.name) if f.name in declared else quoted(f.name) for f in out.schema.fields)) if declared else out
    if set(frame.columns) <= set(declared):
        types = {f.name: f for f in schema.struct().fields}
        return spark.createDataFrame([], T.StructType([types[c] for c in frame.columns]))
    log.warning("an empty pandas frame has no types: its columns become strings")
    return spark.createDataFrame([], T.StructType([T.StructField(str(c), T.StringType()) for c in frame.columns]))


def convert(frame: Any, to: FrameKind, spark: SparkSession | None = None, schema: Schema | None = None) -> Any:
    """``frame`` as a frame of another kind.  Only the way to pandas runs a job."""
    kind = frame_kind(frame)
    if kind is to:
        return frame
    if kind is FrameKind.PANDAS:
        if spark is None:
            raise ValueError("converting a pandas frame needs a Spark session")
        frame = from_pandas(frame, spark, schema)
        return frame if to is FrameKind.PYSPARK else frame.pandas_api()
    if kind is FrameKind.PYSPARK:
        return frame.toPandas() if to is FrameKind.PANDAS else frame.pandas_api()
    return frame.to_pandas() if to is FrameKind.PANDAS else frame.to_spark()


def clone(frame: Any) -> Any:
    """A frame that its holder can change without others seeing it."""
    return frame if isinstance(frame, DataFrame) else frame.copy()


def select(frame: Any, columns: Sequence[str]) -> Any:
    """Exactly these columns; names must match in case, whatever Spark would resolve."""
    if not columns:
        raise NoSelectedColumnsError("no column is selected")
    there = list(frame.columns)
    if set(columns) - set(there):
        raise MissingColumnsError(there, columns)
    return frame.select(*(F.col(f"`{c.replace('`', '``')}`") for c in columns)) if isinstance(frame, DataFrame) else frame[list(columns)]


def conform(frame: Any, schema: Schema | None) -> Any:
    """The declared columns in their order and types: one projection in Spark."""
    if schema is None:
        return frame
    names = schema.get_column_names()
    if frame_kind(frame) is FrameKind.PANDAS_ON_SPARK:
        return conform(frame.to_spark(), schema).pandas_api()
    frame = select(frame, names)
    if isinstance(frame, DataFrame):
        types = {f.name: f.dataType for f in frame.schema.fields}
        quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
        return frame.select(*(conform_column(quoted(c.name), types[c.name], c.type).alias(c.name) for c in schema.columns))
    return pd.DataFrame({c.name: conform_series(frame[c.name], c.type) for c in schema.columns}, columns=names)
