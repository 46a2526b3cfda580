"""Helpers for tests of nodes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import DataMismatchError, SchemaMismatchError
from .operators.frames import FrameKind, convert


def build_session(cores: int = 2, partitions: int = 4, **options: str) -> SparkSession:
    """A local session with UTC times and Arrow."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(map={
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true", **options,
    })
    return builder.getOrCreate()


def get_schema(frame: Any) -> list[tuple[str, str]]:
    """Names and types of the columns."""
    return frame.dtypes if isinstance(frame, DataFrame) else [(str(c), str(t)) for c, t in frame.dtypes.items()]


def assert_schemas_are_equals(a: Any, b: Any) -> None:
    if sorted(get_schema(a)) != sorted(get_schema(b)):
        raise SchemaMismatchError(f"{get_schema(a)} is not {get_schema(b)}")


def assert_dataframes_equals(a: Any, b: Any, spark: SparkSession | None = None) -> None:
    """Equal columns, types and bags of rows."""
    assert_schemas_are_equals(a, b)
    if not isinstance(a, DataFrame) and not isinstance(b, DataFrame) and spark is None:
        order = list(a.columns)
        x, y = (f.sort_values(order).reset_index(drop=True)[order] for f in (a, b))
        if not x.equals(y):
            raise DataMismatchError(f"{x}\nis not\n{y}")
        return
    x, y = (convert(f, FrameKind.PYSPARK, spark) for f in (a, b))
    y = y.select(*x.columns)
    for name, rest in (("first", x.exceptAll(y)), ("second", y.exceptAll(x))):
        if extra := rest.take(5):
            raise DataMismatchError(f"only in the {name} frame: {extra}")


def assert_pyspark_df_equal(a: DataFrame, b: DataFrame, *, order_by: list[str] | None = None, check_order: bool = False) -> None:
    """Equal schemas, counts and cells; in order if ``order_by`` or ``check_order`` is given."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise SchemaMismatchError(f"{a.schema.simpleString()} is not {b.schema.simpleString()}")
    if not (order_by or check_order):
        return assert_dataframes_equals(a, b)
    x, y = ((f.orderBy(*order_by) if order_by else f).collect() for f in (a, b))
    if len(x) != len(y):
        raise DataMismatchError(f"{len(x)} rows are not {len(y)}")
    for k, (r, s) in enumerate(zip(x, y, strict=True)):
        if r != s:
            raise DataMismatchError(f"row {k}: {r} is not {s}")
    return None
