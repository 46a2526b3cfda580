"""Conversions to declared types: null on failure in Spark, an error in pandas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CastError
from .types import Boolean, Date, DateTime, Decimal, Integer, LogicalType, Unknown, logical_type

# Physical types that Spark's analyser refuses to convert, by declared type.
_NEVER: dict[type[LogicalType], tuple[type[T.DataType], ...]] = {
    Boolean: (T.DateType, T.ArrayType, T.MapType, T.StructType, T.BinaryType),
    Date: (T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType, T.BinaryType),
    DateTime: (T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType, T.BinaryType),
}


def conform_column(column: Column, actual: T.DataType, declared: LogicalType) -> Column:
    """``column`` as ``declared``; unchanged if the type's name is already that."""
    if isinstance(declared, Unknown) or logical_type(actual).name == declared.name:
        return column
    if isinstance(actual, _NEVER.get(type(declared), ())):
        raise CastError(f"{actual.simpleString()} cannot be converted to {declared}")
    if isinstance(declared, DateTime):
        return F.try_to_timestamp(column, F.lit(declared.spark_format)) if isinstance(actual, T.StringType) else column.try_cast("timestamp")
    if isinstance(declared, Date):
        return F.try_to_date(column, declared.spark_format) if isinstance(actual, T.StringType) else column.try_cast("date")
    return column.try_cast(declared.spark)


_PANDAS = {"Byte": "int8", "Binary": "S", "Short": "int16", "Long": "int64", "Float": "float32", "Double": "float64", "String": str}
_INFERRED = {"boolean": "Boolean", "integer": "Long", "floating": "Double", "string": "String", "bytes": "Binary", "decimal": "Decimal", "date": "Date", "datetime": "DateTime", "datetime64": "DateTime"}


def pandas_type_name(values: pd.Series) -> str:
    """Name of the logical type of a pandas column, by its values that are not null."""
    return _INFERRED.get(pd.api.types.infer_dtype(values.dropna(), skipna=True), "Unknown")


def conform_series(values: pd.Series, declared: LogicalType) -> pd.Series:
    """``values`` as ``declared``; nulls stay, anything that does not fit is an error."""
    if isinstance(declared, Unknown) or pandas_type_name(values) == declared.name and values.notna().any():
        return values
    there = values.notna()
    if isinstance(declared, Date):
        unit = "datetime64[ns]"
        if there.all() or not there.any():
            return pd.to_datetime(values, format=declared.python_format).astype(unit)
        out = pd.Series(pd.NaT, index=values.index, dtype=unit)
        out[there] = pd.to_datetime(values[there], format=declared.python_format).astype(unit)
        return out
    if isinstance(declared, Boolean):
        bad = [v for v in values[there].unique() if v not in Boolean.valid_values]
        if bad:
            raise CastError(f"{bad} are not valid for {declared}; valid are {Boolean.valid_values}")
        new = values[there].astype(bool)
    elif isinstance(declared, Integer):
        numbers = pd.to_numeric(values[there]) if there.any() else values[there].astype(float)
        return (numbers // 1).astype("Int64").reindex(values.index)
    elif isinstance(declared, Decimal):
        new = values[there].astype(float).round(declared.scale)
    else:
        new = values[there].astype(_PANDAS[declared.name])
    if there.all():
        return new
    out = values.astype(object)
    out[there] = new.astype(object)
    return out.where(there, None) if isinstance(declared, Boolean) or declared.name in ("String", "Binary") else out
