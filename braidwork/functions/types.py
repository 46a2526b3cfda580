"""Logical column types, and the translation of date patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class DateFormat(Enum):
    PYTHON = "python"
    PYSPARK = "pyspark"


# Python's date symbols and Spark's pattern letters for them.
# %j has the year letters ("yyy") for parity; Spark's own day of year is D.
PYTHON_TO_SPARK = {
    "%A": "EEEE",
    "%B": "MMMM",
    "%H": "H",
    "%I": "h",
    "%M": "m",
    "%S": "s",
    "%Y": "yyyy",
    "%a": "E",
    "%b": "MMM",
    "%d": "dd",
    "%f": "SSSSSS",
    "%j": "yyy",
    "%m": "MM",
    "%p": "a",
    "%y": "yy",
    "%z": "z",
}
SPARK_TO_PYTHON = {v: k for k, v in PYTHON_TO_SPARK.items()}


def to_spark_pattern(pattern: str) -> str:
    """A strftime pattern in Spark's letters; other letters are quoted."""

    def one(m: re.Match) -> str:
        if m[0][0] != "%":
            return f"'{m[0]}'"
        if m[0] not in PYTHON_TO_SPARK:
            raise ValueError(f"date symbol {m[0]!r} is not supported")
        return PYTHON_TO_SPARK[m[0]]

    return re.sub(r"%.|[A-Za-z]+", one, pattern)


def to_python_pattern(pattern: str) -> str:
    """A Spark pattern as a strftime pattern."""

    def one(m: re.Match) -> str:
        if m[0][0] == "'":
            return m[0][1:-1]
        if m[0] not in SPARK_TO_PYTHON:
            raise ValueError(f"date symbol {m[0]!r} is not supported")
        return SPARK_TO_PYTHON[m[0]]

    return re.sub(r"'[^']*'|([A-Za-z])\1*", one, pattern)


class LogicalType:
    """A declared column type; ``spark`` is its physical type, None if values pass as they are."""

    spark: T.DataType | None = None

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def key(self) -> str:
        return self.name.lower()

    def __str__(self) -> str:
        return repr(self)

    def __repr__(self) -> str:
        return f"{self.name}()"

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.__dict__ == other.__dict__

    def __hash__(self) -> int:
        return hash((type(self), *sorted(self.__dict__.items())))


class Unknown(LogicalType):
    """Never converted."""


class Boolean(LogicalType):
    spark = T.BooleanType()
    valid_values = (True, False, 1, 0)


class Byte(LogicalType):
    spark = T.ByteType()


class Binary(LogicalType):
    spark = T.BinaryType()


class Short(LogicalType):
    spark = T.ShortType()


class Integer(LogicalType):
    spark = T.IntegerType()


class Long(LogicalType):
    spark = T.LongType()


class Float(LogicalType):
    spark = T.FloatType()


class Double(LogicalType):
    spark = T.DoubleType()


class String(LogicalType):
    spark = T.StringType()


@dataclass(eq=False, repr=False)
class Decimal(LogicalType):
    precision: int = 13
    scale: int = 2

    @property
    def spark(self) -> T.DataType:  # type: ignore[override]
        return T.DecimalType(self.precision, self.scale)

    def __repr__(self) -> str:
        return f"Decimal({self.precision}, {self.scale})"


@dataclass(eq=False, repr=False)
class Date(LogicalType):
    format: str = "yyyy-MM-dd"
    mode: DateFormat = field(default=DateFormat.PYSPARK)
    spark = T.DateType()

    @property
    def spark_format(self) -> str:
        return self.format if self.mode is DateFormat.PYSPARK else to_spark_pattern(self.format)

    @property
    def python_format(self) -> str:
        return self.format if self.mode is DateFormat.PYTHON else to_python_pattern(self.format)

    def __repr__(self) -> str:
        return f"{self.name}(format={self.format!r})"


@dataclass(eq=False, repr=False)
class DateTime(Date):
    format: str = "yyyy-MM-dd H:m:s"
    spark = T.TimestampType()


_BY_SPARK = {t.spark: t for t in (Boolean, Byte, Binary, Short, Integer, Long, Float, Double, String, Date, DateTime)}


def logical_type(data_type: T.DataType) -> LogicalType:
    """The logical type of a Spark type; Unknown for nested types, intervals and zone-free timestamps."""
    if isinstance(data_type, T.DecimalType):
        return Decimal(data_type.precision, data_type.scale)
    return _BY_SPARK.get(data_type, Unknown)()
