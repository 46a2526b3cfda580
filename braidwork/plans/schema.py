"""Declared output schemas, and documentation-only relationships between columns."""

from __future__ import annotations

import copy
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import types as T

from ..config import get_config
from ..functions.types import LogicalType, Unknown


class Cardinality(Enum):
    MANY_TO_ONE = "N:1"
    ONE_TO_MANY = "1:N"
    MANY_TO_MANY = "N:N"
    ONE_TO_ONE = "1:1"


@dataclass(frozen=True)
class Relationship:
    kind: Cardinality
    description: str | None = None


class View(Enum):
    """How a node's column was reached: as declared, to build other schemas, or to point at."""

    DECLARED = "declared"
    OUTPUT = "output"
    REF = "ref"


class Column:
    """A column of a node's output: name, type, description, primary-key flag, relationships."""

    def __init__(self, name: str, type: LogicalType, description: str = "", pk: bool = False):
        if not description and get_config("require_schema_description"):
            raise ValueError(f"column {name!r} needs a description")
        self.name, self.type, self.description, self.pk = name, type, description, pk
        self.owner: Any = None
        self.view = View.DECLARED
        self.relationships: dict[Column, Relationship] = {}

    @property
    def key(self) -> str:
        return f"{self.owner.key if self.owner else None}.{self.name}"

    def seen_as(self, view: View) -> Column:
        """A copy for ``node.output`` (bare) or ``node.ref`` (keeps the key flag)."""
        out = copy.copy(self)
        out.view, out.relationships = view, {}
        if view is View.OUTPUT:
            out.pk = False
        return out

    def set_pk(self, pk: bool = True) -> Column:
        self.pk = pk
        return self

    def _relate(self, other: Column, kind: Cardinality, description: str | None) -> Column:
        if other.view is View.OUTPUT:
            raise ValueError(f"{other.name}: point at columns with node.ref, not node.output")
        if any(x.key == other.key for x in self.relationships):
            raise ValueError(f"{self.name} already has a relationship to {other.key}")
        self.relationships[other] = Relationship(kind, description)
        return self

    def many_to_one(self, other: Column, description: str | None = None) -> Column:
        return self._relate(other, Cardinality.MANY_TO_ONE, description)

    def one_to_many(self, other: Column, description: str | None = None) -> Column:
        return self._relate(other, Cardinality.ONE_TO_MANY, description)

    def many_to_many(self, other: Column, description: str | None = None) -> Column:
        return self._relate(other, Cardinality.MANY_TO_MANY, description)

    def one_to_one(self, other: Column, description: str | None = None) -> Column:
        return self._relate(other, Cardinality.ONE_TO_ONE, description)

    def get_foreign_key(self, other: Column) -> Relationship:
        return next(r for c, r in self.relationships.items() if c.key == other.key)

    def _facts(self) -> tuple:
        related = sorted((c.key, r.kind.value, r.description or "") for c, r in self.relationships.items())
        return self.name, self.owner.key if self.owner else None, type(self.type), self.description, self.pk, tuple(related)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Column) and self._facts() == other._facts()

    def __hash__(self) -> int:
        return hash((self.name, self.owner.key if self.owner else None))

    def __repr__(self) -> str:
        return f"Column({self.name!r}, {self.type!r}{', pk=True' if self.pk else ''})"


class Schema:
    """An ordered set of columns, each also an attribute."""

    def __init__(self, *columns: Column | list[Column]):
        flat = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]
        if not flat:
            raise IndexError("a schema needs a column")
        for c in flat:
            if c.view is View.REF:
                raise ValueError(f"{c.name}: build schemas from node.output, not node.ref")
        self.columns = [copy.copy(c) for c in flat]
        for c in self.columns:
            c.view, c.relationships = View.DECLARED, dict(c.relationships)
            setattr(self, c.name, c)

    def owned_by(self, node: Any) -> Schema:
        out = Schema(*self.columns)
        for c in out.columns:
            c.owner = node
        return out

    def seen_as(self, view: View) -> Schema:
        out = copy.copy(self)
        out.columns = [c.seen_as(view) for c in self.columns]
        for c in out.columns:
            setattr(out, c.name, c)
        return out

    def get(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def get_column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def copy(self) -> Schema:
        return Schema(*self.columns)

    def reset(self) -> Schema:
        """Without key flags and relationships."""
        for c in self.columns:
            c.pk, c.relationships = False, {}
        return self

    def struct(self) -> T.StructType:
        """Spark's form; the documentation goes to the fields' metadata."""
        return T.StructType([T.StructField(c.name, c.type.spark or T.StringType(), True, {"comment": c.description, "pk": c.pk, "logical_type": repr(c.type)}) for c in self.columns])

    def typed(self) -> bool:
        return not any(isinstance(c.type, Unknown) for c in self.columns)

    def __eq__(self, other: object) -> bool:
        by_name = lambda s: sorted(s.columns, key=lambda c: c.name)
        return isinstance(other, Schema) and by_name(self) == by_name(other)

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return f"Schema({self.columns})"
