"""Nodes, the edges between them, and node functions.

Declarations never change during a run: everything a run decides lives in its
:class:`~braidwork.plans.plan.Plan`.
"""

from __future__ import annotations

import importlib
import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from ..config import get_config
from .schema import Schema, View

log = logging.getLogger("braidwork")


class NodeKind(Enum):
    DATASOURCE = "datasource"
    TRANSFORMATION = "transformation"
    NODE_FUNCTION = "node_function"


class PreprocessMode(Enum):
    DISABLE = "disable"


FRAME_TYPES = ("pandas", "pyspark", "pandas_on_spark", "spark_sql")


def _functions(given: tuple) -> tuple | PreprocessMode:
    flat = [f for x in given for f in (x if isinstance(x, (list, tuple)) else [x])]
    if flat == [PreprocessMode.DISABLE]:
        return PreprocessMode.DISABLE
    if not flat or not all(callable(f) for f in flat):
        raise ValueError("preprocess takes functions of a dataframe, or PreprocessMode.DISABLE")
    return tuple(flat)


def default_preprocess() -> tuple:
    """The configured function for edges that declare none."""
    module, name = get_config("default_dependencies_preprocess_module"), get_config("default_dependencies_preprocess_function")
    if not (module and name):
        return ()
    try:
        return (getattr(importlib.import_module(module), name),)
    except (ImportError, AttributeError) as e:
        log.warning("the default preprocess function %s.%s is not used: %s", module, name, e)
        return ()


@dataclass(frozen=True)
class Edge:
    """What a consumer takes of a node, and how."""

    node: Node
    columns: tuple[str, ...] | None = None
    name: str | None = None
    functions: tuple | PreprocessMode = ()
    is_static: bool = False

    def select(self, *columns: str | list[str]) -> Edge:
        flat = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]
        if len(set(flat)) != len(flat):
            raise ValueError(f"columns are selected twice: {sorted({c for c in flat if flat.count(c) > 1})}")
        return replace(self, columns=tuple(sorted(flat)))

    def alias(self, name: str) -> Edge:
        return replace(self, name=name)

    def preprocess(self, *functions: Any) -> Edge:
        return replace(self, functions=_functions(functions))

    def static(self) -> Edge:
        """Read the whole cache, whatever was processed before."""
        return replace(self, is_static=True)

    @property
    def argument(self) -> str:
        return self.name or re.sub(r"[<>]", "", self.node.name.replace(".", "_"))


class Linkable:
    """Edge builders of nodes and node functions."""

    def select(self, *columns: str | list[str]) -> Edge:
        return Edge(self).select(*columns)

    def alias(self, name: str) -> Edge:
        return Edge(self).alias(name)

    def preprocess(self, *functions: Any) -> Edge:
        return Edge(self).preprocess(*functions)

    def static(self) -> Edge:
        return Edge(self).static()


def edges_to(dependencies: Iterable[Any] | None) -> tuple[Edge, ...]:
    out: list[Edge] = []
    for x in dependencies or ():
        edge = x if isinstance(x, Edge) else Edge(x) if isinstance(x, Linkable) else None
        if edge is None:
            raise ValueError(f"{x!r} is not a node")
        if any(e.node.key == edge.node.key for e in out):
            raise ValueError(f"{edge.node.name} is a dependency twice")
        if any(e.argument == edge.argument for e in out):
            raise ValueError(f"two dependencies are named {edge.argument!r}")
        out.append(edge)
    return tuple(out)


def _key_of(function: Callable) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", f"{function.__module__}.{type(function).__name__}.{function.__name__}.{function.__qualname__}")


class Node(Linkable):
    """A function that returns one dataframe (or the text of a query), and what it needs."""

    def __init__(
        self, function: Callable, type: str, *, description: str | None = None, group: str | None = None, tags: Iterable[str] | None = None,
        dependencies: Iterable[Any] | None = None, output: Schema | None = None, spark_context: bool = False,
        requested_columns: bool = False, cache: Any = None, kind: NodeKind = NodeKind.TRANSFORMATION, key: str | None = None, name: str | None = None,
    ):
        from ..operators.cache import Cache

        if type not in FRAME_TYPES:
            raise ValueError(f"type is {type!r}; it must be one of {', '.join(FRAME_TYPES)}")
        if cache is not None and not isinstance(cache, Cache):
            raise TypeError(f"cache must be a Cache, not {cache.__class__.__name__}")
        text = description or (function.__doc__ or "").strip()
        if not text and get_config("require_node_description"):
            raise ValueError(f"node {function.__name__} needs a description")
        self.function, self.type, self.description, self.group = function, type, text, group
        self.tags, self.edges = list(tags or ()), edges_to(dependencies)
        self.spark_context, self.requested_columns, self.cache, self.kind = spark_context, requested_columns, cache, kind
        self.key, self.name = key or _key_of(function), name or function.__name__
        self.output_schema = output.owned_by(self) if output is not None else None

    @property
    def frame_type(self) -> str:
        return "pyspark" if self.type == "spark_sql" else self.type

    @property
    def output(self) -> Schema:
        """Columns to build other schemas from: no keys, no relationships."""
        return self._schema().seen_as(View.OUTPUT)

    @property
    def ref(self) -> Schema:
        """Columns to point relationships at."""
        return self._schema().seen_as(View.REF)

    def _schema(self) -> Schema:
        if self.output_schema is None:
            raise ValueError(f"{self.name} declares no output")
        return self.output_schema

    @property
    def __module__(self) -> str:  # type: ignore[override]
        return self.function.__module__

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        return self.function(*args, **kwargs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Linkable) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)

    def __repr__(self) -> str:
        return f"<{self.__class__.__name__} {self.name}>"

    def renamed(self, key: str, name: str, output: Schema | None) -> Node:
        """This node in the place of a node function."""
        out = Node.__new__(Node)
        out.__dict__.update(self.__dict__, key=key, name=name)
        if output is not None:
            out.output_schema = output.owned_by(out)
        return out

    def run(self, spark: Any = None, **settings: Any) -> Any:
        """The node's dataframe; see :class:`braidwork.operators.execute.Run` for the settings."""
        from ..operators.execute import Run

        return Run(self, spark, **settings).result()

    def html(self, path: str | None = None, **settings: Any) -> str:
        """A page with the node's graph."""
        from ..lineage.catalog import Catalog

        catalog = Catalog()
        catalog.register_node(self, **settings)
        return catalog.html(path)


class NodeFunction(Node):
    """A function that returns nodes; the plan puts them in its place.

    The last node it returns stands for the function itself.  Only declared
    dependencies may be used from outside, and each must be used.
    """

    def __init__(self, function: Callable, *, dependencies: Iterable[Any] | None = None, output: Schema | None = None, requested_columns: bool = False, spark_context: bool = False, **rest: Any):
        listed = list(dependencies or ())
        if not all(isinstance(d, Linkable) for d in listed):
            raise ValueError("a node function depends on nodes, without selection or alias")
        super().__init__(function, "pyspark", dependencies=listed, output=output, requested_columns=requested_columns, spark_context=spark_context, kind=NodeKind.NODE_FUNCTION, **rest)

    def expand(self, requested: list[str] | None, parameters: dict[str, Any]) -> list[Node]:
        """The nodes, the last one under this function's key and name."""
        given = dict(parameters)
        if self.requested_columns:
            given["requested_columns"] = requested
        nodes = self.function(**given)
        nodes = [nodes] if isinstance(nodes, Node) else list(nodes)
        if not nodes or any(isinstance(n, NodeFunction) or not isinstance(n, Node) for n in nodes):
            raise ValueError(f"{self.name} must return nodes, and no node functions")
        inner, declared = {n.key for n in nodes}, {e.node.key for e in self.edges}
        used = {e.node.key for n in nodes for e in n.edges} - inner
        if used - declared:
            raise ValueError(f"{self.name} uses nodes that it does not declare: {sorted(used - declared)}")
        if declared - used:
            raise ValueError(f"{self.name} declares dependencies that it does not use: {sorted(declared - used)}")
        end = nodes[-1]
        if self.output_schema is not None and end.output_schema is not None and self.output_schema.get_column_names() != end.output_schema.get_column_names():
            raise ValueError(f"{self.name} and its last node declare different outputs")
        return [*nodes[:-1], end.renamed(self.key, self.name, self.output_schema)]


def node(type: str, **settings: Any) -> Callable[[Callable], Node]:
    """Decorator: the function becomes a node of the given type."""
    return lambda function: Node(function, type, **settings)


def node_function(**settings: Any) -> Callable[[Callable], NodeFunction]:
    """Decorator: the function becomes a node function."""
    return lambda function: NodeFunction(function, **settings)
