"""Schemas and relationships as DBML text, and as a diagram where a renderer is installed."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Iterable

from ..plans.node import Node
from ..plans.plan import ordered
from ..plans.schema import Cardinality

_ARROW = {Cardinality.MANY_TO_ONE: ">", Cardinality.ONE_TO_MANY: "<", Cardinality.MANY_TO_MANY: "<>", Cardinality.ONE_TO_ONE: "-"}


def _table_name(n: Node) -> str:
    return re.sub(r"[^a-z0-9_]", "_", n.name.lower())


def _table(n: Node, color: str | None) -> str:
    lines = []
    for c in n.output_schema.columns:  # type: ignore[union-attr]
        notes = ["pk"] * c.pk + ([f"note: '''{c.description}'''"] if c.description else [])
        lines.append(f"  {c.name} {str(c.type).replace(' ', '')}" + (f" [{', '.join(notes)}]" if notes else ""))
    note = f"Managed by node `{n.name}`" + (f"\n{n.description}" if n.description else "") + (f"\nTags: {', '.join(n.tags)}" if n.tags else "")
    head = f" [headercolor: {color}]" if color else ""
    return f"Table {_table_name(n)}{head} {{\n" + "\n".join(lines) + f"\n\n  Note: '''{note}'''\n}}\n"


def build_dbml(nodes: Node | Iterable[Node], *, only_nodes_with_tags: str | list[str] | None = None, only_nodes_with_cache: bool = False, colors: dict[str, str] | None = None, path: str | None = None) -> str | None:
    """Tables of the nodes, of all upstream of them and of all that their keys point at; None without any.

    ``colors`` maps tags to header colours.
    """
    tags = {only_nodes_with_tags} if isinstance(only_nodes_with_tags, str) else set(only_nodes_with_tags or ())
    todo = [nodes] if isinstance(nodes, Node) else list(nodes)
    found: dict[str, Node] = {}
    while todo:
        for n in ordered([todo.pop(0)], lambda x: x.edges):
            if n.key not in found:
                found[n.key] = n
                todo += [r.owner for c in (n.output_schema.columns if n.output_schema else ()) for r in c.relationships if r.owner is not None]
    shown = {k: n for k, n in found.items() if n.output_schema and (not tags or tags & set(n.tags)) and (n.cache is not None or not only_nodes_with_cache)}
    if not shown:
        return None
    parts = [_table(n, next((c for t, c in (colors or {}).items() if t in n.tags), None)) for n in sorted(shown.values(), key=_table_name)]
    for n in sorted(shown.values(), key=_table_name):
        for c in n.output_schema.columns:  # type: ignore[union-attr]
            for other, r in sorted(c.relationships.items(), key=lambda x: x[0].key):
                if other.owner is not None and other.owner.key in shown:
                    label = f" {r.description}" if r.description else ""
                    parts.append(f"Ref{label}: {_table_name(n)}.{c.name} {_ARROW[r.kind]} {_table_name(other.owner)}.{other.name}\n")
    text = "\n".join(parts)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def build_erd_svg(nodes: Node | Iterable[Node], path: str, **how: object) -> str:
    """Draw the DBML with the ``dbml-renderer`` program, if it is installed."""
    program = shutil.which("dbml-renderer")
    if program is None:
        raise RuntimeError("dbml-renderer is not installed")
    text = build_dbml(nodes, path=f"{path}.dbml", **how)  # type: ignore[arg-type]
    if text is None:
        raise ValueError("no node declares an output")
    subprocess.run([program, "-i", f"{path}.dbml", "-o", path], check=True)
    return path
