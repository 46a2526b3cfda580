"""A registry of nodes with what a reader wants to know of each."""

from __future__ import annotations

import html
import inspect
import json
import os
import re
from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import get_config
from ..operators.cache import CacheMode
from ..plans.node import Node, NodeKind
from ..plans.plan import Plan, RunStatus


def _source(n: Node) -> tuple[str, str]:
    """Path from the working folder, and text, of the module that declares the node; empty in a notebook."""
    try:
        module = inspect.getmodule(n.function)
        return os.path.relpath(inspect.getfile(n.function)), inspect.getsource(module) if module else ""
    except (OSError, TypeError, ValueError):
        return "", ""


class Catalog:
    """Nodes registered with all that is upstream of them."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.nodes: dict[str, tuple[Node, Plan]] = {}
        self.successors: dict[str, list[str]] = defaultdict(list)

    def register_node(self, n: Node, expand_node_functions: bool = True, **settings: Any) -> None:
        if n.kind is NodeKind.NODE_FUNCTION and not expand_node_functions:
            raise RuntimeError(f"{n.name} is a node function: it can only be registered expanded")
        plan = Plan(n, **settings)
        self.plans[n.key] = plan
        for k in reversed(plan.order):
            self.nodes.setdefault(k, (plan.node(k), plan))
        for k in reversed(plan.order):
            for c in plan.consumers[k]:
                if c not in self.successors[k]:
                    self.successors[k].append(c)

    def record(self, key: str) -> dict[str, Any]:
        """What is known of one node."""
        n, plan = self.nodes[key]
        v = plan.vertices[key]
        path, text = _source(n)
        return {
            "nodeKey": n.key, "nodeType": n.type, "name": n.name, "description": n.description, "group": n.group,
            "tags": [{"id": t, "name": t} for t in n.tags], "filePath": path, "importCmd": f"from {n.function.__module__} import {n.name}",
            "predecessors": sorted(e.node.key for e in n.edges), "predecessorColumns": {e.node.key: list(e.columns or ()) for e in n.edges},
            "predecessorsStatic": sorted(e.node.key for e in n.edges if e.is_static), "successors": sorted(self.successors[key]),
            "output": [{"column": c.name, "type": c.type.name, "description": c.description} for c in (n.output_schema.columns if n.output_schema else ())],
            "sourceCode": text, "isActive": v.status is RunStatus.ACTIVE, "hasCache": n.cache is not None,
            "cacheIsDisabled": v.cache is None or v.cache.mode is CacheMode.DISABLE, "hasProvidedInput": v.status is RunStatus.PROVIDED_INPUT,
        }

    def get_nodes(self) -> list[dict[str, Any]]:
        return [self.record(k) for k in self.nodes]

    def get_groups(self) -> list[dict[str, Any]]:
        out: dict[str, list[str]] = defaultdict(list)
        for n, _ in self.nodes.values():
            if n.group:
                out[n.group].append(n.key)
        return [{"id": re.sub(r"\W+", "_", g.lower()), "name": g, "nodes": keys} for g, keys in out.items()]

    def get_tag_suggestions(self) -> list[dict[str, str]]:
        return [{"id": t, "name": t} for t in sorted({t for n, _ in self.nodes.values() for t in n.tags})]

    def get_count_box_defs(self) -> list[dict[str, Any]]:
        """Number of nodes, and of those with each tag that the configuration names."""
        tags = [t for t in (get_config("catalog_count_box_tags") or "").split(",") if t]
        return [{"label": "nodes", "count": len(self.nodes)}, *({"label": t, "count": sum(t in n.tags for n, _ in self.nodes.values())} for t in tags)]

    def search(self, words: str) -> list[str]:
        """Keys of the nodes whose name, description, columns and tags hold all the words, best first."""
        asked, found = words.lower().split(), []
        for k, (n, _) in self.nodes.items():
            columns = n.output_schema.get_column_names() if n.output_schema else []
            text = " ".join([n.name, n.description, *n.tags, *columns]).lower()
            if all(w in text for w in asked):
                found.append((-sum(w in n.name.lower() for w in asked), n.name, k))
        return [k for *_, k in sorted(found)]

    def code_template(self, key: str) -> str:
        """Source text with which to start a node like this one."""
        n, _ = self.nodes[key]
        down = ", ".join(e.node.name + (f".select({', '.join(map(repr, e.columns))})" if e.columns else "") for e in n.edges)
        columns = "".join(f"        Column({c.name!r}, {c.type!r}, {c.description!r}),\n" for c in (n.output_schema.columns if n.output_schema else ()))
        arguments = ", ".join(e.argument for e in n.edges)
        return f"@node(\n    type={n.type!r},\n    description={n.description!r},\n    tags={n.tags!r},\n    dependencies=[{down}],\n    output=Schema(\n{columns}    ),\n)\ndef {n.name}({arguments}):\n    raise NotImplementedError\n"

    def nodes_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r["nodeKey"], r["name"], r["nodeType"], r["description"], r["group"], sorted(t["id"] for t in r["tags"]), r["isActive"]) for r in self.get_nodes()]
        return spark.createDataFrame(rows, "key string, name string, type string, description string, group string, tags array<string>, active boolean")

    def edges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.node.key, n.key, list(e.columns or ()), e.is_static) for n, _ in self.nodes.values() for e in n.edges]
        return spark.createDataFrame(rows, "source string, destination string, columns array<string>, static boolean")

    def html(self, path: str | None = None) -> str:
        """A page without outside resources: a drawing of the graph and a table of the nodes."""
        plan = next(reversed(self.plans.values()))
        at = positions(plan)
        place = {k: (60 + 180 * (x - 1), 10 + 6 * y) for k, (x, y) in at.items()}
        lines = [f'<line x1="{place[e.node.key][0]}" y1="{place[e.node.key][1]}" x2="{place[k][0]}" y2="{place[k][1]}" stroke="#999"/>' for k in plan.order for e in plan.node(k).edges]
        dots = [f'<g><circle cx="{x}" cy="{y}" r="8" fill="{"#2a7" if plan.vertices[k].status is RunStatus.ACTIVE else "#bbb"}"/><text x="{x}" y="{y + 22}" text-anchor="middle" font-size="11">{html.escape(plan.node(k).name)}</text></g>' for k, (x, y) in place.items()]
        width = max((x for x, _ in place.values()), default=0) + 120
        rows = "".join(f"<tr><td>{html.escape(r['name'])}</td><td>{html.escape(r['nodeType'])}</td><td>{html.escape(r['description'])}</td><td>{html.escape(', '.join(t['id'] for t in r['tags']))}</td></tr>" for r in self.get_nodes())
        data = json.dumps({"nodes": self.get_nodes(), "groups": self.get_groups(), "tags": self.get_tag_suggestions()}).replace("</", "<\\/")
        page = f'<!doctype html><meta charset="utf-8"><title>Catalog</title><svg width="{width}" height="640">{"".join(lines)}{"".join(dots)}</svg><table><tr><th>name<th>type<th>description<th>tags</tr>{rows}</table><script type="application/json" id="catalog">{data}</script>'
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(page)
        return page


def positions(plan: Plan) -> dict[str, list[float]]:
    """Places for a drawing: across by depth, down at equal distances; even depths are raised so that lines do not overlap."""
    out = {}
    for depth, keys in plan.depths().items():
        gap = round(100 / (len(keys) + 1), 2)
        for k, key in enumerate(keys, 1):
            out[key] = [float(depth), k * gap - (0 if depth % 2 else 2.5)]
    return out


def graph_records(plan: Plan) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """Nodes with position, status and neighbours, and edges with their columns."""
    at = positions(plan)
    nodes = []
    for k in plan.order:
        v = plan.vertices[k]
        columns = [{"name": c.name, "type": c.type.name, "description": c.description} for c in (v.node.output_schema.columns if v.node.output_schema else ())]
        if not columns and v.node.kind is NodeKind.DATASOURCE:
            columns = [{"name": c, "type": None, "description": None} for c in v.requested or ()]
        nodes.append({"key": k, "name": v.node.name, "position": at[k], "active": v.status is RunStatus.ACTIVE, "run_status": v.status.value, "type": v.node.type, "node_type": v.node.kind.value, "dependencies": sorted(e.node.key for e in v.node.edges), "successors": sorted(plan.consumers[k]), "columns": columns})
    edges = [{"source": e.node.key, "target": k, "active": RunStatus.SKIP not in (plan.vertices[e.node.key].status, plan.vertices[k].status), "columns": list(e.columns or ())} for k in plan.order for e in plan.node(k).edges]
    return nodes, edges
