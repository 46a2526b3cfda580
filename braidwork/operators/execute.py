"""Execution of a plan.

The unit of work is a node *for an owner*: the run's target, or a node that is
merged into its cache.  Rows that an owner has had already are left out where
its inputs are read from a cache, so a node without a cache can differ between
owners.  A node with a cache is worked out once a run.  Units start as soon as
their inputs are there; there is no barrier between levels.
"""

from __future__ import annotations

import contextvars
import logging
import uuid
from collections import defaultdict
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime, timezone
from typing import Any

from ..config import get_config
from ..log import get_logger
from ..plans.node import Edge, Node, PreprocessMode, default_preprocess
from ..plans.plan import Plan, RunStatus, Vertex
from .cache import CacheMode
from .frames import FrameKind, clone, conform, convert, frame_kind, select
from .merge import ParquetCache

log = logging.getLogger("braidwork")
Unit = tuple[str, str]  # node, owner


class Result:
    """A unit's frame, and what it became in other kinds."""

    def __init__(self, frame: Any, spark: Any, schema: Any = None):
        self.frames = {frame_kind(frame): frame}
        self.first, self.spark, self.schema = frame, spark, schema

    def as_kind(self, kind: FrameKind) -> Any:
        if kind not in self.frames:
            self.frames[kind] = convert(self.first, kind, self.spark, self.schema)
        return clone(self.frames[kind])

    def narrowed(self, columns: tuple[str, ...], kind: FrameKind) -> Any:
        """Some columns in another kind, selected first: what is not asked for is not moved."""
        if kind in self.frames:
            return select(clone(self.frames[kind]), columns)
        return convert(select(self.first, columns), kind, self.spark, self.schema)


class Run:
    """One run of a target.

    ``inputs`` maps nodes to frames that stand for their results; ``parameters``
    maps nodes to keyword arguments; ``cache`` maps nodes to a
    :class:`CacheMode`; ``preprocess`` is ``PreprocessMode.DISABLE``, or maps
    consumers to ``{dependency: PreprocessMode.DISABLE}``; ``max_workers`` units
    run at a time; ``pandas_on_spark_use_pandas`` runs pandas-on-Spark nodes in
    pandas; ``debug`` logs each step.
    """

    def __init__(
        self, target: Node, spark: Any = None, *, inputs: dict | None = None, parameters: dict | None = None, cache: dict | None = None, preprocess: Any = None,
        max_workers: int | None = None, pandas_on_spark_use_pandas: bool = False, debug: bool = False,
    ):
        self.spark, self.preprocess = spark, preprocess
        self.workers = max_workers or get_config("node_run_max_workers") or 1
        get_logger(debug)
        self.plan = Plan(target, spark=spark, inputs=inputs, parameters=parameters, cache=cache, pandas_on_spark_use_pandas=pandas_on_spark_use_pandas)
        self.results: dict[Unit, Result] = {}
        self.peak = 0
        self._provided = {k: Result(v, spark) for k, v in self.plan.inputs.items() if k in self.plan.vertices}

    # -- which units there are ------------------------------------------------

    def _unit(self, key: str, owner: str) -> Unit:
        """A node with a cache belongs to itself when merged, and to the target when filled."""
        v = self.plan.vertices[key]
        if v.cache is None or v.cache.disabled or v.status is not RunStatus.ACTIVE:
            return key, owner
        return key, key if v.cache.merge else self.plan.target.key

    def _units(self) -> dict[Unit, list[Unit]]:
        """Each unit with the units that it needs, inputs first."""
        first = self._unit(self.plan.target.key, self.plan.target.key)
        needs: dict[Unit, list[Unit]] = {}
        out: dict[Unit, list[Unit]] = {}
        stack: list[tuple[Unit, bool]] = [(first, False)]
        while stack:
            unit, leaving = stack.pop()
            if leaving:
                out[unit] = needs[unit]
            elif unit not in needs:
                v = self.plan.vertices[unit[0]]
                ups = [self._unit(e.node.key, unit[1]) for e in v.node.edges] if v.status is RunStatus.ACTIVE else []
                needs[unit] = [u for u in ups if self.plan.vertices[u[0]].status is RunStatus.ACTIVE]
                stack.append((unit, True))
                stack += [(u, False) for u in reversed(needs[unit])]
        return out

    # -- running --------------------------------------------------------------

    def result(self) -> Any:
        target = self.plan.vertices[self.plan.target.key]
        kind = FrameKind(target.frame_type)
        if target.status is RunStatus.PROVIDED_INPUT:
            return self._provided[target.node.key].as_kind(kind)
        if target.status is RunStatus.CACHED:
            frame = conform(target.cache.read(from_node=target.node, to_node=None), target.node.output_schema)
            return convert(frame, kind, self.spark, target.node.output_schema)
        for v in self.plan.vertices.values():
            if v.cache is not None and v.status is not RunStatus.SKIP:
                v.cache.create_cdc_table()
        units = self._units()
        last = next(reversed(units))
        users: dict[Unit, int] = defaultdict(int)
        for needs in units.values():
            for u in set(needs):
                users[u] += 1
        users[last] += 1

        def finish(unit: Unit) -> None:
            self.peak = max(self.peak, len(self.results))
            for u in set(units[unit]):
                users[u] -= 1
                if not users[u]:
                    self.results.pop(u, None)

        if self.workers == 1 or len(units) == 1:
            for unit in units:
                self._process(unit)
                finish(unit)
        else:
            self._parallel(units, finish)
        out = self.results.pop(last)
        self._provided.clear()
        return out.as_kind(kind)

    def _parallel(self, units: dict[Unit, list[Unit]], finish: Any) -> None:
        open_ = {u: len(set(needs)) for u, needs in units.items()}
        users: dict[Unit, list[Unit]] = defaultdict(list)
        for u, needs in units.items():
            for n in set(needs):
                users[n].append(u)
        with ThreadPoolExecutor(min(self.workers, len(units))) as pool:
            start = lambda u: pool.submit(contextvars.copy_context().run, self._process, u)
            running = {start(u): u for u, n in open_.items() if n == 0}
            while running:
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for f in done:
                    unit = running.pop(f)
                    try:
                        f.result()
                    except BaseException:
                        for other in running:
                            other.cancel()
                        raise
                    finish(unit)
                    for u in users[unit]:
                        open_[u] -= 1
                        if open_[u] == 0:
                            running[start(u)] = u

    def _process(self, unit: Unit) -> None:
        key, owner = unit
        v = self.plan.vertices[key]
        log.debug("running %s for %s", v.node.name, self.plan.node(owner).name)
        started = datetime.now(timezone.utc).replace(tzinfo=None)
        views: list[str] = []
        try:
            arguments = {e.argument: self._input(e, v, owner, views) for e in v.node.edges}
            frame = self._call(v, arguments)
        finally:
            for name in views:
                self.spark.catalog.dropTempView(name)
        self.results[unit] = Result(conform(frame, v.node.output_schema), self.spark, v.node.output_schema)
        if v.cache is not None and not v.cache.disabled:
            upstream = [self.plan.node(k) for k in self.plan.cached_predecessors(key)]
            v.cache.write(self.results[unit].first, upstream, v.node, started)
            if isinstance(v.cache.cache, ParquetCache):  # what was written is not worked out again
                self.results[unit] = Result(conform(v.cache.read(), v.node.output_schema), self.spark, v.node.output_schema)

    def _call(self, v: Vertex, arguments: dict[str, Any]) -> Any:
        n = v.node
        if n.spark_context:
            if self.spark is None:
                raise ValueError(f"{n.name} needs a Spark session")
            arguments["spark"] = self.spark
        if n.requested_columns:
            arguments["requested_columns"] = v.requested
        frame = n.function(**arguments | v.parameters)
        if n.type == "spark_sql":
            if self.spark is None:
                raise ValueError(f"{n.name} needs a Spark session")
            return self.spark.sql(frame)
        return frame

    # -- inputs ---------------------------------------------------------------

    def _source(self, e: Edge, owner: str) -> Result:
        """Provided, else from the cache, else from memory."""
        up = self.plan.vertices[e.node.key]
        if up.status is RunStatus.PROVIDED_INPUT:
            return self._provided[e.node.key]
        if up.cache is not None and not up.cache.disabled:
            frame = up.cache.read(from_node=up.node, to_node=self.plan.node(owner), is_static=e.is_static)
            return Result(conform(frame, up.node.output_schema), self.spark, up.node.output_schema)
        return self.results[e.node.key, owner]

    def _functions(self, e: Edge, consumer: Node) -> tuple:
        mode = self.preprocess
        if isinstance(mode, dict):
            mode = mode.get(consumer, {}).get(e.node)
        if PreprocessMode.DISABLE in (mode, e.functions):
            return ()
        return e.functions or default_preprocess()

    def _input(self, e: Edge, consumer: Vertex, owner: str, views: list[str]) -> Any:
        source = self._source(e, owner)
        kind = FrameKind(consumer.frame_type)
        functions = self._functions(e, consumer.node)
        if e.columns is not None and not functions:
            frame = source.narrowed(e.columns, kind)
        else:
            frame = source.as_kind(kind)
            for f in functions:
                frame = f(frame)
            if e.columns is not None:
                frame = select(frame, e.columns)
        if consumer.node.type != "spark_sql":
            return frame
        if self.spark is None:
            raise ValueError(f"{consumer.node.name} needs a Spark session")
        name = f"{consumer.node.name}__{e.argument}__{uuid.uuid4().hex[:12]}"
        frame.createOrReplaceTempView(name)
        views.append(name)
        return name


__all__ = ["CacheMode", "Result", "Run"]
