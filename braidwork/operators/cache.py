"""The cache protocol, and one node's cache during a run."""

from __future__ import annotations

from abc import ABC, abstractmethod
from datetime import datetime
from enum import Enum
from typing import Any


class CacheMode(Enum):
    """``DISABLE``: run the node, neither read nor write.  ``MERGE``: run it and merge its rows into the cache."""

    DISABLE = "disable"
    MERGE = "merge"


class Cache(ABC):
    """Storage of a node's result.

    The methods get the run's Spark session first if it has one.
    """

    @abstractmethod
    def read(self, *spark: Any, from_node: Any = None, to_node: Any = None, is_static: bool = False) -> Any:
        """The stored frame; with history, only what ``to_node`` has not had yet, unless ``is_static``."""

    @abstractmethod
    def write(self, *args: Any, upstream_nodes: list | None = None, to_node: Any = None, datetime_started_transformation: datetime | None = None) -> None:
        """Store a frame, the last positional argument."""

    @abstractmethod
    def exists(self, *spark: Any) -> bool:
        """Whether there is something to read."""

    def create_cdc_table(self, *spark: Any) -> None:  # noqa: B027
        """Prepare the ledger of changes, where there is one."""


class CacheContext:
    """A cache with its mode and session; ``exists`` is asked once a run."""

    def __init__(self, cache: Cache, spark: Any = None, mode: CacheMode | None = None):
        self.cache, self.mode = cache, mode
        self._args = () if spark is None else (spark,)
        self._there: bool | None = None

    @property
    def disabled(self) -> bool:
        return self.mode is CacheMode.DISABLE

    @property
    def merge(self) -> bool:
        return self.mode is CacheMode.MERGE

    def can_load(self) -> bool:
        """Whether the node's function is spared: only without a mode, and with a filled cache."""
        return self.mode is None and self.exists()

    def _usable(self) -> None:
        if self.disabled:
            raise RuntimeError("the cache is disabled in this run")

    def exists(self) -> bool:
        self._usable()
        if self._there is None:
            self._there = bool(self.cache.exists(*self._args))
        return self._there

    def read(self, from_node: Any = None, to_node: Any = None, is_static: bool = False) -> Any:
        self._usable()
        return self.cache.read(*self._args, from_node=from_node, to_node=to_node, is_static=is_static)

    def write(self, frame: Any, upstream_nodes: list, to_node: Any, started: datetime) -> None:
        if not self.disabled:
            self.cache.write(*self._args, frame, upstream_nodes=upstream_nodes, to_node=to_node, datetime_started_transformation=started)

    def create_cdc_table(self) -> None:
        if not self.disabled:
            self.cache.create_cdc_table(*self._args)
