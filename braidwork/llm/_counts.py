"""Sums of fixed-size count vectors over all partitions of a table.

Each task counts into one dense vector and sends it in packed chunks; chunks
are added in two rounds, first within ``SPREAD`` groups of tasks, so that no
group grows with the number of tasks alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

KIND = "name string, chunk int, spread int, seen binary"
CHUNK = 1 << 13
SPREAD = 64


def _thin(part: np.ndarray) -> bytes:
    """The numbers in as few bytes each as hold them all, after that number of bytes."""
    width = 8 if part.min() < 0 else np.min_scalar_type(part.max()).itemsize
    return bytes([width]) + part.astype(f"u{width}" if width < 8 else np.int64).tobytes()


def _wide(thin: pa.Buffer | bytes) -> np.ndarray:
    width = memoryview(thin)[0]
    return np.frombuffer(thin, f"u{width}" if width < 8 else np.int64, offset=1).astype(np.int64)


def pack(name: str, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The chunks of a task's vector that are not all zero."""
    context = TaskContext.get()
    spread = (context.partitionId() if context else 0) % SPREAD
    for k in range(0, len(seen), CHUNK):
        part = seen[k : k + CHUNK].astype(np.int64)
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([k // CHUNK], pa.int32()), pa.array([spread], pa.int32()), pa.array([_thin(part)], pa.binary())], names=["name", "chunk", "spread", "seen"])


def _add(table: pa.Table) -> pa.Table:
    total = None
    for chunk in table["seen"].chunks:
        for x in chunk:
            part = _wide(x.as_buffer())
            total = part if total is None else total + part
    return pa.table({"name": table["name"][:1], "chunk": table["chunk"][:1], "spread": pa.array([0], pa.int32()), "seen": pa.array([_thin(total)], pa.binary())})


def total(rows: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The sum for each name; ``rows`` are made by :func:`pack`."""
    for keys in (["name", "chunk", "spread"], ["name", "chunk"]):
        rows = rows.groupBy(*keys).applyInArrow(_add, KIND)
    out: dict[str, np.ndarray] = {}
    sums = rows.select("name", "chunk", "seen").toArrow()  # at most ``size`` numbers a name, in one job
    for name, chunk, seen in zip(sums["name"].to_pylist(), sums["chunk"].to_pylist(), sums["seen"].to_pylist(), strict=True):
        at = chunk * CHUNK
        out.setdefault(name, np.zeros(size, np.int64))[at : at + CHUNK] = _wide(seen)
    return out
