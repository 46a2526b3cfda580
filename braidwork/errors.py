"""Errors raised by the engine."""

from __future__ import annotations

from collections.abc import Sequence


class FrameKindError(TypeError):
    """A value is not a dataframe of a supported kind."""


class SchemaMismatchError(AssertionError):
    """Two frames differ in their columns or types."""


class DataMismatchError(AssertionError):
    """Two frames with equal schemas differ in their rows."""


class NoSelectedColumnsError(ValueError):
    """A selection names no column."""


class CastError(TypeError):
    """A column's type cannot be converted to the declared one."""


class CycleError(ValueError):
    """A node depends on itself."""


class DuplicateKeyError(ValueError):
    """Rows to merge repeat a merge key."""


class ConcurrentWriteError(RuntimeError):
    """Another writer has claimed the version that a merge was to write."""


class MissingColumnsError(Exception):
    """Columns that were asked for are not in a frame; says which, and what was probably meant."""

    def __init__(self, available: Sequence[str], wanted: Sequence[str]):
        self.available, self.wanted = list(available), list(wanted)
        lower = {c.lower(): c for c in available}
        rows = []
        for c in sorted(wanted):
            close = lower.get(c.lower(), "")
            rows.append((c if c in available else close, c, "found" if c in available else f"Did you mean `{close}`?" if close else "not found"))
        head = ("dataframe", "selection", "result")
        width = [max(len(r[k]) for r in [head, *rows]) for k in range(3)]
        line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
        table = "\n".join([line(head), "-+-".join("-" * w for w in width), *map(line, rows)])
        super().__init__(f"some columns are not in the dataframe\n\ncolumns: {self.available}\nselection: {self.wanted}\n\n{table}")
