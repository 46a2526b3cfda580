"""Options: a context manager comes before the environment, and that before the defaults."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

PREFIX = "BRAIDWORK_"
DEFAULTS: dict[str, Any] = {
    "catalog_count_box_tags": "bronze,silver,gold",
    "node_run_max_workers": 1,
    "require_node_description": False,
    "require_schema_description": False,
    "default_dependencies_preprocess_module": None,
    "default_dependencies_preprocess_function": None,
}
_active: ContextVar[tuple[dict[str, Any], ...]] = ContextVar("braidwork_config", default=())


def _known(name: str) -> None:
    if name not in DEFAULTS:
        raise KeyError(f"unknown option {name!r}; there are {', '.join(sorted(DEFAULTS))}")


def get_config(name: str) -> Any:
    """The value in force.  Options that a context leaves out fall through to the environment."""
    _known(name)
    for layer in reversed(_active.get()):
        if name in layer:
            return layer[name]
    text = os.environ.get(PREFIX + name.upper())
    if text is None:
        return DEFAULTS[name]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if isinstance(DEFAULTS[name], int) and not isinstance(DEFAULTS[name], bool) else text


@contextmanager
def config_context(**options: Any) -> Iterator[None]:
    """Options for a block of code, and for the runs and threads it starts."""
    for name in options:
        _known(name)
    token = _active.set((*_active.get(), options))
    try:
        yield
    finally:
        _active.reset(token)
