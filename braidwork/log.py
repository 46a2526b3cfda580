"""The engine's logger."""

from __future__ import annotations

import logging
import sys

_COLORS = {logging.DEBUG: 36, logging.INFO: 32, logging.WARNING: 33, logging.ERROR: 31, logging.CRITICAL: 35}


class ColorFormatter(logging.Formatter):
    """Level in colour where the stream is a terminal."""

    def __init__(self, color: bool):
        super().__init__("%(asctime)s %(levelname)s %(name)s: %(message)s", "%H:%M:%S")
        self.color = color

    def format(self, record: logging.LogRecord) -> str:
        text = super().format(record)
        code = _COLORS.get(record.levelno)
        return text.replace(record.levelname, f"\033[{code}m{record.levelname}\033[0m", 1) if self.color and code else text


def get_logger(debug: bool = False) -> logging.Logger:
    """The logger ``braidwork``; with ``debug``, it also tells of each step on standard error."""
    logger = logging.getLogger("braidwork")
    if debug:
        logger.setLevel(logging.DEBUG)
        if not any(isinstance(h.formatter, ColorFormatter) for h in logger.handlers):
            handler = logging.StreamHandler()
            handler.setFormatter(ColorFormatter(sys.stderr.isatty()))
            logger.addHandler(handler)
    return logger
